"""Words of many texts at once, for models that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Characters of the texts that are taken apart together; a longer text stands alone.
CHUNK_CHARS = 3_000_000
#: The same for models that make many arrays of a word each: some 10 MB of them at once.
SMALL_CHUNK_CHARS = 500_000
#: Rows of an Arrow column that are Python strings at once.
_READ_ROWS = 64


class Texts:
    """Texts of an Arrow column, null as empty; they are made Python strings a few at a time, as they are read."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __iter__(self) -> Iterator[str]:
        for at in range(0, len(self.column), _READ_ROWS):
            for text in self.column.slice(at, _READ_ROWS).to_pylist():
                yield text or ""


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of up to ``limit`` characters, each with its first position; null reads as empty."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = at, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def coded_words(texts: list[str], split: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, a code for each word in order, and the distinct words by code."""
    counts, words = np.zeros(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        own = split(text)
        counts[i] = len(own)
        words += own
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return counts, codes, distinct


def sums_by_text(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the words' values for each text, 0 for a text without words."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
