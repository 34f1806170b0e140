"""Periodic runs of words: stretches that repeat their first words over and over.

A run of period q and at least four periods has a block of ``L`` words inside, ``q <= L <
2q``, that starts at a multiple of ``L / 2``; the block's next occurrence is ``q`` words on,
the two being the first of a progression, and none stands between. So every block of a
dyadic length asks for its next occurrence in the window behind it, by the range successor
of a wavelet tree over the suffix array: the least position past the block's own among the
suffixes that start with the block. The distances found are the candidate periods; the
stretch around each is then measured word by word.

Many texts share one suffix array, each with words of its own, so that no text sees
another. Only suffixes whose first ``BASE`` words recur in their text are kept: no block
occurs anywhere else.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.common import table
from veilspark.llm.words import chunks

#: The shortest blocks, in words; they find all periods up to this.
BASE = 4
#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


class WaveletTree:
    """Range successor over a permutation of ``0 .. n-1``, level by level from the top bit, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        self.n_zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            one = (values >> level) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - one))).astype(np.int32))
            self.n_zeros.append(int(self.zeros[-1][-1]))
            values = np.concatenate((values[one == 0], values[one == 1]))

    def _below(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of the values from place ``lo`` to before ``hi`` are less than ``limit``."""
        count = np.zeros(len(lo), dtype=np.int64)
        for level, zeros, n_zeros in zip(range(self.bits - 1, -1, -1), self.zeros, self.n_zeros, strict=True):
            one = ((limit >> level) & 1).astype(bool)
            lo0, hi0 = zeros[lo], zeros[hi]
            count += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, lo - lo0 + n_zeros, lo0), np.where(one, hi - hi0 + n_zeros, hi0)
        return count

    def _ranked(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of this rank (from 0) among those from place ``lo`` to before ``hi``."""
        value = np.zeros(len(lo), dtype=np.int64)
        for level, zeros, n_zeros in zip(range(self.bits - 1, -1, -1), self.zeros, self.n_zeros, strict=True):
            lo0, hi0 = zeros[lo], zeros[hi]
            one = rank >= hi0 - lo0
            value |= one.astype(np.int64) << level
            rank = np.where(one, rank - (hi0 - lo0), rank)
            lo, hi = np.where(one, lo - lo0 + n_zeros, lo0), np.where(one, hi - hi0 + n_zeros, hi0)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least value of at least ``least`` (below ``n``) from place ``lo`` to before ``hi``; -1 where there is none."""
        before = self._below(lo, hi, least)
        out = np.full(len(lo), -1, dtype=np.int64)
        some = before < hi - lo
        out[some] = self._ranked(lo[some], hi[some], before[some])
        return out


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how many keys are less, and how many are equal."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    less, equal = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
    less[order], equal[order] = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    return less, equal


def recurring(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose first ``BASE`` words occur more than once, and the class of those words for each.

    ``codes`` are the words of all texts, a text's own; ``ends`` is for each where its text ends.
    """
    names, width = codes, 1
    while width < BASE:
        shifted = np.append(names, np.zeros(width, dtype=np.int64))[width:]
        names = pd.factorize(names * (int(names.max(initial=0)) + 1) + shifted)[0].astype(np.int64)
        width *= 2
    whole = np.flatnonzero(np.arange(len(codes)) + BASE <= ends)
    often = np.bincount(names[whole], minlength=1)[names[whole]] > 1 if len(whole) else np.zeros(0, dtype=bool)
    return whole[often], names[whole[often]]


def candidate_periods(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks that occur again within their length: position, length, and distance of the next occurrence."""
    nothing = np.zeros(0, dtype=np.int64)
    at, names = recurring(codes, ends)
    if not len(at):
        return nothing, nothing, nothing
    n, m = len(codes), len(at)
    where = np.full(n + 1, -1, dtype=np.int64)
    where[at] = np.arange(m)
    less, equal = _classes(names)
    asked, width = [], BASE
    open_ = np.arange(m)
    while len(open_):
        own = open_[(at[open_] - starts[at[open_]]) % (width // 2) == 0]
        asked.append((own, less[own], less[own] + equal[own], np.full(len(own), width)))
        # Suffixes of a class are told apart by what follows; nothing that recurs follows at the end of a text.
        after = at[open_] + width
        inside = after < ends[at[open_]]
        place = np.where(inside, where[np.minimum(after, n)], -1)
        nxt = np.where(place >= 0, less[np.maximum(place, 0)], m + open_)
        local, size = _classes(less[open_] * (2 * m + 1) + nxt)
        first = np.full(m, len(open_), dtype=np.int64)
        np.minimum.at(first, less[open_], local)
        fresh = less[open_] + local - first[less[open_]]
        less[open_], equal[open_] = fresh, size
        open_ = open_[size > 1]
        width *= 2
    suffixes = np.empty(m, dtype=np.int64)
    suffixes[less] = np.arange(m)
    tree = WaveletTree(suffixes)
    own, lo, hi, length = (np.concatenate(x) for x in zip(*asked, strict=True))
    later = own + 1 < m
    own, lo, hi, length = own[later], lo[later], hi[later], length[later]
    found = tree.successor(lo, hi, own + 1)
    distance = at[np.maximum(found, 0)] - at[own]
    # Longer distances belong to longer blocks, shorter ones to shorter blocks.
    near = (found >= 0) & (distance <= length) & ((length == BASE) | (2 * distance > length))
    return at[own[near]], length[near], distance[near]


def _reach(codes: np.ndarray, at: int, period: int, stop: int, step: int) -> int:
    """From ``at`` on in steps of ``step`` (1 or -1), the first place where the words a period apart differ; at most ``stop``."""
    width = 64
    while at != stop:
        to = min(at + width, stop) if step > 0 else max(at - width, stop)
        lo, hi = (at, to) if step > 0 else (to + 1, at + 1)
        differ = np.flatnonzero(codes[lo:hi] != codes[lo + period : hi + period])
        if len(differ):
            return int(lo + (differ[0] if step > 0 else differ[-1]))
        at, width = to, width * 2
    return stop


def runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period.

    ``starts`` and ``ends`` are for each word where its text starts and ends; texts have no
    word in common.
    """
    at, length, period = candidate_periods(codes, starts, ends)
    found = []
    order = np.lexsort((at, period))
    covered, last = -1, -1
    for i, n, p in zip(at[order].tolist(), length[order].tolist(), period[order].tolist(), strict=True):
        if p == last and i < covered:
            continue  # in the stretch that an earlier block of this period has measured
        lo = _reach(codes, i, p, int(starts[i]) - 1, -1) + 1
        hi = _reach(codes, i + n, p, int(ends[i]) - p, 1)
        covered, last = hi, p
        if hi + p - lo >= max(LEAST_WORDS, LEAST_PERIODS * p):
            found.append((lo, hi + p - lo, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list, doc_id: int | None) -> list:
    """The words, periodic from some place on if the id's hash says so; a null id changes nothing."""
    h = zlib.crc32(str(int(doc_id)).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digest(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """Number of runs, the most periodic one, and digests of the runs and of the words without repeats."""
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    if not found:
        return 0, None, None, None, None, _hex(b""), _hex(b" ".join(words))
    start, length, period = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, p in found:
        edges[s + p] += 1
        edges[s + n] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    text = b" ".join([words[k] for k in kept.tolist()])
    return len(found), start, length, period, 1000 * length // period, _hex(listed.encode()), _hex(text)


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, in its own word numbers."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    words = np.array([w for t in texts for w in t] + [None], dtype=object)[:-1]
    codes = pd.factorize(words)[0].astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    codes = pd.factorize(of * (int(codes.max(initial=0)) + 1) + codes)[0].astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs(codes, bounds[of], bounds[of + 1]):
        text = int(of[start])
        out[text].append((start - int(bounds[text]), length, period))
    return out


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` for each row of ``docs``.

    A run is a stretch of words with smallest period ``period``, at least six words and four
    periods long, that goes on no further to either side. The one with the most periods is
    given (then the first, then the one with the least period). The digests are of
    ``start,length,period`` lines of all runs, and of the text without words that any run
    has after its first period, joined by single spaces.

    Null texts count as empty ones, which have no run; repeated rows and null ids stay;
    columns beside ``doc_id`` and ``text`` are neither read nor returned; an empty table
    gives no rows. A text is worked on whole, at some 200 bytes for each of its words.
    With ``plant``, texts are made periodic as ``planted`` says, before anything else.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for first, held in chunks(batch["text"]):
                words = [t.encode("utf-8", "surrogatepass").split() for t in held]
                own = ids[first : first + len(held)]
                if plant:
                    words = [planted(w, i) for w, i in zip(words, own, strict=True)]
                rows = [(i, *digest(w, r)) for i, w, r in zip(own, words, runs_of_texts(words), strict=True)]
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                yield frame.astype({c: "Int64" for c in frame.columns[:6]})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(found, SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
