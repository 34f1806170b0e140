"""Quality by a factorisation machine.

A text is a vector of hashed words (square roots of their shares, so that the words of
a text have length one), structure statistics and metadata. The machine gives every
coordinate a weight and a short factor; all pairwise interactions are summed in linear
time by ``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.
"""

from __future__ import annotations

import pickle
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import held_out, table
from veilspark.llm.labelled import FOLDS, HELD_OUT, labelled_texts
from veilspark.llm.words import SMALL_CHUNK_CHARS, Texts, chunks, coded_words

#: Labelled rows that are learned from, at most: with 4,096 buckets some 200 MB in one task in the worst case.
MAX_LABELLED = 12_000
BUCKETS = 4096
FACTORS = 8
EPOCHS = 12
BATCH = 256
THRESHOLD = 0.3
_KINDS = 8


def _kind(code: int) -> int:
    """Kind of a character: other, lower, upper, digit, blank, line end, sentence mark, symbol."""
    c = chr(code)
    if c in "\n\r":
        return 5
    if c.isspace():
        return 4
    if c in ".,;:!?'\"-()":
        return 6
    group = unicodedata.category(c)
    return {"Ll": 1, "Lu": 2, "Lt": 2, "Nd": 3}.get(group, 7 if group[0] in "PSC" else 0)


_KIND_OF = np.array([_kind(code) for code in range(0x10000)], dtype=np.int64)
#: Shares of the kinds of characters, then what ``structure`` adds, then the length as metadata.
DENSE = _KINDS + 8


def _words(text: str) -> list[str]:
    return text.lower().split()


def structure(texts: list[str], counts: np.ndarray, codes: np.ndarray, cells: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Structure statistics of each text; ``cells`` has the text and the count of each of its distinct words."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _KIND_OF[np.minimum(letters, 0xFFFF)]
    shares = np.bincount(np.repeat(np.arange(n), sizes) * _KINDS + kinds, minlength=n * _KINDS).reshape(n, _KINDS)
    some, chars = np.maximum(counts, 1), np.maximum(sizes, 1)
    owner = np.repeat(np.arange(n), counts)
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    most = np.zeros(n)
    np.maximum.at(most, cells[0], cells[1])
    lines = [text.split("\n") for text in texts]
    repeated = [1 - len(set(own)) / len(own) for own in lines]
    return np.column_stack([
        shares / chars[:, None],
        np.log1p(counts),
        np.log1p(sizes / some),
        np.bincount(cells[0], minlength=n) / some,
        np.bincount(owner[again], minlength=n) / some,
        most / some,
        np.log1p([len(own) for own in lines]),
        repeated,
    ])


def vectors(texts: pd.Series | Texts, n_chars: pd.Series) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: their place, text / bucket / value of every hashed word, and the dense statistics.

    ``n_chars`` is metadata; where it is null the length of the text stands for it.
    """
    for first, held in chunks(texts, SMALL_CHUNK_CHARS):
        counts, codes, distinct = coded_words(held, _words)
        buckets = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in distinct), np.int64, len(distinct))
        owner = np.repeat(np.arange(len(held)), counts)
        word, n_word = np.unique(owner * max(1, len(distinct)) + codes, return_counts=True)
        cells = word // max(1, len(distinct)), n_word
        dense = structure(held, counts, codes, cells)
        sizes = np.fromiter(map(len, held), dtype=np.float64, count=len(held))
        at = slice(first, first + len(held))
        stated = n_chars.iloc[at].to_numpy(dtype=np.float64, na_value=np.nan)
        stated = np.log1p(np.maximum(np.where(np.isnan(stated), sizes, stated), 0))
        cell, back = np.unique(cells[0] * BUCKETS + buckets[word % max(1, len(distinct))], return_inverse=True)
        share = np.bincount(back, weights=n_word, minlength=len(cell)) / np.maximum(counts, 1)[cell // BUCKETS]
        yield at, cell // BUCKETS, cell % BUCKETS, np.sqrt(share), np.column_stack([dense, stated])


class FactorisationMachine:
    """Weights and factors of hashed words and dense statistics; some 150 kB whatever it has learned from."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.mean, self.spread, self.bias, self.weights, self.factors = mean, spread, bias, weights, factors

    def score(self, texts: pd.Series | Texts, n_chars: pd.Series) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, text, bucket, value, dense in vectors(texts, n_chars):
            n = at.stop - at.start
            x = scaled(dense, self.mean, self.spread)
            linear = self.bias + x @ self.weights[BUCKETS:] + np.bincount(text, weights=value * self.weights[bucket], minlength=n)
            pairs = np.zeros(n)
            for v in self.factors.T:
                once = x @ v[BUCKETS:] + np.bincount(text, weights=value * v[bucket], minlength=n)
                twice = (x * x) @ (v[BUCKETS:] ** 2) + np.bincount(text, weights=(value * v[bucket]) ** 2, minlength=n)
                pairs += once**2 - twice
            out[at] = 1 / (1 + np.exp(-np.clip(linear + pairs / 2, -30, 30)))
        return out


def scaled(dense: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised, and within four deviations, so that no single statistic runs away."""
    return np.clip((dense - mean) / spread, -4, 4) / 2


def learn(rows: pd.DataFrame, epochs: int = EPOCHS, seed: int = 1) -> FactorisationMachine:
    """Fits the machine to ``buckets, values`` (uint16 and float16 bytes), ``dense`` and ``label`` by AdaGrad on log loss."""
    dense = np.stack([np.frombuffer(d, dtype=np.float64) for d in rows["dense"]])
    label = rows["label"].to_numpy(dtype=np.float64)
    mean, spread = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    x_dense = scaled(dense, mean, spread)
    buckets = [np.frombuffer(b, dtype=np.uint16) for b in rows["buckets"]]
    values = [np.frombuffer(v, dtype=np.float16) for v in rows["values"]]
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    bias, width = float(np.log(share / (1 - share))), BUCKETS + DENSE
    random = np.random.default_rng(seed)
    weights, factors = np.zeros(width), random.normal(0, 0.05, (width, FACTORS))
    decay = np.where(np.arange(width) < BUCKETS, 1e-3, 1e-4)
    past = [1e-8, np.full(width, 1e-8), np.full((width, FACTORS), 1e-8)]
    for epoch in range(epochs):
        rate = 0.1 / (1 + 0.2 * epoch)
        order = random.permutation(len(label))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            x = np.zeros((len(own), width))
            for i, row in enumerate(own):
                x[i, buckets[row]] = values[row]
            x[:, BUCKETS:] = x_dense[own]
            once = x @ factors
            margin = bias + x @ weights + ((once**2).sum(axis=1) - (x * x) @ (factors**2).sum(axis=1)) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[own]) / len(own)
            d_weights = x.T @ error + decay * weights
            d_factors = x.T @ (error[:, None] * once) - ((x * x).T @ error)[:, None] * factors + decay[:, None] * factors
            d_bias = error.sum()
            past[0] += d_bias**2
            past[1] += d_weights**2
            past[2] += d_factors**2
            bias -= rate * d_bias / np.sqrt(past[0])
            weights -= rate * d_weights / np.sqrt(past[1])
            factors -= rate * d_factors / np.sqrt(past[2])
    return FactorisationMachine(mean, spread, bias, weights, factors)


def stated_chars(docs: DataFrame) -> Column:
    """The stated length; null where the column isn't there or isn't a number."""
    kinds = dict(docs.dtypes)
    usable = kinds.get("n_chars") in ("tinyint", "smallint", "int", "bigint", "float", "double")
    return (docs["n_chars"] if usable else F.lit(None)).cast("double")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> FactorisationMachine | None:
    """Learns from up to ``limit`` labelled rows outside the held-out part; None without any.

    Vectors are made on the executors, four bytes for each distinct bucket of a text; those
    of the bounded sample are fitted by one task, and only the machine comes to the driver.
    """
    plain = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), stated_chars(docs).alias("n"))
    rows = labelled_texts(plain, labels, label, limit)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for at, text, bucket, value, dense in vectors(batch["text"], batch["n"]):
                cuts = np.searchsorted(text, np.arange(at.stop - at.start + 1))
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    found.append((bucket[a:b].astype(np.uint16).tobytes(), value[a:b].astype(np.float16).tobytes(), dense[i].tobytes()))
            yield pd.DataFrame(found, columns=["buckets", "values", "dense"]).assign(label=batch["label"].to_numpy())

    def fitted(found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"machine": [pickle.dumps(learn(found))]})

    found = rows.mapInPandas(features, "buckets binary, values binary, dense binary, label int")
    made = found.groupBy().applyInPandas(fitted, "machine binary").first()
    return pickle.loads(bytes(made["machine"])) if made else None


def quality_score(text: Column, n_chars: Column, model: Broadcast) -> Column:
    """Score from 0 to 1 of a text column and its stated length; null scores as empty text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array(model.value.score(Texts(texts), sizes.to_pandas()) if model.value else np.ones(len(texts)), pa.float64())

    return score(text, n_chars)


def score_quality(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id, text`` and, if there, ``n_chars``).

    Null texts score as empty ones, which have structure statistics of zero. Repeated rows
    and null ids stay; other columns, labels among them, are neither read nor returned.
    Without a labelled row every score is 1. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, limit=limit))
    scored = docs.select(
        "doc_id",
        held_out(docs["doc_id"], FOLDS, HELD_OUT).alias("held_out"),
        quality_score(docs["text"], stated_chars(docs), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
