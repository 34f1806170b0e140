"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary labelled texts, read every
word letter by letter with up to five letters of context. Both fall back on one
Kneser-Ney model of all labelled texts, built from shared continuation counts; what
neither class has seen is equally likely in both. A text's toxic and ordinary
log-likelihoods, each divided by its length, are compared whole; what single
expressions exceed a margin by is added up beside them, as a long text may hold few.
Both are calibrated on cross-fitted rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import held_out, stored, table
from veilspark.llm.labelled import FOLDS, HELD_OUT, MAX_LABELLED, labelled_texts, logistic
from veilspark.llm.words import SMALL_CHUNK_CHARS, Texts, chunks, coded_words, sums_by_text

CONTEXT = 5
DISCOUNT = 0.75
#: Weight of the shared model under each class, in letters seen after a context.
SHARED = 50.0
#: An expression stands out by as much as its log-likelihood ratio exceeds this.
MARGIN = 2.0
CROSS = 3
THRESHOLD = 0.5
START, END = "\x02", "\x03"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str) -> list[str]:
    return text.lower().split()


def gram_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each letter of ``START word END`` after the start, with its context; letters of each word."""
    framed = [START + w + END for w in words]
    sizes = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for back in range(CONTEXT, -1, -1):
            reach = inside >= back
            seen = np.roll(codes, back)[reach] + np.uint64(1)
            hashes[reach] = _step(hashes[reach], seen)
    return hashes[inside > 0], sizes - 1


def gram_counts(texts: DataFrame) -> DataFrame:
    """``gram`` (context and letter), and its counts by class and fold: ``n0, n1, ...`` for class * CROSS + fold.

    Words are parted here as they are when a text is scored; tasks count them first.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: Counter = Counter()
            for text, cell in zip(batch["text"], batch["cell"].tolist(), strict=True):
                held.update((w, cell) for w in _words(text))
            yield pd.DataFrame([(w, c, n) for (w, c), n in held.items()], columns=["word", "cell", "n"])

    fold = F.pmod(F.xxhash64("text"), F.lit(CROSS))
    celled = texts.select("text", (F.col("label") * CROSS + fold).cast("int").alias("cell"))
    words = celled.mapInPandas(count, "word string, cell int, n long").groupBy("word", "cell").agg(F.sum("n").alias("n"))
    framed = F.concat(F.lit(START), "word", F.lit(END))
    letters = words.select("cell", "n", framed.alias("w")).select(
        "cell", "n", "w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("i")
    )
    gram = F.expr(f"substring(w, greatest(1, i - {CONTEXT}), least(i, {CONTEXT + 1}))")
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(2 * CROSS)]
    return letters.groupBy(gram.alias("gram")).agg(*cells)


def _step(value: np.ndarray, letter: np.ndarray) -> np.ndarray:
    mixed = (value ^ letter) * _PRIME
    return mixed ^ (mixed >> np.uint64(29))


def hash_of_grams(grams: pd.Series) -> np.ndarray:
    """The hashes that ``gram_hashes`` gives the last letters of these grams."""
    sizes = grams.str.len().to_numpy(dtype=np.int64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    first, hashes = np.cumsum(sizes) - sizes, np.zeros(len(grams), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(CONTEXT + 1):
            more = np.nonzero(sizes > at)[0]
            hashes[more] = _step(hashes[more], codes[first[more] + at] + np.uint64(1))
    return hashes


def shared_model(grams: pd.Series, counts: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of every gram under both classes together.

    Higher orders interpolate with the next one, which counts distinct continuations; a
    single letter interpolates with all letters alike.
    """
    letters = grams.str.slice(-1).nunique() + 1

    def chances(own: pd.Series, n: np.ndarray) -> np.ndarray:
        code, kinds = pd.factorize(own.str.slice(0, -1))
        total = np.bincount(code, weights=n, minlength=len(kinds))
        types = np.bincount(code, minlength=len(kinds))
        base = np.full(len(own), 1.0 / letters)
        longer = (own.str.len() > 1).to_numpy()
        if longer.any():
            kind, shorter = pd.factorize(own[longer].str.slice(1))
            base[longer] = chances(pd.Series(shorter, dtype=object), np.bincount(kind).astype(np.float64))[kind]
        return (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types[code] * base) / total[code]

    return chances(grams, counts)


def class_ratios(found: pd.DataFrame) -> pd.DataFrame:
    """``gram`` (its hash) and ``r0, r1, ...``: log of toxic over ordinary likelihood, learned without fold k; the last from all.

    Under each class a gram has its discounted count and, in proportion to what was
    discounted and to ``SHARED``, the shared probability. A gram that neither class has seen
    is equally likely in both.
    """
    cells = np.stack([found[f"n{c}"].to_numpy(dtype=np.float64) for c in range(2 * CROSS)]).reshape(2, CROSS, -1)
    shared = shared_model(found["gram"], cells.sum(axis=(0, 1)))
    context = pd.factorize(found["gram"].str.slice(0, -1))[0]
    out = {"gram": hash_of_grams(found["gram"]).view(np.int64)}
    for k in range(CROSS + 1):
        logs = []
        for n in cells.sum(axis=1) - (cells[:, k] if k < CROSS else 0):
            total = np.bincount(context, weights=n)[context]
            types = np.bincount(context, weights=n > 0)[context]
            logs.append((n, np.log((np.maximum(n - DISCOUNT, 0) + (DISCOUNT * types + SHARED) * shared) / (total + SHARED))))
        (ordinary, log_ordinary), (toxic, log_toxic) = logs
        out[f"r{k}"] = np.where(ordinary + toxic > 0, log_toxic - log_ordinary, 0.0).astype(np.float32)
    return pd.DataFrame(out)


def packed(found: pd.DataFrame) -> pd.DataFrame:
    """The ratios as one row of bytes: hashes in order, ratios by fold (16 bits), ratios of all (32 bits)."""
    ratios = class_ratios(found)
    hashes = ratios["gram"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    folds = np.column_stack([ratios[f"r{k}"].to_numpy()[order] for k in range(CROSS)])
    whole = ratios[f"r{CROSS}"].to_numpy()[order]
    blobs = (hashes[order].tobytes(), folds.astype(np.float16).tobytes(), whole.astype(np.float32).tobytes())
    return pd.DataFrame([blobs], columns=["hashes", "folds", "whole"])


def text_features(texts: pd.Series | Texts, hashes: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, for each column of ``ratios``: difference of its log-likelihoods by words, mean excess over the margin; its words."""
    ratio, excess = np.zeros((2, len(texts), ratios.shape[1]))
    size = np.zeros(len(texts))
    for first, held in chunks(texts, SMALL_CHUNK_CHARS):
        counts, codes, distinct = coded_words(held, _words)
        at = slice(first, first + len(held))
        size[at] = counts
        if not len(codes) or not len(hashes):
            continue
        grams, letters = gram_hashes(distinct)
        found = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
        hit = hashes[found] == grams
        for k in range(ratios.shape[1]):
            words = sums_by_text(letters, np.where(hit, ratios[found, k], 0.0))
            ratio[at, k] = sums_by_text(counts, words[codes]) / np.maximum(counts, 1)
            excess[at, k] = sums_by_text(counts, np.maximum(words - MARGIN, 0.0)[codes]) / np.maximum(counts, 1)
    return ratio, excess, size


def design(ratio: np.ndarray, excess: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the calibration sees of a text: the difference of its log-likelihoods by length, what stands out, and how long it is."""
    return np.column_stack([np.ones(len(excess)), ratio, np.log(excess + 0.005), np.log1p(words) / 5])


class ToxicityModel:
    """Ratios by gram hash (sorted), and the calibration. Some 12 bytes for each gram of the labelled texts."""

    def __init__(self, hashes: bytes, ratios: bytes, weights: np.ndarray | None):
        self.hashes, self.ratios, self.weights = hashes, ratios, weights

    def score(self, texts: pd.Series | Texts) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        hashes, ratios = np.frombuffer(self.hashes, np.uint64), np.frombuffer(self.ratios, np.float32)
        ratio, excess, words = text_features(texts, hashes, ratios[:, None])
        return 1 / (1 + np.exp(-np.clip(design(ratio[:, 0], excess[:, 0], words) @ self.weights, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED) -> ToxicityModel:
    """Learns from up to ``limit`` labelled rows; without rows of both classes every text scores 0.

    Counting is a Spark job and smoothing one task over the grams of the bounded sample;
    their hashes and ratios come to the driver as bytes and go on to the workers. Folds for
    the calibration go by the text, so copies are never on both sides.
    """
    plain = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    texts = labelled_texts(plain, labels, label, limit)
    grams = stored(gram_counts(texts), "gram-counts")
    both = grams.agg(*[F.sum(sum(F.col(f"n{y * CROSS + j}") for j in range(CROSS))) for y in range(2)]).first()
    if not all(both):
        return ToxicityModel(b"", b"", None)
    # The grams of the bounded sample fit one task.
    made = grams.groupBy().applyInPandas(packed, "hashes binary, folds binary, whole binary").first()
    hashes = bytes(made["hashes"])
    sent = docs.sparkSession.sparkContext.broadcast((hashes, bytes(made["folds"])))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, folds = np.frombuffer(sent.value[0], np.uint64), np.frombuffer(sent.value[1], np.float16).reshape(-1, CROSS)
        for batch in batches:
            ratio, excess, words = text_features(batch["text"], names, folds.astype(np.float32))
            own = np.arange(len(batch)), batch["fold"].to_numpy(dtype=np.int64)
            yield pd.DataFrame({"ratio": ratio[own], "excess": excess[own], "words": words, "label": batch["label"]})

    folded = texts.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(CROSS)).alias("fold"))
    rows = folded.mapInPandas(features, "ratio double, excess double, words double, label int").toPandas()
    sent.destroy()
    weights = logistic(design(*[rows[c].to_numpy() for c in ("ratio", "excess", "words")]), rows["label"].to_numpy(dtype=float))
    return ToxicityModel(hashes, bytes(made["whole"]), weights)


def toxicity_score(text: Column, model: Broadcast) -> Column:
    """Score of a text column from 0 to 1; null scores as empty text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.score(Texts(texts)), pa.float64())

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id, text``).

    Null texts score as empty ones, which hold no expression; repeated rows and null ids
    stay; columns beside ``doc_id`` and ``text`` are neither read nor returned; an empty
    table gives no rows. The labels' other columns don't matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, limit=limit))
    scored = docs.select(
        "doc_id", held_out(docs["doc_id"], FOLDS, HELD_OUT).alias("held_out"), toxicity_score(docs["text"], model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
