"""Labelled rows for the classifiers, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import held_out

#: Labelled rows that a classifier learns from, at most; they are drawn by a hash of the id.
MAX_LABELLED = 10_000
#: Rows whose crc32 of the id leaves this number are kept out of learning.
FOLDS, HELD_OUT = 5, 0


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """Columns of ``docs`` (``doc_id, text`` and others) but its id, and ``label``, of up to ``limit`` rows outside the held-out part.

    Rows with a null id or label are passed over; an id that is labelled twice takes the
    larger label, one that several rows have stands for the one with the least text hash.
    At most ``limit`` ids of eight bytes are broadcast; texts aren't moved but for those
    of the labelled rows, one for each id and task.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    columns = [c for c in docs.columns if c != "doc_id"]
    found = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", F.struct(F.xxhash64("text").alias("hash"), *columns, "label").alias("row"))
    return found.groupBy("doc_id").agg(F.min("row").alias("row")).select(*[F.col(f"row.{c}").alias(c) for c in columns], "row.label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; ``x`` has a column of ones first."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
