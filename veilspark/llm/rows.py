"""Keeping and removing whole rows by what was found about their id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import free_name, small, stored

#: Keys up to which they are broadcast, at some 40 bytes each.
MAX_BROADCAST_KEYS = 500_000


def _split(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    mark = free_name(docs, "row_text_hash")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    side = keys.select(F.col("doc_id").alias("k_doc_id"), F.col("text_hash").alias("k_text_hash"))
    side = F.broadcast(side) if small(keys, MAX_BROADCAST_KEYS) else side
    same = marked["doc_id"].eqNullSafe(side["k_doc_id"]) & (marked[mark] == side["k_text_hash"])
    return marked.join(side, same, how).drop(mark)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` and text hash aren't among the keys (``doc_id, text_hash``); null is an id like others.

    Few keys are broadcast, so texts stay where they are; many are joined by shuffle.
    """
    return _split(docs, keys, "left_anti")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: the one with the smallest id (null last), then the smallest text hash.

    ``found`` has ``doc_id, text_hash, root`` of every row; rows that are equal in id and
    text are reduced to one as well.
    """
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    members = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    members = stored(members, "group-members")
    first = members.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    gone = members.join(first, "root").where(~(order == F.col("first"))).select("doc_id", "text_hash")
    gone = stored(gone, "group-rest")
    repeated = stored(members.where("n > 1").join(gone, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash"), "repeated")
    left = without(docs, gone)
    if repeated.isEmpty():
        return left
    return without(left, repeated).unionByName(_split(left, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
