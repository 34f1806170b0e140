"""Joins to a side of unique keys, whatever keys the other side repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored

#: A key is heavy if it holds more than one row in so many; there are fewer heavy keys than this.
HEAVY = 1_000
_SALTS = 4_096


def heavy_keys(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """The keys with more than one row in ``HEAVY`` (fewer than ``HEAVY`` of them); ``weight`` counts a row as so many."""
    counts = stored(rows.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("key_rows")), "key-rows")
    total = counts.agg(F.coalesce(F.sum("key_rows"), F.lit(0))).first()[0]
    return counts.where(F.col("key_rows") * HEAVY > total).select(*keys)


def join_unique(rows: DataFrame, other: DataFrame, keys: list[str], spread: Column, heavy: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``other``, whose rows differ in ``keys``; null is no key.

    What ``other`` has on heavy keys (see ``heavy_keys``) is broadcast, fewer than ``HEAVY``
    rows; rows of those keys are dealt by ``spread``, a hash of something they differ in,
    past the shuffle join that the others take. Columns of ``other`` beside the keys must
    have names of their own.
    """
    values = [c for c in other.columns if c not in keys]
    heavy = heavy_keys(rows, keys) if heavy is None else heavy
    few = other.join(F.broadcast(heavy), keys, "left_semi")
    packed = heavy.join(few, keys, "left").select(*keys, F.struct(*values).alias("heavy_value"))
    marked = rows.join(F.broadcast(packed), keys, "left")
    is_heavy = F.col("heavy_value").isNotNull()
    marked = marked.withColumn("heavy_salt", F.when(is_heavy, F.pmod(spread, F.lit(_SALTS)) + 1).otherwise(F.lit(0)))
    for k in keys:
        kind = rows.schema[k].dataType
        none = F.lit("" if kind.typeName() == "string" else 0).cast(kind)
        marked = marked.withColumn(f"light_{k}", F.when(is_heavy, none).otherwise(F.col(k)))
    light = other.select(
        *[F.col(k).alias(f"light_{k}") for k in keys], F.lit(0).alias("heavy_salt").cast("long"), F.struct(*values).alias("light_value")
    )
    marked = marked.withColumn("heavy_salt", F.col("heavy_salt").cast("long"))
    joined = marked.join(light, [*[f"light_{k}" for k in keys], "heavy_salt"], "left")
    got = [F.coalesce(F.col("heavy_value")[v], F.col("light_value")[v]).alias(v) for v in values]
    return joined.select(*[F.col(c) for c in rows.columns], *got)
