"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are ordered by that key within
their source, word counts are summed along the order in blocks (a window in each
block, plus the sum of the blocks before), and each source is cut at its budget;
the document at the cut gives the part that still fits. A budget beyond the size
of its source takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import n_words, small, stored, table

#: Rows of a block of the key order; a source has as many blocks as its rows need.
BLOCK_ROWS = 512
#: Sources up to which their table is broadcast (some 64 bytes a row).
MAX_BROADCAST_SOURCES = 50_000
MAX_EPOCHS = 3
SEED = 7


def random_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """60 random bits of the id, or of the text where the id is null."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words of each source: ``source, n_rows, source_size, target``.

    ``sizes`` has one row for each source. Without ``weights`` (``source, weight``) the
    sources weigh 1, 2, 3, repeating, by code point, null last. Targets share the sum
    of all sizes by weight, none above ``max_epochs`` times its source; what is cut off
    goes to the others by weight. Water filling in closed form: along
    ``max_epochs * size / weight`` the level rises as long as sources fill up, so the
    final level is the largest one. Sources without a weight get no words.
    """
    if weights is None:
        order = Window.orderBy(F.col("source").asc_nulls_last())
        weighted = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(w, F.expr("source <=> w_source"), "left").drop("w_source")
        weighted = weighted.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_ratio = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = weighted.withColumn("ratio", F.when(F.col("weight") > 0, cap / F.col("weight")))
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("weight") > 0, cap)).over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = filled.withColumn("level", F.when(F.col("weight") > 0, level))
    top = F.max("level").over(everything)
    target = F.when(F.col("weight") > 0, F.least(cap, F.col("weight") * top)).otherwise(F.lit(0.0))
    return levels.select("source", "n_rows", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    size: Column | None = None,
) -> DataFrame:
    """Words that the mix takes of every document.

    Returns ``doc_id, source, size, source_size, target, taken``, a row for each row of
    ``docs``; other columns are not carried. ``taken`` counts repeats: whole epochs, then
    the part of the last epoch that lies before the cut. A null text has size 0, null is
    a source of its own, rows that repeat an id are ordered by size and are mixed like
    any others, and an empty table gives an empty mix.
    """
    counted = docs.select(
        "doc_id",
        "source",
        (n_words(docs["text"]) if size is None else size).alias("size"),
        random_key(docs["doc_id"], docs["text"], seed).alias("key"),
    )
    slim = stored(counted, "mix-sizes")  # texts are read once
    sizes = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, max_epochs), "mix-targets")
    per_source = targets.withColumnRenamed("source", "t_source")
    per_source = F.broadcast(per_source) if small(per_source, MAX_BROADCAST_SOURCES) else per_source

    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / BLOCK_ROWS))).cast("int")
    blocked = slim.join(per_source, F.expr("source <=> t_source")).drop("t_source")
    # The top bits of the key, as many as the source needs: a range partition of uniform keys.
    blocked = blocked.withColumn("block", F.floor(F.col("key") / F.pow(F.lit(2.0), 60 - bits)).cast("long"))

    sums = blocked.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("o_source"),
        F.col("block").alias("o_block"),
        F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.expr("source <=> o_source AND block = o_block"))

    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("offset") - F.col("inner")))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


OP1_SQL = r"""
WITH slim AS (
  SELECT doc_id, source,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || COALESCE(doc_id::VARCHAR, 'text ' || md5(COALESCE(text, '')))) AS digest
  FROM documents),
sizes AS (SELECT source, SUM(size)::BIGINT AS source_size FROM slim GROUP BY source),
weighted AS (
  SELECT *, ((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sizes),
levels AS (
  SELECT *,
    (SUM(source_size) OVER ()::DOUBLE
      - COALESCE(SUM(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (SUM(weight) OVER ()
      - COALESCE(SUM(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, LEAST(source_size * 3.0::DOUBLE, weight * MAX(level) OVER ()) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, FLOOR(t.target)::BIGINT AS budget,
    COALESCE(SUM(s.size) OVER (PARTITION BY s.source ORDER BY substr(s.digest, 1, 15), s.doc_id, s.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM slim s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN
     (budget // source_size) * size + LEAST(size, GREATEST(0, budget % source_size - before))
   ELSE 0 END)::BIGINT AS taken
FROM placed
"""
