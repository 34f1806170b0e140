"""The corpus pipeline: toxicity, quality, near-duplicates, benchmark passages, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before
kept; its result is written and read again as the next one's ``docs``. All but the last
return the columns of ``documents`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontaminate, mixing, near_sets, quality_fm, rows, toxicity
from veilspark.llm.common import stored, table

#: Near-duplicates share 0.8 of their distinct shingles of five words.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity models don't reject; the models learn from the rows that have come this far."""
    model = spark.sparkContext.broadcast(toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return docs.where(toxicity.toxicity_score(docs["text"], model) < toxicity.THRESHOLD)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine doesn't reject."""
    model = spark.sparkContext.broadcast(quality_fm.fit_quality(docs, table(spark, sf_dir, "labels")))
    score = quality_fm.quality_score(docs["text"], quality_fm.stated_chars(docs), model)
    return docs.where(score >= quality_fm.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: the one with the smallest id, null last.

    SimHash finds the groups, each link checked on the whole shingle sets; a prefix join adds
    the links that fingerprints can't see.
    """
    return rows.one_of_each(docs, near_sets.near_sets(docs.select("doc_id", "text"), SHINGLE))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, in its own words or with other numbers, names and units."""
    found = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.without(docs, stored(found.select("doc_id", "text_hash").distinct(), "contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every row: ``doc_id, source, size, source_size, target, taken``."""
    return mixing.mix_sources(docs.select("doc_id", "source", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Learned scores and fingerprints have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
