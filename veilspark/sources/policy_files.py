"""Masking rules and token registries as frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from veilspark.frames import local_frame
from veilspark.policy import MaskingPolicy, read_document

RULE_SCHEMA = (
    "columns array<string>, action string, namespace string, prefix string, rule_ord long"
)
OVERRIDE_SCHEMA = "table_name string, column_name string, action string"
TOKEN_FIELDS = ("token_hash", "client_name", "role", "status", "expires_at")
_TOKEN_ENTRY = ", ".join(f"{f} string" for f in TOKEN_FIELDS)
_TOKEN_DOC = "tokens array<struct<" + ", ".join(f"{f}: string" for f in TOKEN_FIELDS) + ">>"


def expand_rules(rule_entries: DataFrame) -> DataFrame:
    """One row per lower-cased column; the last entry for a column wins.

    The winner is an aggregate with map-side combining, so a column that is
    redefined over and over does not pile up in one task.
    """
    listed = rule_entries.select(
        "action",
        F.coalesce("namespace", F.lit("")).alias("namespace"),
        F.coalesce("prefix", F.lit("")).alias("prefix"),
        "rule_ord",
        F.posexplode("columns").alias("pos", "column"),
    )
    last = F.max_by(
        F.struct("action", "namespace", "prefix", "rule_ord"), F.struct("rule_ord", "pos")
    )
    return (
        listed.groupBy(F.lower("column").alias("column_name"))
        .agg(last.alias("rule"))
        .select("column_name", "rule.*")
    )


def rule_entries(spark: SparkSession, doc: Mapping) -> DataFrame:
    rows = [
        (list(r.get("columns") or []), r["action"], r.get("namespace"), r.get("prefix"), i)
        for i, r in enumerate(doc.get("rules") or [])
    ]
    return local_frame(spark, rows, RULE_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of one config file, one row per column."""
    return expand_rules(rule_entries(spark, read_document(spark, path)))


def load_policy(spark: SparkSession, path: str) -> MaskingPolicy:
    return MaskingPolicy.from_document(read_document(spark, path))


def override_rows(spark: SparkSession, policy: MaskingPolicy) -> DataFrame:
    rows = [
        (table, column, action)
        for table, columns in policy.overrides.items()
        for column, action in columns.items()
    ]
    return local_frame(spark, rows, OVERRIDE_SCHEMA)


def rule_rows(spark: SparkSession, policy: MaskingPolicy) -> DataFrame:
    rows = [(c, r.action, r.namespace, r.prefix) for c, r in policy.rules.items()]
    schema = "column_name string, action string, namespace string, prefix string"
    return local_frame(spark, rows, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Registry entries with their position; an unreadable file gives no rows."""
    try:
        docs = spark.read.schema("value string").text(path, wholetext=True)
    except AnalysisException:
        docs = local_frame(spark, [], "value string")
    parsed = docs.select(F.from_json("value", _TOKEN_DOC).alias("doc"))
    return parsed.select(F.posexplode("doc.tokens").alias("pos", "entry")).select(
        "pos", *[F.col(f"entry.{f}").alias(f) for f in TOKEN_FIELDS]
    )


def read_large_registry(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_tokens`, one document being read by many tasks.

    The document is a file, or a folder of parts that follow each other by name. It is cut at
    closing braces, by byte ranges, and each entry parsed by itself; ``pos`` orders entries
    as they stand in it, without counting them. An entry with a
    brace inside a text can't be told apart that way: such a document is parsed whole.
    """
    cut = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Inside a range of bytes rows come in their order; the ranges come in theirs.
    rows = cut.withColumn("row", F.monotonically_increasing_id())
    quotes = F.length(F.regexp_replace("value", r'(?s)\\.|[^"]', ""))
    if not rows.where(quotes % 2 == 1).isEmpty():
        return read_tokens(spark, path)
    entry = F.concat(F.regexp_extract("value", r"(?s)(\{[^{]*)$", 1), F.lit("}"))
    parsed = rows.where(F.col("value").contains("{")).select(
        F.struct("file", "block", "row").alias("pos"), F.from_json(entry, _TOKEN_ENTRY).alias("entry")
    )
    found = parsed.where(F.col("entry").isNotNull() & F.coalesce(*[F.col(f"entry.{f}") for f in TOKEN_FIELDS]).isNotNull())
    return found.select("pos", *[F.col(f"entry.{f}").alias(f) for f in TOKEN_FIELDS])


def numbered(entries: DataFrame, name: str) -> DataFrame:
    """The entries of ``read_large_registry`` with their place in the document, from 1, in a column ``name``.

    Places are counted inside each range of bytes; only the ranges' sizes, a row for each,
    are added up in one task. Entries of a document that was parsed whole have their place.
    """
    if not isinstance(entries.schema["pos"].dataType, StructType):
        return entries.withColumn(name, F.col("pos") + 1)
    ranges = entries.groupBy("pos.file", "pos.block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    same = (F.col("pos.file") == F.col("file")) & (F.col("pos.block") == F.col("block"))
    placed = entries.join(F.broadcast(ranges), same)
    # Every range has entries, so what is ahead of it tells it from the others.
    inside = F.row_number().over(Window.partitionBy("ahead").orderBy("pos.row"))
    return placed.select(*entries.columns, (F.col("ahead") + inside).alias(name))
