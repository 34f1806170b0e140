"""Audit records as JSON lines."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader

AUDIT_SCHEMA = (
    "ts string, client string, role string, tool string, normalized_sql string,"
    " sql_hash string, tables array<string>, status string,"
    " columns_accessed array<string>, masked_columns array<string>,"
    " rows_returned long, duration_ms long, reason string"
)
AUDIT_FIELDS = tuple(part.split()[0] for part in AUDIT_SCHEMA.split(", ") if part)


_BROKEN = "_broken_line"


def audit_lines(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """Parse JSON lines with a batch or stream reader, without the broken ones.

    Dropping malformed lines is left to a filter over all fields: the reader's
    own mode judges only the columns a query happens to ask for, and would
    drop a whole record for one field of another type.
    """
    parsed = (
        reader.schema(f"{AUDIT_SCHEMA}, {_BROKEN} string")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .json(path)
    )
    some_field = reduce(or_, [F.col(c).isNotNull() for c in AUDIT_FIELDS])
    return parsed.where(F.col(_BROKEN).isNull() | some_field).drop(_BROKEN)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON lines; blank and broken lines are skipped."""
    return audit_lines(spark.read, path)


def audit_layout(df: DataFrame) -> DataFrame:
    """Fixed fields in order; empty optional values become null and are not written."""
    out = df
    for name, kind in (
        ("columns_accessed", "array<string>"),
        ("masked_columns", "array<string>"),
        ("rows_returned", "long"),
        ("duration_ms", "long"),
        ("reason", "string"),
    ):
        if name not in df.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
        elif kind == "array<string>":
            out = out.withColumn(name, F.when(F.size(name) > 0, F.col(name)))
        elif kind == "long":
            out = out.withColumn(name, F.nullif(F.col(name), F.lit(0)).cast("long"))
        else:
            out = out.withColumn(name, F.nullif(F.col(name), F.lit("")))
    return out.select(*AUDIT_FIELDS)


def write_audit(df: DataFrame, path: str) -> None:
    """Append one JSON object per record."""
    audit_layout(df).write.mode("append").option("ignoreNullFields", True).json(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names for checkpoints.

    Only a local session that names none gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        return tempfile.mkdtemp(prefix=f"{purpose}-") + "/data"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
