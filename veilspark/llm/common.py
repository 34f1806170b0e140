"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For ``str.translate``: lower-cases A-Z and nothing else.
LOWER_AZ = {ord(c): c.lower() for c in UPPER}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; local masters get one of their own when none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_and_freed(df: DataFrame, name: str) -> DataFrame:
    """``stored``, for jobs that shuffle much: nothing reads what they shuffled any more, and executors may delete it.

    They do so when the driver's JVM notices that the finished job is gone, which is asked of
    it here; left alone it may not look for half an hour, while job after job fills the disks.
    """
    out = stored(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_of(df: DataFrame) -> Column:
    """The text, null read as empty."""
    return F.coalesce(df["text"], F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small(df: DataFrame, rows: int) -> bool:
    """Whether the frame has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows
