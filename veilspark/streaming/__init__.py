"""Masking and audit reading on streams.

Masking is a stateless projection, so it needs no watermark and no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.keys import TokenKeys
from veilspark.operators.masking import apply_masking
from veilspark.policy import MaskingPolicy
from veilspark.sources.audit_log import audit_lines


def mask_stream(
    stream: DataFrame, policy: MaskingPolicy, keys: TokenKeys | None = None, **options
) -> DataFrame:
    """Mask a streaming frame; the same expressions as in batch."""
    return apply_masking(stream, policy, keys, **options)


def write_masked(
    stream: DataFrame,
    policy: MaskingPolicy,
    path: str,
    checkpoint: str,
    keys: TokenKeys | None = None,
    file_format: str = "parquet",
    **options,
) -> StreamingQuery:
    """Mask everything available and append it to files, exactly once."""
    return (
        mask_stream(stream, policy, keys, **options)
        .writeStream.format(file_format)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def stream_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit records as they are appended; broken lines are skipped."""
    return audit_lines(spark.readStream, path)
