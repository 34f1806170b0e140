"""Streams that are stopped, restarted and replayed, and what they must come to."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import audit as oa
from veilspark.plans.audits import flat, judged
from veilspark.plans.registry import PLANS, derive, plan, table
from veilspark.plans.settings import PERSON, POLICY, keys
from veilspark.sources.audit_log import shared_folder, write_audit
from veilspark.streaming import stream_audit, write_masked


def _forget_last_commit(spark, checkpoint: str) -> int:
    """Leaves a stream as if it had been lost after a batch was written and before that was noted; the batch's number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    numbered = {s.getPath().getName(): s.getPath() for s in files.listStatus(path) if s.getPath().getName().isdigit()}
    last = max(numbered, key=int)
    files.delete(numbered[last], False)
    return int(last)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@plan("mask_stream", PLANS["apply_masking_customer"].sql)
def mask_stream_plan(spark, sf):
    """Customers come in two loads; the stream is stopped between them, and its last batch is played twice."""
    people = derive(table(spark, sf, "customer"), PERSON)
    folder = shared_folder(spark, "masked-stream")
    source, out, checkpoint = (f"{folder}/{name}" for name in ("in", "out", "checkpoint"))
    for load in range(2):
        people.where(F.col("id") % 2 == load).repartition(3).write.mode("append").parquet(source)
        for _ in range(2):  # the second time nothing is new, but the last batch comes again
            stream = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 2).parquet(source)
            _finish(write_masked(stream, POLICY, out, checkpoint, keys(spark)))
            _forget_last_commit(spark, checkpoint)
    return spark.read.schema(people.schema).parquet(out)


@plan("stream_audit", PLANS["read_audit"].sql)
def stream_audit_plan(spark, sf):
    """Records are appended while a stream of them is stopped, replayed and started again; broken lines lie between."""
    records = oa.build_audit(judged(spark, sf))
    folder = shared_folder(spark, "audit-stream")
    source, out, checkpoint = (f"{folder}/{name}" for name in ("in", "out", "checkpoint"))
    for allowed in (True, False):
        write_audit(records.where((F.col("status") == "success") == F.lit(allowed)), source)
        spark.range(3).select(F.lit('{"ts": "2024').alias("value")).coalesce(1).write.mode("append").text(source)
        for _ in range(2):
            query = stream_audit(spark, source).writeStream.format("parquet").option("checkpointLocation", checkpoint)
            _finish(query.trigger(availableNow=True).start(out))
            _forget_last_commit(spark, checkpoint)
    return flat(spark.read.parquet(out))
