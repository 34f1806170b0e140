import json

from pyspark.sql import functions as F

from veilspark import Measure, apply_masking
from veilspark.streaming import mask_stream, stream_audit, write_masked


def test_masked_stream_equals_masked_batch(spark, policy, keys, tmp_path):
    df = spark.range(500).select(
        F.concat(F.lit(" 客户"), F.col("id") % 7).alias("customer_name"),
        F.concat(F.lit("138"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("phone"),
        F.when(F.col("id") % 5 == 0, "call 13812345678").otherwise("x").alias("status"),
        F.col("id").alias("amount"),
    )
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = write_masked(stream, policy, out, mark, keys)
    assert query.awaitTermination(120)
    want = apply_masking(df, policy, keys).orderBy("amount").collect()
    assert spark.read.parquet(out).orderBy("amount").collect() == want
    # A restart finds nothing new and writes nothing twice.
    assert write_masked(stream, policy, out, mark, keys).awaitTermination(120)
    assert spark.read.parquet(out).count() == 500


def test_stream_keeps_no_state(spark, policy, keys, tmp_path):
    stream = spark.readStream.schema("customer_name string").parquet(str(tmp_path))
    masked = mask_stream(stream, policy, keys)
    assert masked.isStreaming
    assert Measure.count().safe


def test_audit_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"ts": "t1", "client": "c"}) + "\n\nbroken\n")
    query = stream_audit(spark, str(folder)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [r.client for r in spark.sql("SELECT * FROM seen").collect()] == ["c"]
