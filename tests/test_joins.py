import pytest
from pyspark.sql import functions as F

from veilspark.functions.masking import hash_id
from veilspark.operators import joins
from veilspark.operators.identity import resolve_clients
from veilspark.operators.masking import token_join


def test_size_is_measured(spark):
    assert joins.is_small(spark.range(10))
    assert not joins.is_small(spark.range(1000), max_rows=999)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert not joins.is_small(wide, max_bytes=5000)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_equal_hot_rows_join_whole(spark, how):
    """A third of all rows are the same row, on both sides of a small one."""
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("t"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3)], "t string, r int")
    got = token_join(left, right, "t", how)
    assert got.where("t = 'hot'").count() == 2000
    assert got.count() == (2001 if how == "inner" else 2000 + 2000)


def test_joins_start_no_job_while_planned(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "planning")
    left = spark.range(10).selectExpr("CAST(id AS STRING) AS t", "map(1, id) AS m")
    plan = token_join(left, spark.range(5).selectExpr("CAST(id AS STRING) AS t"), "t")
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setJobGroup("", "")
    assert plan.count() == 5  # a map column is no obstacle


def test_clients_are_resolved_on_a_stream(spark, tmp_path):
    requests = spark.createDataFrame([("tok",), ("none",)], "token string")
    requests.write.parquet(str(tmp_path / "in"))
    tokens = spark.createDataFrame(
        [(0, "", "c1", "viewer", "active", "")],
        "pos int, token_hash string, client_name string, role string, status string, expires_at string",
    )
    tokens = tokens.withColumn("token_hash", hash_id(F.lit("tok")))
    stream = spark.readStream.schema("token string").parquet(str(tmp_path / "in"))
    query = resolve_clients(stream, tokens, "2026-01-01").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.authenticated, r.client) for r in rows} == {(False, None), (True, "c1")}


@pytest.mark.parametrize("copies", [1, 6])
def test_keys_crowded_on_both_sides(spark, copies):
    """A third of all rows on either side is one key, some of them equal rows; the pairs are those of a plain join."""
    left = spark.range(1200).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS t", f"id DIV {copies} AS a")
    right = spark.range(900).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 70)) AS t", f"id DIV {copies} AS b", "NULL AS c")
    grid = {r.key: (r.across, r.down) for r in joins.replica_grid(left, right, "t", 8).collect()}
    assert set(grid) == {"hot"} and min(grid["hot"]) > 5
    got, want = joins.crowded_join(left, right, "t", 8), left.join(right, "t")
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_nothing_crowded_is_a_plain_join(spark):
    left = spark.range(100).selectExpr("id AS t", "id AS a")
    assert joins.crowded_join(left, left.selectExpr("t", "a AS b"), "t", 8).count() == 100
    assert joins.crowded_join(left.limit(0), left.selectExpr("t", "a AS b"), "t", 8).count() == 0
    nulls = left.selectExpr("CAST(NULL AS LONG) AS t", "a")
    assert joins.crowded_join(nulls, nulls.selectExpr("t", "a AS b"), "t", 8).count() == 0


@pytest.mark.parametrize("copies", [1, 6])
def test_pairs_of_crowded_keys_counted(spark, copies):
    """Counted pairs, crowded and not, are the plain join's; nulls pair with nothing."""
    key = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % {}) END AS t"
    left = spark.range(1200).selectExpr(key.format(50), f"id DIV {copies} % 40 AS a")
    right = spark.range(900).selectExpr(key.format(70), f"id DIV {copies} % 30 AS b")
    want = left.join(right, "t").groupBy("t", "a", "b").agg(F.count(F.lit(1)).alias("times"))
    for parts in (8, 1):  # with and without a grid
        got = joins.crowded_join(left, right, "t", parts, copies="times").groupBy("t", "a", "b").agg(F.sum("times").alias("times"))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_equal_pairs_of_a_crowded_key_are_never_held(spark):
    """More equal pairs than an array can hold: counted they take no room, repeated they come a few at a time."""
    side = spark.range(100_000).selectExpr("IF(id < 60000, 'hot', concat('k', id)) AS t")
    found = joins.crowded_join(side, side, "t", 8, copies="times").agg(F.count(F.lit(1)), F.sum("times")).first()
    assert tuple(found) == (40_001, 60_000**2 + 40_000)
    times = [1, 2, 4096, 4097, (1 << 24) + 1]
    rows = joins.repeated(spark.createDataFrame([(n, n) for n in times], "n long, times long"), "times").groupBy("n").count()
    assert {r["n"]: r["count"] for r in rows.collect()} == {n: n for n in times}
    few = joins.crowded_join(side.where("t = 'hot'").limit(9_000), side.where("t = 'hot'").limit(9_000), "t", 8)
    assert few.count() == 81_000_000
