import pytest
from pyspark.sql import functions as F

from veilspark.functions.sqltext import sql_tokens
from veilspark.operators.edges import LineageStore, closed_edges, lineage_edges
from veilspark.operators.tags import tag_source


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def people(spark):
    return tag_source(spark.sql("SELECT 'a' AS customer_name, 1 AS amount, 2 AS level_1"), "shop.People")


def test_edges_say_what_happened(spark, people):
    df = people.select(
        F.col("customer_name").alias("who"), (F.col("amount") + F.col("level_1")).alias("sum_of"), F.lit(1).alias("one")
    )
    assert rows(lineage_edges(df, "V")) == {
        ("v", "who", "people.customer_name", "plain"),
        ("v", "sum_of", "people.amount", "computed"),
        ("v", "sum_of", "people.level_1", "computed"),
    }
    counted = people.groupBy("customer_name").agg(F.sum("amount").alias("total"))
    assert ("v", "total", "people.amount", "aggregated") in rows(lineage_edges(counted, "v"))


def test_masked_columns_keep_their_source(spark, people, policy, keys):
    from veilspark import apply_masking

    got = rows(lineage_edges(apply_masking(people, policy, keys), "v"))
    assert ("v", "customer_name", "people.customer_name", "masked: tokenize") in got


def test_views_of_views(spark, people, tmp_path):
    store = LineageStore(spark, str(tmp_path))
    first = store.save(people.select(F.col("customer_name").alias("a"), "amount"), "First")
    second = store.save(first.select(F.col("a").alias("b"), F.col("amount").alias("c")), "second")
    store.save(second.select(F.col("b").alias("d")).union(people.select("customer_name")), "third")
    assert rows(closed_edges(store.edges())) == {
        ("first", "a", "people.customer_name", 1), ("first", "amount", "people.amount", 1),
        ("second", "b", "people.customer_name", 2), ("second", "c", "people.amount", 2),
        ("third", "d", "people.customer_name", 1),
    }
    store.save(people.select(F.col("level_1").alias("a")), "first")  # rewritten: what hangs on it follows
    assert ("second", "b", "people.level_1", 2) in rows(closed_edges(store.edges()))


def test_no_edges(spark):
    empty = lineage_edges(spark.range(1).select(F.lit(1).alias("x")), "v")
    assert empty.count() == 0 and closed_edges(empty).count() == 0


TEXTS = [
    "SELECT a, 'it''s' FROM `t``x` WHERE b >= 1.5e-3 -- c\n AND d = \"x\" # e\n /* f */;",
    "SELECT [a]]b], 'x' FROM #tmp WHERE c = N'y' AND t.1 = .5",
    "SELECT $t$ a $t$, $$b$$, $1 FROM x",
    "'open", "a \"b", "", "é漢 \t\n 12abc 0xFF x.1.2", "--", "/* open",
]


@pytest.mark.parametrize("dialect", ["mysql", "tsql", "postgres", None])
def test_tokens_give_the_text_again(spark, dialect):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    tokens = sql_tokens(F.col("s"), None if dialect is None else F.lit(dialect))
    got = df.select("s", tokens.alias("t")).collect()
    assert all("".join(x.token for x in r.t) == r.s for r in got)
    kinds = {r.s: {x.kind for x in r.t} for r in got}
    assert "open" in kinds["'open"] and "open" not in kinds[TEXTS[0]]


def test_kinds_follow_the_dialect(spark):
    df = spark.createDataFrame([('SELECT "x", #y\n', d) for d in ("mysql", "tsql")], "s string, d string")
    got = {r.d: {x.token: x.kind for x in r.t} for r in df.select("d", sql_tokens(F.col("s"), F.col("d")).alias("t")).collect()}
    assert got["mysql"]['"x"'] == "string" and got["tsql"]['"x"'] == "name"
    assert got["mysql"]["#y"] == "comment" and got["tsql"]["#"] == "code"
