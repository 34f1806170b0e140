from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilspark import AccessDenied, GovernedSession, Measure, RoleBook, SourceCatalog, tag_source
from veilspark.errors import denial_text
from veilspark.frames import local_frame
from veilspark.operators import governed as g


@pytest.fixture(scope="module")
def summary(spark):
    return tag_source(
        local_frame(
            spark,
            [("陈一鸣", "o1", 2026, 1, 10.0), ("林二白", "o2", 2026, 2, 5.0), ("陈一鸣", "o1", 2025, 1, 1.0)],
            "customer_name string, org_name string, n_year int, n_period int, amount double",
        ),
        "summary",
    )


def code_of(build):
    with pytest.raises(AccessDenied) as info:
        build()
    return info.value.code


@pytest.mark.parametrize(
    "name, dialect, code",
    [
        ("summary", None, None),
        ("SUMMARY", None, None),
        ("shop.summary", None, None),
        ("SHOP.Summary", None, None),
        ("payroll", None, "TABLE_NOT_ALLOWED"),
        ("mysql.user", None, "SYSTEM_TABLE_DENIED"),
        ("Information_Schema.columns", None, "SYSTEM_TABLE_DENIED"),
        ("other.summary", None, "TABLE_NOT_ALLOWED"),
        ("sys", None, "SYSTEM_TABLE_DENIED"),
        ("master", None, "TABLE_NOT_ALLOWED"),
        ("master", "tsql", "SYSTEM_TABLE_DENIED"),
        ("dbo.summary", "tsql", None),
        ("testdb.dbo.summary", "tsql", None),
        ("other.dbo.summary", "tsql", "TABLE_NOT_ALLOWED"),
        ("master.dbo.sysobjects", "tsql", "TABLE_NOT_ALLOWED"),
        ("tempdb.sysobjects", "tsql", "SYSTEM_TABLE_DENIED"),
        ("mysql", "tsql", "TABLE_NOT_ALLOWED"),
    ],
)
def test_table_names(book, sources, name, dialect, code):
    role = book.roles["developer"]
    if code is None:
        assert g.check_table(name, role, sources, dialect) == name.split(".")[-1]
    else:
        assert code_of(lambda: g.check_table(name, role, sources, dialect)) == code


def test_no_configured_database_skips_that_check(book):
    assert g.check_table("any.summary", book.roles["developer"], SourceCatalog()) == "summary"


def test_viewer_sees_its_own_tables(book, sources):
    assert code_of(lambda: g.check_table("detail", book.roles["viewer"], sources)) == "TABLE_NOT_ALLOWED"
    assert g.check_table("v_view", book.roles["viewer"], sources) == "v_view"


def test_raw_equality_is_allowed(summary, policy):
    assert g.governed_filter(summary, policy, [("customer_name", "=", "陈一鸣")]).count() == 2


@pytest.mark.parametrize(
    "where, n",
    [
        ([("customer_name", "like", "陈%")], 2),
        ([("customer_name", "in", ["林二白"])], 1),
        ([("n_year", "between", (2026, 2027)), ("amount", ">", 5)], 1),
        ([("n_year", "!=", 2026)], 1),
        ([("n_year", "<", 2026)], 1),
        ([("n_year", "<=", 2026), ("amount", ">=", 10)], 1),
        ([("org_name", "is not null")], 3),
        ([("org_name", "is null")], 0),
        ([], 3),
    ],
)
def test_comparisons(summary, policy, where, n):
    assert g.governed_filter(summary, policy, where).count() == n


def test_strict_filters_follow_the_documents(summary, policy):
    assert code_of(lambda: g.governed_filter(summary, policy, [("customer_name", "like", "陈%")], strict=True)) == "COLUMN_DENIED"
    g.governed_filter(summary, policy, [("customer_name", "=", "陈一鸣"), ("n_year", ">", 1)], strict=True)


def test_free_predicates_may_not_touch_sensitive_columns(summary, policy):
    assert g.governed_filter(summary, policy, predicate=F.upper("org_name") == "O1").count() == 2
    bad = F.upper("customer_name") == "X"
    assert code_of(lambda: g.governed_filter(summary, policy, predicate=bad)) == "FUNCTION_DENIED"


@pytest.mark.parametrize("measure", [Measure.count, Measure.sum, Measure.avg, Measure.min, Measure.max])
def test_no_aggregate_reads_a_sensitive_column(summary, policy, measure):
    run = lambda: g.governed_group(summary, ["n_year"], {"x": measure("customer_name")}, policy)
    assert code_of(run) == "FUNCTION_DENIED"


def test_divisors_are_checked_too(summary, policy):
    quotient = Measure.sum("amount").over(Measure.count("customer_name"))
    run = lambda: g.governed_group(summary, ["n_year"], {"x": quotient}, policy)
    assert code_of(run) == "FUNCTION_DENIED"


def test_sensitive_group_key(summary, policy, keys):
    grouped = g.governed_group(summary, ["customer_name"], {"t": Measure.sum("amount")}, policy)
    assert code_of(lambda: g.governed_having(grouped, F.col("customer_name") > "a", policy)) == "COLUMN_DENIED"
    assert g.governed_having(grouped, F.col("t") > 6, policy).count() == 1


def test_sorting(summary, policy):
    assert code_of(lambda: g.governed_sort(summary, ["customer_name"], policy)) == "COLUMN_DENIED"
    renamed = g.governed_select(summary, {"amount": "customer_name", "y": "n_year"})
    assert code_of(lambda: g.governed_sort(renamed, ["-amount"], policy)) == "COLUMN_DENIED"
    assert [r.y for r in g.governed_sort(renamed, ["-y"], policy).collect()] == [2026, 2026, 2025]


@pytest.mark.parametrize(
    "kind, expr, code",
    [
        ("function", "upper(customer_name)", "FUNCTION_DENIED"),
        ("function", "substring(customer_name, 1, 3)", "FUNCTION_DENIED"),
        ("arithmetic", "customer_name || '!'", "COLUMN_DENIED"),
        ("arithmetic", "customer_name % 2", "COLUMN_DENIED"),
        ("case", "CASE WHEN customer_name = '陈一鸣' THEN 1 END", "COLUMN_DENIED"),
    ],
)
def test_computing_on_sensitive_columns(summary, policy, kind, expr, code):
    assert code_of(lambda: g.governed_derive(summary, "x", F.expr(expr), policy, kind)) == code


def test_computing_on_plain_columns(summary, policy, keys, book, sources, spark):
    session = GovernedSession(spark, book.roles["developer"], book, policy, sources, keys)
    df = g.governed_derive(summary, "total", F.col("amount") * 2, policy, "arithmetic")
    df = g.governed_derive(df, "double_amount", F.col("amount") * 2, policy, "arithmetic")
    row = session.finish(df.orderBy("amount")).first()
    assert row.total == 2.0 and row.double_amount is None
    assert g.governed_derive(summary, "code", F.upper("org_name"), policy).select("code").first().code == "O1"


def test_plain_mistakes_stay_plain(summary, policy):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        g.governed_derive(summary, "x", F.upper("no_such_column"), policy)


def test_finish_denies_untagged_names(summary, policy, keys, book, sources, spark):
    """An aggregate that names itself like a registered column gains nothing."""
    session = GovernedSession(spark, book.roles["developer"], book, policy, sources, keys)
    leaked = summary.agg(F.max("customer_name").alias("amount"))
    assert code_of(lambda: session.finish(leaked)) == "FUNCTION_DENIED"
    renamed = summary.select(F.col("remark").alias("amount")) if "remark" in summary.columns else None
    assert renamed is None or session.finish(renamed).first().amount is None


@pytest.mark.parametrize(
    "asked, cap", [(None, 5000), (99_999, 5000), (100, 100), (0, 0), (-1, 5000), ("10", 5000), (True, 5000)]
)
def test_row_cap(asked, cap):
    assert g.effective_cap(asked, 5000) == cap


def test_capped_rows(spark):
    assert g.capped_limit(spark.range(100), None, 7).count() == 7
    rows, more = g.fetch_capped(spark.range(100), 7)
    assert rows.count() == 7 and more
    rows, more = g.fetch_capped(spark.range(7), 7)
    assert rows.count() == 7 and not more


def test_unions(book, policy, keys, spark):
    dev, viewer = book.roles["developer"], book.roles["viewer"]
    part = tag_source(spark.sql("SELECT 1 AS n_year, 'a' AS customer_name"), "summary")
    for n in (1, 2, 3):
        assert g.governed_union([part] * n, dev, policy, keys).count() == n
    assert g.governed_union([part] * 3, dev, policy, keys, distinct=True).count() == 1
    assert code_of(lambda: g.governed_union([part] * 4, dev, policy, keys)) == "UNION_DENIED"
    assert code_of(lambda: g.governed_union([part] * 2, viewer, policy, keys)) == "UNION_DENIED"


def test_union_may_be_sorted_by_plain_columns_only(book, policy, keys, spark):
    dev = book.roles["developer"]
    part = tag_source(spark.sql("SELECT explode(sequence(1, 9)) AS n_year, 'a' AS customer_name"), "summary")
    top = g.governed_union([part, part], dev, policy, keys, order=["-n_year"], limit=3)
    assert [r.n_year for r in top.collect()] == [9, 9, 8]
    bad = lambda: g.governed_union([part, part], dev, policy, keys, order=["customer_name"])
    assert code_of(bad) == "COLUMN_DENIED"


def test_large_tables_need_a_time_filter(spark, book):
    detail = tag_source(spark.sql("SELECT 2026 AS n_year, 6 AS n_period, 1.0 AS amount"), "detail")
    assert code_of(lambda: g.require_filter(detail, "detail", [], book)) == "FILTER_REQUIRED"
    assert code_of(lambda: g.require_filter(detail, "Detail", [("amount", ">", 0)], book)) == "FILTER_REQUIRED"
    assert g.require_filter(detail, "detail", [("n_period", "=", 6)], book).count() == 1
    assert g.require_filter(detail, "dimension", [], book).count() == 1


def test_summary_report(summary, policy):
    report = lambda *a: [tuple(r) for r in g.summary_report(summary, policy, *a).collect()]
    assert report(2026) == [("o1", 1, 10.0), ("o2", 2, 5.0)]
    assert report(2026, 0) == report(2026, None)
    assert report(2026, 2) == [("o2", 2, 5.0)]


def test_regroup_merges_spellings(spark, policy, keys):
    df = tag_source(
        spark.sql("SELECT * FROM VALUES (' A', 1.0), ('A', 3.0), ('B', 5.0) AS t(customer_name, amount)"), "s"
    )
    measures = {"n": Measure.count(), "t": Measure.sum("amount"), "m": Measure.avg("amount").times(10)}
    rows = g.governed_regroup(df, ["customer_name"], measures, policy, keys).collect()
    assert sorted((r.n, float(r.t), float(r.m)) for r in rows) == [(1, 5.0, 50.0), (2, 4.0, 20.0)]
    with pytest.raises(ValueError):
        g.governed_regroup(df, ["customer_name"], {"x": Measure.max("amount")}, policy, keys)


@pytest.fixture
def files(spark, tmp_path):
    spark.sql(
        "SELECT * FROM VALUES ('陈一鸣', 2026, 10.0), ('林二白', 2025, 1.0) AS t(customer_name, n_year, amount)"
    ).write.parquet(str(tmp_path / "summary"))
    doc = {
        "datasources": [{"name": "default", "type": "parquet", "path": str(tmp_path) + "/{table}"}],
        "table_routing": [{"pattern": "*", "datasource": "default"}],
    }
    return SourceCatalog.from_document(doc)


def test_session_end_to_end(spark, files, book, policy, keys):
    dev = GovernedSession.open(spark, "developer", book, policy, files, keys)
    got = dev.query(
        lambda s: g.governed_select(
            s.table("summary", [("n_year", "=", 2026)]), {"who": "customer_name", "amount": "amount"}
        )
    )
    assert [tuple(r) for r in got.collect()] == [("CUST_V1_1A291822DC53DA5C", 10.0)]
    viewer = GovernedSession.open(spark, "viewer", book, policy, files, keys)
    assert code_of(lambda: viewer.query(lambda s: s.table("v_view"))) == "ROLE_DENIED"
    assert code_of(lambda: viewer.table("summary")) == "TABLE_NOT_ALLOWED"
    assert code_of(lambda: GovernedSession.open(spark, "hacker", book, policy, files)) == "ROLE_DENIED"


def test_plugin_query(spark, files, book, policy, keys):
    dev = GovernedSession.open(spark, "developer", book, policy, files, keys)
    sql = (
        "SELECT customer_name, sum(amount) AS spent, max(amount) AS top FROM {summary}"
        " WHERE n_year >= ? GROUP BY customer_name"
    )
    rows = dev.plugin_query(sql, [2026], ["summary"], require_role="developer").collect()
    assert [tuple(r) for r in rows] == [("CUST_V1_1A291822DC53DA5C", 10.0, None)]
    viewer = GovernedSession.open(spark, "viewer", book, policy, files, keys)
    assert code_of(lambda: viewer.plugin_query(sql, [2026], ["summary"], require_role="developer")) == "ROLE_DENIED"
    assert code_of(lambda: viewer.plugin_query(sql, [2026], ["summary"])) == "TABLE_NOT_ALLOWED"


def test_plugin_queries_filter_large_tables(spark, files, book, policy, keys):
    strict = RoleBook(book.roles, frozenset({"summary"}), book.filter_columns)
    dev = GovernedSession.open(spark, "developer", strict, policy, files, keys)
    sql = "SELECT amount FROM {summary}"
    assert code_of(lambda: dev.plugin_query(sql, None, ["summary"])) == "FILTER_REQUIRED"
    got = dev.plugin_query(sql, None, ["summary"], where={"summary": [("n_year", "=", 2025)]})
    assert [r.amount for r in got.collect()] == [1.0]


def test_bound_values_are_not_sql(spark, files, book, policy, keys):
    dev = GovernedSession.open(spark, "developer", book, policy, files, keys)
    sql = "SELECT customer_name FROM {summary} WHERE customer_name = :n"
    assert dev.plugin_query(sql, {"n": "x' OR '1'='1"}, ["summary"]).count() == 0


def test_messages():
    assert denial_text("TABLE_NOT_ALLOWED", "t").endswith("（t）")
    assert AccessDenied("FILTER_REQUIRED").detail == ""


@pytest.fixture
def dev(spark, book, policy, sources, keys):
    return GovernedSession(spark, book.roles["developer"], book, policy, sources, keys)


@pytest.mark.parametrize(
    "expr", ["to_json(struct(*))", "concat_ws('', *)", "hash(*)", "max(customer_name) OVER (PARTITION BY amount)"]
)
def test_a_star_is_all_columns(summary, policy, expr):
    assert code_of(lambda: g.governed_derive(summary, "status", F.expr(expr), policy)) == "FUNCTION_DENIED"
    if "OVER" not in expr:
        assert code_of(lambda: g.governed_having(summary, F.expr(f"{expr} IS NOT NULL"), policy)) == "COLUMN_DENIED"


def test_plans_are_judged_as_a_whole(summary, dev, spark, tmp_path):
    spark.range(3).selectExpr("CAST(id AS STRING) AS amount").write.parquet(str(tmp_path / "other"))
    inner = replace(dev, handed=[summary])
    path = f"SELECT amount FROM parquet.`{tmp_path}/other`"
    assert code_of(lambda: inner.finish(spark.sql(path))) == "TABLE_NOT_ALLOWED"
    sub = spark.sql("SELECT (SELECT max(customer_name) FROM {s}) AS amount FROM {s}", s=summary)
    assert code_of(lambda: inner.finish(sub)) == "FUNCTION_DENIED"
    assert code_of(lambda: inner.finish(summary.orderBy("customer_name"))) == "COLUMN_DENIED"
    assert code_of(lambda: inner.finish(summary.select(F.upper("customer_name").alias("amount")))) == "FUNCTION_DENIED"
    assert inner.finish(summary.where("customer_name = 'x' OR NOT amount > 1")).columns == summary.columns
    raw = {r.customer_name for r in summary.collect()}
    plain = summary.select("customer_name").union(summary.select("customer_name")).withColumnRenamed("customer_name", "amount")
    assert not raw & {r.amount for r in inner.finish(plain).collect()}
    viewer = replace(inner, role=replace(dev.role, allow_union=False))
    assert code_of(lambda: viewer.finish(plain)) == "UNION_DENIED"


def test_safe_outputs_are_derived(summary, dev, spark):
    inner = replace(dev, handed=[summary])
    text = "SELECT count(*) AS n, round(coalesce(sum(amount), 0) * 2, 1) AS s, CAST(avg(amount) AS INT) AS a, max(amount) AS m, 7 AS seven FROM {s}"
    row = inner.finish(spark.sql(text, s=summary)).first()
    assert row.n is not None and row.s is not None and row.a is not None
    assert row.m is None and row.seven is None
