import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veilspark.frames import local_frame
from veilspark.functions.sqltext import redact_literals
from veilspark.operators import querylog as q
from veilspark.plans import audits

LOG = "query_id long, role string, client string, tool string, ts timestamp_ntz, sql_text string, dialect string"
SHAPE = "query_id long, statement_type string, n_statements int, union_depth int, limit_value int, has_where boolean"
REFS = "query_id long, ord int, catalog_name string, schema_name string, table_name string"
USES = "query_id long, ord int, column_name string, context string, func string"


def case(sql, kind="select", dialect="mysql", role="developer", n=1, depth=0, limit=None, where=True,
         tables=(("", "", "summary"),), uses=(("n_year", "where", ""),), parsed=True, tool="execute_query"):
    return dict(locals())


def build(spark, cases):
    now = dt.datetime(2024, 1, 1)
    log, shape, refs, uses = [], [], [], []
    for i, c in enumerate(cases):
        log.append((i, c["role"], "agent", c["tool"], now, c["sql"], c["dialect"]))
        if not c["parsed"]:
            continue
        shape.append((i, c["kind"], c["n"], c["depth"], c["limit"], c["where"]))
        refs += [(i, o, *t) for o, t in enumerate(c["tables"])]
        uses += [(i, o, *u) for o, u in enumerate(c["uses"])]
    return (
        local_frame(spark, log, LOG), local_frame(spark, shape, SHAPE),
        local_frame(spark, refs, REFS), local_frame(spark, uses, USES),
    )


SELECT = "SELECT amount FROM summary WHERE n_year = 2026"
CASES = [
    (case(SELECT), None, None),
    (case("INSERT INTO summary VALUES (1)", "insert"), "STATEMENT_DENIED", ""),
    (case("UPDATE summary SET amount = 0", "update", dialect="tsql"), "STATEMENT_DENIED", ""),
    (case("SELECT 1; DROP TABLE summary", n=2), "MULTI_STATEMENT", ""),
    (case("", n=0), "MULTI_STATEMENT", ""),
    (case("(SELECT 1)", "subquery", tables=()), None, None),
    (case("EXPLAIN SELECT 1", "explain", tables=()), None, None),
    (case("EXPLAIN SELECT 1", "explain", tables=(), role="viewer"), "STATEMENT_DENIED",
     "EXPLAIN is not allowed for this role"),
    (case("explain analyze SELECT 1", "explain", tables=()), "EXPLAIN_ANALYZE_DENIED", ""),
    (case("DESCRIBE summary", "describe", role="viewer"), "STATEMENT_DENIED", "DESCRIBE is not allowed for this role"),
    (case("DESCRIBE summary", "describe"), None, None),
    (case("SELECT @myvar := amount FROM summary"), "USER_VARIABLE_DENIED", ""),
    (case("SELECT @@version FROM summary"), None, None),
    (case("SELECT amount FROM summary WHERE n = 'a@b.c'"), "USER_VARIABLE_DENIED", ""),
    (case("SELECT * FROM summary FOR UPDATE"), "FOR_UPDATE_DENIED", ""),
    (case("SELECT * FROM summary FOR\n share"), "FOR_UPDATE_DENIED", ""),
    (case("SELECT * FROM summary WHERE a = 'for share'"), None, None),
    (case("SELECT * FROM summary lock in share mode"), "FOR_UPDATE_DENIED", ""),
    *[
        (case(f"SELECT * FROM summary WITH ( {h})", dialect="tsql"), "FOR_UPDATE_DENIED", "")
        for h in ("NOLOCK", "updlock", "XLOCK", "ROWLOCK", "TABLOCK", "PAGLOCK", "HOLDLOCK", "SERIALIZABLE")
    ],
    (case("SELECT * FROM summary WITH (NOLOCK)"), None, None),
    (case("SELECT SLEEP (10) FROM summary"), "DANGEROUS_FUNCTION", "SLEEP"),
    (case("SELECT sleep/* x */(10) FROM summary"), "DANGEROUS_FUNCTION", "sleep"),
    (case("SELECT BENCHMARK(1, SHA1('t')) FROM summary"), "DANGEROUS_FUNCTION", "BENCHMARK"),
    (case("SELECT LOAD_FILE('/etc/passwd') FROM summary"), "DANGEROUS_FUNCTION", "LOAD_FILE"),
    (case("SELECT my_sleep(10) FROM summary"), None, None),
    (case("SELECT 'sleep(1)' FROM summary"), None, None),
    (case("SELECT 1 FROM summary INTO  OUTFILE 'x'"), "DANGEROUS_FUNCTION", "INTO OUTFILE/DUMPFILE"),
    (case("SELECT * FROM OPENROWSET('a', 'b')", dialect="tsql", tables=()), "DANGEROUS_FUNCTION", "OPENROWSET"),
    (case("SELECT SLEEP(10) FROM summary", dialect="tsql"), None, None),
    (case("SELECT xp_cmdshell('dir') FROM summary"), None, None),
    (case("SELECT get_lock('a') FROM summary", dialect="postgres"), "DANGEROUS_FUNCTION", "get_lock"),
    (case(SELECT, tables=(("", "", "Secret_Table"),)), "TABLE_NOT_ALLOWED", "Secret_Table"),
    (case(SELECT, tables=(("", "mysql", "user"),)), "SYSTEM_TABLE_DENIED", "mysql"),
    (case(SELECT, tables=(("", "other", "summary"),)), "TABLE_NOT_ALLOWED", "database other is not configured"),
    (case(SELECT, tables=(("", "SHOP", "summary"),)), None, None),
    (case(SELECT, tables=(("", "", "SYS"),)), "SYSTEM_TABLE_DENIED", "sys"),
    (case(SELECT, dialect="tsql", tables=(("testdb", "dbo", "summary"),)), None, None),
    (case(SELECT, dialect="tsql", tables=(("", "dbo", "summary"),)), None, None),
    (case(SELECT, dialect="tsql", tables=(("other", "dbo", "summary"),)), "TABLE_NOT_ALLOWED",
     "database other is not configured"),
    (case(SELECT, dialect="tsql", tables=(("", "", "master"),)), "SYSTEM_TABLE_DENIED", "master"),
    (case(SELECT, dialect="tsql", tables=(("", "mysql", "summary"),)), None, None),
    (case(SELECT, tables=(("", "", "summary"), ("", "", "b"), ("", "", "a"))), "TABLE_NOT_ALLOWED", "b"),
    (case(SELECT, role="viewer"), "TABLE_NOT_ALLOWED", "summary"),
    (case(SELECT, role="hacker"), "TABLE_NOT_ALLOWED", "summary"),
    (case("u", "union", depth=1), None, None),
    (case("u", "union", depth=2), None, None),
    (case("u", "union", depth=3), "UNION_DENIED", "depth 3 exceeds 2"),
    (case("u", "union", depth=1, role="viewer", tables=(("", "", "v_view"),)), "UNION_DENIED", ""),
    (case(SELECT, uses=(("Customer_Name", "function", "upper"),)), "FUNCTION_DENIED",
     "function UPPER on sensitive column Customer_Name"),
    (case(SELECT, uses=(("level_1", "function", "upper"),)), None, None),
    (case(SELECT, uses=(("phone", "order_by", ""), ("email", "function", "trim"))), "FUNCTION_DENIED",
     "function TRIM on sensitive column email"),
    (case(SELECT, uses=(("phone", "arithmetic", ""), ("email", "order_by", ""))), "COLUMN_DENIED",
     "sensitive column email in ORDER BY"),
    (case(SELECT, uses=(("phone", "having", ""),)), "COLUMN_DENIED", "sensitive column phone in HAVING"),
    (case(SELECT, uses=(("phone", "case", ""),)), "COLUMN_DENIED", "sensitive column phone in CASE"),
    (case(SELECT, uses=(("phone", "arithmetic", ""),)), "COLUMN_DENIED", "sensitive column phone in ARITHMETIC"),
    (case(SELECT, uses=(("phone", "select", ""), ("phone", "group_by", ""), ("phone", "where", ""))), None, None),
    (case(SELECT, tables=(("", "", "Detail"),), uses=(("N_Period", "where", ""),)), None, None),
    (case(SELECT, tables=(("", "", "detail"),), uses=(("n_year", "select", ""),)), "FILTER_REQUIRED", "detail"),
    (case(SELECT, tables=(("", "", "detail"),), uses=(("n_year", "where", ""),), where=False),
     "FILTER_REQUIRED", "detail"),
    (case(SELECT, tables=(("", "", "dimension"),), uses=(), where=False), None, None),
    (case("THIS IS NOT SQL !!!", parsed=False), "SYNTAX_ERROR", ""),
    # the first failing check decides
    (case("SELECT SLEEP(1), @x FROM payroll FOR UPDATE", tables=(("", "", "payroll"),)), "USER_VARIABLE_DENIED", ""),
    (case("SELECT SLEEP(1) FROM payroll FOR UPDATE", tables=(("", "", "payroll"),)), "FOR_UPDATE_DENIED", ""),
    (case("SELECT SLEEP(1) FROM payroll", tables=(("", "", "payroll"),)), "DANGEROUS_FUNCTION", "SLEEP"),
    (case("u", "union", depth=9, tables=(("", "", "payroll"),)), "TABLE_NOT_ALLOWED", "payroll"),
    (case("u", "union", depth=9, uses=(("phone", "order_by", ""),)), "UNION_DENIED", "depth 9 exceeds 2"),
    (case(SELECT, tables=(("", "", "detail"),), uses=(("phone", "order_by", ""),)), "COLUMN_DENIED",
     "sensitive column phone in ORDER BY"),
]


@pytest.fixture(scope="module")
def verdicts(spark, book, policy, sources):
    frames = build(spark, [c for c, *_ in CASES])
    rows = q.query_verdict(*frames, book, policy, sources).collect()
    return {r.query_id: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: CASES[i][0]["sql"][:40])
def test_verdict(verdicts, i):
    _, code, detail = CASES[i]
    assert (verdicts[i].code, verdicts[i].detail) == (code, detail)


def test_every_query_is_judged_once(verdicts):
    assert len(verdicts) == len(CASES)


def test_message(verdicts):
    by_code = {r.code: r.message for r in verdicts.values()}
    assert by_code[None] is None
    assert by_code["SYNTAX_ERROR"] == "The SQL could not be parsed"
    assert "（" in next(r.message for r in verdicts.values() if r.code == "DANGEROUS_FUNCTION")


def test_single_checks_agree_with_the_chain(spark, book, policy, sources, verdicts):
    log, shape, refs, uses = build(spark, [c for c, *_ in CASES])
    found = {
        "statement": q.check_statements(log, shape, book),
        "variable": q.check_user_variables(log),
        "lock": q.check_locks(log),
        "function": q.check_functions(log),
        "table": q.check_tables(log, refs, book, sources),
        "union": q.check_union(log, shape, book),
        "column": q.check_column_uses(uses, policy, book),
        "filter": q.check_large_filters(shape, refs, uses, book),
    }
    first = {}
    for df in [q.fail_closed(log, shape).select("query_id", "code"), *found.values()]:
        for r in df.collect():
            first.setdefault(r.query_id, r.code)
    assert first == {i: r.code for i, r in verdicts.items() if r.code is not None}


def test_limits(spark, book):
    cases = [
        case(SELECT), case(SELECT, limit=99_999), case(SELECT, limit=100), case(SELECT, limit=-1),
        case(SELECT, limit=5000, role="viewer"), case(SELECT, limit=0), case("u", "union", limit=5),
        case(SELECT, limit=2000, role="hacker"),
    ]
    log, shape, _, _ = build(spark, cases)
    got = {r.query_id: r.effective_limit for r in q.limits(log, shape, book).collect()}
    assert got == {0: 5000, 1: 5000, 2: 100, 3: 5000, 4: 1000, 5: 0, 7: 1000}


def test_dialect_follows_the_first_table(spark, sources):
    cases = [
        case("a", tables=(("", "", "SS_orders"), ("", "", "x"))), case("b", tables=(("", "", "x"), ("", "", "ss_a"))),
        case("c", tables=()), case("d", parsed=False),
    ]
    log, _, refs, _ = build(spark, cases)
    got = {r.query_id: r.dialect for r in q.resolve_dialect(log, refs, sources).collect()}
    assert got == {0: "tsql", 1: "mysql", 2: "mysql", 3: "mysql"}


def test_tables_are_sorted_and_distinct(spark):
    _, _, refs, _ = build(spark, [case("a", tables=(("", "", "B"), ("", "", "a"), ("x", "y", "b")))])
    assert q.tables_of(refs).first().tables == ["a", "b"]


def test_unparsed_text_by_path(spark):
    log, shape, _, _ = build(spark, [case("x", parsed=False), case("x", parsed=False, tool="plug")])
    got = {r.query_id: r.audit_text for r in q.fail_closed(log, shape).collect()}
    assert got == {0: "<unparseable>", 1: ""}


def test_one_query_may_hold_most_facts(spark, book, policy, sources):
    """A third and more of all references belong to one query."""
    log, shape, _, _ = build(spark, [case(SELECT), case(SELECT), case(SELECT)])
    refs = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 2 + 1).otherwise(F.lit(0)).alias("query_id"),
        F.col("id").cast("int").alias("ord"), F.lit("").alias("catalog_name"), F.lit("").alias("schema_name"),
        F.when(F.col("id") == 29_999, "zzz").otherwise("summary").alias("table_name"),
    )
    uses = local_frame(spark, [], USES)
    rows = {r.query_id: r for r in q.judge(log, shape, refs, uses, book, policy, sources).collect()}
    assert rows[0].tables == ["summary", "zzz"] and rows[0].detail == "zzz"
    assert rows[1].code is None and rows[1].tables == ["summary"]


def test_text_is_not_shuffled_for_a_verdict(spark, book, policy, sources, tmp_path):
    frames = []
    for i, f in enumerate(build(spark, [c for c, *_ in CASES])):
        f.write.parquet(str(tmp_path / str(i)))
        frames.append(spark.read.parquet(str(tmp_path / str(i))))
    df = q.query_verdict(*frames, book, policy, sources)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in optimized.splitlines() if "Project" in line and "sql_text" in line]
    assert all("_variable" in line or "AS _analyzes" in line for line in joins)


def changed(book, policy, sources):
    """Rules before some change, for each thing that can change."""
    from dataclasses import replace

    from veilspark.operators.rejudge import Rules

    role = book.roles["developer"]
    others = [
        replace(role, allowed_tables=(*role.allowed_tables, "payroll", "b")), replace(role, allowed_tables=("detail",)),
        replace(role, max_union_depth=9), replace(role, allow_explain=False),
    ]
    books = [replace(book, roles={**book.roles, "developer": r}) for r in others]
    books += [replace(book, large_tables=frozenset({"summary"})), replace(book, filter_columns=frozenset({"level_1"}))]
    books += [replace(book, roles={"viewer": book.roles["viewer"]})]
    plain = replace(policy, rules={**policy.rules, "phone": policy.rules["amount"], "level_1": policy.rules["phone"]})
    return [Rules(b, policy, sources) for b in books] + [Rules(book, plain, sources), Rules(book, policy, replace(sources, routes=()))]


@pytest.mark.parametrize("i", range(9))
def test_only_touched_queries_are_judged_again(spark, book, policy, sources, i):
    from veilspark.operators.rejudge import Rules, change, rejudge, touched_queries

    frames = build(spark, [c for c, *_ in CASES])
    old, new = changed(book, policy, sources)[i], Rules(book, policy, sources)
    stored = q.query_verdict(*frames, old.book, old.policy, old.catalog)
    got = sorted(map(tuple, rejudge(stored, *frames, old, new).collect()))
    assert got == sorted(map(tuple, q.query_verdict(*frames, book, policy, sources).collect()))
    touched = touched_queries(frames[0], frames[2], frames[3], change(old, new)).count()
    assert 0 < touched and (touched < len(CASES) or i == 8)


def test_the_derived_log_is_dealt_out_before_its_texts_are_made(spark):
    """Few bytes of events make many texts; they are shuffled by id once, and neither the texts nor the facts again."""
    plan = audits.judged(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" in plan and "hashpartitioning(query_id" not in plan


def test_tokens_that_begin_like_numbers_names_and_comments(spark):
    text = "SELECT n, N'x', n1, .5, a.b, -1, - 2, a/b, 'q' -- c\n, [x], $1, `y`, \"z\" # d"
    rows = spark.createDataFrame([(d, text) for d in ("mysql", "tsql", "postgres")], "d string, s string")
    found = {r.d: r.t for r in rows.select("d", redact_literals(F.col("s"), F.col("d")).alias("t")).collect()}
    plain = "SELECT n, ?, n1, ?, a.b, -?, - ?, a/b, ? , [x], $?, `y`, \"z\" # d"
    assert found == {"mysql": "SELECT n, ?, n1, ?, a.b, -?, - ?, a/b, ? , [x], $?, `y`, ?", "tsql": plain, "postgres": plain}
