"""Verdicts over a query log derived from the events table.

Each event becomes one logged query: a template chosen from its ids, with the
ids as literals in the text. The lineage facts of the templates stand in for a
lineage feed.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from veilspark.frames import local_frame
from veilspark.functions import sqltext as tx
from veilspark.operators import querylog as q
from veilspark.operators.rejudge import Rules, rejudge
from veilspark.plans.governed import (
    allowed_sql,
    source_sql,
    table_code_sql,
    table_detail_sql,
)
from veilspark.plans.registry import PLANS, derive, derive_sql, in_list, plan, quote, table, values_sql
from veilspark.plans.settings import BOOK, POLICY, ROUTES
from veilspark.sources.audit_log import shared_folder

# (text, dialect, type, statements, union depth, limit, has where, tables, uses);
# tables are (catalog, schema, name), uses are (column, context, function).
_W = ("c_custkey", "where", "")
_TIME = ("o_orderdate", "where", "")
TEMPLATES = [
    ("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = {u}", "mysql", "select", 1, 0, None, True,
     [("", "", "customer")], [("c_name", "select", ""), ("c_acctbal", "select", ""), _W]),
    ("SELECT o_orderkey FROM orders  WHERE o_orderdate >= '1997-01-01' AND o_custkey = {u} LIMIT 100",
     "mysql", "select", 1, 0, 100, True, [("", "", "orders")], [_TIME, ("o_custkey", "where", "")]),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {u}", "mysql", "select", 1, 0, None, True,
     [("", "", "orders")], [("o_custkey", "where", "")]),
    ("SELECT l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "mysql", "select", 1, 0, None,
     False, [("", "", "lineitem"), ("", "", "Orders")], [("l_quantity", "select", "")]),
    ("SELECT * FROM payroll WHERE id = {u}", "mysql", "select", 1, 0, None, True, [("", "", "payroll")], []),
    ("SELECT user FROM mysql.user", "mysql", "select", 1, 0, None, False, [("", "mysql", "user")], []),
    ("SELECT c_acctbal FROM other_db.customer", "mysql", "select", 1, 0, None, False,
     [("", "other_db", "customer")], [("c_acctbal", "select", "")]),
    ("SELECT SLEEP({u}) FROM customer", "mysql", "select", 1, 0, None, False, [("", "", "customer")], []),
    ("SELECT * FROM OPENROWSET('SQLNCLI', 'server={u}', 'SELECT 1')", "tsql", "select", 1, 0, None, False, [], []),
    ("SELECT @v := c_acctbal FROM customer", "mysql", "select", 1, 0, None, False, [("", "", "customer")], []),
    ("SELECT c_acctbal FROM customer WHERE c_name = 'x{u}@example.com'", "mysql", "select", 1, 0, None, True,
     [("", "", "customer")], [("c_acctbal", "select", ""), ("c_name", "where", "")]),
    ("SELECT c_acctbal FROM customer WHERE c_custkey = {u} FOR  UPDATE", "mysql", "select", 1, 0, None, True,
     [("", "", "customer")], [("c_acctbal", "select", ""), _W]),
    ("SELECT c_acctbal FROM customer WITH (NOLOCK) WHERE c_custkey = {u}", "tsql", "select", 1, 0, None, True,
     [("", "", "customer")], [("c_acctbal", "select", ""), _W]),
    ("SELECT c_acctbal FROM customer WITH (NOLOCK) WHERE c_custkey = {u}", "mysql", "select", 1, 0, 20, True,
     [("", "", "customer")], [("c_acctbal", "select", ""), _W]),
    ("SELECT 1; DROP TABLE customer", "mysql", "select", 2, 0, None, False, [("", "", "customer")], []),
    ("DELETE FROM customer WHERE c_custkey = {u}", "mysql", "delete", 1, 0, None, True, [("", "", "customer")], [_W]),
    ("EXPLAIN SELECT c_acctbal FROM customer", "mysql", "explain", 1, 0, None, False, [], []),
    ("EXPLAIN ANALYZE SELECT c_acctbal FROM customer", "mysql", "explain", 1, 0, None, False, [], []),
    ("DESCRIBE customer", "mysql", "describe", 1, 0, None, False, [("", "", "customer")], []),
    ("SELECT c_acctbal FROM customer WHERE c_custkey = {u} UNION ALL SELECT s_acctbal FROM supplier", "mysql",
     "union", 1, 1, None, True, [("", "", "customer"), ("", "", "supplier")],
     [("c_acctbal", "select", ""), _W, ("s_acctbal", "select", "")]),
    ("SELECT 1 FROM nation UNION SELECT 2 FROM nation UNION SELECT 3 FROM region UNION SELECT {u} FROM region",
     "mysql", "union", 1, 3, None, False, [("", "", "nation"), ("", "", "region"), ("", "", "nation")], []),
    ("SELECT UPPER(c_name) FROM customer WHERE c_custkey = {u}", "mysql", "select", 1, 0, None, True,
     [("", "", "customer")], [("c_name", "function", "upper"), ("c_name", "select", ""), _W]),
    ("SELECT c_name FROM customer ORDER BY c_name", "mysql", "select", 1, 0, None, False,
     [("", "", "customer")], [("c_name", "select", ""), ("c_name", "order_by", "")]),
    ("SELECT C_Name, count(*) FROM customer GROUP BY C_Name HAVING C_Name > 'b{u}'", "mysql", "select", 1, 0,
     None, False, [("", "", "customer")],
     [("C_Name", "select", ""), ("C_Name", "group_by", ""), ("C_Name", "having", "")]),
    ("SELECT CASE WHEN c_name = 'a' THEN {u} END FROM customer", "mysql", "select", 1, 0, None, False,
     [("", "", "customer")], [("c_name", "case", "")]),
    ("SELECT c_name || '{e}' FROM customer", "postgres", "select", 1, 0, None, False,
     [("", "", "customer")], [("c_name", "arithmetic", "")]),
    ("SELECT UPPER(c_mktsegment) FROM customer WHERE c_custkey IN ({u}, {e}) LIMIT 99999", "mysql", "select", 1, 0,
     99999, True, [("", "", "customer")], [("c_mktsegment", "function", "upper"), _W]),
    None,  # text that nothing could parse: no facts
    ("SELECT c_acctbal FROM sales.dbo.customer WHERE c_custkey = {u}", "tsql", "select", 1, 0, None, True,
     [("Sales", "dbo", "customer")], [("c_acctbal", "select", ""), _W]),
    ("SELECT * FROM master..sysobjects", "tsql", "select", 1, 0, None, False, [("master", "", "sysobjects")], []),
    ("SELECT c_acctbal FROM customer WHERE c_mktsegment = 'sleep({u})' -- {e}", "mysql", "select", 1, 0, 7, True,
     [("", "", "customer")], [("c_acctbal", "select", ""), ("c_mktsegment", "where", "")]),
    ("SELECT c_acctbal INTO OUTFILE '/tmp/{u}' FROM customer", "mysql", "select", 1, 0, None, False,
     [("", "", "customer")], [("c_acctbal", "select", "")]),
    ("SELECT c_acctbal FROM customer WHERE c_mktsegment = 'it''s {u}' AND c_acctbal > 1.5e3", "mysql", "select",
     1, 0, None, True, [("", "", "customer")], [("c_acctbal", "select", ""), ("c_mktsegment", "where", "")]),
    ("SELECT c_name FROM customer ORDER BY c_name, LENGTH(c_name)", "mysql", "select", 1, 0, None, False,
     [("", "", "customer")], [("c_name", "order_by", ""), ("c_name", "function", "length")]),
    ("BULK INSERT customer FROM 'C:\\{u}.csv'", "tsql", "command", 1, 0, None, False, [], []),
    ("SELECT l_quantity FROM lineitem WHERE l_shipdate > '1998-09-02' AND l_quantity > {u}", "mysql", "select",
     1, 0, 0, True, [("", "", "lineitem")], [("l_shipdate", "where", ""), ("l_quantity", "where", "")]),
    ("SELECT n_regionkey FROM nation WHERE n_nationkey = {u} LIMIT 4000", "mysql", "select", 1, 0, 4000, True,
     [("", "", "nation")], [("n_regionkey", "select", ""), ("n_nationkey", "where", "")]),
    ("SELECT n FROM ods_orders WHERE x = 'open {u}", "postgres", "select", 1, 0, None, True,
     [("", "", "ods_orders")], [("x", "where", "")]),
]
BROKEN = "THIS IS {u} NOT SQL !!!"
_N = len(TEMPLATES)

LOG = {
    "query_id": "event_id",
    "tmpl": f"(event_id * 7 + user_id) % {_N}",
    "role": "CASE user_id % 5 WHEN 0 THEN 'viewer' WHEN 4 THEN 'guest' ELSE 'developer' END",
    "client": "'agent-' || user_id",
    "tool": "CASE WHEN event_type = 'purchase' THEN 'query_summary' ELSE 'execute_query' END",
    "ts": "ts",
    "user_id": "user_id",
    "duration_ms": "CASE WHEN event_type = 'view' THEN 0 ELSE user_id * 3 END",
}
_TEXT_ROWS = [
    (i, t[0] if t else BROKEN, t[1] if t else "mysql") for i, t in enumerate(TEMPLATES)
]
_SHAPE_ROWS = [(i, t[2], t[3], t[4], t[5], t[6]) for i, t in enumerate(TEMPLATES) if t]
_REF_ROWS = [
    (i, n, *ref) for i, t in enumerate(TEMPLATES) if t for n, ref in enumerate(t[7])
]
_USE_ROWS = [
    (i, n, *use) for i, t in enumerate(TEMPLATES) if t for n, use in enumerate(t[8])
]


def _templated(spark, log, rows, schema):
    """Attach template rows; the list is written above, hence a fixed-size broadcast."""
    return log.join(F.broadcast(local_frame(spark, rows, schema)), "tmpl")


def _events(spark, sf):
    """The events dealt out by id: a few bytes of a row make much text, so files are split too coarsely for the work on it.

    All joins and sums by query id find their rows where they need them.
    """
    return table(spark, sf, "events").repartition("event_id")


def query_log(spark, sf):
    log = derive(_events(spark, sf), LOG)
    texts = _templated(spark, log, _TEXT_ROWS, "tmpl long, text string, dialect string")
    user, event = F.col("user_id").cast("string"), F.col("query_id").cast("string")
    filled = F.replace(F.replace("text", F.lit("{u}"), user), F.lit("{e}"), event)
    return texts.select(
        "query_id", "role", "client", "tool", "ts", filled.alias("sql_text"), "dialect", "duration_ms"
    )


def _ids(spark, sf):
    return derive(_events(spark, sf), {k: LOG[k] for k in ("query_id", "tmpl")})


def query_shape(spark, sf):
    schema = (
        "tmpl long, statement_type string, n_statements int, union_depth int,"
        " limit_value int, has_where boolean"
    )
    return _templated(spark, _ids(spark, sf), _SHAPE_ROWS, schema).drop("tmpl")


def query_tables(spark, sf):
    schema = "tmpl long, ord int, catalog_name string, schema_name string, table_name string"
    return _templated(spark, _ids(spark, sf), _REF_ROWS, schema).drop("tmpl")


def query_column_uses(spark, sf):
    schema = "tmpl long, ord int, column_name string, context string, func string"
    return _templated(spark, _ids(spark, sf), _USE_ROWS, schema).drop("tmpl")


def facts(spark, sf):
    return (
        query_log(spark, sf), query_shape(spark, sf), query_tables(spark, sf),
        query_column_uses(spark, sf),
    )


# --- the same tables and checks in SQL --------------------------------------

_IDS = derive_sql("events", {k: LOG[k] for k in ("query_id", "tmpl")})
WITH = f"""WITH log AS (
    SELECT query_id, role, client, tool, ts, duration_ms, dialect,
           replace(replace(text, '{{u}}', '' || user_id), '{{e}}', '' || query_id) AS sql_text
    FROM ({derive_sql('events', LOG)}) l
    JOIN {values_sql(_TEXT_ROWS, ['t', 'text', 'dialect'], 'v')} ON tmpl = t),
shape AS (SELECT query_id, statement_type, n_statements, union_depth, limit_value, has_where
    FROM ({_IDS}) l JOIN {values_sql(_SHAPE_ROWS, ['t', 'statement_type', 'n_statements', 'union_depth',
                                                  'limit_value', 'has_where'], 'v')} ON tmpl = t),
refs AS (SELECT query_id, ord, catalog_name, schema_name, table_name
    FROM ({_IDS}) l JOIN {values_sql(_REF_ROWS, ['t', 'ord', 'catalog_name', 'schema_name', 'table_name'],
                                    'v')} ON tmpl = t),
uses AS (SELECT query_id, ord, column_name, context, func
    FROM ({_IDS}) l JOIN {values_sql(_USE_ROWS, ['t', 'ord', 'column_name', 'context', 'func'], 'v')}
    ON tmpl = t)"""

_MY_STRING = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\""""
_STRING = r"""'(?:[^']|'')*'"""
_NAME = r'"(?:[^"]|"")*"'
_MY_COMMENT = r"--[^\n]*|#[^\n]*|/\*.*?\*/"
_COMMENT = r"--[^\n]*|/\*.*?\*/"
_NUMBER = r"(^|[^\w.])(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b"


def _redact_sql(c: str, strings: str, keep: str, comments: str, open_quotes: str) -> str:
    stripped = f"regexp_replace({c}, {quote(f'(?s)({keep})|(?:{comments})')}, '\\1 ', 'g')"
    bare = f"CASE WHEN regexp_matches({c}, '--|/[*]|#') THEN {stripped} ELSE {c} END"
    strings_out = rf"(?s)(?:\b[nN])?(?:{strings})"
    no_strings = f"regexp_replace({bare}, {quote(strings_out)}, '?', 'g')"
    numbers = f"regexp_replace({no_strings}, {quote(_NUMBER)}, '\\1?', 'g')"
    return (
        f"CASE WHEN regexp_matches({no_strings}, {quote(open_quotes)}) THEN '<unparseable>' "
        f"ELSE trim(regexp_replace({numbers}, '\\s+', ' ', 'g')) END"
    )


def redact_sql(c: str) -> str:
    mysql = _redact_sql(c, _MY_STRING, _MY_STRING, _MY_COMMENT, "['\"]")
    plain = _redact_sql(c, _STRING, f"{_STRING}|{_NAME}", _COMMENT, "'")
    return f"CASE WHEN dialect = 'mysql' THEN {mysql} ELSE {plain} END"


def fingerprint_sql(c: str) -> str:
    return f"'sha256:' || substr(sha256({c}), 1, 16)"


def flag_sql(attribute: str, otherwise: str) -> str:
    arms = " ".join(
        f"WHEN '{r.name}' THEN {str(getattr(r, attribute)).upper()}" for r in BOOK.roles.values()
    )
    return f"CASE role {arms} ELSE {otherwise} END"


def _case(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " END"


_EXPLAIN = flag_sql("allow_explain", "FALSE")
_STATEMENT = [
    ("n_statements <> 1", "'MULTI_STATEMENT'", "''"),
    ("statement_type IN ('select', 'union', 'subquery')", "NULL", "NULL"),
    (f"statement_type = 'explain' AND NOT ({_EXPLAIN})", "'STATEMENT_DENIED'",
     "'EXPLAIN is not allowed for this role'"),
    ("statement_type = 'explain' AND upper(sql_text) LIKE '%ANALYZE%'", "'EXPLAIN_ANALYZE_DENIED'", "''"),
    (f"statement_type = 'describe' AND NOT ({_EXPLAIN})", "'STATEMENT_DENIED'",
     "'DESCRIBE is not allowed for this role'"),
    ("statement_type IN ('explain', 'describe')", "NULL", "NULL"),
    ("TRUE", "'STATEMENT_DENIED'", "''"),
]
STATEMENT_CODE = _case([(c, v) for c, v, _ in _STATEMENT])
STATEMENT_DETAIL = _case([(c, d) for c, _, d in _STATEMENT])
VARIABLE_TEST = "regexp_matches(sql_text, '(^|[^@])@[a-zA-Z_]')"
_HINTS = "|".join(tx.LOCK_HINTS)
LOCK_TEST = (
    "(regexp_matches(sql_text, '(?i)for\\s+update|lock\\s+in\\s+share\\s+mode')"
    f" OR regexp_matches({redact_sql('sql_text')}, '(?i)\\bfor\\s+share\\b')"
    f" OR (dialect = 'tsql' AND regexp_matches(sql_text, '(?i)with\\s*\\(\\s*({_HINTS})')))"
)


def _called(kind: str) -> str:
    names = "|".join(tx.BANNED_FUNCTIONS[kind])
    return f"nullif(regexp_extract({redact_sql('sql_text')}, '(?i)(^|[^\\w@])({names})\\s*\\(', 2), '')"


FUNCTION_NAME = _case(
    [
        ("dialect = 'tsql'",
         f"coalesce({_called('tsql')}, CASE WHEN regexp_matches(sql_text, '(?i)bulk\\s+insert') THEN 'BULK INSERT' END)"),
        ("dialect = 'mysql'",
         f"coalesce({_called('mysql')}, CASE WHEN regexp_matches(sql_text, '(?i)into\\s+(outfile|dumpfile)')"
         " THEN 'INTO OUTFILE/DUMPFILE' END)"),
        ("TRUE", _called("mysql")),
    ]
)
_ALLOWED = allowed_sql("role", "table_name")
TABLE_FACTS = f"""SELECT query_id, arg_min(code, ord) FILTER (code IS NOT NULL) AS table_code,
    arg_min(detail, ord) FILTER (code IS NOT NULL) AS table_detail
    FROM (SELECT query_id, ord, {table_code_sql(_ALLOWED)} AS code, {table_detail_sql(_ALLOWED)} AS detail
          FROM refs JOIN log USING (query_id)) GROUP BY query_id"""
_UNION_OK = flag_sql("allow_union", "FALSE")
_UNION_MAX = flag_sql("max_union_depth", "2")
UNION_CODE = f"""CASE WHEN union_depth > 0 AND (NOT ({_UNION_OK}) OR union_depth > {_UNION_MAX})
    THEN 'UNION_DENIED' END"""
UNION_DETAIL = f"""CASE WHEN union_depth > 0 AND NOT ({_UNION_OK}) THEN ''
    WHEN union_depth > {_UNION_MAX} THEN 'depth ' || union_depth || ' exceeds ' || {_UNION_MAX} END"""
USE_FACTS = f"""SELECT query_id, arg_min(code, r) AS column_code, arg_min(detail, r) AS column_detail
    FROM (SELECT query_id,
        (CASE context WHEN 'function' THEN 0 WHEN 'order_by' THEN 1 WHEN 'having' THEN 2
         WHEN 'case' THEN 3 ELSE 4 END) * 1000 + ord AS r,
        CASE context WHEN 'function' THEN 'FUNCTION_DENIED' ELSE 'COLUMN_DENIED' END AS code,
        CASE context WHEN 'function' THEN 'function ' || upper(func) || ' on sensitive column ' || column_name
        ELSE 'sensitive column ' || column_name || ' in ' || upper(replace(context, '_', ' ')) END AS detail
        FROM uses WHERE context IN ('function', 'order_by', 'having', 'case', 'arithmetic')
        AND lower(column_name) IN {in_list(POLICY.sensitive_columns)}) GROUP BY query_id"""
_LARGE = in_list(BOOK.large_tables)
_FILTERS = in_list(BOOK.filter_columns)
FILTER_FACTS = f"""SELECT query_id, string_agg(name, ', ' ORDER BY name) AS filter_detail
    FROM (SELECT DISTINCT query_id, lower(table_name) AS name FROM refs WHERE lower(table_name) IN {_LARGE})
    JOIN shape USING (query_id)
    WHERE NOT has_where OR query_id NOT IN (SELECT query_id FROM uses
        WHERE context = 'where' AND lower(column_name) IN {_FILTERS})
    GROUP BY query_id"""
_CAP = flag_sql("max_rows", "1000")
LIMIT_SQL = f"""CASE WHEN statement_type = 'select' THEN
    CAST(CASE WHEN limit_value IS NULL OR limit_value < 0 OR limit_value > {_CAP} THEN {_CAP}
    ELSE limit_value END AS BIGINT) END"""
TABLES_SQL = """SELECT query_id, string_agg(name, ',' ORDER BY name) AS tables
    FROM (SELECT DISTINCT query_id, lower(table_name) AS name FROM refs WHERE table_name <> '')
    GROUP BY query_id"""

JUDGED = f"""{WITH},
judged AS (SELECT query_id, role, client, tool, ts, sql_text, dialect, duration_ms,
    statement_type IS NOT NULL AS parsed, coalesce(tables, '') AS tables, {LIMIT_SQL} AS effective_limit,
    coalesce(statement_type = 'select' AND limit_value IS NULL, FALSE) AS unlimited,
    CASE WHEN statement_type IS NULL THEN 'SYNTAX_ERROR'
         WHEN {STATEMENT_CODE} IS NOT NULL THEN {STATEMENT_CODE}
         WHEN {VARIABLE_TEST} THEN 'USER_VARIABLE_DENIED'
         WHEN {LOCK_TEST} THEN 'FOR_UPDATE_DENIED'
         WHEN {FUNCTION_NAME} IS NOT NULL THEN 'DANGEROUS_FUNCTION'
         WHEN table_code IS NOT NULL THEN table_code
         WHEN {UNION_CODE} IS NOT NULL THEN 'UNION_DENIED'
         WHEN column_code IS NOT NULL THEN column_code
         WHEN filter_detail IS NOT NULL THEN 'FILTER_REQUIRED' END AS code,
    CASE WHEN statement_type IS NULL THEN ''
         WHEN {STATEMENT_CODE} IS NOT NULL THEN {STATEMENT_DETAIL}
         WHEN {VARIABLE_TEST} THEN ''
         WHEN {LOCK_TEST} THEN ''
         WHEN {FUNCTION_NAME} IS NOT NULL THEN {FUNCTION_NAME}
         WHEN table_code IS NOT NULL THEN table_detail
         WHEN {UNION_CODE} IS NOT NULL THEN {UNION_DETAIL}
         WHEN column_code IS NOT NULL THEN column_detail
         WHEN filter_detail IS NOT NULL THEN filter_detail END AS detail
    FROM log LEFT JOIN shape USING (query_id) LEFT JOIN ({TABLE_FACTS}) USING (query_id)
    LEFT JOIN ({USE_FACTS}) USING (query_id) LEFT JOIN ({FILTER_FACTS}) USING (query_id)
    LEFT JOIN ({TABLES_SQL}) USING (query_id))"""


def message_sql() -> str:
    from veilspark.errors import CODES

    arms = " ".join(f"WHEN '{c}' THEN {quote(t)}" for c, t in CODES.items())
    return f"CASE code {arms} END || CASE WHEN detail <> '' THEN '（' || detail || '）' ELSE '' END"


# --- plans -------------------------------------------------------------------


@plan("redact_literals", f"{WITH} SELECT query_id, {redact_sql('sql_text')} AS normalized FROM log")
def redact_literals(spark, sf):
    log = query_log(spark, sf)
    return log.select(
        "query_id", tx.redact_literals(F.col("sql_text"), F.col("dialect")).alias("normalized")
    )


@plan(
    "sql_fingerprint",
    f"""{WITH}, n AS (SELECT {redact_sql('sql_text')} AS normalized FROM log)
        SELECT {fingerprint_sql('normalized')} AS sql_hash, count(*) AS n FROM n GROUP BY ALL""",
)
def sql_fingerprint(spark, sf):
    normalized = tx.redact_literals(F.col("sql_text"), F.col("dialect"))
    hashed = query_log(spark, sf).select(tx.sql_fingerprint(normalized).alias("sql_hash"))
    return hashed.groupBy("sql_hash").agg(F.count(F.lit(1)).alias("n"))


_DIALECTS = " ".join(f"WHEN {quote(s.name)} THEN {quote(s.dialect)}" for s in ROUTES.sources.values())


@plan(
    "resolve_dialect",
    f"""{WITH} SELECT query_id, CASE CASE WHEN first_table IS NULL THEN 'default'
        ELSE {source_sql('first_table')} END {_DIALECTS} ELSE 'mysql' END AS dialect
        FROM log LEFT JOIN (SELECT query_id, arg_min(table_name, ord) AS first_table FROM refs
        GROUP BY query_id) USING (query_id)""",
)
def resolve_dialect(spark, sf):
    return q.resolve_dialect(query_log(spark, sf), query_tables(spark, sf), ROUTES)


@plan(
    "check_statements",
    f"""{WITH} SELECT query_id, {STATEMENT_CODE} AS code, {STATEMENT_DETAIL} AS detail
        FROM log JOIN shape USING (query_id) WHERE {STATEMENT_CODE} IS NOT NULL""",
)
def check_statements(spark, sf):
    return q.check_statements(query_log(spark, sf), query_shape(spark, sf), BOOK)


@plan(
    "check_user_variables",
    f"{WITH} SELECT query_id, 'USER_VARIABLE_DENIED' AS code, '' AS detail FROM log WHERE {VARIABLE_TEST}",
)
def check_user_variables(spark, sf):
    return q.check_user_variables(query_log(spark, sf))


@plan(
    "check_locks",
    f"{WITH} SELECT query_id, 'FOR_UPDATE_DENIED' AS code, '' AS detail FROM log WHERE {LOCK_TEST}",
)
def check_locks(spark, sf):
    return q.check_locks(query_log(spark, sf))


@plan(
    "check_functions",
    f"""{WITH} SELECT query_id, 'DANGEROUS_FUNCTION' AS code, {FUNCTION_NAME} AS detail
        FROM log WHERE {FUNCTION_NAME} IS NOT NULL""",
)
def check_functions(spark, sf):
    return q.check_functions(query_log(spark, sf))


@plan(
    "check_tables",
    f"""{WITH} SELECT query_id, table_code AS code, table_detail AS detail FROM ({TABLE_FACTS})
        WHERE table_code IS NOT NULL""",
)
def check_tables(spark, sf):
    return q.check_tables(query_log(spark, sf), query_tables(spark, sf), BOOK, ROUTES)


@plan(
    "check_union",
    f"""{WITH} SELECT query_id, {UNION_CODE} AS code, {UNION_DETAIL} AS detail
        FROM log JOIN shape USING (query_id) WHERE {UNION_CODE} IS NOT NULL""",
)
def check_union(spark, sf):
    return q.check_union(query_log(spark, sf), query_shape(spark, sf), BOOK)


@plan(
    "check_column_uses",
    f"{WITH} SELECT query_id, column_code AS code, column_detail AS detail FROM ({USE_FACTS})",
)
def check_column_uses(spark, sf):
    return q.check_column_uses(query_column_uses(spark, sf), POLICY, BOOK)


@plan(
    "check_large_filters",
    f"{WITH} SELECT query_id, 'FILTER_REQUIRED' AS code, filter_detail AS detail FROM ({FILTER_FACTS})",
)
def check_large_filters(spark, sf):
    return q.check_large_filters(
        query_shape(spark, sf), query_tables(spark, sf), query_column_uses(spark, sf), BOOK
    )


@plan(
    "effective_limit",
    f"""{WITH} SELECT query_id, {LIMIT_SQL} AS effective_limit FROM log JOIN shape USING (query_id)
        WHERE statement_type = 'select'""",
)
def effective_limit(spark, sf):
    return q.limits(query_log(spark, sf), query_shape(spark, sf), BOOK)


@plan("tables_of", f"{WITH} {TABLES_SQL}")
def tables_of(spark, sf):
    found = q.tables_of(query_tables(spark, sf))
    return found.select("query_id", F.array_join("tables", ",").alias("tables"))


@plan(
    "fail_closed",
    f"""{WITH} SELECT query_id, 'SYNTAX_ERROR' AS code,
        CASE WHEN tool = 'execute_query' THEN '<unparseable>' ELSE '' END AS audit_text
        FROM log WHERE query_id NOT IN (SELECT query_id FROM shape)""",
)
def fail_closed(spark, sf):
    return q.fail_closed(query_log(spark, sf), query_shape(spark, sf))


@plan(
    "query_verdict",
    f"""{JUDGED} SELECT query_id, coalesce(code, 'ok') AS code, coalesce(detail, '') AS detail,
        coalesce({message_sql()}, '') AS message FROM judged""",
)
def query_verdict(spark, sf):
    verdicts = q.query_verdict(*facts(spark, sf), BOOK, POLICY, ROUTES)
    return verdicts.select(
        "query_id",
        F.coalesce("code", F.lit("ok")).alias("code"),
        F.coalesce("detail", F.lit("")).alias("detail"),
        F.coalesce("message", F.lit("")).alias("message"),
    )


@plan(
    "verdict_summary",
    f"""{JUDGED} SELECT role, coalesce(code, 'ok') AS code, count(*) AS n FROM judged GROUP BY ALL""",
)
def verdict_summary(spark, sf):
    judged = q.judge(*facts(spark, sf), BOOK, POLICY, ROUTES)
    return judged.groupBy("role", F.coalesce("code", F.lit("ok")).alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )


# What was in force before: other tables, another cap on unions, another sensitive column, another large table.
_BEFORE = Rules(
    replace(
        BOOK,
        roles={
            **BOOK.roles,
            "developer": replace(
                BOOK.roles["developer"], allowed_tables=(*(BOOK.roles["developer"].allowed - {"supplier"}), "payroll")
            ),
        },
        large_tables=BOOK.large_tables - {"lineitem"},
    ),
    replace(POLICY, rules={c: replace(r, action="deny") if c == "c_mktsegment" else r for c, r in POLICY.rules.items()}),
    ROUTES,
)


@plan("rejudged_verdicts", PLANS["query_verdict"].sql)
def rejudged_verdicts(spark, sf):
    """Verdicts made under other rules, stored, and brought up to date: as good as judged anew."""
    path = shared_folder(spark, "verdicts")
    q.query_verdict(*facts(spark, sf), _BEFORE.book, _BEFORE.policy, _BEFORE.catalog).write.parquet(path)
    verdicts = rejudge(spark.read.parquet(path), *facts(spark, sf), _BEFORE, Rules(BOOK, POLICY, ROUTES))
    return verdicts.select("query_id", *[F.coalesce(c, F.lit("ok" if c == "code" else "")).alias(c) for c in ("code", "detail", "message")])
