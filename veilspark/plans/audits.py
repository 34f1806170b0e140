"""Audit records of the derived query log."""

from __future__ import annotations

from contextlib import suppress

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from veilspark.errors import AccessDenied
from veilspark.functions.timezones import audit_local_time
from veilspark.operators import audit as oa
from veilspark.operators import querylog as q
from veilspark.operators.audited import AuditedSession
from veilspark.operators.governed import GovernedSession
from veilspark.plans.querylog import JUDGED, facts, fingerprint_sql, redact_sql
from veilspark.plans.registry import derive, derive_sql, plan, table
from veilspark.plans.settings import BOOK, POLICY, ROUTES, file_catalog, keys, residual_test_sql
from veilspark.sources.audit_log import read_audit, shared_folder, write_audit

_LOCAL = "strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S')"
_MICROS = "strftime(ts, '%f')"
_TS = f"{_LOCAL} || CASE WHEN {_MICROS} = '000000' THEN '' ELSE '.' || {_MICROS} END || '+08:00'"
_REDACTED = redact_sql("sql_text")
_CAPPED = f"""CASE WHEN {_REDACTED} = '<unparseable>' THEN '<unparseable>' WHEN dialect = 'tsql'
    THEN regexp_replace({_REDACTED}, '^((?i)select(?:\\s+(?:distinct|all))?)\\b', '\\1 TOP ?')
    ELSE regexp_replace({_REDACTED}, '[;\\s]+$', '') || ' LIMIT ?' END"""


def _text_sql(run: str) -> str:
    """The audit text; ``run`` tells which queries were run, with the cap put in."""
    return f"""CASE WHEN NOT parsed THEN CASE WHEN tool = 'execute_query' THEN '<unparseable>' ELSE '' END
    WHEN unlimited AND {run} THEN {_CAPPED} ELSE {_REDACTED} END"""


_RECORDS = f"""{JUDGED}, records AS (SELECT {_TS} AS ts, client, role, tool, {_text_sql('code IS NULL')} AS normalized_sql,
    tables, CASE WHEN code IS NULL THEN 'success' ELSE 'denied' END AS status,
    CASE WHEN code IS NULL THEN '' ELSE code || ': ' || detail END AS reason,
    duration_ms, query_id FROM judged)"""
_COLUMNS = f"""ts, client, role, tool, normalized_sql, {fingerprint_sql('normalized_sql')} AS sql_hash,
    tables, status, reason, duration_ms"""


def judged(spark, sf):
    return q.judge(*facts(spark, sf), BOOK, POLICY, ROUTES, redact=True)


def flat(records):
    """Arrays and absent values as plain text and numbers."""
    return records.select(
        "ts", "client", "role", "tool", "normalized_sql", "sql_hash",
        F.coalesce(F.array_join("tables", ","), F.lit("")).alias("tables"),
        "status",
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
    )


@plan("build_audit", f"{_RECORDS} SELECT {_COLUMNS} FROM records")
def build_audit(spark, sf):
    return flat(oa.build_audit(judged(spark, sf)))


@plan(
    "build_denied",
    f"""{JUDGED}, failed AS (SELECT *, CASE WHEN duration_ms > 400 THEN 'TimeoutError'
            WHEN duration_ms > 380 THEN 'OperationalError' END AS error_type FROM judged),
        records AS (SELECT client, {_text_sql('FALSE')} AS normalized_sql, tables,
            CASE WHEN code IS NOT NULL THEN code || ': ' || detail
            WHEN error_type = 'TimeoutError' THEN 'TIMEOUT: TimeoutError'
            ELSE 'SYNTAX_ERROR: ' || error_type END AS reason
            FROM failed WHERE code IS NOT NULL OR error_type IS NOT NULL)
        SELECT client, normalized_sql, tables, reason, 'denied' AS status, count(*) AS n
        FROM records GROUP BY ALL""",
)
def build_denied(spark, sf):
    error = F.when(F.col("duration_ms") > 400, "TimeoutError").when(
        F.col("duration_ms") > 380, "OperationalError"
    )
    records = flat(oa.build_denied(judged(spark, sf).withColumn("error_type", error)))
    return records.groupBy("client", "normalized_sql", "tables", "reason", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


_TIE = ("client", "role", "tool", "sql_hash", "status", "reason", "duration_ms")


@plan(
    "recent_audit",
    f"{_RECORDS} SELECT {_COLUMNS} FROM records ORDER BY judged_ts DESC, {' DESC, '.join(_TIE)} DESC LIMIT 100".replace(
        "duration_ms, query_id FROM judged)", "duration_ms, query_id, ts AS judged_ts FROM judged)"
    ),
)
def recent_audit(spark, sf):
    """The newest records; a limit above the maximum is clamped, and records that tie in all columns are equal."""
    return flat(oa.recent_audit(oa.build_audit(judged(spark, sf)), 5000, tie=_TIE))


_WRITTEN = f"""{_RECORDS} SELECT client, status, normalized_sql = '' AS no_text,
    reason <> '' AS has_reason, duration_ms <> 0 AS has_duration, count(*) AS n
    FROM records GROUP BY ALL"""


@plan("write_audit", _WRITTEN)
def write_audit_plan(spark, sf):
    """The written lines themselves: which fields are there and which left out."""
    path = shared_folder(spark, "audit")
    write_audit(oa.build_audit(judged(spark, sf)), path)
    line = F.col("value")
    return spark.read.text(path).select(
        F.get_json_object(line, "$.client").alias("client"),
        F.get_json_object(line, "$.status").alias("status"),
        (F.get_json_object(line, "$.normalized_sql") == "").alias("no_text"),
        F.array_contains(F.json_object_keys(line), "reason").alias("has_reason"),
        F.array_contains(F.json_object_keys(line), "duration_ms").alias("has_duration"),
    ).groupBy("client", "status", "no_text", "has_reason", "has_duration").agg(
        F.count(F.lit(1)).alias("n")
    )


@plan("read_audit", f"{_RECORDS} SELECT {_COLUMNS} FROM records")
def read_audit_plan(spark, sf):
    """Written as JSON lines with blank and broken lines between, and read back."""
    path = shared_folder(spark, "audit")
    write_audit(oa.build_audit(judged(spark, sf)), path)
    noise = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 3 == 0, "")
        .when(F.col("user_id") % 3 == 1, '{"ts": "2024')
        .otherwise("not json at all")
        .alias("value")
    )
    noise.write.mode("append").text(path)
    return flat(read_audit(spark, path))


def _answered(client: str, text: str, tables: str, masked: str, rows: str, tool: str = "execute_query") -> str:
    return f"""SELECT '{client}' AS client, 'developer' AS role, '{tool}' AS tool, '{text}' AS normalized_sql,
        '{tables}' AS tables, 'success' AS status, {masked} AS masked_columns, {rows} AS rows_returned, '' AS reason"""


def _refused(client: str, role: str, text: str, tables: str, reason: str, tool: str = "execute_query") -> str:
    return f"""SELECT '{client}', '{role}', '{tool}', '{text}', '{tables}', 'denied', '', 0::BIGINT, '{reason}'"""


_HITS = f"""(SELECT CASE WHEN count(*) = 0 THEN '' WHEN bool_or({' OR '.join(residual_test_sql('text', k)
    for k in ('id_card', 'bank_card', 'phone'))}) THEN 'text' ELSE '' END
    FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 5000))"""


@plan(
    "session_audit",
    " UNION ALL ".join(
        [
            _answered("ann", "SELECT c_name, c_acctbal FROM customer WHERE c_nationkey < ? LIMIT ?", "customer", "'c_name'",
                      "(SELECT least(count(*), 5000) FROM customer WHERE c_nationkey < 5)"),
            _answered("ann", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT ?", "documents", _HITS,
                      "(SELECT least(count(*), 5000) FROM documents)"),
            _answered("ann", "SELECT c_name FROM customer WHERE c_custkey < ? LIMIT ?", "customer", "''", "0::BIGINT"),
            _answered("bo", "SELECT n_name, count(*) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name LIMIT ?",
                      "customer,nation", "''", "(SELECT count(DISTINCT n_name) FROM nation JOIN customer ON c_nationkey = n_nationkey)",
                      "segments"),
            _refused("ann", "developer", "SELECT upper(c_name) AS status FROM customer WHERE c_custkey = ?", "customer",
                     "FUNCTION_DENIED: function on a sensitive column"),
            _refused("ann", "developer", "SELECT * FROM payroll", "payroll", "TABLE_NOT_ALLOWED: payroll"),
            _refused("bo", "viewer", "SELECT r_name FROM region", "", "ROLE_DENIED: generic queries are not allowed"),
            _refused("ann", "developer", "SELECT o_orderkey FROM orders", "orders", "FILTER_REQUIRED: orders"),
            _refused("ann", "developer", "SELECT no_such_column FROM nation", "nation", "SYNTAX_ERROR: AnalysisException"),
            _refused("bo", "viewer", "SELECT n_name FROM nation", "", "ROLE_DENIED: segments needs developer or higher", "segments"),
        ]
    ),
)
def session_audit(spark, sf):
    """Ten calls of three sessions, answered, refused and failed, and the records they left."""
    path = shared_folder(spark, "audit")
    opened = {
        (client, role): AuditedSession(GovernedSession.open(spark, role, BOOK, POLICY, file_catalog(sf), keys(spark), client), path)
        for client, role in (("ann", "developer"), ("bo", "developer"), ("bo", "viewer"))
    }
    ann, bo, viewer = opened.values()
    calls = [
        lambda: ann.sql("SELECT c_name, c_acctbal FROM {customer} WHERE c_nationkey < 5", ["customer"]),
        lambda: ann.sql("SELECT doc_id, text FROM {documents} ORDER BY doc_id", ["documents"]),
        lambda: ann.sql("SELECT c_name FROM {customer} WHERE c_custkey < 0", ["customer"]),
        lambda: bo.plugin_query(
            "SELECT n_name, count(*) AS total FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name",
            None, ["nation", "customer"], "segments", "developer",
        ),
        lambda: ann.sql("SELECT upper(c_name) AS status FROM {customer} WHERE c_custkey = 7", ["customer"]),
        lambda: ann.sql("SELECT * FROM {payroll}", ["payroll"]),
        lambda: viewer.sql("SELECT r_name FROM {region}", ["region"]),
        lambda: ann.sql("SELECT o_orderkey FROM {orders}", ["orders"]),
        lambda: ann.sql("SELECT no_such_column FROM {nation}", ["nation"]),
        lambda: viewer.plugin_query("SELECT n_name FROM {nation}", None, ["nation"], "segments", "developer"),
    ]
    for call in calls:
        with suppress(AccessDenied, AnalysisException):
            call()
    records = read_audit(spark, path)
    return records.select(
        "client", "role", "tool", "normalized_sql",
        F.coalesce(F.array_join("tables", ","), F.lit("")).alias("tables"),
        "status",
        F.coalesce(F.array_join("masked_columns", ","), F.lit("")).alias("masked_columns"),
        F.coalesce("rows_returned", F.lit(0)).alias("rows_returned"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


_ZONED = {
    "event_id": "event_id",
    "ts": "ts",
    "zone": "CASE user_id % 7 WHEN 0 THEN 'Asia/Shanghai' WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'UTC' "
            "WHEN 3 THEN 'America/Los_Angeles' WHEN 4 THEN 'America/New_York' "
            "WHEN 5 THEN 'Europe/London' ELSE 'Mars/Base' END",
}
_HOURS = (
    "CASE zone WHEN 'Asia/Tokyo' THEN 9 WHEN 'UTC' THEN 0 WHEN 'America/Los_Angeles' THEN -8 "
    "WHEN 'America/New_York' THEN -5 WHEN 'Europe/London' THEN 0 ELSE 8 END"
)


@plan(
    "audit_local_time",
    f"""SELECT event_id, strftime(ts + to_hours({_HOURS}), '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN {_MICROS} = '000000' THEN '' ELSE '.' || {_MICROS} END
        || CASE WHEN {_HOURS} < 0 THEN '-' ELSE '+' END || '0' || abs({_HOURS}) || ':00' AS local_ts
        FROM ({derive_sql('events', _ZONED)})""",
)
def audit_local_time_plan(spark, sf):
    zoned = derive(table(spark, sf, "events"), _ZONED)
    return zoned.select("event_id", audit_local_time(F.col("ts"), F.col("zone")).alias("local_ts"))
