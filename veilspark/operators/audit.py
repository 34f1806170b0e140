"""Audit records built from judged queries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilspark.errors import AccessDenied
from veilspark.frames import local_frame
from veilspark.functions.sqltext import redact_literals, sql_fingerprint
from veilspark.functions.timezones import audit_local_time
from veilspark.operators.querylog import audit_text
from veilspark.sources.audit_log import audit_layout

DEFAULT_RECENT = 20
MAX_RECENT = 100


def _record(df: DataFrame, status: Column, reason: Column, tz_name: Column | str) -> DataFrame:
    parsed = F.col("parsed") if "parsed" in df.columns else F.lit(True)
    if "redacted" not in df.columns:
        df = df.withColumn("redacted", redact_literals(F.col("sql_text"), F.col("dialect")))
    # What was run had the role's cap in it; what was refused is kept as it was sent.
    capped = F.col("unlimited") & (status == "success") if "unlimited" in df.columns else F.lit(False)
    text = audit_text(parsed, F.col("tool"), F.col("redacted"), F.col("dialect"), capped)
    named = (
        df.withColumn("normalized_sql", text)
        .withColumn("sql_hash", sql_fingerprint(F.col("normalized_sql")))
        .withColumn("ts", audit_local_time(F.col("ts"), tz_name))
        .withColumn("status", status)
        .withColumn("reason", reason)
    )
    return audit_layout(named)


def denial_reason(code: Column, detail: Column) -> Column:
    return F.concat(code, F.lit(": "), F.coalesce(detail, F.lit("")))


def build_audit(events: DataFrame, tz_name: Column | str = "Asia/Shanghai") -> DataFrame:
    """One record per judged query: literal-free text, never values or results.

    ``events`` has the columns of ``querylog.judge`` (best with ``redact``) and optionally
    ``masked_columns, columns_accessed, rows_returned, duration_ms``.
    """
    denied = F.col("code").isNotNull()
    status = F.when(denied, "denied").otherwise("success")
    reason = F.when(denied, denial_reason(F.col("code"), F.col("detail")))
    return _record(events, status, reason, tz_name)


def build_denied(verdicts: DataFrame, tz_name: Column | str = "Asia/Shanghai") -> DataFrame:
    """Records of refused and failed queries only.

    ``error_type``, if present, names an execution failure: a timeout or, for
    anything else, the generic code with the type of the error.
    """
    code, detail = F.col("code"), F.col("detail")
    reason = denial_reason(code, detail)
    failed = code.isNotNull()
    if "error_type" in verdicts.columns:
        error = F.col("error_type")
        kind = F.when(error == "TimeoutError", "TIMEOUT").otherwise("SYNTAX_ERROR")
        reason = F.when(code.isNotNull(), reason).otherwise(F.concat(kind, F.lit(": "), error))
        failed = failed | error.isNotNull()
    return _record(verdicts.where(failed), F.lit("denied"), reason, tz_name)


def audit_event(
    spark: SparkSession,
    client: str,
    role: str,
    tool: str,
    sql_text: str,
    tables: Sequence[str],
    dialect: str = "mysql",
    denied: AccessDenied | None = None,
    masked_columns: Sequence[str] = (),
    rows_returned: int = 0,
    duration_ms: int = 0,
    at: datetime | None = None,
    error_type: str | None = None,
    unlimited: bool = False,
) -> DataFrame:
    """One query of a session as input for :func:`build_audit`, or :func:`build_denied` if it was refused or failed."""
    now = at or datetime.now(timezone.utc).replace(tzinfo=None)
    row = (
        client, role, tool, now, sql_text, dialect, denied and denied.code, denied and denied.detail,
        list(tables), list(masked_columns), rows_returned, duration_ms, error_type, unlimited,
    )
    return local_frame(
        spark,
        [row],
        "client string, role string, tool string, ts timestamp_ntz, sql_text string, dialect string,"
        " code string, detail string, tables array<string>, masked_columns array<string>,"
        " rows_returned long, duration_ms long, error_type string, unlimited boolean",
    )


def clamp_recent(limit: int = DEFAULT_RECENT) -> int:
    return min(max(1, limit), MAX_RECENT)


def recent_audit(audit: DataFrame, limit: int = DEFAULT_RECENT, tie: Sequence[str] = ()) -> DataFrame:
    """The newest records first; a distributed top-k of at most a hundred rows.

    A record whose time can't be read comes last. Records of one time are ordered by the
    columns of ``tie``, largest first.
    """
    order = [F.try_to_timestamp("ts").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie]]
    return audit.orderBy(*order).limit(clamp_recent(limit))
