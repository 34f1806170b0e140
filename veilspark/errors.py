"""Access denials: one exception type and the fixed code table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The denial codes are part of the contract with callers and
# audit readers. The texts are ours.
CODES: dict[str, str] = {
    "SYNTAX_ERROR": "The SQL could not be parsed",
    "MULTI_STATEMENT": "Only a single SQL statement is allowed",
    "STATEMENT_DENIED": "Only SELECT and EXPLAIN are allowed",
    "TABLE_NOT_ALLOWED": "No access to this table",
    "SYSTEM_TABLE_DENIED": "System schemas are off limits",
    "COLUMN_DENIED": "The column may not be used in this context",
    "FUNCTION_DENIED": "Functions may not be applied to a sensitive column",
    "UNION_DENIED": "UNION is not allowed here",
    "DANGEROUS_FUNCTION": "The function is banned",
    "USER_VARIABLE_DENIED": "User variables are not allowed",
    "FOR_UPDATE_DENIED": "Locking reads are not allowed",
    "ROW_LIMIT": "The result was truncated",
    "TIMEOUT": "The query timed out",
    "CONCURRENT_LIMIT": "Too many concurrent queries",
    "FILTER_REQUIRED": "Large tables need a filter on a time column",
    "EXPLAIN_ANALYZE_DENIED": "EXPLAIN ANALYZE is not allowed",
    "ROLE_DENIED": "The role may not use this feature",
    "UNKNOWN_COLUMN_DENIED": "Unregistered columns are denied by default",
}


class AccessDenied(Exception):
    """Raised while a governed plan is being built; carries a stable code."""

    def __init__(self, code: str, detail: str = ""):
        self.code = code
        self.detail = detail
        super().__init__(denial_text(code, detail))


def denial_text(code: str, detail: str = "") -> str:
    base = CODES.get(code, "Request denied")
    return f"{base}（{detail}）" if detail else base


def denial_message(code: Column, detail: Column) -> Column:
    """Column form of :func:`denial_text`; null code stays null."""
    base = F.lit("Request denied")
    for name, text in CODES.items():
        base = F.when(code == name, F.lit(text)).otherwise(base)
    with_detail = F.concat(base, F.lit("（"), detail, F.lit("）"))
    return F.when(
        code.isNotNull(),
        F.when(F.coalesce(detail, F.lit("")) != "", with_detail).otherwise(base),
    )
