"""Column expressions."""

from veilspark.functions.keys import TokenKeys
from veilspark.functions.masking import (
    deny,
    hash_id,
    is_placeholder,
    mask_email,
    mask_phone,
    nfkc,
    normalize_text,
    passthrough,
    residual_hit,
    residual_kind,
    residual_scan,
    tokenize,
)
from veilspark.functions.sqltext import (
    banned_function,
    has_lock,
    has_user_variable,
    redact_literals,
    sql_fingerprint,
    system_schema,
)
from veilspark.functions.timezones import audit_local_time

__all__ = [
    "TokenKeys",
    "audit_local_time",
    "banned_function",
    "deny",
    "has_lock",
    "has_user_variable",
    "hash_id",
    "is_placeholder",
    "mask_email",
    "mask_phone",
    "nfkc",
    "normalize_text",
    "passthrough",
    "redact_literals",
    "residual_hit",
    "residual_kind",
    "residual_scan",
    "sql_fingerprint",
    "system_schema",
    "tokenize",
]
