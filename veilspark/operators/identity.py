"""Who sent a request and what the role may do, over whole access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.functions.masking import hash_id
from veilspark.operators.querylog import role_value
from veilspark.policy import ROLE_RANK, RoleBook


def first_entries(tokens: DataFrame) -> DataFrame:
    """The first registry entry per hash; later duplicates never count."""
    entry = F.struct("client_name", "role", "status", "expires_at")
    return (
        tokens.groupBy("token_hash")
        .agg(F.min_by(entry, "pos").alias("e"))
        .select(
            "token_hash",
            F.col("e.client_name").alias("_client"),
            F.col("e.role").alias("_role"),
            F.col("e.status").alias("_status"),
            F.col("e.expires_at").alias("_expires"),
        )
    )


def resolve_clients(
    requests: DataFrame, tokens: DataFrame, as_of: str, token: str = "token"
) -> DataFrame:
    """Add ``authenticated, client, role`` to requests that carry a raw token.

    The entry must be active and not expired on ``as_of`` (ISO date, compared
    as text). The raw token itself is dropped. One popular client may send a
    large share of all requests; adaptive execution splits its partition, and the
    same plan serves streams.
    """
    hashed = requests.withColumn("token_hash", hash_id(F.col(token))).drop(token)
    joined = hashed.join(first_entries(tokens), "token_hash", "left")
    expires = F.coalesce("_expires", F.lit(""))
    valid = F.coalesce(
        (F.col("_status") == "active") & ((expires == "") | (expires >= as_of)), F.lit(False)
    )
    return joined.select(
        *[c for c in hashed.columns if c != "token_hash"],
        valid.alias("authenticated"),
        F.when(valid, F.coalesce("_client", F.lit("unknown"))).alias("client"),
        F.when(valid, F.coalesce("_role", F.lit("viewer"))).alias("role"),
    )


def role_rank(role: Column) -> Column:
    out = F.lit(0)
    for name, rank in ROLE_RANK.items():
        out = F.when(role == name, F.lit(rank)).otherwise(out)
    return out


def role_at_least(role: Column, required: Column) -> Column:
    """Unknown roles rank 0 on both sides, so an unknown requirement is met by all."""
    return role_rank(role) >= role_rank(required)


def authorize_requests(requests: DataFrame, book: RoleBook) -> DataFrame:
    """Add ``http_status, code, reason`` to resolved requests.

    Needs ``authenticated, role, tool, forwarded_for`` and optionally
    ``require_role``. Developers must not arrive through a public proxy.
    """
    role, tool = F.col("role"), F.col("tool")
    known = role.isin(sorted(book.roles)) if book.roles else F.lit(False)

    def lacks(flag: str) -> Column:
        return ~F.coalesce(role_value(book, role, flag), F.lit(False))

    proxied = (role == "developer") & (F.coalesce("forwarded_for", F.lit("")) != "")
    if "require_role" in requests.columns:
        required = F.coalesce("require_role", F.lit(""))
        below = (required != "") & ~role_at_least(role, required)
    else:
        below = F.lit(False)
    status = F.when(~F.col("authenticated"), 401).when(proxied, 403).otherwise(200)
    reason = (
        F.when(~F.col("authenticated"), F.lit("invalid or expired token"))
        .when(proxied, F.lit("developer access requires the tunnel"))
        .when(~known, F.lit("unknown role"))
        .when((tool == "execute_query") & lacks("allow_generic_query"), F.lit("generic queries are not allowed"))
        .when((tool == "query_audit_log") & lacks("allow_audit_log"), F.lit("audit log is not allowed"))
        .when(below, F.lit("a higher role is required"))
    )
    code = F.when((status == 200) & reason.isNotNull(), F.lit("ROLE_DENIED"))
    return requests.withColumns({"http_status": status, "code": code, "reason": reason})
