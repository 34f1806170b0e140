"""Requests derived from events, clients from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import identity as oi
from veilspark.plans.registry import derive, derive_sql, plan, table
from veilspark.plans.settings import BOOK

AS_OF = "2024-02-01"

REQUESTS = {
    "event_id": "event_id",
    "token": "'token-' || user_id",
    "tool": "CASE event_type WHEN 'view' THEN 'execute_query' WHEN 'click' THEN 'query_audit_log' "
            "WHEN 'error' THEN 'query_summary' ELSE 'list_datasets' END",
    "forwarded_for": "CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || user_id ELSE '' END",
    "require_role": "CASE event_type WHEN 'error' THEN 'developer' WHEN 'signup' THEN 'auditor' "
                    "ELSE '' END",
}
# Every customer holds an entry; some hold a second one that must not count.
_ENTRY = {
    "client_name": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'agent-' || c_custkey END",
    "role": "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'guest' "
            "WHEN c_custkey % 2 = 0 THEN 'viewer' ELSE 'developer' END",
    "status": "CASE WHEN c_nationkey < 4 THEN 'inactive' ELSE 'active' END",
    "expires_at": "CASE WHEN c_acctbal < 0 THEN '2020-01-01' WHEN c_nationkey = 5 THEN '2024-02-01' "
                  "WHEN c_nationkey = 6 THEN '' WHEN c_nationkey = 7 THEN NULL ELSE '2099-12-31' END",
}
_FIRST = {"pos": "c_custkey * 2", "raw": "'token-' || c_custkey", **_ENTRY}
_SECOND = {
    "pos": "c_custkey * 2 + 1", "raw": "'token-' || c_custkey", "client_name": "'shadow'",
    "role": "'developer'", "status": "'active'", "expires_at": "'2099-12-31'",
}
_RESOLVED = f"""SELECT event_id, tool, forwarded_for, require_role,
    coalesce(ok, FALSE) AS authenticated,
    CASE WHEN ok THEN coalesce(client_name, 'unknown') END AS client,
    CASE WHEN ok THEN coalesce(role, 'viewer') END AS role
    FROM ({derive_sql('events', REQUESTS)}) r LEFT JOIN (
        SELECT raw, client_name, role, status = 'active' AND (coalesce(expires_at, '') = ''
            OR expires_at >= '{AS_OF}') AS ok
        FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY pos) AS rn FROM (
            {derive_sql('customer', _FIRST)} UNION ALL
            {derive_sql('customer', _SECOND)} WHERE c_nationkey % 2 = 0)) WHERE rn = 1) c
    ON token = raw"""


def registry(spark, sf):
    customer = table(spark, sf, "customer")
    both = derive(customer, _FIRST).unionByName(
        derive(customer.where("c_nationkey % 2 = 0"), _SECOND)
    )
    from veilspark.functions.masking import hash_id

    return both.withColumn("token_hash", hash_id(F.col("raw"))).drop("raw")


def resolved(spark, sf):
    requests = derive(table(spark, sf, "events"), REQUESTS)
    return oi.resolve_clients(requests, registry(spark, sf), AS_OF)


@plan(
    "resolve_clients",
    f"""SELECT event_id, authenticated, coalesce(client, '') AS client, coalesce(role, '') AS role
        FROM ({_RESOLVED})""",
)
def resolve_clients(spark, sf):
    return resolved(spark, sf).select(
        "event_id",
        "authenticated",
        F.coalesce("client", F.lit("")).alias("client"),
        F.coalesce("role", F.lit("")).alias("role"),
    )


_RANK = "CASE {} WHEN 'viewer' THEN 1 WHEN 'developer' THEN 2 ELSE 0 END"
_BELOW = f"(require_role <> '' AND {_RANK.format('role')} < {_RANK.format('require_role')})"


@plan(
    "authorize_requests",
    f"""SELECT event_id, CASE WHEN NOT authenticated THEN 401
            WHEN role = 'developer' AND forwarded_for <> '' THEN 403 ELSE 200 END AS http_status,
        CASE WHEN NOT authenticated OR (role = 'developer' AND forwarded_for <> '') OR reason = '' THEN ''
            ELSE 'ROLE_DENIED' END AS code, reason
        FROM (SELECT *, CASE WHEN NOT authenticated THEN 'invalid or expired token'
            WHEN role = 'developer' AND forwarded_for <> '' THEN 'developer access requires the tunnel'
            WHEN role NOT IN ('viewer', 'developer') THEN 'unknown role'
            WHEN tool = 'execute_query' AND role <> 'developer' THEN 'generic queries are not allowed'
            WHEN tool = 'query_audit_log' AND role <> 'developer' THEN 'audit log is not allowed'
            WHEN {_BELOW} THEN 'a higher role is required' ELSE '' END AS reason
            FROM ({_RESOLVED}))""",
)
def authorize_requests(spark, sf):
    judged = oi.authorize_requests(resolved(spark, sf), BOOK)
    return judged.select(
        "event_id",
        "http_status",
        F.coalesce("code", F.lit("")).alias("code"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


_ROLES = {
    "event_id": "event_id",
    "role": "CASE user_id % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'developer' ELSE 'guest' END",
    "required": "CASE event_type WHEN 'view' THEN 'viewer' WHEN 'click' THEN 'developer' ELSE 'auditor' END",
}


@plan(
    "role_at_least",
    f"""SELECT event_id, {_RANK.format('role')} >= {_RANK.format('required')} AS allowed
        FROM ({derive_sql('events', _ROLES)})""",
)
def role_at_least(spark, sf):
    asked = derive(table(spark, sf, "events"), _ROLES)
    return asked.select(
        "event_id", oi.role_at_least(F.col("role"), F.col("required")).alias("allowed")
    )
