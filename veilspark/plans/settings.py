"""Policy, roles, routes and derived tables used by the registered queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilspark.functions.keys import TokenKeys
from veilspark.plans.registry import quote
from veilspark.policy import MaskingPolicy, RoleBook, SourceCatalog

# Published test secret: the registered queries and their SQL must share one,
# and a real secret must not end up in SQL text. Library code never uses it.
TEST_SECRET = "veilspark example key, for tests and registered queries only"

POLICY_DOCUMENT = {
    "defaults": {"unknown_column": "deny", "tokenizer_placeholders": ["", "N/A", "null"]},
    "table_overrides": {"nation": {"n_name": "passthrough"}, "region": {"r_name": "deny"}},
    "rules": [
        {
            "columns": ["customer_name", "client_name", "c_name"],
            "action": "tokenize", "namespace": "customer", "prefix": "CUST",
        },
        {
            "columns": ["supplier_name", "vendor_name", "s_name"],
            "action": "tokenize", "namespace": "supplier", "prefix": "SUP",
        },
        {
            "columns": ["n_name"],
            "action": "tokenize", "namespace": "nation", "prefix": "NAT",
        },
        {"columns": ["phone", "mobile", "telephone"], "action": "mask_phone"},
        {"columns": ["email"], "action": "mask_email"},
        {
            "columns": ["id_card", "bank_account", "password", "address", "remark", "r_name"],
            "action": "deny",
        },
        {
            "columns": [
                "amount", "quantity", "price", "total", "balance", "date", "year", "month",
                "id", "status", "type", "code",
                "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment",
                "s_suppkey", "s_nationkey", "s_acctbal",
                "n_nationkey", "n_regionkey", "r_regionkey",
                "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority",
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                "l_shipdate",
                "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice",
                "event_id", "ts", "user_id", "event_type", "value",
                "doc_id", "text", "lang", "source", "n_chars",
            ],
            "action": "passthrough",
        },
    ],
}

ROLE_DOCUMENT = {
    "roles": {
        "viewer": {
            "allowed_tables": ["nation", "region", "v_segments"],
            "max_rows": 1000, "timeout_seconds": 10, "max_concurrent": 2,
        },
        "developer": {
            "allowed_tables": [
                "customer", "orders", "lineitem", "supplier", "nation", "region", "events",
                "documents", "part", "v_segments", "ods_orders",
            ],
            "max_rows": 5000, "timeout_seconds": 30, "max_concurrent": 5,
            "allow_explain": True, "allow_union": True, "max_union_depth": 2,
            "allow_generic_query": True, "allow_audit_log": True,
        },
    },
    "large_tables": ["orders", "lineitem"],
    "large_table_filter_columns": ["o_orderdate", "l_shipdate"],
}

ROUTE_DOCUMENT = {
    "datasources": [
        {"name": "default", "type": "mysql", "database": "sales"},
        {"name": "ledger", "type": "sqlserver", "database": "ledger"},
        {"name": "lake", "type": "postgresql", "database": "lake"},
    ],
    "table_routing": [
        {"pattern": "ods_*", "datasource": "lake"},
        {"pattern": "DWD_Orders", "datasource": "ledger"},
        {"pattern": "dwd_*", "datasource": "lake"},
        {"pattern": "ext_*", "datasource": "missing"},
        {"pattern": "ledger_*", "datasource": "ledger"},
        {"pattern": "view", "datasource": "ledger"},
    ],
}

POLICY = MaskingPolicy.from_document(POLICY_DOCUMENT)
BOOK = RoleBook.from_document(ROLE_DOCUMENT)
ROUTES = SourceCatalog.from_document(ROUTE_DOCUMENT)
DEVELOPER = BOOK.roles["developer"]
VIEWER = BOOK.roles["viewer"]


def file_catalog(sf_dir: str) -> SourceCatalog:
    """The given tables as a file-backed source."""
    return SourceCatalog.from_document(
        {
            "datasources": [
                {"name": "default", "type": "parquet", "path": f"{sf_dir}/{{table}}.parquet"}
            ],
            "table_routing": [{"pattern": "*", "datasource": "default"}],
        }
    )


def keys(spark: SparkSession) -> TokenKeys:
    return TokenKeys(spark, TEST_SECRET)


# --- the same values in SQL ------------------------------------------------


def _pad_hex(byte: int) -> str:
    padded = TEST_SECRET.encode().ljust(64, b"\0")
    return bytes(b ^ byte for b in padded).hex()


def token_sql(value: str, namespace: str, prefix: str) -> str:
    """HMAC token of an ASCII expression that is already normal."""
    message = f"encode('{namespace}:' || {value})"
    inner = f"unhex(sha256(unhex('{_pad_hex(0x36)}') || {message}))"
    outer = f"sha256(unhex('{_pad_hex(0x5C)}') || {inner})"
    return f"('{prefix}_V1_' || upper(substr({outer}, 1, 16)))"


def phone_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} = '' THEN {c} WHEN length({c}) < 7 THEN '***' "
        f"ELSE substr({c}, 1, 3) || '****' || right({c}, 4) END"
    )


def email_sql(c: str) -> str:
    # Everything before the last @, then the rest.
    local = f"regexp_extract({c}, '^(.*)@[^@]*$', 1)"
    domain = f"regexp_extract({c}, '^.*@([^@]*)$', 1)"
    return (
        f"CASE WHEN {c} = '' THEN {c} WHEN strpos({c}, '@') = 0 THEN '***' "
        f"WHEN length({local}) <= 1 THEN '*@' || {domain} "
        f"ELSE substr({local}, 1, 1) || '***@' || {domain} END"
    )


def residual_test_sql(c: str, kind: str) -> str:
    pattern = {
        "id_card": "(^|[^0-9])[0-9]{17}[0-9Xx]([^0-9]|$)",
        "bank_card": "(^|[^0-9])[0-9]{16,19}([^0-9]|$)",
        "phone": "(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)",
    }[kind]
    return f"regexp_matches({c}, {quote(pattern)})"


def residual_sql(c: str) -> str:
    return (
        f"CASE WHEN {residual_test_sql(c, 'id_card')} THEN '[已遮掩:疑似证件号]' "
        f"WHEN {residual_test_sql(c, 'bank_card')} THEN '[已遮掩:疑似银行卡号]' "
        f"WHEN {residual_test_sql(c, 'phone')} THEN '[已遮掩:疑似手机号]' ELSE {c} END"
    )


# --- derived personal data: the given tables hold no phones or addresses ----

_KEY8 = "lpad('' || c_custkey, 8, '0')"

PERSON = {
    "id": "c_custkey",
    "customer_name": "c_name",
    "phone": f"CASE WHEN c_nationkey = 0 THEN '' WHEN c_nationkey = 1 THEN '12345' "
             f"WHEN c_nationkey = 2 THEN NULL ELSE '138' || {_KEY8} END",
    "email": "CASE WHEN c_nationkey = 3 THEN 'nobody' WHEN c_nationkey = 4 THEN '@x.com' "
             "WHEN c_nationkey = 5 THEN 'a@b' || c_custkey || '@c.d' "
             "WHEN c_nationkey = 6 THEN '' ELSE 'u' || c_custkey || '@example.com' END",
    "id_card": f"'1101011990' || {_KEY8}",
    "address": "'No. ' || c_custkey || ' Street'",
    "status": f"CASE WHEN c_nationkey = 7 THEN 'call 139{{0}} now' "
              f"WHEN c_nationkey = 8 THEN 'card 62220212345{{0}}' "
              f"WHEN c_nationkey = 9 THEN 'no 1101011990{{0}}x' "
              f"WHEN c_nationkey = 10 THEN 'run 622202123456{{0}}' ELSE c_mktsegment END"
              .replace("{0}", f"' || {_KEY8} || '"),
    "balance": "c_acctbal",
    "nickname": "'nick' || c_nationkey",
}
