"""Single-value masking over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from veilspark.functions import masking as fm
from veilspark.plans.registry import derive, derive_sql, plan, table
from veilspark.plans.settings import (
    PERSON,
    POLICY,
    email_sql,
    keys,
    phone_sql,
    residual_sql,
    residual_test_sql,
    token_sql,
)

_PLACEHOLDERS = "('', 'N/A', 'null')"

_BLANKS = {
    "c_custkey": "c_custkey",
    "raw": "CASE c_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN 'null' "
           "WHEN 3 THEN '   ' WHEN 4 THEN NULL ELSE c_name END",
}
_MESSY = {
    "c_custkey": "c_custkey",
    "raw": "'  ' || c_name || chr(9) || chr(10) || '  ' || c_mktsegment || '   x ' || chr(13)",
}


@plan("passthrough", "SELECT o_orderkey, o_totalprice FROM orders")
def passthrough(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", fm.passthrough(F.col("o_totalprice")).alias("o_totalprice"))


@plan(
    "tokenize_customer",
    f"SELECT c_custkey, {token_sql('c_name', 'customer', 'CUST')} AS token FROM customer",
)
def tokenize_customer(spark, sf):
    token = fm.tokenize(F.col("c_name"), "customer", "CUST", keys(spark), POLICY.placeholders)
    return table(spark, sf, "customer").select("c_custkey", token.alias("token"))


@plan(
    "tokenize_lineitem",
    f"""SELECT token, count(*) AS n_lines FROM (
        SELECT {token_sql('c_name', 'customer', 'CUST')} AS token
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey) GROUP BY token""",
)
def tokenize_lineitem(spark, sf):
    """Tokens after the count: one per customer instead of one per line."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    per_customer = (
        lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("n").alias("n_lines"))
    )
    token = fm.tokenize(F.col("c_name"), "customer", "CUST", keys(spark), POLICY.placeholders)
    named = per_customer.join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return (
        named.select(token.alias("token"), "n_lines")
        .groupBy("token")
        .agg(F.sum("n_lines").alias("n_lines"))
    )


@plan(
    "tokenize_two_namespaces",
    f"""SELECT c_custkey, {token_sql('c_name', 'customer', 'CUST')} AS as_customer,
        {token_sql('c_name', 'supplier', 'SUP')} AS as_supplier FROM customer""",
)
def tokenize_two_namespaces(spark, sf):
    k, name = keys(spark), F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey",
        fm.tokenize(name, "customer", "CUST", k).alias("as_customer"),
        fm.tokenize(name, "supplier", "SUP", k).alias("as_supplier"),
    )


@plan(
    "normalize_text",
    f"""SELECT c_custkey, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS normalized
        FROM ({derive_sql('customer', _MESSY)})""",
)
def normalize_text(spark, sf):
    messy = derive(table(spark, sf, "customer"), _MESSY)
    return messy.select("c_custkey", fm.normalize_text(F.col("raw")).alias("normalized"))


@plan("normalize_documents")
def normalize_documents(spark, sf):
    """Unicode text; DuckDB has no NFKC, so the tests compare it with Python."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", fm.normalize_text(F.col("text")).alias("normalized"))


@plan(
    "placeholder_skip",
    f"""SELECT c_custkey, raw, raw IN {_PLACEHOLDERS} AS is_placeholder,
        CASE WHEN raw IN {_PLACEHOLDERS} OR trim(raw) = '' THEN raw
        ELSE {token_sql('raw', 'customer', 'CUST')} END AS token
        FROM ({derive_sql('customer', _BLANKS)})""",
)
def placeholder_skip(spark, sf):
    raw = F.col("raw")
    return derive(table(spark, sf, "customer"), _BLANKS).select(
        "c_custkey",
        "raw",
        fm.is_placeholder(raw, POLICY.placeholders).alias("is_placeholder"),
        fm.tokenize(raw, "customer", "CUST", keys(spark), POLICY.placeholders).alias("token"),
    )


@plan(
    "mask_phone",
    f"SELECT id, {phone_sql('phone')} AS phone FROM ({derive_sql('customer', PERSON)})",
)
def mask_phone(spark, sf):
    people = derive(table(spark, sf, "customer"), PERSON)
    return people.select("id", fm.mask_phone(F.col("phone")).alias("phone"))


@plan(
    "mask_email",
    f"SELECT id, {email_sql('email')} AS email FROM ({derive_sql('customer', PERSON)})",
)
def mask_email(spark, sf):
    people = derive(table(spark, sf, "customer"), PERSON)
    return people.select("id", fm.mask_email(F.col("email")).alias("email"))


@plan("deny_column", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer")
def deny_column(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fm.deny(T.StringType()).alias("c_name"))


@plan("hash_id", "SELECT c_custkey, 'sha256:' || sha256(c_name) AS hashed FROM customer")
def hash_id(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", fm.hash_id(F.col("c_name")).alias("hashed")
    )


@plan(
    "residual_scan",
    f"""SELECT doc_id, {residual_sql('text')} AS scanned,
        CASE WHEN {residual_test_sql('text', 'id_card')} THEN 'id_card'
        WHEN {residual_test_sql('text', 'bank_card')} THEN 'bank_card'
        WHEN {residual_test_sql('text', 'phone')} THEN 'phone' ELSE 'none' END AS kind
        FROM documents""",
)
def residual_scan(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        fm.residual_scan(text).alias("scanned"),
        F.coalesce(fm.residual_kind(text), F.lit("none")).alias("kind"),
    )


@plan(
    "residual_scan_pages",
    f"""SELECT page_id, {residual_sql('html')} = html AS unchanged, md5({residual_sql('html')}) AS digest
        FROM pages""",
)
def residual_scan_pages(spark, sf):
    scanned = fm.residual_scan(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id",
        (scanned == F.col("html")).alias("unchanged"),
        F.md5(scanned.cast("binary")).alias("digest"),
    )
