"""Checks of the masking itself over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from veilspark.functions import masking as fm
from veilspark.operators import masking as om
from veilspark.operators import quality as oq
from veilspark.plans.registry import derive, derive_sql, plan, table
from veilspark.plans.settings import PERSON, POLICY, keys, residual_sql, residual_test_sql

_PERSON_SQL = derive_sql("customer", PERSON)
_EXPECTED = {
    "customer_name": "tokenize", "phone": "mask_phone", "email": "mask_email", "id_card": "deny",
    "address": "deny", "status": "passthrough", "balance": "passthrough", "nickname": "deny",
}
# A tampered copy: some cells come back raw and must be counted as failed.
_TAMPERED = {
    "customer_name": "id % 10 = 0",
    "phone": "id % 7 = 0",
    "status": "id % 5 = 0",
}


def _clean_report(name: str, action: str) -> str:
    return (
        f"SELECT '{name}' AS column_name, '{action}' AS expected, count(*) AS total, count(*) AS passed, "
        f"0::BIGINT AS failed, 1.0::DOUBLE AS pass_rate FROM customer"
    )


@plan(
    "verify_policy",
    " UNION ALL ".join(_clean_report(c, a) for c, a in {"id": "passthrough", **_EXPECTED}.items()),
)
def verify_policy(spark, sf):
    people = derive(table(spark, sf, "customer"), PERSON)
    return oq.verify_policy(people, POLICY, keys(spark))


_BAD = {
    "customer_name": "id % 10 = 0",
    "phone": "id % 7 = 0 AND phone IS NOT NULL AND phone <> ''",
    "status": "id % 5 = 0",
}


def _tampered_report(name: str, action: str) -> str:
    bad = _BAD.get(name, "FALSE")
    return (
        f"SELECT '{name}' AS column_name, '{action}' AS expected, count(*) AS total, "
        f"count(*) FILTER (NOT coalesce({bad}, FALSE)) AS passed, "
        f"count(*) FILTER (coalesce({bad}, FALSE)) AS failed, "
        f"count(*) FILTER (NOT coalesce({bad}, FALSE)) / count(*) AS pass_rate FROM ({_PERSON_SQL})"
    )


@plan(
    "verify_masking",
    " UNION ALL ".join(_tampered_report(c, a) for c, a in _EXPECTED.items()),
)
def verify_masking(spark, sf):
    people = derive(table(spark, sf, "customer"), PERSON)
    masked = om.apply_masking(people, POLICY, keys(spark))
    raw = people.select("id", *[F.col(c).alias(f"raw_{c}") for c in ("customer_name", "phone")])
    joined = masked.join(raw, "id")
    broken = joined.withColumns(
        {
            "customer_name": F.expr(f"IF({_TAMPERED['customer_name']}, raw_customer_name, customer_name)"),
            "phone": F.expr(f"IF({_TAMPERED['phone']}, raw_phone, phone)"),
            "status": F.expr(f"IF({_TAMPERED['status']}, 'changed', status)"),
        }
    )
    return oq.verify_masking(people, broken, "id", _EXPECTED)


@plan(
    "token_consistency",
    """SELECT 'value_has_many_tokens' AS violation, c_name AS item, 2::BIGINT AS n
       FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name
       HAVING bool_or(o_orderkey % 17 = 0) AND NOT bool_and(o_orderkey % 17 = 0)""",
)
def token_consistency(spark, sf):
    """Every seventeenth order was tokenised under the wrong namespace."""
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    k = keys(spark)
    token = F.when(
        F.col("o_orderkey") % 17 == 0, fm.tokenize(F.col("c_name"), "supplier", "SUP", k)
    ).otherwise(fm.tokenize(F.col("c_name"), "customer", "CUST", k))
    return oq.token_consistency(joined.select("c_name", token.alias("token")), "c_name", "token")


@plan(
    "token_consistency_clean",
    "SELECT 'x' AS violation, c_name AS item, 1::BIGINT AS n FROM customer WHERE FALSE",
)
def token_consistency_clean(spark, sf):
    named = table(spark, sf, "customer").select(F.col("c_name").alias("customer_name"))
    pairs = named.select(
        "customer_name",
        fm.tokenize(F.col("customer_name"), "customer", "CUST", keys(spark)).alias("token"),
    )
    return oq.token_consistency(pairs, "customer_name", "token")


def _leak_sql(source: str, column: str) -> str:
    a, b, c = (residual_test_sql(column, k) for k in ("id_card", "bank_card", "phone"))
    return " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, '{kind}' AS kind, count(*) FILTER ({test}) AS cells FROM {source}"
        for kind, test in (
            ("id_card", a), ("bank_card", f"{b} AND NOT {a}"), ("phone", f"{c} AND NOT {a} AND NOT {b}"),
        )
    )


@plan("residual_leaks", _leak_sql("documents", "text"))
def residual_leaks(spark, sf):
    return oq.residual_leaks(table(spark, sf, "documents"), ["text"])


@plan(
    "residual_leaks_masked",
    " UNION ALL ".join(
        f"SELECT 'status' AS column_name, '{k}' AS kind, 0::BIGINT AS cells FROM (SELECT count(*) FROM customer)"
        for k in ("id_card", "bank_card", "phone")
    ),
)
def residual_leaks_masked(spark, sf):
    """After masking nothing is left to find in text that passed through."""
    people = derive(table(spark, sf, "customer"), PERSON)
    return oq.residual_leaks(om.apply_masking(people, POLICY, keys(spark)))


_LINES = "string_split(text, chr(10))"
_NESTED_SQL = f"""SELECT doc_id, unnest(list_concat({_LINES}, [text, lang], [lang || '/' || text])) AS leaf FROM documents"""


def nested_documents(spark, sf):
    """Texts as the lines of an array, the fields of a struct, and the value and key of a map."""
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        F.split("text", "\n").alias("text"),
        F.struct(F.array(F.struct(F.col("text").alias("whole"), F.col("n_chars"))).alias("inner"), "lang").alias("source"),
        F.create_map(F.concat_ws("/", "lang", "text"), F.array("n_chars")).alias("type"),
    )


@plan(
    "residual_leaks_nested",
    " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, kind, cells FROM ({_leak_sql(f'(SELECT unnest({listed}) AS leaf FROM documents)', 'leaf')})"
        for column, listed in (("text", _LINES), ("source", "[text, lang]"), ("type", "[lang || '/' || text]"))
    ),
)
def residual_leaks_nested(spark, sf):
    """Numbers inside arrays, structs and maps, each of them counted."""
    return oq.residual_leaks(nested_documents(spark, sf), ["text", "source", "type"])


@plan(
    "residual_scan_nested",
    f"""SELECT doc_id, array_to_string(list_transform({_LINES}, lambda x: {residual_sql('x')}), chr(10)) AS lines,
        {residual_sql('text')} AS whole, lang,
        CASE WHEN ({residual_sql("(lang || '/' || text)")}) = lang || '/' || text THEN lang || '/' || text
             ELSE ({residual_sql("(lang || '/' || text)")}) || ' 1' END AS named, n_chars FROM documents""",
)
def residual_scan_nested(spark, sf):
    """Masking reaches the texts inside a nested value and leaves the rest of it as it is."""
    masked = om.apply_masking(nested_documents(spark, sf), POLICY, keys(spark))
    return masked.select(
        "doc_id",
        F.array_join("text", "\n").alias("lines"),
        F.col("source.inner")[0]["whole"].alias("whole"),
        F.col("source.lang").alias("lang"),
        F.map_keys("type")[0].alias("named"),
        F.map_values("type")[0][0].alias("n_chars"),
    )


_LINE_EXPECTED = {"customer_name": "tokenize", "phone": "mask_phone", "balance": "passthrough", "address": "deny"}
_SHARED_KEY = "id % 50"


def _repeated_report(name: str, action: str) -> str:
    bad = {"customer_name": "id % 10 = 0", "phone": "id % 7 = 0 AND phone IS NOT NULL AND phone <> ''"}.get(name, "FALSE")
    return f"""SELECT '{name}' AS column_name, '{action}' AS expected, count(*) AS total,
        count(*) FILTER (NOT coalesce({bad}, FALSE)) AS passed, count(*) FILTER (coalesce({bad}, FALSE)) AS failed,
        count(*) FILTER (NOT coalesce({bad}, FALSE)) / count(*) AS pass_rate
        FROM (SELECT * FROM ({_PERSON_SQL}) UNION ALL SELECT * FROM ({_PERSON_SQL}) WHERE id % 2 = 0)"""


@plan("verify_masking_repeated", " UNION ALL ".join(_repeated_report(c, a) for c, a in _LINE_EXPECTED.items()))
def verify_masking_repeated(spark, sf):
    """A key that many rows share, some of them equal: columns are compared as multisets."""
    people = derive(table(spark, sf, "customer"), PERSON)
    people = people.unionByName(people.where("id % 2 = 0")).withColumn("shared", F.expr(_SHARED_KEY))
    raw = people.select("shared", "id", F.col("customer_name").alias("raw_name"), F.col("phone").alias("raw_phone"), *_LINE_EXPECTED)
    marks = ["shared", "id", "raw_name", "raw_phone"]
    masked = om.project_actions(
        raw, [om.ColumnAction(f.name, f.dataType, POLICY.decide("id" if f.name in marks else f.name)) for f in raw.schema.fields],
        POLICY, keys(spark),
    )
    broken = masked.withColumns(
        {
            "customer_name": F.expr("IF(id % 10 = 0, raw_name, customer_name)"),
            "phone": F.expr("IF(id % 7 = 0, raw_phone, phone)"),
        }
    )
    return oq.verify_masking(people, broken, "shared", _LINE_EXPECTED)


_CASES = {
    "Customer_Name": "customer_name", "CUSTOMER_NAME": "customer_name", "CustomeR_NamE": "customer_name",
    "Phone": "phone", "PHONE": "phone", "Email": "email", "EMAIL": "email",
    "Id_Card": "id_card", "ID_CARD": "id_card", "Address": "address", "ADDRESS": "address",
    "Status": "status", "STATUS": "status", "Balance": "balance", "BALANCE": "balance",
}


@plan(
    "case_variants",
    " UNION ALL ".join(_clean_report(v, _EXPECTED[b]) for v, b in _CASES.items()),
)
def case_variants(spark, sf):
    people = derive(table(spark, sf, "customer"), PERSON)
    return oq.case_variants(people, _CASES, POLICY, keys(spark))


SAMPLES = {
    "customer_name": ["Ann Lee", "Bo Chen", "N/A", "Carla Diaz", ""],
    "phone": ["13800000001", "123", "13911112222"],
    "email": ["ann@example.com", "nobody", "b@c.d"],
    "id_card": ["110101199001011234", None],
    "status": ["open", "closed", "call 13812345678", "id 110101199001011234"],
    "amount": ["12.50", "0", "99"],
    "mood": ["fine", "tired"],
}


def _pick_sql(name: str, samples) -> str:
    listed = ", ".join("NULL" if s is None else f"'{s}'" for s in samples)
    number = f"CAST('0x' || substr(md5('42:{name}:' || event_id), 1, 8) AS BIGINT)"
    return f"[{listed}][{number} % {len(samples)} + 1] AS {name}"


@plan(
    "random_tables",
    f"SELECT event_id, {', '.join(_pick_sql(n, s) for n, s in SAMPLES.items())} FROM events",
)
def random_tables(spark, sf):
    """Seeded fixture rows, one per event."""
    return oq.fixture_rows(table(spark, sf, "events"), "event_id", SAMPLES)


@plan(
    "random_tables_verified",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{POLICY.decide(c).action}' AS expected, count(*) AS total, "
        "count(*) AS passed, 0::BIGINT AS failed, 1.0::DOUBLE AS pass_rate FROM events"
        for c in SAMPLES
    ),
)
def random_tables_verified(spark, sf):
    fixture = oq.fixture_rows(table(spark, sf, "events"), "event_id", SAMPLES)
    return oq.verify_policy(fixture.drop("event_id"), POLICY, keys(spark))


_POOLS = {"sensitive": ["customer_name", "phone", "id_card"], "safe": ["status", "amount"], "unknown": ["mood"]}
_SEEDS = range(6)


@plan(
    "random_layouts",
    " UNION ALL ".join(
        f"SELECT {seed} AS seed, '{c}' AS column_name, '{POLICY.decide(c).action}' AS expected, count(*) AS total, "
        "count(*) AS passed, 0::BIGINT AS failed FROM events"
        for seed in _SEEDS
        for c in oq.random_layout(_POOLS, seed)
    ),
)
def random_layouts(spark, sf):
    """Tables with a seeded choice of columns, one row for each event, masked and held against their policy."""
    reports = []
    for seed in _SEEDS:
        fixture = oq.random_table(table(spark, sf, "events"), "event_id", _POOLS, SAMPLES, seed).drop("event_id")
        report = oq.verify_policy(fixture, POLICY, keys(spark)).drop("pass_rate")
        reports.append(report.withColumn("seed", F.lit(seed)))
    return reduce(DataFrame.unionByName, reports)
