import pytest
from pyspark.sql import Observation, functions as F, types as T

from tests.conftest import POLICY_DOC
from veilspark import MaskingPolicy, Measure, apply_masking, lineage_of, masked_fields, safe_agg, tag_source
from veilspark.frames import local_frame
from veilspark.operators.masking import (
    mask_union,
    observed_fields,
    resolve_actions,
    token_join,
)
from veilspark.operators.tags import MASKED

ROWS = [
    ("陈一鸣", "13812345678", "a@test.com", "110101199001011234", 12.5, "call 13812345678", "x"),
    (None, "123", "nomail", None, 1.0, "fine", "y"),
    ("N/A", "", "", "z", None, None, None),
]
LAYOUT = (
    "customer_name string, PHONE string, email string, id_card string, amount double,"
    " status string, favourite string"
)


@pytest.fixture(scope="module")
def people(spark):
    return local_frame(spark, ROWS, LAYOUT)


def test_whole_table(people, policy, keys):
    got = apply_masking(people, policy, keys).collect()
    assert [tuple(r) for r in got] == [
        ("CUST_V1_1A291822DC53DA5C", "138****5678", "*@test.com", None, 12.5, "[已遮掩:疑似手机号]", None),
        (None, "***", "***", None, 1.0, "fine", None),
        ("N/A", "", "", None, None, None, None),
    ]


def test_schema_is_kept(people, policy, keys):
    masked = apply_masking(people, policy, keys)
    assert [(f.name, f.dataType) for f in masked.schema] == [(f.name, f.dataType) for f in people.schema]


def test_masking_twice_is_masking_once(people, policy, keys):
    once = apply_masking(people, policy, keys)
    assert apply_masking(once, policy, keys).collect() == once.collect()


def test_names_match_in_any_case(spark, policy):
    for name in ("Customer_Name", "CUSTOMER_NAME", "CustomeR_NamE", "客户姓名"):
        schema = T.StructType([T.StructField(name, T.StringType())])
        assert resolve_actions(schema, policy)[0].action == "tokenize"


def test_non_text_passes_unless_strict(spark, policy, keys):
    df = spark.sql("SELECT 42 AS customer_name, 13812345678 AS phone, 5 AS password")
    assert tuple(apply_masking(df, policy, keys).first()) == (42, 13812345678, None)
    strict = apply_masking(df, policy, keys, strict=True).first()
    assert strict.customer_name.startswith("CUST_V1_") and strict.phone == "138****5678"
    report = masked_fields(df, policy).first().masked_fields
    assert report == ["customer_name", "password", "phone"]


def test_nested_types_are_denied_by_default(spark, policy, keys):
    df = spark.sql("SELECT array('a') AS tags, map('k', 'v') AS attrs, 1 AS amount")
    assert tuple(apply_masking(df, policy, keys).first()) == (None, None, 1)


def with_overrides(overrides, **more):
    return MaskingPolicy.from_document({**POLICY_DOC, "table_overrides": overrides, **more})


def test_override_beats_rule(spark, keys):
    p = with_overrides({"dept": {"customer_name": "passthrough", "amount": "deny", "odd": "tokenize"}})
    df = spark.sql("SELECT 'A' AS customer_name, 5 AS amount, 'x' AS odd")
    assert tuple(apply_masking(df, p, keys, tables=["Dept"]).first()) == ("A", None, "_V1_6CF6D53B6E7E2096")
    assert apply_masking(df, p, keys).first().amount == 5


def test_override_to_tokenise_borrows_the_rule(spark, keys):
    p = with_overrides({"t": {"customer_name": "tokenize"}})
    df = spark.sql("SELECT '陈一鸣' AS customer_name")
    assert apply_masking(df, p, keys, tables=["t"]).first()[0] == "CUST_V1_1A291822DC53DA5C"


def test_strictest_override_wins(spark, keys):
    p = with_overrides({"a": {"x": "passthrough"}, "b": {"x": "deny"}})
    df = spark.sql("SELECT 'v' AS x")
    for tables in (["a", "b"], ["b", "a"]):
        assert apply_masking(df, p, keys, tables=tables).first().x is None


def test_override_belongs_to_its_table(spark, keys):
    p = with_overrides({"dept": {"customer_name": "passthrough"}})
    df = tag_source(spark.sql("SELECT 1 AS id, 'A' AS customer_name"), "dept").alias("d").join(
        tag_source(spark.sql("SELECT 1 AS id, '陈一鸣' AS customer_name"), "people").alias("p"), "id"
    ).select(F.col("d.customer_name").alias("a"), F.col("p.customer_name").alias("b"))
    assert tuple(apply_masking(df, p, keys).first()) == ("A", "CUST_V1_1A291822DC53DA5C")


def test_unknown_action_nulls(spark, keys):
    p = MaskingPolicy.from_document({"rules": [{"columns": ["a"], "action": "scramble"}]})
    df = spark.sql("SELECT 'v' AS a")
    assert apply_masking(df, p, keys).first().a is None
    assert masked_fields(df, p).first()[0] == ["a"]


def test_default_can_be_passthrough(spark, keys):
    p = with_overrides({}, defaults={"unknown_column": "passthrough"})
    df = spark.sql("SELECT 'tel 13812345678' AS mystery")
    assert apply_masking(df, p, keys).first()[0] == "[已遮掩:疑似手机号]"


def test_last_rule_wins():
    p = MaskingPolicy.from_document(
        {"rules": [{"columns": ["A"], "action": "deny"}, {"columns": ["a"], "action": "passthrough"}]}
    )
    assert p.decide("A").action == "passthrough"


def test_explicit_lineage(spark, policy, keys):
    df = spark.sql("SELECT '陈一鸣' AS amount")
    masked = apply_masking(df, policy, keys, lineage={"Amount": "Customer_Name"})
    assert masked.first().amount == "CUST_V1_1A291822DC53DA5C"


@pytest.fixture(scope="module")
def summary(spark):
    return tag_source(
        local_frame(
            spark,
            [("陈一鸣", "13812345678", 2026, 10.0), ("林二白", "13912345678", 2026, 5.0), ("陈一鸣", "1", 2025, 1.0)],
            "customer_name string, phone string, n_year int, amount double",
        ),
        "summary",
    )


NESTED = [
    "SELECT amount FROM (SELECT customer_name AS amount FROM {t}) s",
    "WITH c AS (SELECT customer_name AS amount FROM {t}) SELECT amount FROM c",
    "SELECT amount FROM (SELECT amount FROM (SELECT customer_name AS amount FROM {t}) a) b",
    "SELECT x AS amount FROM (SELECT customer_name AS x FROM {t}) s",
    "SELECT amount AS total FROM (SELECT x AS amount FROM (SELECT customer_name AS x FROM {t}))",
    "SELECT customer_name AS amount FROM {t} WHERE n_year = 2026 ORDER BY n_year LIMIT 5",
    "SELECT DISTINCT customer_name AS total FROM {t}",
    "SELECT customer_name AS id FROM {t} GROUP BY customer_name HAVING count(*) > 0",
    "SELECT a.customer_name AS code FROM {t} a JOIN {t} b ON a.n_year = b.n_year",
    "SELECT s.amount FROM (SELECT customer_name AS amount, n_year FROM {t}) s LEFT JOIN {t} USING (n_year)",
]


@pytest.mark.parametrize("sql", NESTED)
def test_renaming_never_unmasks(spark, summary, policy, keys, sql):
    df = spark.sql(sql, t=summary)
    assert set(lineage_of(df).values()) == {"summary.customer_name"}
    values = {r[0] for r in apply_masking(df, policy, keys).collect()}
    assert values and all(v.startswith("CUST_V1_") for v in values)


COMPUTED = [
    "SELECT upper(customer_name) AS amount, n_year FROM {t}",
    "SELECT customer_name || '' AS total, n_year FROM {t}",
    "SELECT CASE WHEN true THEN customer_name END AS code, n_year FROM {t}",
    "SELECT coalesce(customer_name, 'x') AS status, n_year FROM {t}",
    "SELECT max(customer_name) AS type, n_year FROM {t} GROUP BY n_year",
    "SELECT first_value(customer_name) OVER (PARTITION BY n_year ORDER BY amount) AS code, n_year FROM {t}",
    "SELECT element_at(array(customer_name), 1) AS status, n_year FROM {t}",
]


@pytest.mark.parametrize("sql", COMPUTED)
def test_computed_values_are_denied(spark, summary, policy, keys, sql):
    masked = apply_masking(spark.sql(sql, t=summary), policy, keys)
    assert {r[0] for r in masked.collect()} == {None}


def test_safe_aggregates_pass_and_others_do_not(summary, policy, keys):
    df = safe_agg(
        summary,
        ["customer_name"],
        {
            "n_plus": Measure.count().plus(1),
            "times": Measure.count().times(100),
            "spent": Measure.sum("amount").rounded(1),
            "mean": Measure.avg("amount"),
            "same": Measure.sum("amount").over(Measure.count()),
            "odd": Measure.sum("amount").over(Measure.max("amount")),
            "who": Measure.max("phone"),
        },
    )
    rows = {r.customer_name: tuple(r)[1:] for r in apply_masking(df, policy, keys).collect()}
    assert rows["CUST_V1_1A291822DC53DA5C"] == (3, 200, 11.0, 5.5, 5.5, None, None)


def test_masked_fields(people, policy, spark):
    report = masked_fields(people, policy).first().masked_fields
    assert report == ["PHONE", "customer_name", "email", "favourite", "id_card", "status"]
    quiet = people.where("customer_name IS NULL")
    assert "status" not in masked_fields(quiet, policy).first().masked_fields
    assert masked_fields(people.limit(0), policy).first().masked_fields == []


def test_observed_fields_need_no_second_pass(people, policy, keys):
    seen = Observation()
    actions = resolve_actions(people.schema, policy)
    apply_masking(people, policy, keys, observation=seen).collect()
    assert observed_fields(actions, seen) == masked_fields(people, policy).first().masked_fields


def test_duplicate_names_are_refused(spark, policy, keys):
    with pytest.raises(ValueError):
        apply_masking(spark.sql("SELECT 1 AS a, 2 AS A"), policy, keys)


def test_secret_is_only_needed_for_tokens(spark, policy, monkeypatch):
    monkeypatch.delenv("HMAC_SECRET", raising=False)
    assert apply_masking(spark.sql("SELECT 1 AS amount"), policy).first().amount == 1
    with pytest.raises(RuntimeError):
        apply_masking(spark.sql("SELECT 'a' AS customer_name"), policy)


def test_tokens_join_within_a_namespace_only(spark, policy, keys):
    a = apply_masking(spark.sql("SELECT ' 陈一鸣' AS customer_name, 1 AS amount"), policy, keys)
    b = apply_masking(spark.sql("SELECT '陈一鸣' AS client_name, 2 AS total"), policy, keys)
    c = apply_masking(spark.sql("SELECT '陈一鸣' AS employee_name, 3 AS total"), policy, keys)
    assert token_join(a, b, ("customer_name", "client_name")).count() == 1
    assert token_join(a, c, ("customer_name", "employee_name")).count() == 0


def test_union_takes_the_strictest_branch(spark, policy, keys):
    a = tag_source(spark.sql("SELECT 'x' AS status, 'p' AS code"), "t")
    b = tag_source(spark.sql("SELECT '陈一鸣' AS customer_name, 's' AS secret"), "u")
    rows = {tuple(r) for r in mask_union([a, b], policy, keys).collect()}
    assert rows == {
        ("CUST_V1_1A291822DC53DA5C", None),
        (apply_masking(spark.sql("SELECT 'x' AS customer_name"), policy, keys).first()[0], None),
    }


def test_union_distinct_compares_raw_values(spark, policy, keys):
    phones = tag_source(
        spark.sql("SELECT * FROM VALUES ('13800005678'), ('13811115678'), ('13800005678') AS t(phone)"), "t"
    )
    rows = mask_union([phones, phones], policy, keys, distinct=True).collect()
    assert [r.phone for r in rows] == ["138****5678"] * 2


def test_masked_columns_are_marked(people, policy, keys):
    marks = {f.name: f.metadata[MASKED] for f in apply_masking(people, policy, keys).schema}
    assert marks["customer_name"] == "tokenize" and marks["favourite"] == "deny"


def test_one_projection_no_shuffle_no_python(people, policy, keys):
    plan = apply_masking(people.repartition(4), policy, keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_ascii_engine_lets_filters_through(spark, policy, keys, tmp_path):
    spark.range(100).select(
        F.concat(F.lit("  c  "), "id").alias("customer_name"), F.col("id").alias("amount")
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = apply_masking(df, policy, keys, engine="ascii")
    assert plain.collect() == apply_masking(df, policy, keys).collect()
    text = plain.where("amount > 90")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(amount,90)" in text
    python = apply_masking(df, policy, keys, engine="python")
    assert python.collect() == plain.collect()


def test_nested_values_are_scanned(spark, policy, keys):
    """Texts inside arrays, structs and maps that pass through; everything else of the value stays."""
    number, mark = "13812345678", "[已遮掩:疑似手机号]"
    schema = "status array<string>, type struct<a: array<struct<b: string, n: int>>, s: string>, code map<string, array<string>>, total array<int>"
    rows = [
        ([number, "x", None], ([(number, 1), (None, 2)], "y"), {f"{number} a": [number], f"b {number}": None, "c": ["z"]}, [1]),
        (None, None, None, None),
        ([], ([], None), {}, []),
    ]
    df = spark.createDataFrame(rows, schema)
    masked = apply_masking(df, policy, keys)
    assert [f.dataType for f in masked.schema.fields] == [f.dataType for f in df.schema.fields]
    got = masked.collect()
    assert got[0].status == [mark, "x", None]
    assert [tuple(x) for x in got[0].type.a] == [(mark, 1), (None, 2)] and got[0].type.s == "y"
    keys_of = sorted(got[0].code, key=len)
    assert keys_of[0] == "c" and all(k.startswith(mark) for k in keys_of[1:]) and len(keys_of) == 3
    assert sorted(got[0].code.values(), key=str) == sorted([[mark], None, ["z"]], key=str)
    assert got[0].total == [1] and [tuple(r) for r in got[1:]] == [tuple(r) for r in df.collect()[1:]]
    assert masked_fields(df, policy).first()[0] == ["code", "status", "type"]


def test_reported_fields_follow_all_branches(spark, policy):
    a = tag_source(spark.sql("SELECT 'x' AS status"), "t")
    b = tag_source(spark.sql("SELECT 'x' AS customer_name"), "t")
    assert masked_fields(a.union(b), policy).first()[0] == ["status"]
