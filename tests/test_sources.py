import decimal
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import POLICY_DOC, SF, SOURCES_DOC
from veilspark import AccessDenied, MaskingPolicy, RoleBook, SourceCatalog
from veilspark.frames import local_frame
from veilspark.operators.catalog import describe_columns, list_datasets
from veilspark.operators.masking import column_masking_info, sensitive_columns
from veilspark.operators.routing import route_tables
from veilspark.plans.registry import PLANS
from veilspark.policy import DataSource, read_document
from veilspark.sources.policy_files import numbered, read_large_registry, read_tokens
from veilspark.sources import (
    column_catalog,
    decimals_as_double,
    expand_rules,
    jdbc_options,
    load_policy,
    load_rules,
    override_rows,
    param_query,
    read_source,
    routed_read,
    rule_entries,
    rule_rows,
)


def test_rules_from_json(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(POLICY_DOC, ensure_ascii=False), encoding="utf-8")
    rows = {r.column_name: (r.action, r.namespace, r.prefix) for r in load_rules(spark, str(path)).collect()}
    policy = load_policy(spark, str(path))
    assert rows == {c: (r.action, r.namespace, r.prefix) for c, r in policy.rules.items()}


def test_rules_from_yaml(spark, tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    monkeypatch.setenv("VEIL_TEST_PREFIX", "CU")
    path = tmp_path / "rules.yaml"
    path.write_text(
        "defaults:\n  unknown_column: deny\nrules:\n"
        "  - columns: [\"Name\", \"名字\"]\n    action: tokenize\n    namespace: ${VEIL_UNSET}\n"
        "    prefix: \"${VEIL_TEST_PREFIX}\"\n",
        encoding="utf-8",
    )
    rows = {r.column_name: (r.action, r.namespace, r.prefix) for r in load_rules(spark, str(path)).collect()}
    assert rows == {"name": ("tokenize", "", "CU"), "名字": ("tokenize", "", "CU")}


def test_empty_yaml_is_an_empty_document(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "x.yaml"
    path.write_text("# nothing\n")
    assert MaskingPolicy.from_document(read_document(spark, str(path))).rules == {}


def test_environment(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("VEIL_A", 'x"y')
    monkeypatch.delenv("VEIL_B", raising=False)
    path = tmp_path / "doc.json"
    path.write_text('{"a": ["${VEIL_A}-${VEIL_B}", 5], "b": "${not a name}"}')
    assert read_document(spark, str(path)) == {"a": ['x"y-', 5], "b": "${not a name}"}


def test_last_definition_wins(spark):
    doc = {"rules": [
        {"columns": ["A", "b"], "action": "deny"},
        {"columns": ["a"], "action": "tokenize", "namespace": "n", "prefix": "P"},
    ]}
    rows = {r.column_name: r.action for r in expand_rules(rule_entries(spark, doc)).collect()}
    assert rows == {"a": "tokenize", "b": "deny"}


def test_sensitive_columns(spark):
    policy = MaskingPolicy.from_document({**POLICY_DOC, "table_overrides": {"t": {"Odd": "deny", "amount": "passthrough"}}})
    got = {r[0] for r in sensitive_columns(rule_rows(spark, policy), override_rows(spark, policy)).collect()}
    assert got == policy.sensitive_columns
    assert "odd" in got and "amount" not in got


def test_masking_info_ignores_overrides_unless_asked(spark):
    policy = MaskingPolicy.from_document({**POLICY_DOC, "table_overrides": {"t": {"amount": "deny"}}})
    columns = local_frame(
        spark, [("T", "Amount"), ("u", "amount"), ("t", "what")], "table_name string, column_name string"
    )
    plain = column_masking_info(columns, rule_rows(spark, policy), policy).collect()
    assert {(r.table_name, r.masking) for r in plain} == {("T", "passthrough"), ("u", "passthrough"), ("t", "deny")}
    aware = column_masking_info(columns, rule_rows(spark, policy), policy, table="table_name").collect()
    assert {(r.table_name, r.masking) for r in aware} == {("T", "deny"), ("u", "passthrough"), ("t", "deny")}


def test_role_defaults():
    book = RoleBook.from_document({"roles": {"r": {"allowed_tables": ["A"]}}})
    role = book.roles["r"]
    assert role.allowed == {"a"} and role.max_union_depth == 2 and not role.allow_union
    assert book.filter_columns == {"n_year", "n_period", "fyear", "fperiod"}


ROUTES = {
    "datasources": SOURCES_DOC["datasources"],
    "table_routing": [
        {"pattern": "ODS_x", "datasource": "exact"}, {"pattern": "ods_*", "datasource": "ss"},
        {"pattern": "o*", "datasource": "late"}, {"pattern": "a_b*", "datasource": "default"},
    ],
}
NAMES = {
    "ods_x": "exact", "ODS_X": "exact", "ods_y": "ss", "Ods_": "ss", "orders": "late", "o": "late",
    "a_b": "default", "a_": "default", "z": "default", "": "default",
}


def test_routing(spark):
    catalog = SourceCatalog.from_document(ROUTES)
    assert {n: catalog.source_of(n) for n in NAMES} == NAMES
    df = local_frame(spark, [(n,) for n in NAMES], "table_name string")
    assert {r.table_name: r.datasource for r in route_tables(df, catalog).collect()} == NAMES
    got = {r.table_name: r.database for r in route_tables(df, catalog).collect()}
    assert got["ods_y"] == "testdb" and got["z"] == "shop" and got["orders"] == ""


def test_long_route_lists_are_one_projection(spark):
    routes = [{"pattern": f"t{i}_*", "datasource": f"d{i}"} for i in range(100)] + [{"pattern": "*", "datasource": "rest"}]
    catalog = SourceCatalog.from_document({"table_routing": routes})
    names = [f"T{i}_x" for i in range(0, 100, 9)] + ["other", "t1"]
    routed = route_tables(local_frame(spark, [(n,) for n in names], "table_name string"), catalog)
    assert {r.table_name: r.datasource for r in routed.collect()} == {n: catalog.source_of(n) for n in names}
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("n", [10, 80])
def test_routes_work_on_a_stream(spark, tmp_path, n):
    routes = [{"pattern": f"t{i}_*", "datasource": f"d{i}"} for i in range(n)]
    catalog = SourceCatalog.from_document({"table_routing": routes})
    spark.createDataFrame([("T3_a",), ("x",)], "table_name string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("table_name string").parquet(str(tmp_path / "in"))
    query = route_tables(stream, catalog).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.table_name: r.datasource for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"T3_a": "d3", "x": "default"}


def test_a_folder_of_policies_is_refused(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name in "ab":
        (tmp_path / "p" / f"{name}.json").write_text("{}")
    with pytest.raises(ValueError):
        read_document(spark, str(tmp_path / "p"))
    assert read_document(spark, str(tmp_path / "p" / "a.json")) == {}


def test_dialects():
    catalog = SourceCatalog.from_document(SOURCES_DOC)
    assert catalog.dialect_of("orders") == "mysql" and catalog.dialect_of("ss_x") == "tsql"
    assert DataSource("x", "MariaDB").dialect == "mysql" and DataSource("x", "mssql").dialect == "tsql"
    assert DataSource("x", "postgresql").dialect == "postgres" and DataSource("x", "other").dialect == "mysql"


def test_mysql_options():
    source = DataSource("m", "mysql", "db", {"host": "h", "port": 3307, "user": "u", "password": "p"})
    opts = jdbc_options(source, "t")
    assert opts["url"] == "jdbc:mysql://h:3307/db" and opts["dbtable"] == "`t`"
    assert opts["user"] == "u" and "numPartitions" not in opts


def test_sqlserver_options():
    source = DataSource(
        "s", "mssql", "db",
        {"user": "u", "password": "p", "encrypt": "no", "partition_column": "id", "lower_bound": 0,
         "upper_bound": 100, "partitions": 6, "maxsize": 2, "timeout_seconds": 30},
    )
    opts = jdbc_options(source, "t")
    assert opts["url"].endswith("databaseName=db;encrypt=false;trustServerCertificate=true")
    assert opts["dbtable"] == "[dbo].[t]" and opts["numPartitions"] == "6" and opts["queryTimeout"] == "30"


def test_unsupported_source():
    with pytest.raises(ValueError):
        jdbc_options(DataSource("p", "postgresql", "db"), "t")


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_file_sources(spark, tmp_path, kind):
    df = spark.range(5).select("id", F.concat(F.lit("n"), "id").alias("name"))
    df.write.format(kind).save(str(tmp_path / "t"))
    options = {"path": str(tmp_path) + "/{table}", "schema": "id long, name string"}
    got = read_source(spark, DataSource("f", kind, "", options), "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_missing_source(spark):
    with pytest.raises(ValueError):
        routed_read(spark, "t", SourceCatalog())


def test_parameters(spark):
    df = spark.range(10).toDF("n")
    assert param_query(spark, "SELECT * FROM {t} WHERE n > ?", [7], t=df).count() == 2
    assert param_query(spark, "SELECT * FROM {t} WHERE n > :x", {"x": 8}, t=df).count() == 1


def test_decimals(spark):
    df = local_frame(spark, [(decimal.Decimal("1.10"), 1)], "d decimal(10,2), n int")
    out = decimals_as_double(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["double", "int"] and out.first().d == 1.1


def test_column_catalog(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b").select("a", F.col("b").alias("b", metadata={"comment": "hi"}))
    rows = column_catalog(spark, {"t": df}).collect()
    assert [(r.ordinal, r.column_name, r.data_type, r.comment) for r in rows] == [(1, "a", "int", ""), (2, "b", "string", "hi")]


def test_describe_and_list(spark, tmp_path, policy, book):
    spark.sql("SELECT 'x' AS customer_name, 1 AS amount, 2 AS odd").write.parquet(str(tmp_path / "v_view"))
    catalog = SourceCatalog.from_document(
        {"datasources": [{"name": "default", "type": "parquet", "database": "lake", "path": str(tmp_path) + "/{table}"}]}
    )
    rows = describe_columns(spark, "v_view", book.roles["viewer"], catalog, policy).collect()
    assert [(r.name, r.type, r.masking) for r in rows] == [
        ("customer_name", "string", "tokenize"), ("amount", "int", "passthrough"), ("odd", "int", "deny"),
    ]
    with pytest.raises(AccessDenied):
        describe_columns(spark, "summary", book.roles["viewer"], catalog, policy)
    listed = {r.name: (r.type, r.database) for r in list_datasets(spark, book, catalog, "developer").collect()}
    assert listed == {
        "Summary": ("table", "lake"), "detail": ("table", "lake"), "dimension": ("table", "lake"), "v_view": ("view", "lake"),
    }
    with pytest.raises(AccessDenied):
        list_datasets(spark, book, catalog, "hacker")


def test_one_registry_read_by_many_tasks(spark, tmp_path):
    """Entries are cut by bytes wherever the ranges fall; all arrive once, in their order."""
    entry = lambda i: {"token_hash": f"h{i}", "client_name": "é\\" * (i % 5), "role": "r", "status": "active", "expires_at": None}
    doc = {"tokens": [entry(i) for i in range(500)]}
    path = tmp_path / "tokens.json"
    path.write_text(json.dumps(doc, indent=1, ensure_ascii=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        found = read_large_registry(spark, str(path))
        assert found.rdd.getNumPartitions() > 10
        rows = found.orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = read_tokens(spark, str(path)).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in rows] == [tuple(r)[1:] for r in whole] and len(rows) == 500


def test_a_brace_inside_a_text(spark, tmp_path):
    path = tmp_path / "tokens.json"
    path.write_text(json.dumps({"tokens": [{"token_hash": "a}b", "client_name": "{", "role": "r", "status": "active"}] * 2}))
    assert [r.token_hash for r in read_large_registry(spark, str(path)).collect()] == ["a}b", "a}b"]


def test_no_registry(spark, tmp_path):
    path = tmp_path / "tokens.json"
    path.write_text(json.dumps({"tokens": []}))
    assert read_large_registry(spark, str(path)).count() == 0


def test_places_in_a_registry_of_parts(spark, tmp_path):
    """A document in parts, each cut into ranges: places run on from part to part, and no task counts them all."""
    entry = lambda i: json.dumps({"token_hash": f"h{i}", "client_name": "c", "role": "r", "status": "active"})
    for part in range(3):
        lines = [entry(i) + "," for i in range(200 * part, 200 * part + 200)]
        ends = ['{"tokens": ['] * (part == 0), ["null]}"] * (part == 2)
        (tmp_path / f"part-{part}").write_text("\n".join([*ends[0], *lines, *ends[1]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        found = numbered(read_large_registry(spark, str(tmp_path)), "place")
        rows = {r.place: r.token_hash for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {i + 1: f"h{i}" for i in range(600)}
    assert [r.place for r in numbered(read_large_registry(spark, str(tmp_path / "part-0")).limit(0), "place").collect()] == []


def test_places_in_a_document_parsed_whole(spark, tmp_path):
    path = tmp_path / "tokens.json"
    path.write_text(json.dumps({"tokens": [{"token_hash": h, "client_name": "{", "role": "r"} for h in ("a}b", "c")]}))
    found = numbered(read_large_registry(spark, str(path)), "place").orderBy("place").collect()
    assert [(r.place, r.token_hash) for r in found] == [(1, "a}b"), (2, "c")]


def test_the_registry_query_sorts_nothing_in_one_task(spark):
    """Entries are sorted by ranges when written and counted by ranges when read."""
    plan = PLANS["read_large_registry"].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert windows and all("ahead" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in windows)
