import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from veilspark import GovernedSession
from veilspark.errors import AccessDenied
from veilspark.operators import governed as g
from veilspark.operators.audited import AuditedSession
from veilspark.operators.measures import Measure
from veilspark.operators.tags import MASKED, SAFE
from veilspark.policy import SourceCatalog
from veilspark.sources import read_audit


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(f"n{i}", float(i), "call 13812345678" if i == 7 else "open", f"x{i}") for i in range(20)]
    frame = spark.createDataFrame(rows, "customer_name string, amount double, status string, mood string")
    frame.write.parquet(str(folder / "summary.parquet"))
    frame.write.parquet(str(folder / "dimension.parquet"))
    source = {"name": "default", "type": "parquet", "path": f"{folder}/{{table}}.parquet"}
    return SourceCatalog.from_document({"datasources": [source], "table_routing": [{"pattern": "*", "datasource": "default"}]})


@pytest.fixture
def dev(spark, book, policy, catalog, keys):
    return GovernedSession.open(spark, "developer", book, policy, catalog, keys, "ann")


@pytest.fixture
def audited(dev, tmp_path):
    return AuditedSession(dev, str(tmp_path / "audit"))


def records(spark, audited):
    return read_audit(spark, audited.path).orderBy("ts").collect()


def test_an_answer_and_its_record(spark, audited):
    answer = audited.sql("SELECT customer_name, status FROM {summary} WHERE amount < 10", ["summary"])
    assert answer.rows.count() == 10 and answer.masked_fields == ["customer_name", "status"]
    row = records(spark, audited)[0]
    assert row.normalized_sql == "SELECT customer_name, status FROM summary WHERE amount < ? LIMIT ?"
    assert (row.client, row.tables, row.rows_returned, row.masked_columns) == ("ann", ["summary"], 10, ["customer_name", "status"])
    assert "13812345678" not in str(answer.rows.collect())


def test_masked_fields_are_those_of_the_rows_returned(spark, audited):
    assert audited.sql("SELECT status FROM {summary} WHERE amount > 10", ["summary"]).masked_fields == []
    assert audited.sql("SELECT customer_name FROM {summary} WHERE amount > 99", ["summary"]).masked_fields == []
    assert audited.sql("SELECT status FROM {summary} ORDER BY amount", ["summary"], limit=3).masked_fields == []
    assert [r.rows_returned for r in records(spark, audited)] == [9, None, 3]


@pytest.mark.parametrize(
    "text, tables, error, reason",
    [
        ("SELECT upper(customer_name) FROM {summary}", ["summary"], AccessDenied, "FUNCTION_DENIED: function on a sensitive column"),
        ("SELECT * FROM {payroll}", ["payroll"], AccessDenied, "TABLE_NOT_ALLOWED: payroll"),
        ("SELECT nothing FROM {summary}", ["summary"], AnalysisException, "SYNTAX_ERROR: AnalysisException"),
        ("SELECT status FROM {summary} WHERE 13812345678 / (amount - amount) > 1", ["summary"], Exception, None),
    ],
)
def test_refused_and_failed_calls_are_recorded(spark, audited, text, tables, error, reason):
    with pytest.raises(error):
        audited.sql(text, tables)
    (row,) = records(spark, audited)
    assert row.status == "denied" and row.tables == tables and row.rows_returned is None
    assert row.reason == reason if reason else row.reason.startswith("SYNTAX_ERROR: ")
    assert "13812345678" not in str(row)


def test_plugins(spark, audited, book, policy, catalog, keys, tmp_path):
    got = audited.plugin_query("SELECT status, count(*) AS total FROM {summary} GROUP BY status LIMIT 9", None, ["summary"], "per_status")
    assert got.rows.count() == 2
    viewer = AuditedSession(GovernedSession.open(spark, "viewer", book, policy, catalog, keys, "bo"), audited.path)
    with pytest.raises(AccessDenied):
        viewer.plugin_query("SELECT 1", None, [], "per_status", "developer")
    with pytest.raises(AccessDenied):
        viewer.sql("SELECT 1", [])
    rows = records(spark, audited)
    assert rows[0].tool == "per_status" and rows[0].normalized_sql.endswith("LIMIT ?") and rows[0].normalized_sql.count("LIMIT") == 1
    assert {r.reason for r in rows[1:]} == {"ROLE_DENIED: per_status needs developer or higher", "ROLE_DENIED: generic queries are not allowed"}


def test_described_tables_are_recorded(spark, audited):
    assert [r.name for r in audited.describe("summary").collect()] == ["customer_name", "amount", "status", "mood"]
    with pytest.raises(AccessDenied):
        audited.describe("payroll")
    rows = records(spark, audited)
    assert [(r.tool, r.status, r.tables) for r in rows] == [
        ("describe_columns", "success", ["summary"]), ("describe_columns", "denied", ["payroll"]),
    ]
    assert rows[1].reason == "TABLE_NOT_ALLOWED: payroll" and rows[0].normalized_sql == ""


@pytest.mark.parametrize("mark", [{MASKED: "passthrough"}, {SAFE: True}, {"veil.checked": True}])
def test_forged_marks_prove_nothing(dev, mark):
    """Only what the library itself masked, found safe or checked may pass."""
    forged = dev.query(lambda s: s.table("summary").select(F.col("customer_name").alias("customer_name", metadata=mark)))
    assert all(r[0].startswith("CUST_V1_") for r in forged.collect())
    hidden = dev.query(lambda s: s.table("summary").select(F.concat("mood", F.lit("!")).alias("status", metadata=mark)))
    assert all(r[0] is None for r in hidden.collect())
    with pytest.raises(AccessDenied):
        dev.query(lambda s: s.table("summary").select(F.upper("customer_name").alias("status", metadata=mark)))


def test_forged_marks_in_a_union(dev, policy, keys):
    """A mark that nothing stands behind is denied where masked frames are put together."""
    raw = dev.table("summary").select(F.col("customer_name").alias("customer_name", metadata={MASKED: "passthrough"}))
    got = g.governed_union([raw, raw], dev.role, policy, keys)
    assert all(r[0] is None for r in got.collect())


def test_masked_parts_stay_masked_once(dev, policy, keys):
    from veilspark import apply_masking

    def build(s):
        names = apply_masking(s.table("summary").select("customer_name", "amount"), policy, keys)
        return names.join(s.table("dimension").select(F.col("amount").alias("key"), "status"), F.col("amount") == F.col("key"))

    rows = dev.query(build).collect()
    assert len(rows) == 20 and all(r.customer_name.count("_V1_") == 1 for r in rows)


def test_unions_keep_what_is_known(dev, policy):
    def derived(s):
        parts = [g.governed_derive(s.table(t), "code", F.concat("status", F.lit(t)), policy) for t in ("summary", "dimension")]
        return parts[0].select("code").union(parts[1].select("code"))

    assert dev.query(derived).where("code IS NULL").count() == 0
    counts = dev.plugin_query(
        "SELECT n AS total_n FROM (SELECT count(*) AS n FROM {summary} UNION ALL SELECT sum(amount) FROM {dimension})",
        None, ["summary", "dimension"],
    )
    assert sorted(r[0] for r in counts.collect()) == [20.0, 190.0]
    mixed = dev.plugin_query(
        "SELECT n AS total_n FROM (SELECT count(*) AS n FROM {summary} UNION ALL SELECT max(amount) FROM {dimension})",
        None, ["summary", "dimension"],
    )
    assert [r[0] for r in mixed.collect()] == [None, None]


def test_refusals_name_the_table(spark, dev, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "payroll.parquet"))
    with pytest.raises(AccessDenied, match="payroll.parquet"):
        dev.query(lambda s: s.table("summary").crossJoin(spark.read.parquet(str(tmp_path / "payroll.parquet"))))


def test_measures_over_unions(dev, policy):
    rows = dev.query(
        lambda s: g.governed_group(s.table("summary").union(s.table("dimension")), ["status"], {"total": Measure.count()}, policy)
    )
    assert sum(r.total for r in rows.collect()) == 40
