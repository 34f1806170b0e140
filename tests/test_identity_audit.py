import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veilspark import AccessDenied
from veilspark.frames import local_frame
from veilspark.functions import hash_id
from veilspark.operators import audit as oa
from veilspark.operators import identity as oi
from veilspark.operators import querylog as q
from veilspark.sources import read_audit, read_tokens, write_audit
from veilspark.sources.audit_log import AUDIT_FIELDS, shared_folder

ENTRIES = "pos int, raw string, client_name string, role string, status string, expires_at string"


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [
        (0, "good", "agent", "developer", "active", "2099-12-31"),
        (1, "old", "agent", "developer", "active", "2020-01-01"),
        (2, "off", "agent", "developer", "inactive", "2099-12-31"),
        (3, "twice", "first", "developer", "inactive", "2099-12-31"),
        (4, "twice", "second", "developer", "active", "2099-12-31"),
        (5, "bare", None, None, "active", None),
        (6, "today", "agent", "viewer", "active", "2024-05-05"),
        (7, "empty", "agent", "guest", "active", ""),
    ]
    df = local_frame(spark, rows, ENTRIES)
    return df.withColumn("token_hash", hash_id(F.col("raw"))).drop("raw")


def test_clients(spark, tokens):
    names = ["good", "old", "off", "twice", "bare", "today", "empty", "none"]
    requests = local_frame(spark, [(n, n) for n in names], "name string, token string")
    rows = oi.resolve_clients(requests, tokens, "2024-05-05").collect()
    assert {r.name: (r.authenticated, r.client, r.role) for r in rows} == {
        "good": (True, "agent", "developer"), "old": (False, None, None), "off": (False, None, None),
        "twice": (False, None, None), "bare": (True, "unknown", "viewer"), "today": (True, "agent", "viewer"),
        "empty": (True, "agent", "guest"), "none": (False, None, None),
    }
    assert "token" not in rows[0].asDict()


REQUESTS = [
    # authenticated, role, tool, forwarded, required → status, code
    ((False, None, "execute_query", "", ""), (401, None)),
    ((True, "developer", "execute_query", "1.2.3.4", ""), (403, None)),
    ((True, "developer", "execute_query", "", ""), (200, None)),
    ((True, "viewer", "execute_query", "1.2.3.4", ""), (200, "ROLE_DENIED")),
    ((True, "viewer", "query_audit_log", "", ""), (200, "ROLE_DENIED")),
    ((True, "developer", "query_audit_log", None, ""), (200, None)),
    ((True, "guest", "list_datasets", "", ""), (200, "ROLE_DENIED")),
    ((True, "viewer", "plug", "1.1.1.1", "developer"), (200, "ROLE_DENIED")),
    ((True, "viewer", "plug", "", "viewer"), (200, None)),
    ((True, "viewer", "plug", "", "auditor"), (200, None)),
    ((True, "viewer", "list_datasets", "", None), (200, None)),
]


def test_authorisation(spark, book):
    rows = [(i, *r) for i, (r, _) in enumerate(REQUESTS)]
    layout = "i int, authenticated boolean, role string, tool string, forwarded_for string, require_role string"
    got = oi.authorize_requests(local_frame(spark, rows, layout), book).collect()
    assert [(r.http_status, r.code) for r in sorted(got, key=lambda r: r.i)] == [w for _, w in REQUESTS]


def test_registry_file(spark, tmp_path):
    good = tmp_path / "tokens.json"
    entry = {"token_hash": "sha256:a", "client_name": "x", "status": "active"}
    good.write_text(json.dumps({"tokens": [entry, {"token_hash": "b"}]}, indent=2))
    rows = read_tokens(spark, str(good)).orderBy("pos").collect()
    assert [(r.pos, r.token_hash, r.role) for r in rows] == [(0, "sha256:a", None), (1, "b", None)]
    broken = tmp_path / "broken.json"
    broken.write_text('{"tokens": [')
    assert read_tokens(spark, str(broken)).count() == 0
    assert read_tokens(spark, str(tmp_path / "missing.json")).count() == 0


JUDGED = (
    "query_id long, role string, client string, tool string, ts timestamp_ntz, sql_text string, dialect string,"
    " code string, detail string, tables array<string>, parsed boolean, rows_returned long, duration_ms long,"
    " masked_columns array<string>"
)


@pytest.fixture(scope="module")
def judged(spark):
    t = dt.datetime(2024, 1, 1, 12, 0, 0)
    us = dt.timedelta(microseconds=5)
    rows = [
        (1, "developer", "a", "execute_query", t, "SELECT x FROM t WHERE n = '陈一鸣' AND k = 77", "mysql", None, None,
         ["t"], True, 3, 0, ["x"]),
        (2, "viewer", "b", "plug", t + us, "SELECT 1 FROM p", "mysql", "TABLE_NOT_ALLOWED", "p", ["p"], True, 0, 5, []),
        (3, "viewer", "b", "execute_query", t, "NOT SQL 13812345678", "mysql", "SYNTAX_ERROR", "", [], False, 0, 0, []),
    ]
    return local_frame(spark, rows, JUDGED)


def test_audit_records(judged):
    rows = {r.client + r.tool: r for r in oa.build_audit(judged).collect()}
    ok = rows["aexecute_query"]
    assert ok.ts == "2024-01-01T20:00:00+08:00" and ok.status == "success" and ok.reason is None
    assert ok.normalized_sql == "SELECT x FROM t WHERE n = ? AND k = ?"
    assert (ok.rows_returned, ok.duration_ms, ok.masked_columns) == (3, None, ["x"])
    bad = rows["bplug"]
    assert bad.ts == "2024-01-01T20:00:00.000005+08:00"
    assert (bad.status, bad.reason, bad.rows_returned, bad.duration_ms) == (
        "denied", "TABLE_NOT_ALLOWED: p", None, 5,
    )
    assert bad.masked_columns is None
    broken = rows["bexecute_query"]
    assert (broken.normalized_sql, broken.reason) == ("<unparseable>", "SYNTAX_ERROR: ")


def test_denied_records(judged):
    failed = judged.withColumn("error_type", F.when(F.col("query_id") == 1, "TimeoutError"))
    reasons = {r.reason for r in oa.build_denied(failed).collect()}
    assert reasons == {"TIMEOUT: TimeoutError", "TABLE_NOT_ALLOWED: p", "SYNTAX_ERROR: "}
    assert oa.build_denied(judged).count() == 2


def test_log_file_round_trip(spark, judged, tmp_path):
    path = str(tmp_path / "audit")
    records = oa.build_audit(judged)
    write_audit(records, path)
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert '"rows_returned":0' not in text and "columns_accessed" not in text and "陈一鸣" not in text
    (tmp_path / "audit" / "extra.json").write_text(
        '\n\n{"broken": \nnot json\n{"ts": "2025-01-01T00:00:00+08:00", "client": "张"}\n', encoding="utf-8"
    )
    (tmp_path / "audit" / "odd.json").write_text('{"ts": "2023", "client": "odd", "rows_returned": "many"}\n')
    back = read_audit(spark, path)
    odd = back.where("client = 'odd'").first()
    assert odd.ts == "2023" and odd.rows_returned is None
    assert back.select("client").count() == back.count() == 5
    back = back.where("client != 'odd'")
    assert back.columns == list(AUDIT_FIELDS)
    assert back.count() == 4
    newest = oa.recent_audit(back, 2).collect()
    assert [r.client for r in newest] == ["张", "b"]
    again = back.where("client != '张'").orderBy("client", "tool").collect()
    assert again == records.orderBy("client", "tool").collect()


@pytest.mark.parametrize("asked, n", [(20, 20), (0, 1), (-5, 1), (100, 100), (5000, 100)])
def test_recent_is_clamped(asked, n):
    assert oa.clamp_recent(asked) == n


def test_one_event(spark, tmp_path):
    denied = AccessDenied("TABLE_NOT_ALLOWED", "payroll")
    at = dt.datetime(2024, 1, 1)
    for event in (
        oa.audit_event(spark, "c", "developer", "execute_query", "SELECT 5", ["t"], at=at, rows_returned=2),
        oa.audit_event(spark, "c", "viewer", "plug", "SELECT 'x'", ["payroll"], denied=denied, at=at),
    ):
        write_audit(oa.build_audit(event), str(tmp_path / "log"))
    rows = {r.status: r for r in read_audit(spark, str(tmp_path / "log")).collect()}
    assert rows["success"].normalized_sql == "SELECT ?" and rows["success"].rows_returned == 2
    assert rows["denied"].reason == "TABLE_NOT_ALLOWED: payroll" and rows["denied"].tables == ["payroll"]


class Session:
    """Stands in for a session: that setting is fixed when a session starts."""

    def __init__(self, **settings):
        self.conf = settings


def test_shared_folder_prefers_the_cluster_setting():
    named = Session(**{"spark.checkpoint.dir": "/shared/x/", "spark.master": "yarn"})
    one, two = shared_folder(named, "audit"), shared_folder(named, "audit")
    assert one.startswith("/shared/x/audit-") and one != two
    with pytest.raises(RuntimeError):
        shared_folder(Session(**{"spark.master": "yarn"}), "audit")
    assert shared_folder(Session(**{"spark.master": "local[2]"}), "audit")


def test_audit_text_paths(spark):
    df = spark.sql("SELECT false AS p, 'plug' AS tool, 'x 1' AS s, 'mysql' AS d")
    text = q.audit_text(F.col("p"), F.col("tool"), F.col("s"), F.col("d"), F.lit(False))
    assert df.select(text.alias("t")).first().t == ""
