"""Registered queries against their SQL, and the pipeline stage by stage."""

import collections
import subprocess
import sys

import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.conftest import ROOT
from veilspark.llm import queries as registered
from veilspark.llm.common import stored, table

duckdb = pytest.importorskip("duckdb")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(columns), collections.Counter(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registered.queries()[name](spark, SF)
    cursor = con.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, cursor.fetchall())


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in registered.queries()] == [f"op{i}" for i in range(1, 14)]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    first = docs.limit(5).withColumn("doc_id", docs["doc_id"] + 1_000_000)
    docs = stored(docs.unionByName(first), "with-copies")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF), name)
        assert kept.columns == columns and 0 < kept.count() <= before
        assert kept.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs, before = kept, kept.count()
    assert docs.where("doc_id >= 1000000").count() == 0  # copies of smaller ids
    assert docs.groupBy("text").count().where("count > 1").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(mixed) == before


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "near_duplicates"], ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, stage, odd_docs, no_docs):
    """Nulls, blanks, repeats, a very long text and clashing names; nothing of an empty table."""
    name, run = stage
    kept = run(spark, odd_docs, SF)
    rows = kept.count()
    if name == "mixing":
        assert rows == odd_docs.count()
    else:
        assert kept.columns == odd_docs.columns and rows <= odd_docs.count()
        assert kept.where("doc_id IN (1, 2)").count() in (0, 3)  # equal texts share their fate
    assert run(spark, no_docs, SF).count() == 0


def test_repeated_rows_are_reduced_to_one(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s t u v"), (None, "q r s t u v"), (3, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(map(str, kept)) == sorted(["Row(doc_id=1, text='a b c d e f g')", "Row(doc_id=None, text='q r s t u v')", "Row(doc_id=2, text='')"])


@pytest.mark.parametrize("gone", ["veilspark.llm", "xxhash"])
def test_the_rest_works_without_the_subpackage(tmp_path, gone):
    """The entry module imports where the subpackage, or a package that it needs, is gone."""
    code = (
        f"import sys; sys.modules[{gone!r}] = None; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; "
        "assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); print(len(e.queries()))"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 90, done.stderr
