import re

import pytest

from veilspark.llm.mixing import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, top=3):
    """Weights 1, 2, 3 by code point, null last; caps filled one after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > top * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = top * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_budgets(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 4 if i % 3 else 0}") for i in range(600)] + [(1000 + i, "w", "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    assert {s: int(want[s] + 1e-9) for s in want} == taken  # cut exactly
    assert want["tiny"] == 9  # three times its size
    again = mix_sources(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 0.0)], "source string, weight double")
    taken = {"a": 0, "b": 0}
    for r in mix_sources(docs, weights).collect():
        taken[r.source] += r.taken
    assert taken == {"a": 1000, "b": 0}


def test_odd_rows(odd_docs, no_docs):
    got = mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.size for r in got if r.doc_id == 7) == 60_000
    assert mix_sources(no_docs).count() == 0
