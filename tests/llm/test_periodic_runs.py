import hashlib
import random
import zlib

import numpy as np
import pytest

from veilspark.llm import periodic_runs as P


def brute_runs(words):
    """Every stretch in which words a period apart agree, for every period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(6, 4 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(text, doc_id):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    exponent = None if not found else 1000 * top[1] // top[2]
    return (doc_id, len(found), *top, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def random_texts(count, seed):
    pick = random.Random(seed)
    for _ in range(count):
        letters, words = pick.choice([1, 2, 3, 5, 50]), []
        for _ in range(pick.randint(0, 6)):
            block = [pick.randrange(letters) for _ in range(pick.randint(1, 12))]
            words += (block * 8)[: pick.randint(1, 7 * len(block))] if pick.random() < 0.6 else block
        yield [b"%d" % w for w in words]


def test_runs_of_many_texts_at_once():
    texts = list(random_texts(1500, 3))
    assert P.runs_of_texts(texts) == [brute_runs(t) for t in texts]
    assert P.runs_of_texts([]) == [] and P.runs_of_texts([[], []]) == [[], []]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 300])
def test_range_successor(n):
    pick = np.random.default_rng(n)
    values = pick.permutation(n)
    tree = P.WaveletTree(values)
    lo = pick.integers(0, n, 500)
    hi = np.minimum(n, lo + pick.integers(0, n + 1, 500))
    least = pick.integers(0, n, 500)
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(lo, hi, least, strict=True)]
    assert tree.successor(lo, hi, least).tolist() == want


def test_query_rows(spark):
    rows = [(i, " ".join(w.decode() for w in t)) for i, t in enumerate(random_texts(300, 5))]
    rows += [(1000 + i, " ".join(str(x) for x in range(40))) for i in range(200)]  # some of them are made periodic
    got = P.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), plant=True).collect()
    assert sorted(map(tuple, got)) == sorted(brute_row(t, i) for i, t in rows)
    assert sum(r.n_runs for r in got if r.doc_id >= 1000) >= 10


def test_odd_rows(spark, odd_docs, no_docs):
    got = P.periodic_runs(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    assert tuple(by_id[7])[1:6] == (1, 0, 60_000, 1, 60_000_000)
    assert by_id[3][1:] == by_id[4][1:] == by_id[5][1:]
    assert sum(r.doc_id is None for r in got) == 3 and by_id[3].start is None
    assert P.periodic_runs(no_docs).count() == 0


def test_long_periods():
    words = [b"%d" % (i % 7_001) for i in range(60_000)]
    half = [b"a", b"b"] * 30_000
    assert P.runs_of_texts([words, half]) == [[(0, 60_000, 7_001)], [(0, 60_000, 2)]]
