import numpy as np
import pytest
import xxhash

from veilspark.llm import simhash as S
from veilspark.llm.components import components


def brute_print(text, width=4):
    words = [w for w in (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).encode().split()]
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    n, root = len(prints), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def partition(roots):
    groups = {}
    for i, r in enumerate(roots):
        groups.setdefault(r, set()).add(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("text", ["", "one", "a b c", "a b c d", "A b C d e F g", "x " * 500, "é à b c d e"])
def test_fingerprints(text):
    assert S.simhash(text) & 0xFFFFFFFFFFFFFFFF == brute_print(text)


@pytest.mark.parametrize("block", [64, S.BLOCK])
def test_links_are_whole(spark, block, radius=4):
    """Clusters around centres, one of them crowded, in small blocks and whole."""
    random = np.random.default_rng(radius)
    prints = set()
    for size in [1] * 20 + [5] * 5 + [40]:
        centre = int(random.integers(0, 1 << 63))
        for _ in range(size):
            flips = random.choice(64, size=int(random.integers(0, 5)), replace=False) if size > 1 else []
            prints.add(centre ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, 0) for p in signed], "fp long, more long")
    links = [(r.a, r.b) for r in S.near_links(df, radius, block=block).collect()]
    place = {p: i for i, p in enumerate(signed)}
    root = list(range(len(signed)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert bin((a ^ b) & 0xFFFFFFFFFFFFFFFF).count("1") <= radius
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert partition([find(i) for i in range(len(signed))]) == partition(brute_components(prints, radius))


def test_second_word_limits_links(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (3, 255)], "fp long, more long")
    links = {(r.a, r.b) for r in S.near_links(df, 4, total=6).collect()}
    assert links == {(1, 0)}


def test_thresholds_cover_every_pair():
    random = np.random.default_rng(1)
    p = random.uniform(0.1, 0.9, 64)
    both = np.outer(p, p) * 1e6
    np.fill_diagonal(both, p * 1e6)
    for n in (100, 10**6, 10**9):
        plan = S.plan_partitions(n, both * n / 1e6, 4)
        bits = sorted(b for part, _ in plan for b in part)
        assert len(bits) == len(set(bits))
        assert sum(t + 1 for _, t in plan) == 5


def test_components(spark):
    path = [(i, i + 1) for i in range(5)]
    star = [(100, i) for i in range(101, 112)]
    edges = spark.createDataFrame(path + star + [(3, 3), (5, 4), (4, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(6)} | {i: 100 for i in range(100, 112)}
    assert components(edges.limit(0)).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = S.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = {r.component_id for r in got if r.fp == 0}
    assert empty == {3}  # null, empty and blank texts, the smallest id among them
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    nameless = [r for r in got if r.doc_id is None and r.fp != 0]
    assert len(nameless) == 2 and {r.component_id for r in nameless} == {None}
    assert S.near_duplicates(no_docs).count() == 0
