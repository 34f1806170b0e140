"""The near-duplicates stage against the Jaccard similarity of all pairs."""

import random

import numpy as np

import corpus_pipeline
from tests.conftest import SF
from veilspark.llm import near_sets as N


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def survivors(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_short_texts_have_no_chance_links(spark):
    """Unrelated texts of few shingles link neither to empty ones nor to each other."""
    rng = random.Random(3)
    texts = [None, "", " \n"] + [" ".join(words(rng, 1 + i % 10)) for i in range(400)]
    assert survivors(spark, texts) == [0, *range(3, len(texts))]


def nested(rng, share):
    """Two texts whose Jaccard similarity is ``share`` or a little less, by a tail that only one has."""
    whole = words(rng, rng.randrange(24, 300))
    kept = int((len(whole) - 4) * share) + 4
    return [" ".join(whole), " ".join(whole[:kept])]


def edited(rng, share):
    """Two texts with words replaced here and there."""
    whole = words(rng, rng.randrange(40, 300))
    other = list(whole)
    for _ in range(max(1, int(len(whole) * (1 - share) / (1 + share) / 5))):
        other[rng.randrange(len(other))] = words(rng, 1)[0]
    return [" ".join(whole), " ".join(other)]


def planted():
    rng = random.Random(7)
    texts = []
    for share in (0.6, 0.7, 0.75, 0.79, 0.8, 0.81, 0.85, 0.9):
        for _ in range(12):
            texts += nested(rng, share) + edited(rng, share)
    for n in (5, 6, 8, 9, 10, 13, 14):  # nested short texts: 4 of 5 shingles link, 3 of 4 don't
        for _ in range(8):
            short = words(rng, n)
            texts += [" ".join(short), " ".join(short[:-1])]
    line = words(rng, 30)  # one line in texts of all kinds, and a crowd of edits of one text
    texts += [" ".join(line + words(rng, rng.randrange(1, 200))) for _ in range(60)]
    base = words(rng, 80)
    for _ in range(80):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = words(rng, 1)[0]
        texts.append(" ".join(own))
    return texts


def test_stage_is_that_of_all_pairs(spark):
    texts = planted()
    groups = brute_groups(texts)
    sizes = [groups.count(g) for g in set(groups)]
    assert max(sizes) > 20 and sizes.count(1) > 100 and sizes.count(2) > 50
    assert survivors(spark, texts) == sorted(set(groups))


def test_every_link_is_compared_or_implied(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.root for r in N.near_sets(docs, 5).collect()}
    groups = brute_groups(texts)
    assert len({(got[i], groups[i]) for i in got}) == len(set(got.values())) == len(set(groups))


def test_simhash_links_by_itself(spark, monkeypatch):
    """Texts with few words changed are found by their fingerprints alone; texts whose fingerprints meet by chance aren't linked."""
    rng = random.Random(11)
    texts = []
    for _ in range(20):
        base = words(rng, 400)
        texts += [" ".join(base), " ".join(base + words(rng, 1)), " ".join(words(rng, 1) + base)]
    monkeypatch.setattr(N, "shared_rows", lambda rows: rows.where("false"))
    kept = survivors(spark, texts)
    assert set(kept) >= set(range(0, 60, 3)) and len(kept) <= 22
    monkeypatch.setattr(N, "near_links", lambda prints, radius: prints.selectExpr("fp AS a", "fp AS b").where("false"))
    assert len(survivors(spark, texts)) > 40  # equal fingerprints alone
    # Every two fingerprints taken for near: the whole sets decide.
    monkeypatch.setattr(N, "near_links", lambda prints, radius: prints.selectExpr("fp AS a").crossJoin(prints.selectExpr("fp AS b")).where("a > b"))
    assert survivors(spark, [*texts, "", "a", "b c d e f g"]) == [*range(0, 60, 3), 60, 61, 62]


def test_fingerprint_pairs(spark):
    """Sets of one fingerprint pair with the first of them, near ones by theirs; copies of a set are one."""
    marked = spark.createDataFrame([(5, 0), (3, 0), (3, 0), (9, 1), (7, 255), (8, 255)], "sid long, fp long")
    assert {tuple(r) for r in N.fingerprint_pairs(marked).collect()} == {(5, 3), (9, 3), (8, 7)}


def test_parities_rule_out_no_link(spark):
    """Pairs at every similarity, sizes on either side of a power of two and apart: none that links is ruled out, most others are."""
    rng = np.random.default_rng(5)
    sets, pairs, links = [], [], set()
    for n in (1, 2, 5, 63, 64, 65, 128, 129, 130, 500, 1030):
        for share in (1.0, 0.95, 0.9, 0.85, 0.82, 0.8, 0.78, 0.7, 0.5, 0.1, 0.0):
            for shrink in (1.0, 0.9, 0.8):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                b = np.concatenate([a[: int(n * share)], rng.integers(0, 1 << 63, max(1, int((n - int(n * share)) * shrink))).astype(np.uint64)])
                at = len(sets)
                sets += [np.unique(a), np.unique(b)]
                pairs.append((at + 1, at))
                if alike(set(sets[at].tolist()), set(sets[at + 1].tolist())):
                    links.add((at + 1, at))
    rows = [(i, len(x), N.parities(x).tolist()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "sid long, n int, parity array<long>")
    left = {tuple(r) for r in N.likely(spark.createDataFrame(pairs, "a long, b long"), df).collect()}
    assert 50 < len(links) and links <= left and len(left) < len(links) + 0.4 * (len(pairs) - len(links))


def near_copies(rng, n, length=120, edits=9):
    """Edits of one text, so many words replaced that a good part of them links to none of the others."""
    base = words(rng, length)
    texts = [" ".join(base)]
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(1, edits)):
            own[rng.randrange(length)] = words(rng, 1)[0]
        texts.append(" ".join(own[: length - rng.randrange(4)]))
    return texts


def test_near_copies_of_one_text_are_not_paired_with_each_other(spark, monkeypatch):
    """Pairs whose whole sets are compared grow with a group of near copies, not with its square; groups are those of all pairs."""
    rng, store, compared = random.Random(23), N.stored_and_freed, []

    def counted(df, name):
        out = store(df, name)
        if name in ("end-pairs", "other-pairs"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(N, "stored_and_freed", counted)
    texts = near_copies(rng, 500)
    groups = brute_groups(texts)
    assert len(set(groups)) > 100 and max(map(groups.count, set(groups))) > 100
    assert survivors(spark, texts) == sorted(set(groups))
    assert sum(compared) < 12 * len(texts)


def test_pivots_lose_no_link(spark, monkeypatch):
    """The groups are those of all pairs if every shared shingle counts as crowded, whatever its pivot."""
    monkeypatch.setattr(N, "CROWD", 1)
    texts = planted() + near_copies(random.Random(29), 60, 60, 7)
    assert survivors(spark, texts) == sorted(set(brute_groups(texts)))
    monkeypatch.setattr(N, "main_pivots", lambda rows, sets, share: rows.selectExpr("pivot", "pivot AS main").where("false"))
    monkeypatch.setattr(N, "NEAR", (0, 1))
    monkeypatch.setattr(N, "fingerprint_pairs", lambda marked: marked.selectExpr("sid AS a", "sid AS b").where("false"))
    assert survivors(spark, texts) == sorted(set(brute_groups(texts)))


def test_differences_of_linked_sets_meet():
    """Of two linked sets, one not linked to the pivot, some of the first hashes that tell them apart from it are the same."""
    rng, counts, links = np.random.default_rng(13), np.zeros(1 << N.COUNTER_BITS, dtype=np.int32), 0
    for _ in range(3000):
        share = (4, 5) if rng.random() < 0.7 else (2, 3)
        pool = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        pool[:40] >>= np.uint64(int(rng.integers(0, 30)))
        size = int(rng.integers(1, 60))
        pivot = pool[:size]
        first = rng.permutation(pool)[: max(1, size - int(rng.integers(0, 20)))] if rng.random() < 0.2 else np.concatenate(
            [rng.permutation(pivot)[: max(1, int(size * rng.uniform(0.4, 1)))], pool[60 : 60 + int(rng.integers(0, 12))]]
        )
        other = np.concatenate([rng.permutation(first)[: max(1, int(len(first) * rng.uniform(0.75, 1)))], pool[80 : 80 + int(rng.integers(0, 4))]])
        first, other, pivot = (np.unique(x) for x in (first, other, pivot))
        told = [
            N.differences(np.setdiff1d(x, pivot), np.setdiff1d(pivot, x), len(x), len(pivot), counts, share) for x in (first, other)
        ]
        alike_sets = lambda x, y: share[1] * len(np.intersect1d(x, y)) >= share[0] * len(np.union1d(x, y))  # noqa: B023, E731
        assert [t[0] for t in told] == [alike_sets(x, pivot) for x in (first, other)]
        if not alike_sets(first, other):
            continue
        for (linked, _, probe, _, keys), (_, _, _, index, others) in (told, told[::-1]):
            if not linked:
                links += 1
                assert set(keys[:probe].tolist()) & set(others[:index].tolist())
    assert links > 500
