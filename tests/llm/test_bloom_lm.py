import math
import zlib
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import bloom_lm as B


def brute(rows):
    counts, texts = Counter(), 0
    words = {d: (t or "").encode().lower().split() for d, t in rows}
    for d, own in words.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(own)
            texts += 1
    n, kinds = sum(counts.values()) + texts, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (kinds + 1)))
    return {d: (len(own) + 1, sum(w in counts for w in own) + 1, n, sum(log(counts[w]) for w in own) + log(texts)) for d, own in words.items()}


def test_scores(spark):
    random = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(random.choice(vocabulary, size=int(random.integers(0, 60)), p=np.arange(400, 0, -1) / 80200))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    whole = {r.doc_id: r for r in B.score_texts(docs, frequent=50).collect()}
    for d, r in whole.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[d][:3]
        assert r.base_score == pytest.approx(want[d][3])
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1) and r.score <= 0
    passes = {r.doc_id: r for r in B.score_texts(docs, max_filter_bytes=3_000, block_tokens=50).collect()}
    for d, r in passes.items():
        assert r.base_score == pytest.approx(want[d][3])
        assert r.score == pytest.approx(whole[d].score, rel=0.1)  # other blocks, other chance hits


def lowered(count):
    return 2 ** (count.bit_length() - 1) if count else 0


def brute_pairs(rows, frequent):
    """The pair model from the counts themselves, quantised as the filter would, with no chance hits."""
    words, pairs, texts = Counter(), Counter(), 0
    split = {d: (t or "").encode().lower().split() for d, t in rows}
    for d, own in split.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            words.update(own)
            pairs.update(zip(["<"] + own, own + [">"]))
            texts += 1
    n, kinds = sum(words.values()) + texts, len(words) + 1
    exact = {w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:frequent]}
    words["<"] = words[">"] = texts

    def chance(before, word):
        known, sure = words[word] if word in exact or word == ">" else lowered(words[word]), before in exact or before == "<"
        most = words[before] if sure else 2 ** words[before].bit_length() - 1
        both = min(lowered(pairs[before, word]), known, words[before] if sure else known)
        return (both + B.PRIOR * (known + 0.5) / (n + 0.5 * (kinds + 1))) / (most + B.PRIOR)

    return {d: sum(math.log10(chance(a, b)) for a, b in zip(["<"] + own, own + [">"])) for d, own in split.items()}, chance, words


@pytest.mark.parametrize("passes", [1, 5])
@pytest.mark.parametrize("frequent", [0, 20])
def test_score_against_brute_force(spark, frequent, passes):
    """With so many bits that no unseen pair is taken for a seen one; also where no run of blocks holds all words."""
    random = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in random.exponential(12, size=int(random.integers(0, 40))))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = B.MAX_FILTER_BYTES if passes == 1 else 40_000
    got = {r.doc_id: r.score for r in B.score_texts(docs, frequent=frequent, max_filter_bytes=size, block_tokens=60, item_bits=400).collect()}
    want, chance, words = brute_pairs(rows, frequent)
    assert got == pytest.approx(want, rel=1e-6)
    for before in ["<", *[w for w in words if w not in ("<", ">")][:20]]:
        assert sum(chance(before, w) for w in words if w != "<") <= 1 + 1e-9


def test_filter_reads_counts_back():
    random = np.random.default_rng(4)
    hashes = random.integers(0, 1 << 63, size=20_000, dtype=np.uint64) * np.uint64(2)
    counts = np.maximum(1, random.geometric(0.2, size=len(hashes)) ** 2)
    frame = B._blobs(hashes, hashes, counts, 4)
    frame["grams"] = [[g[: len(g) // 18 * 9], g[len(g) // 18 * 9 :]] for g in frame["grams"]]
    rows = [(r.block, r.bits) for part in B._fill([frame], B.BITS_PER_ITEM) for r in part.itertuples()]
    model = B.LogBloom(4, 0, 16, rows)
    got, level = model.levels(hashes, hashes), B.levels(counts)
    assert (got >= level).all()  # never too low
    assert np.mean(got == level) > 0.93
    assert (B.least_counts(level) <= counts).all() and (B.most_counts(level) >= counts).all()
    unseen = random.integers(0, 1 << 63, size=20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert np.mean(model.levels(unseen, unseen) > 0) < 0.06
    half = B.LogBloom(4, 8, 16, [r for r in rows if r[0] >= 8])
    own = half.holds(hashes)
    assert (half.levels(hashes[own], hashes[own]) == got[own]).all()


def test_odd_rows(odd_docs, no_docs):
    got = B.score_texts(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert {r.n_tokens for r in got if r.doc_id == 7} == {60_001}
    assert B.score_texts(no_docs).count() == 0
