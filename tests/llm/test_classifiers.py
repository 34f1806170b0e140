import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from veilspark.llm import quality_fm as Q
from veilspark.llm import toxicity as X
from veilspark.llm.words import Texts, chunks

RUDE, KIND = ("zorkish", "blemful"), ("meadow", "river", "stone", "cloud", "lantern", "harvest")


@pytest.fixture(scope="module")
def corpus(spark):
    """Plain texts; every third has rude words, every fourth shouts symbols."""
    random = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(600):
        words = list(random.choice(KIND, size=40))
        if i % 3 == 0:
            words[5] = words[20] = RUDE[i % 2]
        if i % 4 == 0:
            words = [w.upper() + "!!$$" for w in words]
        rows.append((i, " ".join(words), 0))
        marks.append((i, int(i % 4 != 0), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("score, label, cut", [(X.score_toxicity, 2, 0.5), (Q.score_quality, 1, 0.3)])
def test_held_out_rows(corpus, score, label, cut):
    docs, labels, marks = corpus
    truth = {m[0]: m[label] for m in marks}
    rows = score(docs, labels).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.95


@pytest.mark.parametrize("score", [X.score_toxicity, Q.score_quality])
def test_odd_rows(odd_docs, no_docs, labels, score):
    got = score(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        if r.doc_id in (3, 4):
            by_text.setdefault("empty", set()).add(r.score)
        if r.doc_id in (1, 2):
            by_text.setdefault("same", set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values())
    assert score(no_docs, labels).count() == 0
    assert score(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_gram_hashes_agree():
    grams, letters = X.gram_hashes(np.array(["ab", "é"], dtype=object))
    names = [X.START + "a", X.START + "ab", X.START + "ab" + X.END, X.START + "é", X.START + "é" + X.END]
    assert grams.tolist() == X.hash_of_grams(pd.Series(names)).tolist() and letters.tolist() == [3, 2]


def test_shared_model_sums_to_one():
    words = ["abc", "abd", "bcd", "zzz"] * 3
    grams: dict = {}
    for w in words:
        s = X.START + w + X.END
        for i in range(1, len(s)):
            g = s[max(0, i - X.CONTEXT) : i + 1]
            grams[g] = grams.get(g, 0) + 1
    names = pd.Series(list(grams))
    chance = X.shared_model(names, np.array(list(grams.values()), dtype=float))
    total = pd.Series(chance).groupby(names.str.slice(0, -1)).sum()
    assert (total <= 1 + 1e-9).all() and (chance > 0).all()


def brute_chance(counts, shared, gram):
    """Discounted count of a gram after its context; what was taken off, and ``SHARED`` besides, goes by the shared chance."""
    same = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
    total, kinds = sum(same), sum(n > 0 for n in same)
    return (max(counts.get(gram, 0) - X.DISCOUNT, 0) + (X.DISCOUNT * kinds + X.SHARED) * shared) / (total + X.SHARED)


def brute_shared(counts, letters):
    """Kneser-Ney, order by order: a shorter context counts the different letters before it."""

    def chance(counts, gram):
        same = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if len(gram) > 1:
            kinds = {g for g in counts if len(g) > 1}
            lower = {}
            for g in kinds:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            base = chance(lower, gram[1:])
        else:
            base = 1 / letters
        total = sum(same.values())
        return (max(counts[gram] - X.DISCOUNT, 0) + X.DISCOUNT * len(same) * base) / total

    return {g: chance(counts, g) for g in counts}


def test_ratios_against_brute_force():
    random = np.random.default_rng(2)
    classes = [["".join(random.choice(list(letters), size=3)) for _ in range(12)] for letters in ("abc", "bcd")]
    counts = [{}, {}]
    for own, words in zip(counts, classes, strict=True):
        for w in words:
            s = X.START + w + X.END
            for i in range(1, len(s)):
                g = s[max(0, i - X.CONTEXT) : i + 1]
                own[g] = own.get(g, 0) + 1
    grams = sorted(set(counts[0]) | set(counts[1]))
    both = {g: counts[0].get(g, 0) + counts[1].get(g, 0) for g in grams}
    found = pd.DataFrame({"gram": grams})
    for y in range(2):
        for fold in range(X.CROSS):
            found[f"n{y * X.CROSS + fold}"] = [counts[y].get(g, 0) if fold == 1 else 0 for g in grams]
    shared = brute_shared(both, len({g[-1] for g in grams}) + 1)
    want = [np.log(brute_chance(counts[1], shared[g], g) / brute_chance(counts[0], shared[g], g)) for g in grams]
    got = X.class_ratios(found)
    assert got["r0"].to_numpy() == pytest.approx(want, abs=1e-5) and not got["r1"].any()

    # The score of a text compares its two log-likelihoods, by words.
    by_gram = dict(zip(grams, want, strict=True))
    text = " ".join(classes[0][:3] + classes[1][:2] + ["zz"])
    total = 0.0
    for w in text.split():
        s = X.START + w + X.END
        total += sum(by_gram.get(s[max(0, i - X.CONTEXT) : i + 1], 0.0) for i in range(1, len(s)))
    blobs = X.packed(found).iloc[0]
    hashes = np.frombuffer(blobs["hashes"], np.uint64)
    ratio, _, words = X.text_features(pd.Series([text, None]), hashes, np.frombuffer(blobs["folds"], np.float16).reshape(-1, X.CROSS))
    assert ratio[0, 0] == pytest.approx(total / 6, abs=0.01) and words.tolist() == [6, 0] and ratio[1, 0] == 0


def test_words_are_parted_alike(spark):
    """White space beyond ASCII parts words in training as it does in scoring."""
    texts = spark.createDataFrame([("a\u3000b\u00a0C\x1fd", 1)], "text string, label int")
    got = {r.gram for r in X.gram_counts(texts).collect()}
    assert {g for g in got if len(g) == 2} == {X.START + w for w in "abcd"}


def test_labelled_rows_are_bounded(spark):
    """An id that very many rows have is one row."""
    from veilspark.llm.labelled import labelled_texts

    docs = spark.range(2_000).selectExpr("1L AS doc_id", "concat('t', id) AS text", "5 AS n")
    docs = docs.unionByName(spark.createDataFrame([(2, "x", 1), (2, "x", 1), (None, "y", 1)], "doc_id long, text string, n int"))
    marks = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(2, 0), (None, 1)], "doc_id long, toxic int")
    got = labelled_texts(docs, marks, "toxic").collect()
    assert len(got) == 2 and {r.label for r in got} == {1} and got[0].asDict().keys() == {"text", "n", "label"}


def test_pairs_in_linear_time():
    """The sum-of-squares identity against all pairs one by one."""
    random = np.random.default_rng(3)
    width = Q.BUCKETS + Q.DENSE
    model = Q.FactorisationMachine(
        np.zeros(Q.DENSE), np.ones(Q.DENSE), 0.1, random.normal(0, 0.3, width), random.normal(0, 0.3, (width, Q.FACTORS))
    )
    texts = pd.Series(["some words, some MORE!", "", "a\nb\nb"])
    sizes = pd.Series([None, 0.0, 5.0])
    got = model.score(texts, sizes)
    for at, text, bucket, value, dense in Q.vectors(texts, sizes):
        for i in range(at.stop - at.start):
            x = np.zeros(width)
            x[bucket[text == i]] = value[text == i]
            x[Q.BUCKETS :] = Q.scaled(dense[i : i + 1], model.mean, model.spread)[0]
            v = model.factors * x[:, None]
            gram = v @ v.T
            pairs = (gram.sum() - np.trace(gram)) / 2
            want = 1 / (1 + np.exp(-(model.bias + x @ model.weights + pairs)))
            assert got[at.start + i] == pytest.approx(want)


def test_chunks_hold_whole_texts():
    texts = pd.Series(["ab", None, "c" * 10, "", "de"])
    found = list(chunks(texts, 4))
    assert [t for _, own in found for t in own] == ["ab", "", "c" * 10, "", "de"]
    assert [first for first, _ in found] == [sum(len(o) for _, o in found[:i]) for i in range(len(found))]
    assert all(len(own) == 1 or sum(map(len, own)) <= 4 or len(own[0]) > 4 for _, own in found)


def test_an_arrow_column_is_never_all_strings_at_once():
    column = pa.array([("word " * 2_000) + str(i) for i in range(2_000)] + [None, ""])
    tracemalloc.start()
    sizes = [sum(map(len, held)) for _, held in chunks(Texts(column), 100_000)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == sum(len(x or "") for x in column.to_pylist()) and max(sizes) <= 100_000
    assert peak < 5_000_000 and len(Texts(column)) == 2_002 and list(Texts(column.slice(2_000))) == ["", ""]
