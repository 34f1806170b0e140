import hashlib

from pyspark.sql import functions as F

from veilspark.llm import order_minhash as O


def test_signatures(spark):
    base = [f"w{i}" for i in range(200)]
    swapped = base[100:] + base[:100]
    shuffled = base[::-1]
    edited = [w if i % 40 else "changed" for i, w in enumerate(base)]
    texts = [" ".join(x) for x in (base, base, edited, swapped, shuffled)] + ["", None, "one", "one two", "a " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = O.fingerprints(docs).withColumnRenamed("doc_id", "i")
    sig = {r.i: r.signature for r in got.collect()}
    assert sig[0] == sig[1] and all(len(s) == 64 for s in sig.values())
    assert not any(sig[5]) and not any(sig[6]) and sum(map(bool, sig[7])) == 1
    like = lambda a, b: sum(x == y != 0 for x, y in zip(sig[a], sig[b])) / sum(bool(x or y) for x, y in zip(sig[a], sig[b]))
    assert like(0, 2) > 0.4 > like(0, 4)
    assert like(0, 3) < 1  # the same words in another order
    both = got.where("i IN (0, 2)").groupBy().agg(F.min_by("signature", "i").alias("a"), F.max_by("signature", "i").alias("b"))
    assert both.select(O.likeness(F.col("a"), F.col("b"))).first()[0] == like(0, 2)


def test_repeats_are_numbered(spark):
    docs = spark.createDataFrame([(0, "a b c " * 3), (1, "a b c " * 30)], "doc_id long, text string")
    a, b = (r.signature for r in O.fingerprints(docs).orderBy("doc_id").collect())
    assert a != b and sum(map(bool, a)) < sum(map(bool, b))


def brute_next(rows):
    rows = sorted(rows, reverse=True)
    return {d: rows[(i + 1) % len(rows)][1] for i, (d, _) in enumerate(rows)}


def test_next_document(spark):
    rows = [(i * 7 % 1009 - 300, f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for ranges, part in ((512, 32 << 20), (8, 100)):
        got = {r.doc_id: r.next_text for r in O.with_next(docs, ranges, part).select("doc_id", "next_text").collect()}
        assert got == brute_next(rows)


def test_odd_rows(odd_docs, no_docs):
    got = O.with_next(odd_docs.select("doc_id", "text")).select("doc_id", "text", "next_text").collect()
    assert len(got) == odd_docs.count()
    assert {r.next_text for r in got if r.doc_id == 8} == {"long " * 60_000}
    assert all(r.text is not None and r.next_text is not None for r in got)
    assert O.with_next(no_docs).count() == 0


def test_digest_of_edited_text(spark, tmp_path):
    rows = [(1, "äbcdefg"), (2, "0123"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in O.op6_order_minhash(spark, str(tmp_path)).collect()}
    edited = {1: "äbcd", 2: "01äb", 5: ""}  # after the last, 1, comes the first, 5
    for i, text in edited.items():
        assert got[i].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[5].near_edited == 1.0 and got[5].near_next == 0.0 and got[1].n_chars == 7


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_likeness_follows_edit_distance(spark):
    """Texts with more and more words changed, left out, put in or moved: likeness falls as they grow apart."""
    import random

    import numpy as np

    pick, rows = random.Random(4), []
    for n in range(120):
        words = [f"w{pick.randrange(500)}" for _ in range(300)]
        other = list(words)
        for _ in range(pick.choice([0, 2, 5, 10, 20, 40, 80, 160])):
            at, kind = pick.randrange(len(other)), pick.randrange(4)
            if kind == 0:
                other[at] = "changed"
            elif kind == 1:
                del other[at]
            elif kind == 2:
                other.insert(at, f"n{n}")
            else:
                other.insert(pick.randrange(len(other)), other.pop(at))
        rows.append((n, " ".join(words), " ".join(other), edit_distance(words, other) / 300))
    shuffled = [(1_000 + n, a, " ".join(pick.sample(a.split(), 300)), 1.0) for n, a, _, _ in rows[:20]]
    df = spark.createDataFrame(rows + shuffled, "n int, a string, b string, apart double").repartition(4)
    got = df.select("n", "apart", O.likeness(O.signature(F.col("a")), O.signature(F.col("b"))).alias("like")).collect()
    apart, like = (np.array([r[c] for r in got if r.n < 1_000]) for c in ("apart", "like"))
    ranks = [np.argsort(np.argsort(x)) for x in (-apart, like)]
    assert np.corrcoef(*ranks)[0, 1] > 0.9
    assert like[apart == 0].min() == 1.0 and like[apart > 0.4].max() < 0.1
    # The same words in another order share next to nothing.
    assert np.mean([r.like for r in got if r.n >= 1_000]) < 0.02
