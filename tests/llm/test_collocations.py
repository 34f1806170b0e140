import random
import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import collocations as C


def brute(rows, least, top):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: a for p, a in counts.items() if a >= least}
    rows = []
    for (lang, phrase), a in often.items():
        if len(phrase) < 2 or any(
            x == lang and len(long) > len(phrase) and b >= a and any(long[i : i + len(phrase)] == phrase for i in range(len(long)))
            for (x, long), b in often.items()
        ):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
            cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, " ".join(phrase), a, left, right, sizes[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


def texts(seed, n=300):
    pick = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "état", "ÉTAT", "漢字", "a-b", "\x00", "x\u00a0y", *[f"w{i}" for i in range(20)]]
    for i in range(n):
        words = [vocabulary[min(int(pick.expovariate(0.25)), len(vocabulary) - 1)] for _ in range(pick.randint(0, 40))]
        words += ["in", "front", "of", "the", "house"] * (i % 2)
        text = "".join(w + pick.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", "!", " ; "]) for w in words)
        yield pick.choice(["en", "en", "en", "fr", None, "und"]), text


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("top", [3, C.TOP])
def test_phrases(spark, monkeypatch, small, top):
    """Also with containers that burst, tries that overflow, frequent words and a crowded filter all the time."""
    if small:
        for name, value in {"BURST": 4, "FULL": 60, "FULL_WORDS": 30, "CHUNK_CHARS": 200, "CHUNK_PLACES": 17, "ASKED": 1, "PARTITION_CHARS": 400}.items():
            monkeypatch.setattr(C, name, value)
    rows = list(texts(7))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = rows_of(C.collocations(docs, least=12, top=top))
    assert got == brute(rows, 12, top)
    assert len(got) > (5 if top == 3 else 30)


def rows_and_counts(windows, counts):
    return Counter({tuple(w): n for w, n in zip(windows.tolist(), counts.tolist(), strict=True)})


def test_trie_keeps_every_count(monkeypatch):
    monkeypatch.setattr(C, "BURST", 50)
    pick, trie, want, spilled = np.random.default_rng(1), C.HatTrie(), Counter(), Counter()
    for _ in range(60):
        windows = pick.integers(1, 9, (400, C.LONGEST)).astype(np.int32)
        windows[pick.random(400) < 0.3, 3:] = 0
        trie.add(windows)
        want += Counter(map(tuple, windows.tolist()))
        if trie.size > 3_000:
            spilled += rows_and_counts(*trie.spill(1_000))
            assert trie.size <= 1_000 and trie.size == sum(c.size for c in trie.nodes.values() if c)
    windows, counts = trie.spill(0)
    assert sorted(windows.tolist()) == windows.tolist()
    spilled += rows_and_counts(windows, counts)
    assert spilled == want and trie.size == 0 and not trie.nodes
    assert len(trie.spill(0)[0]) == 0


def test_containers_burst(monkeypatch):
    monkeypatch.setattr(C, "BURST", 10)
    trie = C.HatTrie()
    trie.add(np.array([(1, x, y, 0, 0) for x in range(2, 13) for y in range(20, 32)], dtype=np.int32))
    assert trie.nodes[1,] is None and all(trie.nodes[1, x] is None for x in range(2, 13))
    assert max(c.size for c in trie.nodes.values() if c) <= 10


def test_windows():
    ids = C.WordIds("en")
    assert [ids[w] for w in (b"x", b"y", b"x", b"\xff")] == [1, 2, 1, 0]
    codes = np.array([1, 2, 0, 3, 4, 5, 6, 7, 8, 0, 9], dtype=np.int32)
    got = [tuple(w) for w in C.windows_of(codes, 0, 20).tolist()]
    assert got[:3] == [(1, 2, 0, 0, 0), (2, 0, 0, 0, 0), (3, 4, 5, 6, 7)] and got[-1] == (9, 0, 0, 0, 0) and len(got) == 9
    assert [tuple(w) for w in np.concatenate([C.windows_of(codes, i, i + 3) for i in range(0, 11, 3)]).tolist()] == got


def test_crowded_prefixes_are_dealt_further(spark):
    """A phrase that a third of all windows start with is no partition of its own."""
    rows = [("en", "of the " + " ".join(f"w{(i * k) % 97}" for k in range(3))) for i in range(400)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    try:
        C.ASKED, asked = 1, C.ASKED
        crowded = C.crowded_prefixes(docs, 20)
    finally:
        C.ASKED = asked
    ids = C.WordIds("en")
    codes = ids.places([t for _, t in rows])
    windows = C.windows_of(codes, 0, len(codes))
    depth, _ = C.dealt_by(windows, np.array(ids.hashes, dtype=np.uint64), crowded)
    starts = windows[:, 0] == ids[b"of"]
    assert (depth[starts] > 2).all() and len(crowded) < 4 * 2 * 20
    assert (C.dealt_by(windows, np.array(ids.hashes, dtype=np.uint64), crowded[:0])[0] == 1).all()


def test_crowded_phrases_at_the_end_of_pieces_count(spark, monkeypatch):
    """Too few windows end with a crowded phrase to keep it where they are dealt, but they are part of its count."""
    for name, value in {"ASKED": 1, "PARTITION_CHARS": 100}.items():
        monkeypatch.setattr(C, name, value)
    rows = [("en", f"of the w{i % 40}") for i in range(400)] + [("en", "so of the.")] * 37 + [("en", f"v{i} x y") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = {r.phrase: r.a for r in C.phrase_counts(docs, 50).collect()}
    assert got["of the"] == 437 and got["the"] == 437 and got["of"] == 437 and got["x y"] == 300
    assert "so of" not in got and got[None] == 400 * 3 + 37 * 3 + 300 * 3


def test_large_products(spark):
    """Counts whose products pass 64 bits."""
    from pyspark.sql import functions as F

    a, n, x, y = 2**41, 2**44, 2**43 + 7, 2**42 + 11
    df = spark.createDataFrame([(a, n, x, y)], "a long, n long, l long, r long")
    assert C.with_score(df).select(F.col("score")).first()[0] == 1000 * a * n // (x * y)


def test_odd_rows(odd_docs, no_docs):
    got = rows_of(C.collocations(odd_docs.drop("a", "l", "r"), least=2))
    phrases = {(r[0], r[2]) for r in got}
    assert ("en", "a b c d e") in phrases and ("en", "long long") in phrases and ("de", "x y z") in phrases
    assert C.collocations(no_docs).count() == 0
