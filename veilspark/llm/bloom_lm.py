"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised by powers of two; an n-gram of level q is
put into a Bloom filter once for each level 1 to q. A count is read back by probing the
levels in turn until one is missing, so errors only go up, and rarely far. The filter
is made of blocks that executors fill side by side. A rare word lives in the block that
its hash names, together with all pairs that end in it; exact counts of frequent words
are at hand everywhere, and pairs that end in one are spread by their own hash. So a run
of blocks can be scored by itself: workers hold one run at a time as a broadcast of
bounded size, and score in as many passes as it takes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import held_out, stored, table
from veilspark.llm.words import chunks, coded_words, sums_by_text

FOLDS, HELD_OUT = 5, 1
#: Weight of the word model in the pair model, in pairs seen after a word.
PRIOR = 100.0
BITS_PER_ITEM, PROBES = 8, 5
#: Word pairs of the corpus that a block is meant for.
BLOCK_TOKENS = 8_000
#: Filter bytes that a worker holds in one pass; a larger filter takes several.
MAX_FILTER_BYTES = 256 << 20
#: Words whose exact counts are broadcast, at 16 bytes each; those of the others are joined, and in the filter.
FREQUENT = 100_000
#: Distinct words that a counting task holds.
_HELD = 300_000
_LEVELS = 40
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)
#: Fixed hashes of a text's start and end.
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _words(text: str) -> list[bytes]:
    """A-Z are lower-cased, ASCII white space parts words."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), dtype=np.uint64, count=len(words))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(first * _ODD + second)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts of ``docs``; the end of a text is not among the words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def rows() -> pd.DataFrame:
            words = pd.Series([w.decode("utf-8", "surrogatepass") for w in held], dtype=object)
            return pd.DataFrame({"word": words, "n": np.fromiter(held.values(), np.int64, len(held))})

        for batch in batches:
            for _, texts in chunks(batch["text"], 500_000):
                for text in texts:
                    held.update(_words(text))
                if len(held) > _HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# The filter


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def least_counts(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0. What is put above a bar."""
    return np.where(level > 0, 2.0 ** (level - 1), 0.0)


def most_counts(level: np.ndarray) -> np.ndarray:
    """The greatest count of a level. What is put below a bar, so that the chances after a word never sum to over 1."""
    return 2.0**level - 1


def _strides(low: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an n-gram starts to set bits at a level, and how far it goes on."""
    with np.errstate(over="ignore"):
        mixed = _mix(low * _ODD + np.uint64(level))
    return mixed, (mixed >> np.uint64(32)) | np.uint64(1)


def _spot(start: np.ndarray, stride: np.ndarray, k: int, bits: np.ndarray | int) -> np.ndarray:
    """The k-th bit, in a block of so many bits."""
    with np.errstate(over="ignore"):
        at = (start + np.uint64(k) * stride) & np.uint64(0xFFFFFFFF)
    return (at % np.asarray(bits).astype(np.uint64)).astype(np.int64)


def _blocks_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def _blobs(homes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, block_bits: int) -> pd.DataFrame:
    """Counted n-grams by the block of their home: five bytes of hash and four of count each, as one value for a block."""
    block = _blocks_of(homes, block_bits)
    order = np.argsort(block, kind="stable")
    block, low, counts = block[order], (hashes & _LOW)[order], counts[order]
    five = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    four = np.minimum(counts, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)
    raw = np.ascontiguousarray(np.hstack([five, four]))
    names, starts = np.unique(block, return_index=True)
    ends = np.append(starts[1:], len(block))
    return pd.DataFrame({"block": names, "grams": [raw[a:b].tobytes() for a, b in zip(starts, ends)]})


def _fill(batches: Iterator[pd.DataFrame], item_bits: int) -> Iterator[pd.DataFrame]:
    """The bits of each block from all its n-grams."""
    for batch in batches:
        found = []
        for block, blobs in zip(batch["block"], batch["grams"]):
            raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 9)
            low = np.zeros((len(raw), 8), dtype=np.uint8)
            low[:, :5] = raw[:, :5]
            keys, back = np.unique(low.view("<u8").ravel(), return_inverse=True)
            counts = np.bincount(back, weights=np.ascontiguousarray(raw[:, 5:]).view("<u4").ravel())
            own = levels(counts)
            size = -(-int(own.sum()) * item_bits // 64) * 64
            bits = np.zeros(size, dtype=bool)
            for level in range(1, int(own.max()) + 1):
                start, stride = _strides(keys[own >= level], level)
                for k in range(PROBES):
                    bits[_spot(start, stride, k, size)] = True
            found.append((block, np.packbits(bits, bitorder="little").tobytes()))
        yield pd.DataFrame(found, columns=["block", "bits"])


def filled_blocks(blobs: DataFrame, item_bits: int = BITS_PER_ITEM) -> DataFrame:
    """``block, bits``: the blocks of a filter from ``block, grams``."""
    grouped = blobs.groupBy("block").agg(F.collect_list("grams").alias("grams"))
    return grouped.mapInPandas(lambda batches: _fill(batches, item_bits), "block long, bits binary")


class LogBloom:
    """Blocks ``first`` to ``last`` (not included) of a filter of ``2 ** block_bits`` blocks."""

    def __init__(self, block_bits: int, first: int, last: int, rows: list[tuple[int, bytes]]):
        self.block_bits, self.first, self.last = block_bits, first, last
        sizes = np.zeros(last - first, dtype=np.int64)
        for block, bits in rows:
            sizes[block - first] = len(bits)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.bytes = np.zeros(int(self.starts[-1]), dtype=np.uint8)
        for block, bits in rows:
            at = self.starts[block - first]
            self.bytes[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)

    def holds(self, homes: np.ndarray) -> np.ndarray:
        """Which homes belong to these blocks."""
        block = _blocks_of(homes, self.block_bits)
        return (block >= self.first) & (block < self.last)

    def levels(self, homes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Levels read back, one after the other, of n-grams whose homes belong to these blocks."""
        block = _blocks_of(homes, self.block_bits) - self.first
        start, size = self.starts[block], (self.starts[block + 1] - self.starts[block]) * 8
        low, level = hashes & _LOW, np.zeros(len(hashes), dtype=np.int64)
        left = np.nonzero(size > 0)[0]
        for probe in range(1, _LEVELS + 1):
            first, stride = _strides(low[left], probe)
            for k in range(PROBES):
                spot = _spot(first, stride, k, size[left])
                hit = (self.bytes[start[left] + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 == 1
                left, first, stride = left[hit], first[hit], stride[hit]
            if not len(left):
                break
            level[left] = probe
        return level


class Frequent:
    """Exact counts of the most frequent words, and of the end and start of a text, by hash."""

    def __init__(self, words: list[bytes], counts: list[int], texts: int):
        hashes = np.concatenate([_word_hashes(np.array([*words, None], dtype=object)[:-1]), [_END, _START]]).astype(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], np.array([*counts, texts, texts], dtype=np.int64)[order]

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """The counts; -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], -1)


# The model


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts with their ends: tokens of each, codes of contexts and tokens, distinct words, hashes by code.

    The end of a text has the code after the last word, its start the one after that.
    """
    counts, codes, distinct = coded_words(texts, _words)
    n = len(distinct)
    tokens = np.insert(codes, np.cumsum(counts), n) if len(codes) else np.full(len(texts), n)
    context = np.concatenate(([n + 1], tokens[:-1]))
    context[context == n] = n + 1
    hashes = np.concatenate([_word_hashes(distinct), np.array([_END, _START], dtype=np.uint64)])
    return counts + 1, context, tokens, distinct, hashes


def _homes(pair: np.ndarray, second: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """What names the block of a pair: a rare second word, else the pair."""
    return np.where(frequent, pair, second)


def pair_blobs(docs: DataFrame, known: Broadcast, block_bits: int, held: int = 4_000_000) -> DataFrame:
    """Counted word pairs of the texts by block; a task sends them on whenever it holds ``held`` of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0

        def out() -> pd.DataFrame:
            pairs = np.concatenate([p for p, _ in kept])
            names, at, times = np.unique(pairs, return_index=True, return_counts=True)
            return _blobs(np.concatenate([h for _, h in kept])[at], names, times, block_bits)

        for batch in batches:
            for _, texts in chunks(batch["text"]):
                _, context, tokens, _, hashes = _pairs(texts)
                pair = _pair_hashes(hashes[context], hashes[tokens])
                kept.append((pair, _homes(pair, hashes[tokens], (known.value.count(hashes) >= 0)[tokens])))
                n += len(tokens)
                if n > held:
                    yield out()
                    kept, n = [], 0
        if kept:
            yield out()

    return docs.select("text").mapInPandas(count, "block long, grams binary")


def word_blobs(counts: DataFrame, known: Broadcast, block_bits: int) -> DataFrame:
    """Counts of the words that aren't frequent, by block."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = _word_hashes(np.array([w.encode("utf-8", "surrogatepass") for w in batch["word"]] + [None], dtype=object)[:-1])
            rare = known.value.count(hashes) < 0
            if rare.any():
                yield _blobs(hashes[rare], hashes[rare], batch["n"].to_numpy()[rare], block_bits)

    return counts.mapInPandas(put, "block long, grams binary")


def _passes(blocks: DataFrame, block_bits: int, max_bytes: int) -> list[tuple[int, int]]:
    """Runs of blocks that fit a worker; hashes are even, so equal runs have equal sizes."""
    total = blocks.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    n, blocks_in_all = max(1, -(-total // max_bytes)), 1 << block_bits
    cuts = [blocks_in_all * i // n for i in range(n + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _held_blocks(blocks: DataFrame, block_bits: int, first: int, last: int) -> LogBloom:
    rows = blocks.where(F.col("block").between(first, last - 1)).collect()  # one pass's bytes at most
    return LogBloom(block_bits, first, last, [(r["block"], bytes(r["bits"])) for r in rows])


class PairModel:
    """The pair model as far as the blocks of one pass hold it; the first pass sees to frequent words before a token."""

    def __init__(self, grams: LogBloom, known: Frequent, n: int, kinds: int):
        self.grams, self.known, self.n, self.kinds = grams, known, n, kinds

    def logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its tokens and its log10 probability, as far as held here; codes and distinct words."""
        counts, context, tokens, distinct, hashes = _pairs(texts)
        exact = self.known.count(hashes)
        frequent, held = exact >= 0, self.grams.holds(hashes)
        level = np.zeros(len(hashes), dtype=np.int64)
        rare = np.nonzero(~frequent & held)[0]
        level[rare] = self.grams.levels(hashes[rare], hashes[rare])
        seen = np.where(frequent, exact, least_counts(level))
        before = np.where(frequent, exact, most_counts(level))
        chance = (seen + 0.5) / (self.n + 0.5 * (self.kinds + 1))
        pair = _pair_hashes(hashes[context], hashes[tokens])
        home = _homes(pair, hashes[tokens], frequent[tokens])
        logs = np.zeros(len(tokens))
        here = np.nonzero(self.grams.holds(home))[0]
        both = least_counts(self.grams.levels(home[here], pair[here]))
        most = np.where(frequent[context[here]], np.minimum(seen[tokens[here]], exact[context[here]]), seen[tokens[here]])
        logs[here] = np.log10(np.minimum(both, most) + PRIOR * chance[tokens[here]])
        below = np.where(frequent, self.grams.first == 0, held)[context]
        logs[below] -= np.log10(before[context[below]] + PRIOR)
        return counts, sums_by_text(counts, logs), tokens, distinct


_MAIN = "row long, doc_id long, text_hash long, tokens long, known long, base double, score double, word string, n long"


def score_texts(
    docs: DataFrame,
    *,
    max_filter_bytes: int = MAX_FILTER_BYTES,
    frequent: int = FREQUENT,
    block_tokens: int = BLOCK_TOKENS,
    item_bits: int = BITS_PER_ITEM,
) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id, text``) by a model of those outside the held-out part.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens
    are the words and the end of the text. ``base_score`` is the exact add-one-half word
    model; ``score`` the pair model read from the filter, its pairs smoothed by ``PRIOR``
    pairs of the word model. Pairs count as the least of their level and the word before
    them as the greatest, so that after each word the chances sum to 1 at most, but for
    what the filter takes for seen though it isn't. Exact counts of the ``frequent`` most
    frequent words are broadcast, those of the others are joined. The filter is held in as
    many passes over the texts as ``max_filter_bytes`` asks for, one at a time. Null texts
    read as empty: one token, the end. Repeated rows and null ids stay, other columns are
    not carried. Without training texts every count is 0.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    training = slim.where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    counts = stored(word_counts(training), "word-counts")
    facts = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    n_texts = training.select("doc_id").count()
    n, kinds = (facts["n"] or 0) + n_texts, facts["kinds"] + (n_texts > 0)

    bits = min(24, max(4, int(np.ceil(np.log2(max(1, n) / block_tokens)))))
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    words = [r["word"].encode("utf-8", "surrogatepass") for r in top]
    known = spark.sparkContext.broadcast(Frequent(words, [r["n"] for r in top], n_texts))
    grams = pair_blobs(training, known, bits).unionByName(word_blobs(counts, known, bits))
    blocks = stored(filled_blocks(grams, item_bits), "bloom-filter")

    def passed(first: int, last: int, make) -> DataFrame:
        """What one pass over the texts gives; its blocks are gone from the workers when it is done."""
        model = spark.sparkContext.broadcast(PairModel(_held_blocks(blocks, bits, first, last), known.value, n, kinds))
        done = make(model)
        model.destroy()
        return done

    def first_pass(model: Broadcast, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, exact = model.value, known.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, marks = batch["doc_id"].astype("Int64"), batch["text_hash"].to_numpy()
            for first, texts in chunks(batch["text"]):
                sizes, score, tokens, distinct = model.logs(texts)
                logs = exact.count(np.append(_word_hashes(distinct), _END)).astype(np.float64)
                logs = np.where(logs < 0, np.nan, np.log10(np.maximum(logs, 0) + 0.5))
                there = ~np.isnan(logs)
                there[-1] = n_texts > 0
                frequent_log = np.nan_to_num(logs)
                rows = row + np.arange(len(texts))
                yield pd.DataFrame({
                    "row": rows,
                    "doc_id": ids.iloc[first : first + len(texts)].to_numpy(),
                    "text_hash": marks[first : first + len(texts)],
                    "tokens": sizes,
                    "known": sums_by_text(sizes, there[tokens]).astype(np.int64),
                    "base": sums_by_text(sizes, frequent_log[tokens]),
                    "score": score,
                    "word": pd.Series([None] * len(texts), dtype=object),
                    "n": 0,
                }).astype({"doc_id": "Int64"})
                rare = np.nonzero(np.isnan(logs)[tokens])[0]
                owner = np.repeat(rows, sizes)[rare] - row
                cell, times = np.unique(owner * (len(distinct) + 1) + tokens[rare], return_counts=True)
                spelled = [distinct[c].decode("utf-8", "surrogatepass") for c in (cell % (len(distinct) + 1)).tolist()]
                if spelled:
                    yield pd.DataFrame({
                        "row": row + cell // (len(distinct) + 1),
                        "doc_id": pd.array([None] * len(cell), dtype="Int64"),
                        "text_hash": 0,
                        "tokens": 0,
                        "known": 0,
                        "base": 0.0,
                        "score": 0.0,
                        "word": pd.Series(spelled, dtype=object),
                        "n": times,
                    })
                row += len(texts)

    runs = _passes(blocks, bits, max_filter_bytes)
    main = passed(*runs[0], lambda m: stored(slim.mapInPandas(lambda b: first_pass(m, b), _MAIN), "lm-rows"))
    rare = main.where(F.col("word").isNotNull()).select("row", "word", F.col("n").alias("times"))
    joined = rare.join(counts, "word", "left")
    of_rare = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"),
    )
    scored = main.where(F.col("word").isNull()).drop("word", "n").join(of_rare, "row", "left")
    added = [passed(a, b, lambda m: _more(slim, m)) for a, b in runs[1:]]
    known.destroy()
    if added:
        sums = reduce(DataFrame.unionByName, added).groupBy("m_doc_id", "m_text_hash").agg(F.sum("more").alias("more"))
        scored = scored.join(sums, F.expr("doc_id <=> m_doc_id AND text_hash = m_text_hash"))
        scored = scored.withColumn("score", F.col("score") + F.col("more")).drop("m_doc_id", "m_text_hash", "more")
    total = F.lit(float(np.log10(n + 0.5 * (kinds + 1))))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("tokens") * total).alias("base_score"),
        "score",
    )


def _more(slim: DataFrame, model: Broadcast) -> DataFrame:
    """What another pass adds to the score of each text, once for each id and text."""

    def more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, marks = batch["doc_id"].astype("Int64"), batch["text_hash"].to_numpy()
            for first, texts in chunks(batch["text"]):
                own = slice(first, first + len(texts))
                yield pd.DataFrame({"m_doc_id": ids.iloc[own].to_numpy(), "m_text_hash": marks[own], "more": model.value.logs(texts)[1]}).astype(
                    {"m_doc_id": "Int64"}
                )

    added = slim.mapInPandas(more, "m_doc_id long, m_text_hash long, more double").dropDuplicates(["m_doc_id", "m_text_hash"])
    return stored(added, "lm-pass")


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
