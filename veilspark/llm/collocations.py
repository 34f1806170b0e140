"""Collocations: frequent phrases whose parts go together more often than by chance.

Every place of a text is counted once, with the window of up to five words that starts
there; a phrase occurs as often as windows start with it. A task counts windows in a
HAT-trie: a shallow trie over word ids, whose leaves are hash containers (equal windows
are found by their hashes) that burst into one container per next word when they outgrow
``BURST``. When the trie is full, its largest subtrees leave it whole, as sorted runs cut
by prefix partition; the runs of one partition are merged, and every prefix of their
windows gets its count.

A window belongs to the partition of its first word, or, where very many windows start
with that word, of its first two words, and so on: of its shortest prefix that isn't
crowded. So no frequent word or phrase makes a large partition. The counts of the crowded
prefixes themselves, a few for each partition, are spread, and added up at last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import stored, table
from veilspark.llm.skew import join_unique

#: Words of the longest phrase, and the fewest occurrences of a phrase.
LONGEST, LEAST = 5, 100
#: Phrases for each language.
TOP = 2_000
#: Windows of a hash container before it bursts, and of a task's tries before subtrees leave them (some 30 bytes each).
BURST, FULL = 16_384, 700_000
#: Distinct words of a task's tries before one leaves it whole (some 250 bytes each).
FULL_WORDS = 200_000
#: Characters counted in one go, and places of a longer text.
CHUNK_CHARS, CHUNK_PLACES = 2_000_000, 500_000
#: Characters of the corpus to a partition, about.
PARTITION_CHARS = 6_000_000
#: One text in so many tells which prefixes are crowded. It decides the partitions alone, never what is counted.
ASKED = 64
NO_LANG = "und"

_BREAK = b"\xff"  # stands in no UTF-8 text
_PIECES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", _BREAK * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words in order, A-Z lower-cased; the byte 255 stands between pieces."""
    return text.encode().lower().translate(_PIECES).replace(_BREAK, b" \xff ").split()


def lang_seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang)


def word_hash(seed: int, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, seed=seed)


def _by_lang(batch: pd.DataFrame) -> Iterator[tuple[str, list[str]]]:
    """Texts of each language, in parts of up to ``CHUNK_CHARS`` characters or one text."""
    for lang, texts in batch.groupby(batch["lang"].fillna(NO_LANG), sort=False)["text"]:
        held, size = [], 0
        for text in texts:
            text = text if isinstance(text, str) else ""
            if held and size + len(text) > CHUNK_CHARS:
                yield lang, held
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield lang, held


class WordIds(dict):
    """A number for every word of a language; 0 stands for breaks."""

    def __init__(self, lang: str):
        super().__init__({_BREAK: 0})
        self.seed = lang_seed(lang)
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(word_hash(self.seed, word))
        return code

    def places(self, texts: list[str]) -> np.ndarray:
        """The words of the texts in order, a break after each text."""
        codes: list[int] = []
        for text in texts:
            codes += [self[w] for w in words_of(text)]
            codes.append(0)
        return np.array(codes, dtype=np.int32)


def windows_of(codes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The windows that start from ``start`` to before ``stop``; 0 breaks windows and fills them up."""
    n = min(stop, len(codes)) - start
    padded = np.concatenate((codes[start : stop + LONGEST - 1], np.zeros(LONGEST - 1, dtype=np.int32)))
    out = np.stack([padded[k : k + n] for k in range(LONGEST)], axis=1)
    for k in range(1, LONGEST):
        out[out[:, k - 1] == 0, k] = 0
    return out[out[:, 0] > 0]


def _hashes(windows: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(windows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LONGEST):
            mixed = (mixed ^ windows[:, k].astype(np.uint64)) * _MIX
            mixed ^= mixed >> np.uint64(29)
    return mixed


def _added_up(windows: np.ndarray, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In this order, neighbours that are equal become one; others stay apart."""
    windows, counts = windows[order], counts[order]
    fresh = np.ones(len(windows), dtype=bool)
    fresh[1:] = (windows[1:] != windows[:-1]).any(axis=1)
    starts = np.flatnonzero(fresh)
    return windows[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def by_hash(windows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows as one, found by their hashes; a rare one may stay twice, between others of its hash."""
    return _added_up(windows, counts, np.argsort(_hashes(windows), kind="stable"))


class Container:
    """Windows with one prefix, and their counts; equal ones are added up when it fills."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def put(self, windows: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((windows, counts))
        self.size += len(windows)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([w for w, _ in self.parts]), np.concatenate([n for _, n in self.parts])

    def add_up(self) -> None:
        self.parts = [by_hash(*self.all())]
        self.size = len(self.parts[0][0])


class HatTrie:
    """Counts of windows: hash containers below the shortest prefixes that keep them small."""

    def __init__(self):
        #: By prefix: a container, or None where it has burst.
        self.nodes: dict[tuple[int, ...], Container | None] = {}
        self.size = 0

    def add(self, windows: np.ndarray) -> None:
        self._deal((), *by_hash(windows, np.ones(len(windows), dtype=np.int64)))

    def _deal(self, prefix: tuple[int, ...], windows: np.ndarray, counts: np.ndarray) -> None:
        """To the containers of each next word."""
        word = windows[:, len(prefix)]
        order = np.argsort(word, kind="stable")
        windows, counts, word = windows[order], counts[order], word[order]
        bounds = np.flatnonzero(np.diff(word, prepend=-1)).tolist() + [len(word)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            self._put((*prefix, int(word[lo])), windows[lo:hi], counts[lo:hi])

    def _put(self, prefix: tuple[int, ...], windows: np.ndarray, counts: np.ndarray) -> None:
        held = self.nodes.get(prefix, False)
        if held is None:
            return self._deal(prefix, windows, counts)
        if held is False:
            held = self.nodes[prefix] = Container()
        before = held.size
        held.put(windows, counts)
        if held.size > BURST:
            held.add_up()
        self.size += held.size - before
        if held.size > BURST and len(prefix) < LONGEST - 1:
            self.nodes[prefix] = None
            self.size -= held.size
            self._deal(prefix, *held.all())
        return None

    def spill(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out the largest subtrees until at most ``most`` windows are left: their windows in order, with counts."""
        sizes: Counter = Counter()
        for prefix, held in self.nodes.items():
            sizes[prefix[0]] += held.size if held else 0
        gone = set()
        for word, size in sizes.most_common():
            if self.size <= most:
                break
            gone.add(word)
            self.size -= size
        out = Container()
        for prefix in [p for p in self.nodes if p[0] in gone]:
            held = self.nodes.pop(prefix)
            out.parts += held.parts if held else []
        if not out.parts:
            return np.zeros((0, LONGEST), dtype=np.int32), np.zeros(0, dtype=np.int64)
        windows, counts = out.all()
        return _added_up(windows, counts, np.lexsort(windows.T[::-1]))


def prefix_hashes(windows: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hash of the first one, two, ... words of each window; ``hashes`` are those of the words."""
    mixed, out = np.zeros(len(windows), dtype=np.uint64), []
    with np.errstate(over="ignore"):
        for k in range(LONGEST):
            mixed = (mixed ^ hashes[windows[:, k]]) * _MIX
            mixed ^= mixed >> np.uint64(31)
            out.append(mixed)
    return out


def dealt_by(windows: np.ndarray, hashes: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the shortest prefix of each window that isn't crowded, and the hash it is dealt by.

    A window of which all prefixes are crowded is dealt whole, and counts as one word longer
    than it is: its phrases are in other partitions, too. ``crowded`` are hashes in order.
    """
    size = (windows > 0).sum(axis=1)
    depth, chosen = np.zeros(len(windows), dtype=np.uint8), np.zeros(len(windows), dtype=np.uint64)
    for k, own in enumerate(prefix_hashes(windows, hashes), 1):
        at = np.minimum(np.searchsorted(crowded, own), max(0, len(crowded) - 1))
        often = crowded[at] == own if len(crowded) else np.zeros(len(own), dtype=bool)
        here = (depth == 0) & ((size == k) | ~often)
        depth[here], chosen[here] = k + often[here], own[here]
    return depth, chosen


def crowded_prefixes(docs: DataFrame, parts: int) -> np.ndarray:
    """Hashes, in order, of the prefixes of up to four words that half a partition's share of all windows start with.

    Read off one text in ``ASKED``; a few for each partition come to the driver.
    """
    least = 1 / (2 * parts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                ids = WordIds(lang)
                codes = ids.places(texts)
                windows = windows_of(codes, 0, len(codes))
                hashes = np.array(ids.hashes, dtype=np.uint64)
                found = [(np.zeros(1, dtype=np.uint64), np.array([len(windows)]))]  # how many there are in all
                for k, own in enumerate(prefix_hashes(windows, hashes)[: LONGEST - 1], 1):
                    names, n = np.unique(own[windows[:, k - 1] > 0], return_counts=True)
                    often = n >= max(2, least / 4 * len(windows))
                    found.append((names[often], n[often]))
                names, n = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"prefix": names.view(np.int64), "n": n})

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(ASKED)) == 0)
    sums = some.select("lang", "text").mapInPandas(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    sums = stored(sums, "window-prefixes")
    total = sums.where("prefix = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = sums.where((F.col("prefix") != 0) & (F.col("n") > max(2, least * total))).select("prefix").toPandas()
    return np.sort(rows["prefix"].to_numpy(dtype=np.int64).view(np.uint64))


def sorted_runs(lang: str, ids: WordIds, windows: np.ndarray, counts: np.ndarray, crowded: np.ndarray, parts: int) -> pd.DataFrame:
    """``part, lang, words, windows, depths, counts``: sorted windows cut by partition, with the words they are made of."""
    names = ["part", "lang", "words", "windows", "depths", "counts"]
    if not len(windows):
        return pd.DataFrame([], columns=names)
    depth, chosen = dealt_by(windows, np.array(ids.hashes, dtype=np.uint64), crowded)
    part = (chosen % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    windows, counts, depth, part = windows[order], counts[order], depth[order], part[order]
    size = np.uint32 if counts.max() < 1 << 32 else np.uint64
    bounds = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
    place = np.zeros(len(ids.words), dtype=np.int64)
    rows = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = windows[lo:hi]
        used = pd.unique(own.ravel())
        used = np.sort(used[used > 0])
        place[used] = np.arange(1, len(used) + 1)
        kind = np.uint16 if len(used) < 1 << 16 else np.uint32
        spelled = b" ".join([ids.words[u] for u in used.tolist()]).decode()
        local = np.ascontiguousarray(place[own].T.astype(kind))
        rows.append((int(part[lo]), lang, spelled, local.tobytes(), depth[lo:hi].tobytes(), counts[lo:hi].astype(size).tobytes()))
    return pd.DataFrame(rows, columns=names)


RUN_SCHEMA = "part long, lang string, words string, windows binary, depths binary, counts binary"


def window_runs(docs: DataFrame, crowded: Broadcast, parts: int) -> DataFrame:
    """The sorted runs of every task's tries, one for each language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[str, tuple[WordIds, HatTrie]] = {}

        def out(lang: str, most: int) -> pd.DataFrame:
            ids, trie = tries[lang] if most else tries.pop(lang)
            return sorted_runs(lang, ids, *trie.spill(most), crowded.value, parts)

        for batch in batches:
            for lang, texts in _by_lang(batch):
                ids, trie = tries.setdefault(lang, (WordIds(lang), HatTrie()))
                places = ids.places(texts)
                for at in range(0, len(places), CHUNK_PLACES):
                    trie.add(windows_of(places, at, at + CHUNK_PLACES))
                    if trie.size > FULL:
                        yield out(lang, FULL // 2)
                while sum(len(i) for i, _ in tries.values()) > FULL_WORDS:
                    yield out(max(tries, key=lambda x: len(tries[x][0])), 0)
                while sum(t.size for _, t in tries.values()) > FULL:
                    largest = max(tries, key=lambda x: tries[x][1].size)
                    yield out(largest, tries[largest][1].size // 2)
        for lang in list(tries):
            yield out(lang, 0)

    return docs.select("lang", "text").mapInPandas(count, RUN_SCHEMA)


def merged_counts(runs: pd.DataFrame, least: int) -> pd.DataFrame:
    """``lang, phrase, a`` of the runs of one partition: each prefix of their windows with its count here.

    What windows are dealt by, and longer phrases, are in this partition alone: if they occur
    too seldom they are left out. Of shorter ones, which are crowded, this is a part of the
    count. A null phrase counts all windows.
    """
    out = []
    for lang, own in runs.groupby("lang", sort=False):
        spelled = [s.split(" ") for s in own["words"]]
        codes, distinct = pd.factorize(np.array([w for s in spelled for w in s] + [None], dtype=object)[:-1])
        codes = codes + 1
        windows, counts, at = [], [], 0
        for words, data, n in zip(spelled, own["windows"], own["counts"], strict=True):
            local = np.concatenate(([0], codes[at : at + len(words)])).astype(np.int32)
            at += len(words)
            width = 2 if len(words) < 1 << 16 else 4
            ids = np.frombuffer(data, dtype=f"u{width}").reshape(LONGEST, -1)
            windows.append(local[ids])
            counts.append(np.frombuffer(n, dtype=f"u{len(n) // ids.shape[1]}").astype(np.int64))
        cells, n = np.concatenate(windows, axis=1), np.concatenate(counts)
        depth = np.frombuffer(b"".join(own["depths"]), dtype=np.uint8)
        order = np.lexsort(cells[::-1])
        cells, n, depth = cells[:, order], n[order], depth[order]
        out.append((lang, None, int(n.sum())))
        fresh = np.zeros(len(n), dtype=bool)
        fresh[0] = True
        for k in range(LONGEST):
            fresh[1:] |= cells[k, 1:] != cells[k, :-1]
            starts = np.flatnonzero(fresh)
            sums = np.add.reduceat(n, starts)
            keep = (cells[k, starts] > 0) & ((sums >= least) | (depth[starts] > k + 1))
            for i, a in zip(starts[keep].tolist(), sums[keep].tolist(), strict=True):
                out.append((lang, " ".join([distinct[c - 1] for c in cells[: k + 1, i].tolist()]), a))
    return pd.DataFrame(out, columns=["lang", "phrase", "a"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, phrase, a`` of every phrase of up to ``LONGEST`` words with ``a >= least``, and of all words under null, exactly.

    Only the hashes of crowded prefixes are broadcast, a few for each partition.
    """
    chars = docs.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // PARTITION_CHARS)
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_prefixes(docs, parts))

    def merged(runs: pd.DataFrame) -> pd.DataFrame:
        return merged_counts(runs, least)

    found = window_runs(docs, crowded, parts).groupBy("part").applyInPandas(merged, "lang string, phrase string, a long")
    sums = found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    counts = stored(sums.where((F.col("a") >= least) | F.col("phrase").isNull()), "phrase-counts")
    crowded.destroy()
    return counts


def with_score(cuts: DataFrame) -> DataFrame:
    """Adds ``score``, ``floor(1000 * a * n / (l * r))``, exactly: the products have up to 38 digits."""
    over = "1000BD * cast(a AS decimal(15,0)) * cast(n AS decimal(19,0))"
    return cuts.withColumn("score", F.expr(f"({over}) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score, count, phrase.

    Texts are cut into pieces at ``.,;:!?`` and line ends, A-Z lower-cased; a phrase is 2 to
    5 words of one piece that occur ``least`` times or more. Its score is the lowest over
    all cuts of ``1000 * a * n / (l * r)``, for ``l`` and ``r`` occurrences of the parts and
    ``n`` words of the language. A phrase inside a longer one that occurs as often is left out.

    A null ``lang`` is ``und``, a null text empty; repeated rows count again; columns beside
    the two are neither read nor returned; an empty table gives no rows.
    """
    known = phrase_counts(docs.select(docs["lang"], docs["text"]), least)
    sizes = known.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
    known = known.where("phrase IS NOT NULL")
    n_words = F.size(F.split("phrase", " "))
    phrases = known.where(n_words > 1)
    # A longer phrase occurs as often only if one that is longer by a single word does.
    parts = F.split("phrase", " ")
    inner = phrases.where(n_words > 2).select(
        "lang", F.explode(F.array(*[F.array_join(F.slice(parts, at, F.size(parts) - 1), " ") for at in (1, 2)])).alias("phrase"), "a"
    )
    kept = phrases.join(inner, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", parts.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"),
    )
    spread = F.xxhash64("phrase")
    cuts = join_unique(cuts, known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"], spread)
    cuts = join_unique(cuts, known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"], spread)
    cuts = join_unique(cuts, sizes, ["lang"], spread)
    scored = with_score(cuts)
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    lowest = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that the last ranking sees a bounded number of rows of each.
    dealt = lowest.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), sizes AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM lists GROUP BY lang
), places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), grams AS (SELECT lang, w[i : i + k - 1] AS g, k FROM places, (SELECT unnest(range(1, {LONGEST} + 1)) AS k) WHERE i + k - 1 <= len(w)
), counts AS (SELECT lang, g, k, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), inner_ AS (
  SELECT lang, g[1 : k - 1] AS g, a FROM counts WHERE k > 2 UNION SELECT lang, g[2 : k] AS g, a FROM counts WHERE k > 2
), kept AS (SELECT c.* FROM counts c ANTI JOIN inner_ i ON c.lang = i.lang AND c.g = i.g AND c.a = i.a WHERE c.k > 1
), cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept
), scored AS (
  SELECT c.lang, c.g, c.a, c.cut, x.a AS l, y.a AS r, s.n, (1000 * c.a * s.n) // (x.a * y.a) AS score
  FROM cuts c JOIN counts x ON c.lang = x.lang AND x.g = c.g[1 : c.cut] JOIN counts y ON c.lang = y.lang AND y.g = c.g[c.cut + 1 : c.k]
  JOIN sizes s ON c.lang = s.lang
), lowest AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {TOP}
"""
