"""Exact near-duplicates: texts that share a given part of their distinct shingles.

SimHash finds most of them: fingerprints of the sets that differ in few bits, by the
pigeonhole search of ``simhash``. A prefix join finds the candidates that fingerprints
can't see. Under any one order of all shingles, two texts of Jaccard similarity ``SHARE``
or more have a shingle in common among the first ``n - ceil(SHARE * n) + 1`` of each;
frequent shingles are put last, so that few texts meet by them. Every candidate of
either way is decided on the whole sets of shingle hashes.

Sets that crowd one shingle and are near each other, as copies of one text with edits
are, aren't paired with each other: they are compared with one of them, the pivot, and a
second prefix join on what sets them apart from it finds the links that it doesn't imply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored, stored_and_freed
from veilspark.llm.components import components
from veilspark.llm.rows import MAX_BROADCAST_KEYS
from veilspark.llm.simhash import RADIUS, near_links, shingle_hashes, voted
from veilspark.llm.words import Texts

#: The least Jaccard similarity of near-duplicates, as a fraction.
SHARE = (4, 5)
#: Counters of shingles, by the top bits of their hashes, that decide which come last: 2^20, 4 MB.
COUNTER_BITS = 20
#: The highest counters, which come to the driver; the shingles of all others are ordered by hash alone.
FREQUENT = 20_000
#: One text in so many is counted. It decides the order alone, never what is found.
COUNTED = 8
#: Sets that a task remembers, about; it gives a forgotten one again, to no harm.
SEEN = 500_000
#: Sets that a task holds before it gives them.
GIVEN = 1_000
#: Shingles up to which they are broadcast.
BROADCAST_SHINGLES = 100_000
#: Sets that are paired by a shingle they have in common; more of them are compared by a pivot.
CROWD = 50
#: Sets that share less with a pivot, as far as sizes and parities show, are paired with all others of the shingle.
NEAR = (3, 5)
#: Shingles of all pivots up to which their sets are broadcast, at 8 bytes each.
BROADCAST_PIVOTS = 2_000_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes in order; a text of fewer words is one shingle, null and empty texts have none."""
    return np.unique(shingle_hashes(text if isinstance(text, str) else "", width))


def _name(hashes: np.ndarray) -> int:
    value = xxhash.xxh64_intdigest(hashes.tobytes())
    return value - (1 << 64) if value >> 63 else value


def marks_column(text: Column, width: int) -> Column:
    """``sid, fp`` of a text: the name of its set of shingles, equal for texts of one set, and the set's SimHash."""

    @F.arrow_udf("sid long, fp long")
    def marks(texts: pa.Array) -> pa.Array:
        sids, prints = np.empty((2, len(texts)), dtype=np.int64)
        for i, text in enumerate(Texts(texts)):  # one set is held at a time
            hashes = shingle_set(text, width)
            sids[i], prints[i] = _name(hashes), voted(hashes)
        return pa.StructArray.from_arrays([pa.array(sids), pa.array(prints)], ["sid", "fp"])

    return marks(text)


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of the counted texts by the top bits of their hashes, 0 but for the ``FREQUENT`` highest counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            for text in Texts(batch.column("text")):
                np.add.at(counts, (shingle_set(text, width) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_pydict({"at": at, "n": counts[at]})

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).select("text")
    sums = some.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << COUNTER_BITS, dtype=np.int32)
    for row in sums.where("n > 1").orderBy(F.desc("n"), "at").limit(FREQUENT).collect():
        counts[row["at"]] = min(row["n"], np.iinfo(np.int32).max)
    return counts


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the hashes, set if an odd number of them leaves it; as many as hashes, or up to twice.

    Two sets differ in at least as many hashes as their parities in bits. Half as many bits are
    the two halves laid over each other, so that sets of other sizes can be compared.
    """
    bits = 1 << max(6, int(len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def by_count(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order of hashes by the counters of ``shingle_counts``, then by themselves."""
    return np.lexsort((hashes, counts[(hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))


def prefixes(docs: DataFrame, width: int, counts: Broadcast, share: tuple[int, int] = SHARE) -> DataFrame:
    """``sid, n, parity, keys``: the size and parities of each set, and its first shingles by count and hash.

    A task gives a set once, however many copies of a text it meets; of all tasks' one is kept.
    """
    part, whole = share

    def given(rows: list[tuple]) -> pa.RecordBatch:
        columns = ("sid", pa.int64()), ("n", pa.int32()), ("parity", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(zip(*rows), columns)], [c for c, _ in columns])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = counts.value, set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            rows = []
            for text in Texts(batch.column("text")):
                if len(rows) == GIVEN:
                    yield given(rows)
                    rows = []
                hashes = shingle_set(text, width)
                n, name = len(hashes), _name(hashes)
                if not n or name in seen:
                    continue
                seen.add(name)
                order = by_count(hashes, often)
                rows.append((name, n, parities(hashes), hashes[order[: n - -(-part * n // whole) + 1]].view("<i8")))
            if rows:
                yield given(rows)

    return docs.select("text").mapInArrow(cut, "sid long, n int, parity array<long>, keys array<long>").dropDuplicates(["sid"])


def fingerprint_pairs(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: pairs of sets whose SimHash fingerprints are near, by the pigeonhole search of ``simhash``.

    Sets of one fingerprint are paired with the first of them, near fingerprints by theirs.
    """
    sets = marked.select("sid", "fp").distinct()
    prints = stored_and_freed(sets.groupBy("fp").agg(F.min("sid").alias("first")), "distinct-fingerprints")
    links = near_links(prints.select("fp", F.lit(0).cast("long").alias("more")), radius)
    near = links.join(prints.selectExpr("fp AS a", "first AS x"), "a").join(prints.selectExpr("fp AS b", "first AS y"), "b")
    near = near.select("x", "y").unionByName(sets.join(prints, "fp").selectExpr("sid AS x", "first AS y"))
    return near.where("x <> y").selectExpr("greatest(x, y) AS a", "least(x, y) AS b").distinct()


def _broadcast_if_few(found: DataFrame, rows: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """A stored frame, broadcast if it has few rows; they are counted by all tasks."""
    return F.broadcast(found) if found.count() <= rows else found


def _may_link(a: str, b: str, share: tuple[int, int]) -> str:
    """Whether two sets that meet by their first common shingle can be similar enough, by sizes and places."""
    part, whole = share
    return (
        f"({part} * {a}.n <= {whole} * {b}.n AND {part} * {b}.n <= {whole} * {a}.n AND"
        f" {part + whole}L * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {part}L * ({a}.n + {b}.n))"
    )


def likely(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs ``a, b`` without those that sizes and parities show to be less similar than ``share``; loses no link.

    ``sets`` has ``sid, n, parity``. Few pairs have their whole sets moved after this.
    """
    part, whole = share
    x, y = (sets.select(F.col("sid").alias(c), F.struct("n", "parity").alias(f"{c}_set")) for c in "ab")
    fits = f"({part} * a_set.n <= {whole} * b_set.n AND {part} * b_set.n <= {whole} * a_set.n)"

    def folded(own: str, other: str) -> str:
        half = f"size({other}.parity)"
        return (
            f"IF(size({own}.parity) > {half}, zip_with(slice({own}.parity, 1, {half}),"
            f" slice({own}.parity, {half} + 1, {half}), (p, q) -> p ^ q), {own}.parity)"
        )

    apart = f"aggregate(zip_with({folded('a_set', 'b_set')}, {folded('b_set', 'a_set')}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    near = f"{part + whole}L * {apart} <= {whole - part}L * (a_set.n + b_set.n)"
    return pairs.join(x, "a").join(y, "b").where(f"CASE WHEN {fits} THEN {near} ELSE false END").select("a", "b")


def whole_sets(ids: DataFrame, docs: DataFrame, marked: DataFrame, width: int) -> DataFrame:
    """``sid, held``: the shingle hashes, in order, of the sets in ``ids`` (``sid``), each from one of its texts."""
    texts = marked.join(ids, "sid", "left_semi").groupBy("sid").agg(F.min("text_hash").alias("text_hash"))
    texts = stored_and_freed(texts, "candidate-texts")
    texts = _broadcast_if_few(texts)
    once = docs.select("text", F.xxhash64("text").alias("text_hash")).join(texts, "text_hash").dropDuplicates(["sid"])

    @F.arrow_udf("array<long>")
    def hashes(column: pa.Array) -> pa.Array:
        return pa.array((shingle_set(x, width).view("<i8") for x in Texts(column)), pa.list_(pa.int64()))

    return stored_and_freed(once.select("sid", hashes("text").alias("held")), "candidate-sets")


def _enough(a: str, b: str, share: tuple[int, int]) -> str:
    part, whole = share
    return f"{part + whole}L * size(array_intersect({a}, {b})) >= {part}L * (size({a}) + size({b}))"


def verified(pairs: DataFrame, docs: DataFrame, marked: DataFrame, width: int, share: tuple[int, int] = SHARE) -> DataFrame:
    """Those of the pairs ``a, b`` of sets whose Jaccard similarity is ``share`` or more."""
    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), docs, marked, width)
    left, right = sets.selectExpr("sid AS a", "held AS a_held"), sets.selectExpr("sid AS b", "held AS b_held")
    both = pairs.join(left, "a").join(right, "b")
    return stored_and_freed(both.where(_enough("a_held", "b_held", share)).select("a", "b"), "verified-links")


def differences(
    lacks: np.ndarray, lost: np.ndarray, n: int, p: int, counts: np.ndarray, share: tuple[int, int] = SHARE
) -> tuple[bool, int, int, int, np.ndarray]:
    """``linked, apart, probe, index, keys`` of a set of size ``n`` and its pivot of size ``p``.

    ``lacks`` are the hashes that the pivot doesn't have, ``lost`` those that only it has:
    ``apart`` of them, which tell sets of one pivot apart, too. In one order of them, what the
    pivot lacks first, a linked pair has a hash in common among the first ``probe`` of one set
    and the first ``index`` of the other, if the former doesn't link to the pivot. Sets that do
    have no ``probe``: the pivot links them to each other. ``keys`` are as many as are needed.

    Say two sets have a and d such hashes, o of them in both, so that they differ by
    a + d - 2o. They link if that is at most L = c(n + m), n and m their sizes,
    c = (whole - part) / (whole + part). As o <= d, o >= a - L: ``probe`` follows from the
    largest m. If the first doesn't link to the pivot, a > c(n + p), so 2o > d - c(m - p): ``index``.
    """
    part, whole = share
    apart = len(lacks) + len(lost)
    linked = (part + whole) * apart <= (whole - part) * (n + p)
    probe = 0 if linked else min(apart, (whole - part) * (n + whole * n // part) // (part + whole) + 1)
    index = apart - ((part + whole) * apart - (whole - part) * (n - p)) // (2 * (part + whole))
    keys = np.concatenate([lacks[by_count(lacks, counts)], lost[by_count(lost, counts)]])
    return linked, apart, probe, index, keys[: max(probe, index)]


def main_pivots(rows: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """``pivot, main``: pivots of the rows ``key, pivot, sid`` that seem to link to a pivot of more rows, and that one.

    Near copies crowd many keys, and the sets that stand first in some of them have edits of
    their own. Their other keys lead to the pivot that most copies have. Any set can be a pivot,
    those nearest to the others tell them apart with the fewest hashes.
    """
    weights = stored_and_freed(rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("weight")), "pivot-weights")
    named = weights.selectExpr("pivot AS sid", "weight AS own")
    pairs = rows.join(_broadcast_if_few(named), "sid").join(weights, "pivot").where("weight > own OR (weight = own AND pivot > sid)")
    pairs = stored_and_freed(pairs.selectExpr("sid AS a", "pivot AS b").distinct(), "pivot-pairs")
    best = likely(pairs, sets, share).join(weights.selectExpr("pivot AS b", "weight"), "b")
    return best.groupBy("a").agg(F.max(F.struct("weight", "b")).alias("best")).selectExpr("a AS pivot", "best.b AS main")


def near_pivots(rows: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows ``key, pivot, ...`` with the pivot that stands for theirs, or null if sizes and parities show that the set isn't near it."""
    mains = _broadcast_if_few(stored_and_freed(main_pivots(rows, sets, share), "main-pivots"))
    rows = stored_and_freed(rows.join(mains, "pivot", "left").withColumn("pivot", F.coalesce("main", "pivot")).drop("main"), "main-rows")
    near = likely(rows.selectExpr("sid AS a", "pivot AS b").distinct(), sets, NEAR).selectExpr("a AS sid", "b AS near")
    near = _broadcast_if_few(stored_and_freed(near.withColumn("pivot", F.col("near")), "near-pivots"))
    return rows.join(near, ["sid", "pivot"], "left").drop("pivot").withColumnRenamed("near", "pivot")


def by_pivots(
    rows: DataFrame, docs: DataFrame, marked: DataFrame, width: int, counts: Broadcast, share: tuple[int, int] = SHARE
) -> tuple[DataFrame, DataFrame]:
    """Links and candidates ``a, b`` among the rows ``pivot, sid, n, root``; each set is compared with its pivots alone.

    Every pair that links, has a pivot in common and is in two components is a candidate, or
    both link to the pivot.
    """
    part, whole = share
    members = stored_and_freed(rows.select("pivot", "sid", "n", "root").distinct(), "pivot-members")
    sets = whole_sets(members.select("sid").unionByName(members.selectExpr("pivot AS sid")).distinct(), docs, marked, width)
    pivots = sets.join(members.selectExpr("pivot AS sid").distinct(), "sid", "left_semi").selectExpr("sid AS pivot", "held AS pivot_held")
    pivots = stored_and_freed(pivots, "pivot-sets")
    if (pivots.agg(F.sum(F.size("pivot_held"))).first()[0] or 0) <= BROADCAST_PIVOTS:
        pivots = F.broadcast(pivots)

    @F.arrow_udf("linked boolean, apart int, probe int, index int, keys array<long>")
    def told(*columns: pa.Array) -> pa.Array:
        found = []
        for lacks, lost, n, p in zip(*columns):
            hashes = (x.values.to_numpy().view("<u8") for x in (lacks, lost))
            *few, keys = differences(*hashes, n.as_py(), p.as_py(), counts.value, share)
            found.append((*few, keys.view("<i8")))
        kinds = pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())
        arrays = [pa.array(v, k) for v, k in zip(zip(*found) if found else [[]] * len(kinds), kinds)]
        return pa.StructArray.from_arrays(arrays, ["linked", "apart", "probe", "index", "keys"])

    apart = "array_except(held, pivot_held)", "array_except(pivot_held, held)", "size(held)", "size(pivot_held)"
    told_apart = members.join(sets, "sid").join(pivots, "pivot").select("pivot", "sid", "n", "root", told(*map(F.expr, apart)).alias("told"))
    told_apart = stored_and_freed(told_apart.select("pivot", "sid", "n", "root", "told.*"), "differences")
    links = told_apart.where("linked AND sid <> pivot").selectExpr("greatest(sid, pivot) AS a", "least(sid, pivot) AS b").distinct()
    keys = told_apart.select("pivot", "sid", "n", "root", "apart", "probe", "index", F.posexplode("keys").alias("pos", "key"))
    x, y = keys.where("pos < probe").alias("x"), keys.where("pos < index").alias("y")
    fits = f"{part} * x.n <= {whole} * y.n AND {part} * y.n <= {whole} * x.n"
    most = "least(x.apart - x.pos, y.apart - y.pos)"  # hashes in both, if this is the first of them
    near = f"{part + whole}L * (x.apart + y.apart - 2 * {most}) <= {whole - part}L * (x.n + y.n)"
    met = x.join(y, F.expr(f"x.pivot = y.pivot AND x.key = y.key AND x.root <> y.root AND {fits} AND {near}"))
    return links, met.selectExpr("greatest(x.sid, y.sid) AS a", "least(x.sid, y.sid) AS b").distinct()


def _rooted(links: DataFrame, name: str) -> DataFrame:
    return _broadcast_if_few(stored(components(links).withColumnRenamed("node", "sid"), name))


def with_roots(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows with the component of their set, which stands for itself if it has no link."""
    return rows.join(rooted, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def shared_rows(rows: DataFrame) -> DataFrame:
    """Those of the rows ``key, sid, n, pos, root`` whose shingle is in sets of more than one component."""
    ends = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    keys = stored_and_freed(ends.where("low < high").select("key"), "shared-keys")
    return stored_and_freed(rows.join(_broadcast_if_few(keys, BROADCAST_SHINGLES), "key", "left_semi"), "shared-shingles")


def near_sets(docs: DataFrame, width: int, share: tuple[int, int] = SHARE) -> DataFrame:
    """``doc_id, text_hash, root`` for each row of ``docs`` (``doc_id, text``): ``root`` names its component.

    Links are all pairs of texts of Jaccard similarity ``share`` or more. Null texts read
    as empty; these have no shingle and link among themselves only. Repeated rows stay.
    SimHash finds most of them: pairs of near fingerprints count where the sets are similar
    enough. What fingerprints can't see is found by the prefix join, on shingles that sets of
    several components have: first each set with the first and last component it meets,
    then all pairs that are still in two, those of crowded shingles by pivots. None is left out.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), marks_column(F.col("text"), width).alias("marks"))
    marked = stored(marked.select("doc_id", "text_hash", "marks.*"), "shingle-sets")
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, width))
    sets = stored_and_freed(prefixes(docs, width, counts, share), "prefixes")
    met = stored_and_freed(fingerprint_pairs(marked), "near-fingerprints")
    links = verified(stored_and_freed(likely(met, sets, share), "likely-pairs"), docs, marked, width, share)
    first = with_roots(sets.select("sid", "n", "keys"), _rooted(links, "fingerprint-roots"))
    shared = shared_rows(first.select("sid", "n", "root", F.posexplode("keys").alias("pos", "key")))
    entry = F.struct("root", "sid", "n", "pos")
    ends = shared.groupBy("key").agg(F.min(entry).alias("least"), F.max(entry).alias("most"))
    ends = shared.join(ends, "key").select(entry.alias("own"), F.explode(F.array("least", "most")).alias("other"))
    ends = ends.where(f"own.root <> other.root AND {_may_link('own', 'other', share)}")
    ends = ends.selectExpr("greatest(own.sid, other.sid) AS a", "least(own.sid, other.sid) AS b").distinct()
    ends = stored_and_freed(ends, "end-pairs")
    links = links.unionByName(verified(stored_and_freed(likely(ends, sets, share), "likely-pairs"), docs, marked, width, share))
    shared = shared_rows(with_roots(shared.drop("root"), _rooted(links, "end-roots")))
    # The pivot is the set with the fewest rarer shingles: the edits of a text have some of their own.
    crowded = shared.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min(F.struct("pos", "n", "sid")).alias("pivot"))
    crowded = stored_and_freed(crowded.where(F.col("sets") > CROWD).selectExpr("key", "pivot.sid AS pivot"), "crowded-shingles")
    plain = shared.withColumn("pivot", F.lit(None).cast("long"))
    if not crowded.isEmpty():
        crowded = _broadcast_if_few(crowded, BROADCAST_SHINGLES)
        rows = near_pivots(stored_and_freed(shared.join(crowded, "key"), "crowded-rows"), sets, share)
        rows = stored_and_freed(rows.select(*plain.columns), "near-rows")
        linked, more = by_pivots(rows.where("pivot IS NOT NULL"), docs, marked, width, counts, share)
        plain = plain.join(crowded.select("key"), "key", "left_anti").unionByName(rows)
    x, y = plain.where("pivot IS NULL").alias("x"), plain.alias("y")
    once = "(y.pivot IS NOT NULL OR x.sid > y.sid)"
    rest = x.join(y, F.expr(f"x.key = y.key AND x.root <> y.root AND {once} AND {_may_link('x', 'y', share)}"))
    rest = rest.selectExpr("greatest(x.sid, y.sid) AS a", "least(x.sid, y.sid) AS b")
    if not crowded.isEmpty():
        links, rest = links.unionByName(linked), rest.unionByName(more)
    rest = rest.distinct().join(ends.unionByName(met), ["a", "b"], "left_anti")
    rest = stored_and_freed(likely(stored_and_freed(rest, "other-pairs"), sets, share), "likely-pairs")
    links = links.unionByName(verified(rest, docs, marked, width, share))
    return with_roots(marked, _rooted(links, "roots")).select("doc_id", "text_hash", "root")
