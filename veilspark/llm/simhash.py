"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints of word shingles. Bits that go together are grouped into
partitions; if two fingerprints differ in at most ``radius`` bits, then for any
thresholds ``t_i >= -1`` with ``sum(t_i + 1) = radius + 1`` they differ in at most
``t_i`` bits of some partition i. Thresholds and the number of partitions come from a
dynamic programme over estimated candidate counts. Every fingerprint is put under its
own value of each partition, probes the values within the threshold, and candidates
that meet are verified on all 64 bits, and where asked on 64 more from a second seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import stored, table
from veilspark.llm.components import components

BITS = 64
WIDTH = 4
RADIUS = 4
SEED, SECOND_SEED = 42, 43
#: Rows of a block; larger groups are compared block by block.
BLOCK = 1 << 15
#: What a probing row costs, in comparisons of two fingerprints.
ROW_COST = 600
_SLICE = 1 << 15


# Fingerprints


def shingle_hashes(text: str, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z are lower-cased, ASCII white space parts words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :].tolist() or [len(line)]
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(line[s:e], seed) for s, e in zip(starts.tolist(), last)], dtype="<u8")


def simhash(text: str, width: int = WIDTH, seed: int = SEED, repeats: bool = True) -> int:
    """The fingerprint as a signed 64-bit number: a bit is set if it is in over half the hashes.

    Repeated shingles count as often as they stand there, or once without ``repeats``.
    """
    hashes = shingle_hashes(text, width, seed)
    return voted(hashes if repeats else np.unique(hashes))


def voted(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as a signed number."""
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def simhash_column(text: Column, width: int = WIDTH, seed: int = SEED, repeats: bool = True) -> Column:
    """Fingerprints of a text column in Arrow batches; null is fingerprinted as empty text."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x if isinstance(x, str) else "", width, seed, repeats) for x in texts], dtype="int64")

    return fingerprint(text)


# Partitions and thresholds


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for every two bits, how many have both; each task sends 4,096 sums."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            raw = batch["fp"].to_numpy(dtype="<i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), _SLICE):
                bits = np.unpackbits(raw[at : at + _SLICE], axis=1, bitorder="little").astype(np.float32)
                bits = np.hstack([bits, np.ones((len(bits), 1), dtype=np.float32)])
                both += bits.T @ bits
        yield pd.DataFrame({"at": np.arange(both.size), "n": both.ravel()})

    sums = prints.mapInPandas(count, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS + 1) ** 2)
    for row in sums:
        both[row["at"]] = row["n"]
    both = both.reshape(BITS + 1, BITS + 1)
    return int(both[BITS, BITS]), both[:BITS, :BITS]


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of near-equal width, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def near_chances(p: np.ndarray, up_to: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, ... of the bits with these shares of ones."""
    chances = np.zeros(up_to + 1)
    chances[0] = 1.0
    for differ in 2 * p * (1 - p):
        chances[1:] = chances[1:] * (1 - differ) + chances[:-1] * differ
        chances[0] *= 1 - differ
    return np.minimum(1.0, np.cumsum(chances))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the least cost: ``costs[i][t + 1]`` is partition i's at t, the t + 1 add up to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra, more in enumerate(part[: total - used + 1]):
                if used + extra not in step or cost + more < step[used + extra][0]:
                    step[used + extra] = (cost + more, [*chosen, extra - 1])
        best = step
    return best.get(total, (float("inf"), []))


def plan_partitions(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of every partition that is probed, for the number of partitions that costs least."""
    n = max(n, 1)  # an empty table is planned like one fingerprint, not with every plan for nothing
    p = np.diag(both) / n
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, min(radius + 1, BITS) + 1):
        groups = correlated_groups(n, both, parts)
        costs = []
        for group in groups:
            chance = near_chances(p[group], min(radius, len(group)))
            row, probes = [0.0], 0
            for t in range(min(radius, len(group)) + 1):
                probes += comb(len(group), t)
                row.append(n * probes * ROW_COST + float(n) ** 2 * chance[t])
            costs.append(row)
        cost, thresholds = allocate(costs, radius + 1)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def _signed(bits: tuple[int, ...] | list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def probe_rows(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """``part, key, own, fp, more``: each fingerprint under its own key and those within the threshold."""
    probes = [
        F.struct(F.lit(i).alias("part"), F.lit(_signed(bits)).alias("mask"), F.lit(_signed(flip)).alias("flip"))
        for i, (bits, t) in enumerate(plan)
        for k in range(t + 1)
        for flip in combinations(bits, k)
    ]
    rows = prints.select("fp", "more", F.explode(F.array(*probes)).alias("probe"))
    return rows.select(
        F.col("probe.part").alias("part"),
        F.expr("(fp & probe.mask) ^ probe.flip").alias("key"),
        F.expr("probe.flip = 0L").alias("own"),
        "fp",
        "more",
    )


# Verification


def near(a: np.ndarray, b: np.ndarray, radius: int, total: int) -> np.ndarray:
    """Which fingerprints of ``a`` (rows) and ``b`` (columns) are near; the second words count only towards ``total``."""
    apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    close = apart <= radius
    if total < 2 * BITS and close.any():
        i, j = np.nonzero(close)
        close[i, j] = apart[i, j] + np.bitwise_count(a[i, 1] ^ b[j, 1]) <= total
    return close


def forest(own: np.ndarray, probes: np.ndarray, radius: int, total: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is near: own with own, own with probes. Fingerprints are rows of two words.

    All such pairs while they are few; otherwise the links of a breadth-first search,
    which reach the same fingerprints with less than one link for each.
    """
    everything = np.concatenate([own, probes])
    rows = max(1, (1 << 20) // max(1, len(everything)))
    found, n = [], 0
    for at in range(0, len(own), rows):
        part = own[at : at + rows]
        i, j = np.nonzero(near(part, everything, radius, total))
        keep = part[i, 0] != everything[j, 0]
        i, j = i[keep], j[keep]
        n += len(i)
        if n > 4 * len(everything):
            break
        found.append((part[i, 0], everything[j, 0]))
    else:
        return found
    _, once = np.unique(everything[:, 0], return_index=True)
    left, found = everything[once], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            rows = max(1, (1 << 20) // len(left))
            now, front = front[:rows], front[rows:]
            close = near(now, left, radius, total)
            hit = close.any(axis=0)
            found.append((left[hit, 0], now[close.argmax(axis=0)[hit], 0]))
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return found


def _verify(radius: int, total: int):
    def words(prints: list, more: list) -> np.ndarray:
        return np.column_stack([np.asarray(prints, dtype="<i8"), np.asarray(more, dtype="<i8")]).view("<u8")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for own, own_more, probes, probes_more in zip(*(batch[c] for c in _LISTS)):
                found += forest(words(own, own_more), words(probes, probes_more), radius, total)
            if found:
                a = np.concatenate([x for x, _ in found]).view("<i8")
                b = np.concatenate([y for _, y in found]).view("<i8")
                yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    return links


_LISTS = ("own", "own_more", "probes", "probes_more")


def near_links(prints: DataFrame, radius: int = RADIUS, total: int = 2 * BITS, block: int = BLOCK) -> DataFrame:
    """``a, b``: links whose components are those of all pairs within ``radius`` bits, and ``total`` with the second words.

    ``prints`` has each fingerprint once, in ``fp``, with its second word in ``more``. A key
    that more than ``block`` rows share is cut into blocks by hash and compared block by
    block, so no task holds more than two blocks, and no key is left out.
    """
    plan = plan_partitions(*bit_counts(prints.select("fp")), radius)
    rows = probe_rows(prints, plan)
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.where(F.col("n") > block).select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("cuts"))
    crowded = stored(crowded, "crowded-keys")
    single = F.col("cuts").isNull()
    cut = rows.join(crowded, ["part", "key"], "left")
    cut = cut.withColumn("cut", F.when(single, 0).otherwise(F.pmod(F.xxhash64("fp"), F.coalesce("cuts", F.lit(1)))))
    own = F.col("own")
    blocks = cut.groupBy("part", "key", "cut").agg(
        F.collect_list(F.when(own, F.struct("fp", "more"))).alias("mine"),
        F.collect_list(F.when(~own, F.struct("fp", "more"))).alias("others"),
    )

    def lists(mine: str, others: str) -> list[Column]:
        pairs = (f"{mine}.fp", f"{mine}.more", f"{others}.fp", f"{others}.more")
        return [F.expr(x).alias(name) for x, name in zip(pairs, _LISTS)]

    schema = "a long, b long"
    inside = blocks.where("size(mine) > 0 AND size(mine) + size(others) > 1").select(*lists("mine", "others"))
    links = inside.mapInPandas(_verify(radius, total), schema)
    if crowded.limit(1).count():
        split = stored(blocks.join(crowded.drop("cuts"), ["part", "key"], "left_semi"), "crowded-blocks")
        left = split.select("part", "key", "cut", F.col("mine").alias("l_mine"))
        right = split.select("part", "key", F.col("cut").alias("r_cut"), "mine", "others")
        across = left.join(right, ["part", "key"]).where("cut <> r_cut")
        # Own against own once for both orders, own against the other block's probes in each order.
        across = across.select("l_mine", F.expr("IF(cut < r_cut, concat(mine, others), others)").alias("r_all"))
        across = across.where("size(l_mine) > 0 AND size(r_all) > 0").select(*lists("l_mine", "r_all"))
        links = links.unionByName(across.mapInPandas(_verify(radius, total), schema))
    return links.distinct()


#: Copies of one fingerprint from which it is joined by broadcast: at least this many, and a 10,000th of all rows.
CROWD = 500
CROWD_SHARE = 1e-4


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = WIDTH,
    radius: int = RADIUS,
    total: int | None = None,
    repeats: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for each row of ``docs`` (``doc_id, text``).

    Fingerprints link at ``radius`` or fewer differing bits; with ``total`` a second
    fingerprint is made, and both together may differ in so many. ``root`` names the
    component by a fingerprint, ``component_id`` by the smallest id reachable; null ids
    are passed over, a component of null ids alone has the name null. Null and empty texts
    have fingerprint zero and link like any other. Repeated rows stay, other columns are
    not carried. Copies are reduced to one fingerprint before any comparison.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    more = F.lit(0).cast("long") if total is None else simhash_column(text, width, SECOND_SEED, repeats)
    marked = docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), simhash_column(text, width, SEED, repeats).alias("fp"), more.alias("more")
    )
    marked = stored(marked, "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("more").alias("more"), F.min("doc_id").alias("least_doc"), F.count(F.lit(1)).alias("n"))
    prints = stored(prints, "distinct-fingerprints")
    links = near_links(prints.select("fp", "more"), radius, 2 * BITS if total is None else total, block)
    rooted = stored(components(links).withColumnRenamed("node", "fp"), "roots")
    names = rooted.join(prints, "fp").groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = rooted.join(names, "root")
    whole = prints.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least_doc").alias("component_id")
    )
    # Fingerprints with very many copies, 10,000 at most, are broadcast; the others are joined by key.
    whole = stored(whole, "components")
    crowd = max(CROWD, int(CROWD_SHARE * (whole.agg(F.sum("n")).first()[0] or 0)))
    crowds = whole.where(F.col("n") >= crowd).drop("n")
    rest = marked.join(F.broadcast(crowds.select("fp")), "fp", "left_anti").join(whole.where(F.col("n") < crowd).drop("n"), "fp")
    everyone = marked.join(F.broadcast(crowds), "fp").unionByName(rest)
    return everyone.select("doc_id", "text_hash", "fp", "root", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
