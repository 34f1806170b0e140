"""Broadcasts of measured size, and a join for keys that are crowded on both sides.

Other joins are plain equi-joins: adaptive execution broadcasts a side that proves
small and splits the partitions of crowded keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilspark.frames import local_frame

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 * 1024 * 1024


def bounded_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only after measuring the frame; otherwise leave it.

    The measurement stops at ``max_rows + 1`` rows, so it costs little on a
    frame that turns out to be large.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = (
        df.select(width.alias("w"))
        .limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0)))
        .first()
    )
    return n <= max_rows and size <= max_bytes


#: Keys that the sketch keeps for each side; one that holds more than a few ten-thousandths of its rows is among them.
SKETCH_KEYS = 2_000
SKETCH_ITEMS = 20_000


def heavy_hitters(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``key, rows``: the most frequent keys and about how many rows each has, by a sketch that tasks make and then merge.

    No key is shuffled; what comes out has ``SKETCH_KEYS`` rows at most.
    """
    some = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), F.spark_partition_id().alias("task"))
    sketches = some.groupBy("task").agg(F.expr(f"approx_top_k_accumulate(item, {SKETCH_ITEMS})").alias("sketch"))
    merged = sketches.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(sketch, {SKETCH_ITEMS})").alias("sketch"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {SKETCH_KEYS})")).alias("t"))
    return top.select(F.col("t.item").alias("key"), F.col("t.count").alias("rows"))


def replica_grid(left: DataFrame, right: DataFrame, key: str, parts: int) -> DataFrame:
    """``key, across, down`` of keys crowded on both sides: pieces that the left and the right rows are dealt into.

    A piece is meant to hold what an even share of a side would be, so a key is cut only as
    far as its rows ask for; keys that neither side has too many of aren't among them.
    """
    found = [heavy_hitters(side, key, parts) for side in (left, right)]
    sizes = [side.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n")) for side in (left, right)]
    share = [max(1, -(-s.first()[0] // (4 * parts))) for s in sizes]
    both = found[0].withColumnRenamed("rows", "l").join(found[1].withColumnRenamed("rows", "r"), "key")
    pieces = [F.ceil(F.col(c) / F.lit(n)).cast("int") for c, n in zip("lr", share)]
    return both.select("key", pieces[0].alias("across"), pieces[1].alias("down")).where("across > 1 AND down > 1")


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` (1 or more) says, without that column; dealt in steps, so arrays stay small."""
    for step in (1 << 24, 1 << 12, 1):
        df = df.withColumn("veil_at", F.explode(F.expr(f"sequence(0L, ({times} - 1) DIV {step})")))
        df = df.withColumn(times, F.expr(f"least({times} - veil_at * {step}, {step})"))
    return df.drop("veil_at", times)


def crowded_join(left: DataFrame, right: DataFrame, key: str, parts: int | None = None, copies: str | None = None) -> DataFrame:
    """Inner equi-join on ``key`` where one key may hold a third of the rows on both sides.

    Keys that are crowded on both sides are dealt into a grid: a left row goes to one row of
    it and is copied along it, a right row to one column; every pair meets in one cell. Rows
    that are equal are counted first and repeated last, so the piece follows from what a
    row holds and copies don't pile up. All other keys take the plain join. With ``copies``
    nothing is repeated: a column of that name tells how often a joined row stands there,
    and every key is counted before it is joined.
    """
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(side: DataFrame, n: str) -> DataFrame:
        return side.groupBy(*[F.col(f"`{c}`") for c in side.columns]).agg(F.count(F.lit(1)).alias(n))

    def multiplied(met: DataFrame) -> DataFrame:
        times = F.col("veil_l") * F.col("veil_r")
        return met.withColumn(copies or "veil_times", times).drop("veil_l", "veil_r")

    def plain(some: DataFrame, others: DataFrame) -> DataFrame:
        return multiplied(counted(some, "veil_l").join(counted(others, "veil_r"), key)) if copies else some.join(others, key)

    # Cut off from its lineage: three joins read it, and it has SKETCH_KEYS rows at most.
    rows = [tuple(r) for r in replica_grid(left, right, key, parts).collect()]
    if not rows:
        return plain(left, right)
    grid = F.broadcast(local_frame(left.sparkSession, rows, "veil_key string, veil_across int, veil_down int"))
    match = F.col(key).cast("string") == F.col("veil_key")
    light = plain(left.join(grid, match, "left_anti"), right.join(grid, match, "left_anti"))

    def dealt(side: DataFrame, own: str, other: str, n: str) -> DataFrame:
        placed = counted(side, n).join(grid, match)
        place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in side.columns]), F.col(f"veil_{own}")).cast("int")
        cells = F.explode(F.sequence(F.lit(0), F.col(f"veil_{other}") - 1))
        placed = placed.withColumn(f"cell_{own}", place).withColumn(f"cell_{other}", cells)
        return placed.drop("veil_key", "veil_across", "veil_down")

    met = dealt(left, "across", "down", "veil_l").join(dealt(right, "down", "across", "veil_r"), [key, "cell_across", "cell_down"])
    heavy = multiplied(met.drop("cell_across", "cell_down"))
    return light.unionByName(heavy if copies else repeated(heavy, "veil_times"))
