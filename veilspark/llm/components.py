"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("least"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of the links ``a, b``; the root is the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes: each step gives every
    neighbour of a node to the smallest one, with one combined aggregate and one join,
    so a node with very many links is never gathered. Rounds are written to the shared
    folder. Links to oneself and repeated links are harmless, no links give no rows.
    """
    current = stored(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links")
    before = None
    while (mark := _mark(current)) != before:
        before = mark
        both = current.unionByName(current.selectExpr("b AS a", "a AS b"))
        least = _minima(both).selectExpr("a AS n", "least(a, least) AS m")
        # Larger neighbours of n go to the smallest of n and its neighbours.
        large = current.selectExpr("b AS n", "a AS v").join(least, "n").selectExpr("v AS a", "m AS b").distinct()
        low = _minima(large).selectExpr("a AS n", "least AS m")
        # Smaller neighbours of n, and n itself, go to the smallest neighbour.
        small = large.selectExpr("a AS n", "b AS v").join(low, "n").selectExpr("v AS a", "m AS b")
        small = small.unionByName(low.selectExpr("n AS a", "m AS b"))
        current = stored(small.where("a <> b").distinct(), "links")
    roots = current.selectExpr("b AS node", "b AS root").distinct()
    return current.selectExpr("a AS node", "b AS root").unionByName(roots)
