"""Distributed union-find: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks the neighbours of each node to its smallest neighbour (or itself): the larger ones, or the smaller.

    The minimum is an aggregate that combines before the shuffle and is joined back, so a node with very many
    neighbours is never collected; the join's skew is split by adaptive execution.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = side.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hooked = side.join(low, "a")
    if large:
        return hooked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (
        hooked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(low.select("a", F.col("m").alias("b")))
    )


def _round(edges: DataFrame) -> DataFrame:
    out = edges
    for large in (True, False):
        out = _star(out, large).where(F.col("a") != F.col("b")).distinct()
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge table (a, b) of longs; component is the smallest node reachable.

    Nulls and loops are ignored; an empty table gives an empty one. Rounds end when the edges are stars and stay so;
    their number grows as the logarithm of the longest path. Each round is written in the shared folder.
    """
    now = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        new = cut(_round(now))
        found = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(now)
        now, same, mark = new, mark == tuple(found), tuple(found)
        if same or not found[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
