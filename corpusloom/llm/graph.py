"""Connected components of a large edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node that an edge (a, b) with a <> b touches.

    Alternates two steps until the edges stay the same: every node links its larger neighbours to its smallest one, then
    its smaller neighbours. Minima are combined before the shuffle, no neighbour list is ever gathered, and every round
    is stored, so lost executors cost a round at most.
    """
    edge = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edge, before = stored(edge), None
    for _ in range(most_rounds):
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def bucket_components(live: DataFrame, marks: DataFrame, admit: str, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of the links among nodes that share a bucket, without pairing a bucket's members that are linked already.

    live: key, node, first (the smallest node of the key). marks: node and struct m, by which the SQL condition `admit`
    on x.m and y.m rules pairs out. verify: keeps of pairs (a, b) those that link.

    Every key's first node is tried against the key's others. Then nodes of different components so far that share a key
    are paired. Every pair under a key is thus either tried or already in one component, while a large group of copies
    costs a few rows per member.
    """
    x = marks.select(F.col("node").alias("a"), F.struct("m").alias("x"))
    y = marks.select(F.col("node").alias("b"), F.struct("m").alias("y"))
    stars = live.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verify(stars.join(x, "a").join(y, "b").filter(admit).select("a", "b")))
    comp = components(links)
    now = live.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_ = stored(now.join(mixed, "key").join(marks, "node"))
    across = open_.alias("x").join(open_.alias("y"), F.expr(f"x.key = y.key AND x.node < y.node AND x.comp <> y.comp AND {admit}"))
    across = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return components(links.union(stored(verify(across))))
