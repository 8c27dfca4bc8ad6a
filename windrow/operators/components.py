"""Connected components as iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.session import materialise, release


def components(edges: DataFrame, src: str = "a", dst: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds over (node, smaller node) pairs: each round at least halves the
    height of a tree, so paths take a logarithmic number of rounds. Every round is written to the shared folder, so
    lineage stays short. Self-loops keep a lone node; repeated edges and either direction are fine; nulls drop out.
    """
    pairs = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull())
        .distinct()
    )
    nodes = None
    pairs = materialise(pairs, "cc")
    loops = pairs.where("u = v").select(F.col("u").alias("node"))
    nodes = loops
    edges_now = pairs.where("u <> v")
    seen, base = None, pairs
    for _ in range(most_rounds):
        both = edges_now.select("u", "v").unionByName(edges_now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        )
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        following = materialise(small, "cc")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen is not None:
            release(edges_now)
        edges_now = following
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    linked = edges_now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges_now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    inner = linked.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
    alone = nodes.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))
    del base
    return inner.unionByName(alone)
