"""Clusters from tiered edges: merging, pruning of weak tails, splitting, classes, numbers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.text import kind_of
from windrow.operators.components import components
from windrow.operators.ranking import global_index
from windrow.session import materialise


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """node, other: every edge from either end."""
    return edges.select(F.col("entity_a").alias("node"), F.col("entity_b").alias("other"), *extra).unionByName(
        edges.select(F.col("entity_b").alias("node"), F.col("entity_a").alias("other"), *extra)
    )


def merge_edges(edges: DataFrame) -> DataFrame:
    """entity_a, entity_b of the edges that merge: strong ones; weak ones with a hard link or lineage of one half, with
    a common strong neighbour, or alone between two nodes without strong neighbours."""
    strong, weak = edges.where("tier = 'strong'"), edges.where("tier = 'weak'")
    near = both_ways(strong).distinct()
    backed = weak.where("hard_link >= 0.5 OR lineage >= 0.5")
    rest = weak.where("NOT (hard_link >= 0.5 OR lineage >= 0.5)").select("entity_a", "entity_b")
    left = near.select(F.col("node").alias("entity_a"), F.col("other").alias("x"))
    right = near.select(F.col("node").alias("entity_b"), F.col("other").alias("y"))
    common = rest.join(left, "entity_a").join(right, "entity_b").where("x = y").select("entity_a", "entity_b").distinct()
    degree = both_ways(weak).groupBy("node").agg(F.countDistinct("other").alias("n"))
    free = degree.where("n = 1").join(near.select("node").distinct(), "node", "left_anti").select("node")
    alone = rest.join(free, F.col("entity_a") == F.col("node"), "left_semi").join(free, F.col("entity_b") == F.col("node"), "left_semi")
    chosen = [e.select("entity_a", "entity_b") for e in (strong, backed, common, alone)]
    out = chosen[0]
    for e in chosen[1:]:
        out = out.unionByName(e)
    return out.distinct()


def group(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component for every entity; those without an edge are their own."""
    linked = components(edges, "entity_a", "entity_b")
    return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def inner_edges(edges: DataFrame, grouped: DataFrame) -> DataFrame:
    """Edges whose ends are in one component, with it."""
    a = grouped.select(F.col("node").alias("entity_a"), F.col("component"))
    b = grouped.select(F.col("node").alias("entity_b"), F.col("component").alias("component_b"))
    return edges.join(a, "entity_a").join(b, "entity_b").where("component = component_b").drop("component_b")


def prune_tails(grouped: DataFrame, edges: DataFrame, below: float, most_rounds: int = 50) -> DataFrame:
    """Peel nodes of components of three or more with at most one neighbour left, no firm edge and a best score under
    ``below``; peeled nodes stand alone, and the rest of a peeled component is grouped anew over all its edges."""
    size = Window.partitionBy("component")
    sized = materialise(grouped.withColumn("n", F.count("*").over(size)), "sized")
    inner = materialise(inner_edges(edges, sized.where("n >= 3").select("node", "component")), "inner")
    current, gone = inner, None
    for _ in range(most_rounds):
        ends = both_ways(current, "total", "hard_link", "lineage")
        left = sized.where("n >= 3").select("node")
        if gone is not None:
            left = left.join(gone, "node", "left_anti")
        state = left.join(ends, "node", "left").groupBy("node").agg(
            F.countDistinct("other").alias("k"), F.max((F.col("hard_link") >= 0.5) | (F.col("lineage") >= 0.5)).alias("firm"), F.max("total").alias("best")
        )
        drop = materialise(state.where((F.col("k") <= 1) & ~F.coalesce("firm", F.lit(False)) & (F.coalesce("best", F.lit(0.0)) < below)).select("node"), "peeled")
        if drop.isEmpty():
            break
        gone = drop if gone is None else materialise(gone.unionByName(drop), "peeled")
        a, b = drop.withColumnRenamed("node", "entity_a"), drop.withColumnRenamed("node", "entity_b")
        current = materialise(current.join(a, "entity_a", "left_anti").join(b, "entity_b", "left_anti"), "inner")
    if gone is None:
        return grouped
    touched = sized.join(gone, "node", "left_semi").select("component").distinct()
    same = sized.join(touched, "component", "left_anti").select("node", "component")
    rest = sized.join(touched, "component", "left_semi").join(gone, "node", "left_anti").select("node")
    anew = group(rest, current.join(touched, "component", "left_semi"))
    return same.unionByName(anew).unionByName(gone.select("node", F.col("node").alias("component")))


def cohesive(cfg: dict[str, Any]) -> Column:
    """Edges that hold a large cluster together."""
    s, c = cfg["similarity"], F.col
    text = (c("title_salient") >= s["split_lineage_semantic"]) & (c("semantic_text") >= s["split_lineage_semantic"])
    lineage = (c("lineage") >= 0.5) & ((c("hunk_overlap") >= s["split_lineage_hunk"]) | (c("hard_link") >= s["split_hard_link"]) | text)
    return (c("hard_link") >= s["split_hard_link"]) | lineage | ((c("title_salient") >= s["split_title"]) & (c("semantic_text") >= s["split_semantic_text"]))


def split_large(grouped: DataFrame, edges: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """Group components of ``split_size`` or more anew over their cohesive edges only."""
    sized = grouped.withColumn("n", F.count("*").over(Window.partitionBy("component")))
    large = materialise(sized.where(F.col("n") >= cfg["similarity"]["split_size"]).select("node", "component"), "large")
    small = sized.where(F.col("n") < cfg["similarity"]["split_size"]).select("node", "component")
    if large.isEmpty():
        return grouped
    return small.unionByName(group(large.select("node"), inner_edges(edges.where(cohesive(cfg)), large)))


def classify(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """component, n, cluster_type by the kinds of the members."""
    kind = kind_of(F.col("node"))
    counts = grouped.groupBy("component").agg(
        F.count("*").alias("n"), F.sum((kind == "pr").cast("int")).alias("prs"), F.sum((kind == "issue").cast("int")).alias("issues")
    )
    hard = inner_edges(edges, grouped).groupBy("component").agg(F.max("hard_link").alias("hard"))
    firm = F.coalesce("hard", F.lit(0.0)) >= 0.5
    cluster_type = (
        F.when(F.col("n") == 1, "singleton_orphan")
        .when((F.col("prs") >= 2) | (F.col("issues") >= 2), "duplicate_candidate")
        .when((F.col("prs") == 1) & (F.col("issues") == 1), F.when(firm, "linked_pair").otherwise("mixed_pair"))
        .when((F.col("prs") > 0) & (F.col("issues") > 0), "mixed_related")
        .otherwise("related_group")
    )
    return counts.join(hard, "component", "left").select("component", F.col("n").cast("long").alias("n"), cluster_type.alias("cluster_type"))


def clusters(nodes: DataFrame, edges: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """node, component after merging, pruning and splitting. The smallest member names a component."""
    merged = materialise(group(nodes, merge_edges(edges)), "merged")
    pruned = materialise(prune_tails(merged, edges, cfg["similarity"]["cluster_tail_prune_score"]), "pruned")
    return split_large(pruned, edges, cfg)


def number(types: DataFrame) -> DataFrame:
    """``types`` with cluster_id ``cluster-N``, by size and then by the smallest member (which names a component)."""
    placed = global_index(types, F.desc("n"), F.asc("component"))
    return placed.withColumn("cluster_id", F.concat(F.lit("cluster-"), (F.col("index") + 1).cast("string"))).drop("index")
