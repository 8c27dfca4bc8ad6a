"""Canonical member of each cluster and the state of the others; routing rows; shadow members."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.text import kind_of
from windrow.operators.graph import both_ways

METRICS = ("total", "lineage", "file_overlap", "hunk_overlap", "hard_link", "title_salient", "semantic_text")


def scores(members: DataFrame, fingerprints: DataFrame, edges: DataFrame, priority: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """members: cluster_id, entity_id. Adds lane and score; absent edges count 0 in the centrality."""
    w = cfg["canonical"]["weights"]
    inside = members.select("cluster_id", F.col("entity_id").alias("node"))
    other = members.select(F.col("cluster_id").alias("c2"), F.col("entity_id").alias("other"))
    central = both_ways(edges, "total").join(inside, "node").join(other, "other").where("cluster_id = c2")
    central = central.groupBy("cluster_id", F.col("node").alias("entity_id")).agg(F.sum("total").alias("sims"))
    files = members.join(fingerprints.select("entity_id", F.explode(F.array_distinct("changed_files")).alias("file")), "entity_id")
    own = files.groupBy("cluster_id", "entity_id").agg(F.count("*").alias("own_files"))
    whole = files.select("cluster_id", "file").distinct().groupBy("cluster_id").agg(F.count("*").alias("all_files"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    ci = F.when(F.col("ci_status") == "pass", 1.0).when(F.col("ci_status") == "fail", -1.0).otherwise(0.0)
    churn = F.col("additions") + F.col("deletions")
    facts = fingerprints.select("entity_id", "approvals", "reviewer_score", ci.alias("ci"), churn.alias("churn"))
    joined = (
        members.join(facts, "entity_id")
        .join(priority.select("entity_id", "priority_weight"), "entity_id", "left")
        .join(central, ["cluster_id", "entity_id"], "left")
        .join(own, ["cluster_id", "entity_id"], "left")
        .join(whole, "cluster_id", "left")
        .join(sizes, "cluster_id")
    )
    coverage = F.coalesce(F.col("own_files") / F.col("all_files"), F.lit(0.0))
    centrality = F.coalesce("sims", F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
    score = (
        w["coverage"] * coverage + w["centrality"] * centrality + w["ci"] * F.col("ci") + w["reviewer"] * F.col("reviewer_score")
        + w["approvals"] * F.least(F.lit(1.0), F.col("approvals") / 3.0) + w["priority"] * F.coalesce("priority_weight", F.lit(1.0))
        - w["size_penalty"] * F.least(F.lit(1.0), F.log1p("churn") / 8.0)
    )
    return joined.select("cluster_id", "entity_id", kind_of(F.col("entity_id"), "default").alias("lane"), score.alias("rank_score"))


def veto(c: dict[str, Any]) -> Column:
    """Unlike titles and texts without lineage or a full hard link."""
    return (
        (F.col("lineage") < 0.5) & (F.col("title_salient") <= c["veto_title"]) & (F.col("semantic_text") <= c["veto_semantic_text"])
        & (F.col("hard_link") < c["veto_hard_link"])
    )


def evidence(c: dict[str, Any]) -> Column:
    x = F.col
    text = (x("title_salient") >= c["duplicate_title"]) & (x("semantic_text") >= c["duplicate_semantic_text"])
    lineage = (x("lineage") >= 0.5) & ((x("hard_link") >= c["duplicate_hard_link"]) | (x("hunk_overlap") >= c["duplicate_hunk"]) | text)
    linked = (x("hard_link") >= c["duplicate_hard_link"]) & (
        (x("file_overlap") >= c["duplicate_hard_link_file"]) | (x("hunk_overlap") >= c["duplicate_hard_link_hunk"])
        | (x("title_salient") >= c["duplicate_hard_link_title"])
    )
    files = (x("file_overlap") >= c["duplicate_file"]) & (x("title_salient") >= c["duplicate_file_title"]) & (x("semantic_text") >= c["duplicate_semantic_text"])
    return lineage | linked | (x("hunk_overlap") >= c["duplicate_hunk"]) | files


def rank(scored: DataFrame, edges: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """cluster_id, entity_id, lane, state, score, duplicate_of, lane_rank: one canonical a lane."""
    c = cfg["canonical"]
    lane = Window.partitionBy("cluster_id", "lane").orderBy(F.desc("rank_score"), "entity_id")
    whole = Window.partitionBy("cluster_id", "lane")
    ranked = scored.withColumns({"lane_rank": F.row_number().over(lane), "behind": F.lag("rank_score").over(lane) - F.col("rank_score")})
    ranked = ranked.withColumn("head", F.max(F.when(F.col("lane_rank") == 1, F.col("entity_id"))).over(whole))
    metrics = both_ways(edges, *METRICS).select(F.col("node").alias("entity_id"), F.col("other").alias("head"), *METRICS)
    joined = ranked.join(metrics, ["entity_id", "head"], "left").fillna(0.0, subset=list(METRICS))
    first = F.col("lane_rank") == 1
    meets = (F.col("total") >= c["duplicate_threshold"]) | (F.col("lineage") >= 0.5)
    duplicate = meets & evidence(c) & ~veto(c)
    near = (F.col("hard_link") >= c["tie_hard_link"]) | (F.col("hunk_overlap") >= c["tie_hunk"]) | ((F.col("file_overlap") >= c["tie_file"]) & (F.col("semantic_text") >= c["tie_semantic_text"]))
    tie = (F.col("lane_rank") == 2) & (F.col("behind") < c["tie_margin"]) & ~veto(c) & (F.col("total") >= c["tie_similarity"]) & near
    state = F.when(first, "canonical").when(duplicate, "duplicate_of").when(tie, "needs_human_tie_break").otherwise("related_non_duplicate")
    return joined.select(
        "cluster_id", "entity_id", "lane", state.alias("state"),
        F.when(first, F.col("rank_score")).otherwise(F.col("total")).alias("score"),
        F.when(~first & duplicate, F.col("head")).alias("duplicate_of"),
        F.col("lane_rank").cast("long").alias("lane_rank"),
    )


def route(filtered: DataFrame, decisions: DataFrame, types: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """id, labels, queue_key, comment, close for every entity of the noise filter's result."""
    names, act = cfg["labels"], cfg["action"]
    d = decisions.join(types.select("cluster_id", "cluster_type", "n"), "cluster_id").select(F.col("entity_id").alias("id"), F.col("state").alias("decision"), "duplicate_of", "cluster_type", "n")
    joined = filtered.join(d, "id", "left")
    noisy = F.col("filter_state") != "pass"
    closing = F.col("action") == "close"
    big = F.coalesce("n", F.lit(1)) > 1
    pair = big & (F.col("cluster_type") == "linked_pair")
    is_canonical, is_duplicate = F.col("decision") == "canonical", F.col("decision") == "duplicate_of"
    role = (
        F.when(pair, names["linked_pair"])
        .when(is_canonical, F.when(big, names["canonical"]))
        .when(is_duplicate, names["duplicate"])
        .when(big, names["related"])
    )
    noise = [F.lit(names["noise_suppressed"])] + ([F.lit(names["quarantine"])] if act["queue_on_suppress"] else []) + [F.when(closing, names["close_candidate"])]
    labels = F.when(noisy, F.array(*noise)).otherwise(F.array(F.lit(names["ready_human"]), role))
    said = (
        F.when(noisy, F.when(closing, act["close_comment"]))
        .when(pair, F.when(is_canonical & (F.col("kind") == "pr"), "Linked PR/issue pair for the same work item."))
        .when(is_canonical, F.when(big, "Marked as canonical candidate for this similarity cluster."))
        .when(is_duplicate, F.concat(F.lit("Potential duplicate of "), F.col("duplicate_of"), F.lit("; routed for maintainer confirmation.")))
    )
    return joined.select(
        "id",
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("labels"),
        (F.when(noisy, "quarantine") if act["queue_on_suppress"] else F.lit(None).cast("string")).alias("queue_key"),
        (said if act["add_comments"] else F.lit(None).cast("string")).alias("comment"),
        (closing & F.lit(not act["safe_mode"])).alias("close"),
    )


def attach_shadows(members: DataFrame, fingerprints: DataFrame, shadows: DataFrame) -> DataFrame:
    """id, cluster_id, votes: each filtered-out entity joins the cluster that shares most issue references (ties: the
    smallest cluster id as a string)."""
    links = F.array_union("linked_issues", "soft_linked_issues")
    refs = members.join(fingerprints.select("entity_id", F.explode(links).alias("ref")), "entity_id").select("cluster_id", "ref").distinct()
    own = F.when((F.col("kind") == "issue") & F.col("number").isNotNull(), F.array(F.col("number").cast("string"))).otherwise(F.array().cast("array<string>"))
    asked = shadows.select("id", F.explode(F.array_union(links, own)).alias("ref")).distinct()
    votes = asked.join(refs, "ref").groupBy("id", "cluster_id").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("id").orderBy(F.desc("votes"), "cluster_id")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "cluster_id", "votes")
