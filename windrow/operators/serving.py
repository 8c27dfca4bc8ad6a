"""Queries behind the cluster map, the graph and the author pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.text import hash28

# Trust by association with the repository.
TRUST = {
    "OWNER": 1.0,
    "MEMBER": 0.9,
    "COLLABORATOR": 0.8,
    "CONTRIBUTOR": 0.6,
    "FIRST_TIME_CONTRIBUTOR": 0.25,
    "FIRST_TIMER": 0.2,
    "NONE": 0.3,
}


def trust(association: Column) -> Column:
    out = F.lit(0.4)
    for name, value in TRUST.items():
        out = F.when(F.upper(association) == name, value).otherwise(out)
    return out


def attention(comments: Column, reactions: Column) -> Column:
    return 0.6 * comments + 0.4 * reactions


def cluster_summary(members: DataFrame) -> DataFrame:
    """members: cluster_id, kind, comments, reactions, churn. Attention of issues, size, pressure and priority."""
    found = members.groupBy("cluster_id").agg(
        F.count("*").alias("size"),
        F.sum(F.when(F.col("kind") == "issue", attention(F.col("comments"), F.col("reactions"))).otherwise(0.0)).alias("attention"),
        (F.count("*") - 1).cast("double").alias("pressure"),
    )
    return found.withColumn("priority", 0.45 * F.col("attention") + 0.35 * F.col("size") + 0.20 * F.col("pressure"))


def author_rollup(rows: DataFrame) -> DataFrame:
    """rows: author, kind, state, association, seen (order), trust. First association in order of ``seen``."""
    is_open = F.lower("state") == "open"
    return rows.groupBy("author").agg(
        F.count_if(is_open & (F.col("kind") == "pr")).alias("open_prs"),
        F.count_if(is_open & (F.col("kind") == "issue")).alias("open_issues"),
        F.min_by("association", F.when(F.col("association").isNotNull(), F.col("seen"))).alias("association"),
        F.max("trust").alias("trust"),
    )


def bridges(edges: DataFrame, members: DataFrame, facts: DataFrame, author_weight: float = 0.8, ref_weight: float = 1.2, most: int = 2000) -> DataFrame:
    """cluster_a, cluster_b, weight: similarity across clusters, shared authors and shared references.

    members: cluster_id, entity_id; facts: entity_id, what ('author' or 'ref'), value."""
    a = members.select(F.col("entity_id").alias("entity_a"), F.col("cluster_id").alias("ca"))
    b = members.select(F.col("entity_id").alias("entity_b"), F.col("cluster_id").alias("cb"))
    pair = [F.least("ca", "cb").alias("cluster_a"), F.greatest("ca", "cb").alias("cluster_b")]
    across = edges.join(a, "entity_a").join(b, "entity_b").where("ca <> cb").select(*pair, F.col("total").alias("w"))
    held = members.join(facts, "entity_id").select("cluster_id", "what", "value").distinct()
    left, right = held.withColumnRenamed("cluster_id", "ca"), held.withColumnRenamed("cluster_id", "cb")
    weight = F.when(F.col("what") == "author", author_weight).otherwise(ref_weight)
    shared = left.join(right, ["what", "value"]).where("ca < cb").select(*pair, weight.alias("w"))
    found = across.unionByName(shared).groupBy("cluster_a", "cluster_b").agg(F.sum("w").alias("weight"))
    return found.orderBy(F.desc("weight"), "cluster_a", "cluster_b").limit(most)


def signal(comments: Column, reactions: Column, approvals: Column, reviews: Column, cluster_size: Column, churn: Column, age_days: Column, canonical: Column) -> Column:
    """How much an entity should stand out at a given time."""
    recency = 1 / (1 + F.greatest(age_days, F.lit(0.0)) / 10.0)
    bonus = F.least(F.lit(2.0), F.log1p(F.greatest(churn, F.lit(0))))
    score = 1.0 + 0.35 * comments + 0.20 * reactions + 0.80 * approvals + 0.12 * reviews + 0.42 * cluster_size + recency + bonus
    return score * F.when(canonical, 1.35).otherwise(1.0)


def axis_weight(axis: int, place: Column) -> Column:
    """A fixed pseudo-random weight in [-1, 1) for a place of a vector."""
    return hash28(F.concat(F.lit(f"{axis}:"), place.cast("string"))) / float(1 << 27) - 1


def project(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y: two hash-seeded projections, scaled to [-1, 1] by their bounds."""
    spread = vectors.select(F.col(key).alias("key"), F.posexplode(vector).alias("i", "v"))
    raw = spread.groupBy("key").agg(
        F.sum(F.col("v").cast("double") * axis_weight(0, F.col("i"))).alias("px"), F.sum(F.col("v").cast("double") * axis_weight(1, F.col("i"))).alias("py")
    )
    bounds = raw.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    scaled = lambda v, lo, hi: (F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * 2 - 1
    joined = raw.crossJoin(F.broadcast(bounds))  # one row
    return joined.select("key", scaled("px", "x0", "x1").alias("x"), scaled("py", "y0", "y1").alias("y"))


def reference_edges(entities: DataFrame) -> DataFrame:
    """entity_a, entity_b: references between stored entities of one repository, by issue number."""
    asked = entities.select("repo", "id", F.explode(F.array_union("linked_issues", "soft_linked_issues")).alias("ref"))
    known = entities.select("repo", F.col("id").alias("to"), F.col("number").cast("string").alias("ref"))
    met = asked.join(known, ["repo", "ref"]).where(F.col("id") != F.col("to"))
    return met.select(F.least("id", "to").alias("entity_a"), F.greatest("id", "to").alias("entity_b")).distinct()


def filter_summaries(summaries: DataFrame, least: int, kind: str, most: int) -> DataFrame:
    kept = summaries.where(F.col("size") >= least)
    kept = kept if kind == "all" else kept.where(F.col("cluster_type") == kind)
    return kept.orderBy(F.desc("priority"), F.desc("size"), "cluster_id").limit(most)
