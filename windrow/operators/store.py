"""Stored tables: upserts that keep enrichment, closing of unseen rows, caches, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["repo", "entity_id"]


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """One row a key: the one with the largest ``by``; of equal ones, that whose other columns have the largest hash."""
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last(by), F.desc(F.xxhash64(*rows.columns)))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def upsert_preserving(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old payload and watermark stay where the revision is the same, the new row has no files and the old one has;
    else the new row wins and its watermark is empty."""
    o = old.select(*KEY, *(F.col(c).alias(f"o_{c}") for c in ("updated_at", "payload", "n_files", "watermark", "state")))
    n = new.select(*KEY, F.lit(True).alias("arrived"), *(F.col(c).alias(f"n_{c}") for c in ("updated_at", "payload", "n_files", "state")))
    joined = o.join(n, KEY, "full_outer")
    arrived = F.coalesce("arrived", F.lit(False))
    keep = arrived & F.col("o_updated_at").eqNullSafe(F.col("n_updated_at")) & (F.col("n_n_files") == 0) & (F.col("o_n_files") > 0)
    kept = ~arrived | F.coalesce(keep, F.lit(False))
    pick = lambda c: F.when(kept, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c)
    return joined.select(
        *KEY,
        F.when(arrived, F.col("n_updated_at")).otherwise(F.col("o_updated_at")).alias("updated_at"),
        F.when(arrived, F.col("n_state")).otherwise(F.col("o_state")).alias("state"),
        pick("payload"),
        pick("n_files"),
        F.when(kept, F.col("o_watermark")).alias("watermark"),
    )


def close_unseen(rows: DataFrame, seen: DataFrame, whole: bool = True) -> DataFrame:
    """Open rows whose id was not seen are closed; everything else stays. ``whole``: whether the pass that saw the rows was
    complete; after a partial one nothing is closed."""
    if not whole:
        return rows.withColumn("closed_now", F.lit(False))
    marked = rows.join(seen.select(*KEY).distinct().withColumn("__seen", F.lit(True)), KEY, "left")
    closes = (F.col("state") == "open") & F.col("__seen").isNull()
    return marked.withColumns({"state": F.when(closes, "closed").otherwise(F.col("state")), "closed_now": closes}).drop("__seen")


def cache_probe(entities: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``entities`` with hit: the cache has the same revision, input hash and model."""
    known = cache.where(F.col("model_id") == model).select(*KEY, "updated_at", "input_hash", F.lit(True).alias("hit")).distinct()
    return entities.join(known, [*KEY, "updated_at", "input_hash"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def needs_enrichment(entities: DataFrame, marks: DataFrame) -> DataFrame:
    """Entities whose revision was not enriched yet, or that still lack files, checks or mergeability."""
    m = marks.select(*KEY, F.col("watermark").alias("__w"))
    missing = (F.col("n_files") == 0) | (F.col("ci_status") == "unknown") | F.col("mergeable").isNull()
    return entities.join(m, KEY, "left").where(F.col("__w").isNull() | (F.col("__w") != F.col("updated_at")) | missing).drop("__w")


def quality_stats(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """One row of conditional counts over all rows (or those of a kind), zero for an empty table."""
    count = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(name)
    return (rows if kind is None else rows.where(F.col("kind") == kind)).agg(
        F.count("*").alias("total"),
        count(F.coalesce("n_files", F.lit(0)) == 0, "missing_changed_files"),
        count(F.coalesce("n_hunks", F.lit(0)) == 0, "missing_diff_hunks"),
        count(F.coalesce("ci_status", F.lit("unknown")) == "unknown", "ci_unknown"),
        count(F.col("watermark").isNotNull(), "enriched_rows"),
    )


def audit_counts(rows: DataFrame) -> DataFrame:
    """metric, key, n: totals by kind, kind and state, drafts, enrichment level; one pass by grouping sets."""
    cells = F.explode(F.array(
        F.struct(F.lit("total").alias("metric"), F.lit("").alias("key")),
        F.struct(F.lit("kind").alias("metric"), F.col("kind").alias("key")),
        F.struct(F.lit("kind_state").alias("metric"), F.concat_ws("/", "kind", "state").alias("key")),
        F.struct(F.lit("draft").alias("metric"), F.col("is_draft").cast("string").alias("key")),
        F.struct(F.lit("level").alias("metric"), F.coalesce("enrich_level", F.lit("none")).alias("key")),
    )).alias("x")
    return rows.select(cells).groupBy("x.metric", "x.key").agg(F.count("*").alias("n"))


def integrity(rows: DataFrame) -> DataFrame:
    """Four counters of rows that contradict themselves."""
    bad = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("long")), F.lit(0)).alias(name)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return rows.agg(
        bad(~F.lower("entity_id").startswith(F.concat(F.lower("kind"), F.lit(":"))), "kind_id_mismatch"),
        bad(field("kind") != F.col("kind"), "kind_payload_mismatch"),
        bad(field("repo") != F.col("repo"), "repo_payload_mismatch"),
        bad(F.substring_index("entity_id", ":", -1) != F.col("number").cast("string"), "number_id_mismatch"),
    )
