"""Pair scores and edge tiers as column expressions over joined fingerprints."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions import text as T
from windrow.operators.sketch import SIMHASH_BITS, minhash_similarity


#: What :func:`possible` reads of a fingerprint: all but vectors, signatures and winnowed hashes.
SLIM = ("patch_ids", "hunk_signatures", "changed_files", "salient", "linked_issues", "soft_linked_issues", "simhash", "additions", "deletions", "signed", "winnows")


def slim(fingerprints: DataFrame) -> DataFrame:
    """``fingerprints`` with a byte of each place of the signature, and whether there are winnowed hashes."""
    signed = F.transform("signature", lambda x: (x % 128).cast("tinyint"))
    return fingerprints.withColumns({"signed": signed, "winnows": F.size("winnow") > 0})


def possible(pairs: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """The pairs whose tier can be other than null: structs a and b hold ``SLIM`` columns. Similarities of vectors, signatures
    and winnowed hashes are taken at their most, and no rule turns a tier to null as they fall or the reverse."""
    a, b = F.col("a"), F.col("b")
    most = {
        "semantic_text": F.lit(1.0), "semantic_diff": F.lit(1.0), "minhash": F.coalesce(minhash_similarity(a["signed"], b["signed"]), F.lit(0.0)),
        "winnow": F.when(a["winnows"] & b["winnows"], 1.0).otherwise(0.0),
    }
    scored = features(pairs, cfg, most).withColumns({"files_a": F.size(a["changed_files"]), "files_b": F.size(b["changed_files"])})
    return scored.where(tier(cfg).isNotNull())


def features(pairs: DataFrame, cfg: dict[str, Any], known: dict[str, Column] | None = None) -> DataFrame:
    """``pairs`` holds structs a and b of fingerprint columns, with the norms of vectors and the salient title words made
    once an entity; adds every feature and the total. ``known`` may give those of vectors, signatures and winnowed hashes."""
    s = cfg["similarity"]
    a, b = F.col("a"), F.col("b")
    shared = F.size(F.array_intersect(a["patch_ids"], b["patch_ids"]))
    lineage = T.jaccard(a["patch_ids"], b["patch_ids"])
    lineage = F.when(shared >= s["lineage_min_shared"], F.greatest(lineage, T.overlap(a["patch_ids"], b["patch_ids"]))).otherwise(lineage)
    sketched = known or {
        "semantic_text": F.greatest(F.lit(0.0), T.scaled(a["text_embedding"], b["text_embedding"], a["text_norm"] * b["text_norm"])),
        "semantic_diff": F.greatest(F.lit(0.0), T.scaled(a["diff_embedding"], b["diff_embedding"], a["diff_norm"] * b["diff_norm"])),
        "minhash": F.coalesce(minhash_similarity(a["signature"], b["signature"]), F.lit(0.0)),
        "winnow": T.jaccard(a["winnow"], b["winnow"]),
    }
    out = pairs.withColumns(sketched | {
        "lineage": lineage,
        "hunk_overlap": T.jaccard(a["hunk_signatures"], b["hunk_signatures"]),
        "file_overlap": T.jaccard(a["changed_files"], b["changed_files"]),
        "title_salient": T.jaccard(a["salient"], b["salient"]),
        "hard_link": F.greatest(T.jaccard(a["linked_issues"], b["linked_issues"]), T.overlap(a["linked_issues"], b["linked_issues"])),
        "soft_link": T.jaccard(a["soft_linked_issues"], b["soft_linked_issues"]),
        "simhash": F.greatest(F.lit(0.0), 1 - F.bit_count(F.coalesce(a["simhash"], F.lit(0)).bitwiseXOR(F.coalesce(b["simhash"], F.lit(0)))) / SIMHASH_BITS),
        "penalty": T.size_penalty(a["additions"] + a["deletions"], b["additions"] + b["deletions"]),
    })
    return totals(out, cfg)


def totals(features: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """Adds structure, semantic and the total, which follow from the other features."""
    s = cfg["similarity"]
    text, diff = s["semantic_text_share"], s["semantic_diff_share"]
    w = s["weights"]
    out = features.withColumns({
        "structure": 0.7 * F.col("hunk_overlap") + 0.3 * F.col("file_overlap"),
        "semantic": (text * F.col("semantic_text") + diff * F.col("semantic_diff")) / max(1e-9, text + diff),
    })
    total = (
        w["lineage"] * F.col("lineage") + w["structure"] * F.col("structure") + w["semantic"] * F.col("semantic")
        + w["minhash"] * F.col("minhash") + w["simhash"] * F.col("simhash") + w["winnow"] * F.col("winnow")
        - w["size_penalty"] * F.col("penalty")
    )
    return out.withColumn("total", total)


def tier(cfg: dict[str, Any]) -> Column:
    """strong, weak or null, from the features, kind_a, kind_b, files_a and files_b; rules in order."""
    s, c = cfg["similarity"], F.col
    both_pr = (c("kind_a") == "pr") & (c("kind_b") == "pr")
    issue_pr = ((c("kind_a") == "issue") & (c("kind_b") == "pr")) | ((c("kind_a") == "pr") & (c("kind_b") == "issue"))
    broad, ps, weak, un, up = s["broad_pr"], s["pr_semantic"], s["weak"], s["unstructured"], s["unstructured_pr"]
    strong, none = F.lit("strong"), F.lit(None).cast("string")
    backed = (c("lineage") > 0) | (c("structure") >= weak["structure"])
    bare = (c("structure") <= 0) & (c("lineage") <= 0)
    structured_or = lambda m: (c("structure") >= weak["structure"]) | (c("semantic") >= m)
    enough = (
        (c("structure") >= weak["structure"]) | (c("semantic") >= weak["semantic"]) | (c("minhash") >= weak["minhash"])
        | (c("simhash") >= weak["simhash"]) | (c("winnow") >= weak["winnow"])
    )
    bare_weak = (
        (both_pr & (c("title_salient") >= up["title"]) & (c("semantic_text") >= up["semantic_text"]) & (c("simhash") >= up["simhash"]))
        | ((c("hard_link") >= s["hard_link_weak"]) & (c("semantic") >= s["hard_link_semantic_weak"]))
        | ((c("soft_link") > 0) & (c("semantic") >= weak["semantic"]))
        | ((c("semantic") >= un["semantic"]) & (c("minhash") >= un["minhash"]) & (c("winnow") >= un["winnow"]))
    )
    most, least = F.greatest("files_a", "files_b"), F.least("files_a", "files_b")
    hard = c("hard_link") >= s["hard_link_strong"]
    return (
        F.when(
            both_pr & (most >= broad["min_files"]) & (least >= broad["pair_min_files"]) & (c("hard_link") <= 0)
            & (c("title_salient") < broad["title"]) & (c("semantic_text") < broad["semantic_text"]), none)
        .when(hard & backed, strong)
        .when(hard & issue_pr & (c("semantic") >= s["hard_link_semantic_issue_pr"]), strong)
        .when(hard & ~issue_pr & (c("semantic") >= s["hard_link_semantic_strong"]), strong)
        .when((c("lineage") >= s["lineage_strong"]) | (c("total") >= s["strong_score"]), strong)
        .when(((c("lineage") > 0) | (c("hunk_overlap") > 0)) & ((c("minhash") >= s["strong_minhash"]) | (c("winnow") >= s["strong_winnow"])), strong)
        .when(both_pr & (c("structure") >= ps["structure"]) & (c("semantic") >= ps["semantic"]) & (c("simhash") >= ps["simhash"]) & (c("title_salient") >= ps["title"]), "weak")
        .when(bare, F.when(bare_weak, "weak"))
        .when((c("hard_link") >= s["hard_link_weak"]) & structured_or(s["hard_link_semantic_weak"]), "weak")
        .when((c("soft_link") > 0) & structured_or(weak["semantic"]), "weak")
        .when((c("total") >= s["min_score"]) & enough, "weak")
    )


def edges(pairs: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """Scored pairs that have a tier."""
    scored = features(pairs, cfg).withColumns({"files_a": F.size(F.col("a")["changed_files"]), "files_b": F.size(F.col("b")["changed_files"])})
    return scored.withColumn("tier", tier(cfg)).where("tier IS NOT NULL")
