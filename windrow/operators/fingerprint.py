"""Fingerprints of entities: tokens, modules, hunk signatures, links, hashed embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.text import kind_of, lines, module_bucket, tokens
from windrow.operators.lowpass import content_lines


def token_body(kind: Column, body: Column) -> Column:
    """Issue bodies lose empty and template lines before they are cut into tokens."""
    return F.when(kind == "issue", F.array_join(content_lines(body), "\n")).otherwise(F.coalesce(body, F.lit("")))


def hunk_material(hunk: Column) -> Column:
    """file | context | first 64 added tokens | first 64 removed tokens."""
    part = lambda xs: F.array_join(F.slice(tokens(F.array_join(xs, "\n")), 1, 64), " ")
    return F.concat_ws("|", hunk["file_path"], hunk["context"], part(hunk["added_lines"]), part(hunk["removed_lines"]))


def hunk_signatures(hunks: Column) -> Column:
    """160-bit digests, in the order of the hunks."""
    return F.transform(hunks, lambda h: F.sha1(hunk_material(h)))


def diff_text(files: Column, hunks: Column, most_hunks: int = 200, most_lines: int = 10) -> Column:
    """The text that stands for a diff in an embedding: a line of files and a line of hunks, each only where there are any."""

    def one(h: Column) -> Column:
        part = lambda xs: F.array_join(F.slice(xs, 1, most_lines), " ")
        return F.concat_ws(" ", h["file_path"], F.coalesce(h["context"], F.lit("")), part(h["added_lines"]), part(h["removed_lines"]))

    body = F.array_join(F.transform(F.slice(hunks, 1, most_hunks), one), " ")
    return F.concat_ws(
        "\n",
        F.when(F.size(files) > 0, F.concat(F.lit("files:"), F.array_join(files, " "))),
        F.when(F.size(hunks) > 0, F.concat(F.lit("hunks:"), body)),
    )


def material_tokens() -> Column:
    """What sketches are made of: tokens, links of both kinds and hunk signatures, in lower case."""
    every = F.concat("tokens", "linked_issues", "soft_linked_issues", "hunk_signatures")
    return F.filter(F.transform(every, F.lower), lambda x: x != "")


def own_links(kind: Column, number: Column, links: Column) -> Column:
    """Links in string order; an issue also links its own number."""
    own = F.when((kind == "issue") & number.isNotNull(), F.array(number.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(links, own))


def assemble(entities: DataFrame, *more: Column) -> DataFrame:
    """One fingerprint row an entity, with ``more`` columns made of the entity."""
    hunks = F.col("diff_hunks") if "diff_hunks" in entities.columns else None
    scores = F.col("review_scores") if "review_scores" in entities.columns else F.array().cast("array<double>")
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda t, x: t + x) / F.size(scores)).otherwise(0.0)
    both = F.concat_ws("\n", "title", token_body(F.col("kind"), F.col("body")))
    none = F.array().cast("array<string>")
    return entities.select(
        F.col("id").alias("entity_id"),
        kind_of(F.col("id")).alias("lane"),
        tokens(F.col("title")).alias("title_tokens"),
        tokens(both).alias("tokens"),
        F.array_sort(F.array_distinct(F.transform("changed_files", module_bucket))).alias("module_buckets"),
        F.col("changed_files"),
        (hunk_signatures(hunks) if hunks is not None else none).alias("hunk_signatures"),
        own_links(F.col("kind"), F.col("number"), F.col("linked_issues")).alias("linked_issues"),
        F.array_sort(F.col("soft_linked_issues")).alias("soft_linked_issues"),
        (F.col("patch_ids") if "patch_ids" in entities.columns else none).alias("patch_ids"),
        "additions",
        "deletions",
        "ci_status",
        "approvals",
        mean.alias("reviewer_score"),
        *more,
    )


def hash_embedding(df: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """key, idx, value: signed token counts in hashed places, to unit length; zero vectors have no rows.

    The text is lower-cased before it is cut. The place is the first 8 hex digits of sha256 modulo ``dims``, the sign
    negative when its last digit is odd."""
    words = df.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))).alias("w"))
    counted = words.groupBy("key", "w").agg(F.count("*").alias("n"))
    hashed = counted.select("key", "n", F.sha2("w", 256).alias("h"))
    sign = F.when(F.conv(F.right("h", F.lit(1)), 16, 10).cast("int") % 2 == 1, -1).otherwise(1)
    idx = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int")
    parts = hashed.select("key", idx.alias("idx"), (sign * F.col("n")).alias("v")).groupBy("key", "idx").agg(F.sum("v").alias("v"))
    length = parts.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length")).where("length > 0")
    return parts.join(length, "key").where("v <> 0").select("key", "idx", (F.col("v") / F.col("length")).alias("value"))


def input_hash(*columns: str) -> Column:
    """Digest of the fields that a cached fingerprint depends on."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


__all__ = ["assemble", "diff_text", "hash_embedding", "hunk_signatures", "input_hash", "lines", "material_tokens", "own_links", "token_body"]
