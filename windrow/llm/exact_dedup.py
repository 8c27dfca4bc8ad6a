"""Exact deduplication by skew-safe combining (DataFrame functions only).

Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Three combining steps,
each of which groups by the digest *and* the whole text:

1. locally: the map-side half of the first aggregate leaves one row a text and task;
2. salted: those rows meet by (digest, salt), the salt being the task's number modulo ``salts``, so that one
   text with a third of all rows is spread over ``salts`` reducers;
3. globally: at most ``salts`` winners a text meet by digest.

Members then take their class by the digest, without their text. Where a digest turned out to hold several
texts (the combining sees that, as it compares texts), its members are compared by text instead.

Cases: null or empty texts form one group; of rows that repeat both id and text exactly one stays; a null
doc_id only stays in a group that has no other id; very long texts are compared whole; an empty table gives an empty
result; further columns, whatever their names, are ignored by :func:`classes` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import ascii_lower, id_text
from windrow.session import materialise


def _digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _normalised(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = id_text(docs).select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    return norm.select("doc_id", "norm", digest(F.col("norm")).alias("digest"))


def text_classes(docs: DataFrame, salts: int = 32, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """digest, norm, keep_id, group_size: one row a distinct text."""
    local = _normalised(docs, digest).withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("best"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))


def classes(docs: DataFrame, salts: int = 32, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row a document, dropped ones too."""
    found = text_classes(docs, salts, digest).withColumn("sha", F.sha2("norm", 256))
    by_digest = materialise(
        found.groupBy("digest").agg(
            F.count("*").alias("n_texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
            F.max("sha").alias("sha"),
        ),
        "classes",
    )
    members = _normalised(docs, digest)
    repeats = members.groupBy("digest", "doc_id").agg(F.count("*").alias("times"))
    plain = by_digest.where("n_texts = 1").select("digest", "keep_id", "group_size", "sha")
    joined = repeats.join(plain, "digest").select("doc_id", "keep_id", "group_size", "sha", "times")
    mixed = by_digest.where("n_texts > 1").select("digest")
    if not mixed.isEmpty():
        texts = members.join(mixed, "digest", "left_semi").groupBy("digest", "norm", "doc_id").agg(F.count("*").alias("times"))
        joined = joined.unionByName(
            texts.join(found, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", "sha", "times")
        )
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest doc_id."""
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    tagged = docs.select(F.sha2(norm, 256).alias("digest"), F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    keep = classes(docs, salts).where("kept").select(F.col("text_sha256").alias("sha"), F.col("keep_id").alias("stays"))
    stays = tagged.join(keep, (F.col("digest") == F.col("sha")) & F.col("id").eqNullSafe(F.col("stays")), "left_semi")
    return stays.dropDuplicates(["digest", "id"]).select("row.*")
