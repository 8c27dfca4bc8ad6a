"""Queries and SQL of the corpus operators, added to the library's own by __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import exact_dedup, hmm, jaccard_join, langid, mixing, pieces, quality, sharding, token_files, toxicity
from windrow.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.segment(table(spark, sf_dir, "documents"))
    n_best = F.size("scores").cast("long").alias("n_best")
    worst = F.element_at("scores", -1).alias("last_score")
    n_pieces = F.size("ids").cast("long").alias("n_pieces")
    return found.select("doc_id", n_pieces, "score", n_best, worst, "nbest_crc32", "round_trip")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents")))


#: Shares of the domains in the mix.
WEIGHTS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WEIGHTS)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_corpus(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op3_toxicity": op3_toxicity,
        "op2_sentencepiece": op2_sentencepiece,
        "op4_token_files": op4_token_files,
        "op5_mixing": op5_mixing,
        "op6_sharding": op6_sharding,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_language_id": op9_language_id,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8}
