"""The corpus pipeline: language, exact copies, near copies, mix and pieces, each stage on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one.
Stages handle nulls in any column, empty and very long texts, repeated rows, empty tables and further columns as the
operators they call define; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windrow.llm import exact_dedup, jaccard_join, langid, mixing, pieces
from windrow.session import materialise, table

#: Shares of the domains in the mix; clean documents come in whole.
WEIGHTS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is unknown: without letters, or with a score below 0.4."""
    return langid.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of five-word shingles keep the document with the smallest doc_id."""
    return jaccard_join.drop_near(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin the domains to their shares; documents likelier clean than not all stay."""
    return mixing.thin(docs, table(spark, sf_dir, "labels"), WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with the scores of its best segmentations and whether all decode to the text."""
    return pieces.segment(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Learned models decide in it, which SQL cannot express; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
