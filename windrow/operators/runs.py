"""Stored runs: one folder a table and run. A run counts from when its mark is written, which is last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def persist(path: str, run_id: int, **tables: DataFrame) -> None:
    """Write each table's rows of the run, in place of what an earlier try of the same run left; then mark the run."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(name,) for name in tables], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/run_id={run_id}")


def _complete(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/marks").where(F.col("name") == name).select(F.col("run_id").alias("done")).distinct()


def listed(spark: SparkSession, path: str, name: str, most: int = 20) -> DataFrame:
    """run_id, rows of complete runs, newest first; partition values come from the folders."""
    rows = spark.read.parquet(f"{path}/{name}").groupBy("run_id").agg(F.count("*").alias("rows"))
    return rows.join(_complete(spark, path, name), F.col("run_id") == F.col("done"), "left_semi").orderBy(F.desc("run_id")).limit(most)


def latest(spark: SparkSession, path: str, name: str, repo: str | None = None) -> DataFrame:
    """The rows of the newest complete run (of those that hold the repository, if one is given)."""
    rows = spark.read.parquet(f"{path}/{name}")
    held = rows if repo is None else rows.where(F.col("repo") == repo)
    done = held.select("run_id").distinct().join(_complete(spark, path, name), F.col("run_id") == F.col("done"), "left_semi")
    last = done.agg(F.max("run_id").alias("last")).first()["last"]
    return held.where(F.col("run_id") == F.lit(last))


class DryRunSink:
    """Collects what routing would do, labels before comment before queue before close."""

    def __init__(self, known_labels: set[str] | None = None, apply_labels: bool = False) -> None:
        self.known, self.apply_labels = known_labels, apply_labels
        self.actions: list[tuple[str, str, str]] = []

    def apply(self, routing: DataFrame) -> None:
        for r in routing.orderBy("id").toLocalIterator():
            labels = [x for x in r["labels"] if self.known is None or x in self.known] if self.apply_labels else []
            self.actions += [(r["id"], "label", x) for x in labels]
            if r["comment"]:
                self.actions.append((r["id"], "comment", r["comment"]))
            if r["queue_key"]:
                self.actions.append((r["id"], "queue", r["queue_key"]))
            if r["close"]:
                self.actions.append((r["id"], "close", ""))
