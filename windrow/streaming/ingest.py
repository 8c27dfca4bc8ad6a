"""Incremental ingest: a file stream of entity rows, upserted by batch into versions of a table."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators.store import KEY, latest, upsert_preserving
from windrow.session import materialise, release

COLUMNS = [*KEY, "updated_at", "state", "payload", "n_files", "watermark"]
SCHEMA = "repo string, entity_id string, updated_at timestamp, state string, payload string, n_files int, watermark timestamp"


class VersionedTable:
    """A table in buckets of its keys. A batch writes the next version, which holds only the buckets that it touches; readers
    take of every bucket the last complete version. Versions carry the stream and batch that wrote them, so that a batch
    is never applied twice and a new stream over an old table goes on after the last version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _folders(self, path: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()) if fs.exists(root) else []

    def _complete(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        done = []
        for name in self._folders(self.path):
            mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
            if mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
                done.append(name)
        return done

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def read(self, touched: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: the last version of each."""
        last = {}
        for name in self._complete():
            for folder in self._folders(f"{self.path}/{name}"):
                last[int(folder.partition("=")[2])] = f"{self.path}/{name}/{folder}"
        paths = [p for b, p in sorted(last.items()) if touched is None or b in touched]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "") -> None:
        """Idempotent: a batch of a stream that was written is not written again."""
        done, mark = self._complete(), f"-{zlib.crc32(stream.encode()):08x}-{batch_id}"
        if any(name.endswith(mark) for name in done):
            return
        number = max((int(name[1:10]) for name in done), default=-1) + 1
        fresh = materialise(latest(batch, KEY, "updated_at").withColumn("watermark", F.lit(None).cast("timestamp")).select(*COLUMNS), "batch")
        touched = {r["b"] for r in fresh.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets``
        if touched:
            out = upsert_preserving(self.read(touched), fresh).select(*COLUMNS, self._bucket().alias("bucket"))
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{number:09d}{mark}")
        release(fresh)


def ingest(rows: DataFrame, target: VersionedTable, checkpoint: str) -> None:
    """Run all that is available of a stream of rows, exactly once by batch of its checkpoint."""
    apply = lambda batch, batch_id: target.apply(batch, batch_id, checkpoint)
    query = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
