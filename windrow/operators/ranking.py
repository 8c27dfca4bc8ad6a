"""Global places without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.session import materialise


def global_index(df: DataFrame, *order) -> DataFrame:  # noqa: ANN002
    """``df`` with ``index`` from 0 in the given order: a range-partitioned sort, and the counts of its partitions."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    split = sorted_.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND((1 << 33) - 1)}).drop("__m")
    placed = materialise(split, "index")
    before, total = [], 0
    for p, n in sorted((r["__p"], r["count"]) for r in placed.groupBy("__p").count().collect()):  # one row a partition
        before.append((p, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before or [(0, 0)], "__q long, __s long"))
    joined = placed.join(starts, F.col("__p") == F.col("__q"))
    return joined.withColumn("index", F.col("__s") + F.col("__i")).drop("__p", "__i", "__q", "__s")
