"""Balanced label propagation of documents into shards.

Documents of equal texts are linked. Every document starts in the shard its id hashes to; in each round the linked
documents of a group vote by these shards, and the group prefers, of the shards that still have room for all of it, the
one most of them are in. Its members move there as far as the room left by settled groups goes (whole groups are
admitted by a hash that differs from round to round); refused groups wish again, until no group moves. The few that
then fit nowhere go where most room is. Groups
larger than half a shard are first cut by their ids' hashes, each piece moving as a group of its own. Last, exact
quotas: shards above theirs give their last rows, unlinked ones first, to the shards below, so that the law ``rows``
holds: counts are at most one apart. The places in the result are ranks from one distributed sort.

Cases: null and empty texts are equal texts; repeated rows are rows of their own; an empty table gives an empty
result; null ids sort first; very long texts only weigh by their hash; ties of votes go by a hash; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import id_text
from windrow.session import materialise

#: Hash ranges by which groups are admitted to a shard.
BUCKETS = 4_096


def _switch(key: Column, values: list[int]) -> Column:
    """values[key] for a shard column."""
    return F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), (key + 1).cast("int"))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``index``: its place in the global order, from a range-partitioned sort and counts of partitions."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = placed.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m")
    placed = materialise(placed, "ranked")
    sizes = sorted((r["__p"], r["count"]) for r in placed.groupBy("__p").count().collect())  # one row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "__q long, __s long")
    joined = placed.join(F.broadcast(table), F.col("__p") == F.col("__q"))
    return joined.withColumn("index", F.col("__s") + F.col("__i")).drop("__p", "__i", "__q", "__s")


def met(rows: DataFrame, found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows with what ``found`` (keys, k: their rows) says of their keys, or nulls. Keys that hold more than a 1,024th of
    the ``n`` rows, of which there are fewer than 1,024, are broadcast, so that no task takes more rows of one key."""
    heavy = F.broadcast(found.where(F.col("k") > n / 1_024))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(found.where(F.col("k") <= n / 1_024), keys, "left")
    return rows.join(heavy, keys).unionByName(light)


def settle(pieces: DataFrame, quota: list[int]) -> DataFrame:
    """piece, k, to: a shard for each of ``pieces`` (piece, k, votes: rows in all and by present shard).

    A wish goes to shards with a 64th of the largest room or more, so that no shard is asked for more than 64 times the
    number of shards times what it has, and some of BUCKETS hash ranges always fit."""
    room, still, settled, turn = list(quota), pieces, [], 0
    while True:
        fit = (
            F.when(F.col("k") <= r, F.struct(F.col("votes")[s].alias("votes"), F.xxhash64("piece", F.lit(s)).alias("tie"), F.lit(s).alias("to")))
            for s, r in enumerate(room)
            if 64 * r >= max(room)
        )
        bucket = F.pmod(F.xxhash64("piece", F.lit(2 + turn)), F.lit(BUCKETS)).cast("int")
        wish = still.select("piece", "k", "votes", F.array_max(F.array(*fit))["to"].alias("to"), bucket.alias("bucket"))
        wish = materialise(wish, "wish")
        asked = wish.where("to IS NOT NULL").groupBy("to", "bucket").agg(F.sum("k").alias("k"))
        asked = sorted((r["to"], r["bucket"], r["k"]) for r in asked.collect())  # at most BUCKETS rows a shard
        if not asked:
            break
        upto, full = [0] * len(room), set()
        for to, at, k in asked:
            if to not in full and k <= room[to]:
                room[to], upto[to] = room[to] - k, at + 1
            else:
                full.add(to)
        admitted = F.col("to").isNotNull() & (F.col("bucket") < _switch(F.col("to"), upto))
        settled.append(wish.where(admitted).select("piece", "k", "to"))
        still, turn = wish.where(~admitted).select("piece", "k", "votes"), turn + 1
    rest = []
    for r in wish.select("piece", "k").orderBy(F.desc("k"), "piece").collect():  # fewer than shards: each exceeds all room left
        to = room.index(max(room))
        rest.append((r["piece"], r["k"], to))
        room[to] -= r["k"]
    found = pieces.sparkSession.createDataFrame(rest, "piece long, k long, to int")
    for some in settled:
        found = found.unionByName(some)
    return found


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce("text", F.lit(""))
    base = id_text(docs).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    )
    base = materialise(base, "nodes")
    n = base.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    piece = max(1, min(quota) // 2)
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    groups = materialise(base.groupBy("g", "size", "text_crc32").agg(F.count("*").alias("k")).where("k > 1"), "groups")
    keys = ["g", "size", "text_crc32"]
    cut = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("k") / piece))
    tagged = materialise(
        met(base, groups, keys, n).select(
            "doc_id", *keys, F.when(F.col("k").isNotNull(), F.xxhash64(*keys, cut)).alias("piece"), start.alias("shard")
        ),
        "links",
    )
    linked = tagged.where("piece IS NOT NULL").select("doc_id", *keys, "piece", "shard")
    votes = F.array(*(F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)))
    pieces = materialise(linked.groupBy("piece").agg(F.count("*").alias("k"), votes.alias("votes")), "pieces")
    moved = met(linked.drop("shard"), settle(pieces, quota), ["piece"], n)
    linked = materialise(moved.select("doc_id", *keys, "piece", F.col("to").alias("shard")), "labels")
    alone = tagged.where("piece IS NULL").select("doc_id", *keys, "piece", "shard")
    placed = linked.unionByName(alone).withColumn("single", F.col("piece").isNull().cast("int"))
    found = ranked(placed, "shard", "single", "piece", "doc_id", "text_crc32")
    found = materialise(found, "placed")
    have = {r["shard"]: r["count"] for r in found.groupBy("shard").count().collect()}  # one row a shard
    have = [have.get(s, 0) for s in range(shards)]
    first = [sum(have[:s]) for s in range(shards)]
    over = [max(0, have[s] - quota[s]) for s in range(shards)]
    room = [max(0, quota[s] - have[s]) for s in range(shards)]
    over_before = [sum(over[:s]) for s in range(shards)]
    rank = F.col("index") - _switch(F.col("shard"), first)
    spare = rank - _switch(F.col("shard"), quota)
    number = spare + _switch(F.col("shard"), over_before)
    target, begin = F.lit(0), F.lit(0).cast("long")
    for s in range(shards):
        fits = number >= sum(room[:s])
        target = F.when(fits & (number < sum(room[: s + 1])), F.lit(s)).otherwise(target)
        begin = F.when(fits & (number < sum(room[: s + 1])), F.lit(have[s] - sum(room[:s])).cast("long")).otherwise(begin)
    stays = spare < 0
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(stays, F.col("shard")).otherwise(target).cast("int").alias("shard"),
        F.when(stays, rank).otherwise(number + begin).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
