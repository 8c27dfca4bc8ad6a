"""Votes of entities for each other by shared keys, without a row for every two holders of a key.

The pairs of an inverted index grow with the square of a key's holders; here they are only counted, inside a task. Holders
are numbers. Each key becomes one list of its holders; a cell takes a block of asking entities and a range of the others,
and of each list the members in both. It counts an entity's votes and returns the best of them, or their sums. How many members
a cell holds is bounded, whatever the input: many blocks where lists are short, ranges where they are long. Cells run in
passes, so that no more than ``PASS_BYTES`` of lists, or twice those of the keys, lie on disk at a time. Keys are 64-bit
numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.session import materialise, release

PASS_BYTES = 400_000_000
#: Rows grouped by key at once, expansions counted at once, and of a cell the asking members, the others and the expansions.
ROWS, BATCH, ASKS, RANGE, WORK = 500_000, 1_000_000, 500_000, 4_000_000, 200_000_000


def hashed(kind: str, key: Column) -> Column:
    """A negative number for a key of a kind; winnowed hashes, which are not negative, stand for themselves."""
    return -F.xxhash64(F.lit(kind), key).bitwiseAND((1 << 63) - 1) - 1


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _grouped(caps: dict[int, int]):  # noqa: ANN202
    """Rows sorted by key and holder -> lists; no more than ``ROWS`` rows, or twice the longest list, are in hand."""
    most = np.full(256, np.iinfo(np.int64).max)
    for k, cap in caps.items():
        most[k] = cap

    def lists(key: np.ndarray, holder: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = _runs(key)
        held = np.diff(np.append(starts, len(key)))
        keep = (held > 1) & (held <= most[w[starts] & 255])
        take = np.repeat(keep, held)
        at = np.concatenate([[0], np.cumsum(held[keep])])
        out = [pa.LargeListArray.from_arrays(pa.array(at), pa.array(x[take])) for x in (holder, w >> 8)]
        for i in range(0, int(keep.sum()), 20_000):
            yield pa.record_batch([x.slice(i, 20_000).cast(pa.list_(pa.int64())) for x in out], ["members", "times"])

    def once(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each holder of a key once, with the sum of its times."""
        key, holder, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        one = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (holder[1:] != holder[:-1])]))
        return key[one], holder[one], (np.add.reduceat(w >> 8, one) << 8) | (w[one] & 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, limit = [], 0, ROWS
        for batch in batches:
            if batch.num_rows:
                parts.append([batch.column(c).to_numpy() for c in range(3)])
                n += batch.num_rows
            if n < limit:
                continue
            rows = once(parts)
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from lists(*(x[:last] for x in rows))
            # The last key may go on. Over its cap it is dropped, so one holder more than that says as much as all.
            upto = last + min(len(rows[0]), int(most[rows[2][-1] & 255]) + 1)
            parts = [[x[last:upto].copy() for x in rows]]
            n = len(parts[0][0])
            limit = max(ROWS, 2 * n)
        if n:
            yield from lists(*once(parts))

    return run


def postings(rows: DataFrame, caps: dict[int, int]) -> DataFrame:
    """rows: key, holder, w (times the holder has it, above eight bits of the kind) -> members, times of each key that two or
    more hold and no more than the cap of its kind."""
    dealt = rows.select("key", "holder", "w").repartition("key").sortWithinPartitions("key", "holder")
    return dealt.mapInArrow(_grouped(caps), "members array<long>, times array<long>")


def _gather(at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of the picked lists, and how many each has."""
    n = at[pick + 1] - at[pick]
    ends = np.cumsum(n)
    return np.repeat(at[pick] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), n


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.ListArray, pa.ListArray]]:
    """Members and times of lists that hold ``BATCH`` members together, or of one longer list."""
    at, a = batch.column(0).offsets.to_numpy(), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, int(at[a]) + BATCH, side="right")) - 1)
        yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
        a = b


def _dealt(blocks: int, ranges: int, low: int, high: int):  # noqa: ANN202
    """Lists -> cell, asking members of it and how often each has the key, and the others of it, for blocks low to high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, times in (x for batch in batches for x in _slices(batch)):
            at = members.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            m, t = members.flatten().to_numpy(), times.flatten().to_numpy()
            owner, block = np.repeat(np.arange(len(at) - 1), np.diff(at)), m % blocks
            for j in range(ranges):
                right, right_at = m, at
                if ranges > 1:
                    here = m % ranges == j
                    right = m[here]
                    right_at = np.concatenate([[0], np.cumsum(np.bincount(owner[here], minlength=len(at) - 1))])
                pick = np.flatnonzero((block >= low) & (block < high))
                pick = pick[np.lexsort((block[pick], owner[pick]))]
                starts = _runs(owner[pick] * blocks + block[pick])
                ends = np.append(starts[1:], len(pick))
                lists = owner[pick][starts]
                total = np.cumsum(right_at[lists + 1] - right_at[lists]) if len(lists) else np.zeros(0, np.int64)
                a = 0
                while a < len(lists):
                    done = total[a - 1] if a else 0
                    b = max(a + 1, int(np.searchsorted(total, done + BATCH, side="right")))
                    places, n = _gather(right_at, lists[a:b])
                    own = pick[starts[a] : ends[b - 1]]
                    left_at = np.append(starts[a:b], ends[b - 1]) - starts[a]
                    many = lambda x, v: pa.ListArray.from_arrays(pa.array(x, pa.int32()), pa.array(v))
                    yield pa.record_batch(
                        [pa.array(block[pick][starts[a:b]] * ranges + j), many(left_at, m[own]), many(left_at, t[own]), many(np.concatenate([[0], np.cumsum(n)]), right[places])],
                        ["cell", "asks", "times", "others"],
                    )
                    a = b

    return run


def _cell(ranges: int, k: int | None):  # noqa: ANN202
    def reduced(who: np.ndarray, other: np.ndarray, votes: np.ndarray) -> list[np.ndarray]:
        """Rows sorted by who -> the best k of each, or how many, the sum and the best."""
        if k is None:
            starts = _runs(who)
            return [who[starts], np.diff(np.append(starts, len(who))), np.add.reduceat(votes, starts), np.maximum.reduceat(votes, starts)] if len(who) else [who, who, who, who]
        order = np.lexsort((other, -votes, who))
        who, other, votes = who[order], other[order], votes[order]
        starts = _runs(who)
        place = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
        return [x[place < k] for x in (who, other, votes)]

    def run(table: pa.Table) -> pa.Table:
        asks, times, others = (table.column(c).combine_chunks() for c in ("asks", "times", "others"))
        flat = lambda x: (x.flatten().to_numpy(), x.offsets.to_numpy().astype(np.int64))
        (who, at), (t, _), (right, right_at) = flat(asks), flat(times), flat(others)
        right_at = right_at - right_at[0]
        lists = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.argsort(who, kind="stable")
        who, t, lists = who[order], t[order], lists[order]
        starts = _runs(who)
        ends = np.append(starts[1:], len(who))
        total = np.cumsum(right_at[lists + 1] - right_at[lists])
        upto = total[ends - 1] if len(ends) else total
        width, found, i = int(right.max()) // ranges + 1 if len(right) else 1, [], 0
        short = right // ranges
        shift = int(right[0] % ranges) if len(right) else 0
        while i < len(starts):
            before = upto[i - 1] if i else 0
            first = upto[i] - before
            if first > 4_000 and first * 8 > width:  # dense: one counter for each other
                own = slice(starts[i], ends[i])
                votes = np.zeros(width, np.int64)
                for times_ in np.unique(t[own]):
                    mine = lists[own][t[own] == times_]
                    ends_ = np.cumsum(right_at[mine + 1] - right_at[mine])
                    for part in np.split(mine, _runs(ends_ // BATCH)[1:]):
                        places, _ = _gather(right_at, part)
                        votes += times_ * np.bincount(short[places], minlength=width)
                other = np.flatnonzero(votes)
                votes, other = votes[other], other * ranges + shift
                keep = other != who[starts[i]]
                votes, other = votes[keep], other[keep]
                if k is not None and len(votes) > 4 * k:
                    keep = votes >= np.partition(votes, len(votes) - k)[len(votes) - k]
                    votes, other = votes[keep], other[keep]
                found.append(reduced(np.full(len(other), who[starts[i]]), other, votes))
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(upto, before + BATCH, side="right")))
            own = slice(starts[i], ends[j - 1])
            places, n = _gather(right_at, lists[own])
            number = np.repeat(np.arange(j - i), ends[i:j] - starts[i:j])
            code, w = np.repeat(number, n) * width + short[places], np.repeat(t[own], n)
            by = np.argsort(code, kind="stable")
            code, w = code[by], w[by]
            one = _runs(code)
            votes = np.add.reduceat(w, one) if len(one) else w
            asker, other = who[starts[i:j]][code[one] // width], code[one] % width * ranges + shift
            keep = asker != other
            found.append(reduced(asker[keep], other[keep], votes[keep]))
            i = j
        names = ["holder", "others", "votes", "best"] if k is None else ["holder", "other", "votes"]
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64) for _ in names], names)

    return run


def _shape(sizes: list[tuple[int, int, float]], cores: int) -> tuple[int, int, float]:
    """Blocks and ranges, and the members that all cells take together. sizes: of classes of lists of like length, how many
    lists, their members and the sum of the squares of their lengths."""
    n, work = sum(x[1] for x in sizes), sum(x[2] for x in sizes)
    best = None
    for i in range(16):
        blocks = max(2 * cores, -(-n // ASKS)) << i
        others = sum(min(float(m), squares / blocks) for _, m, squares in sizes)  # of a cell, were there one range
        ranges = max(1, math.ceil(others / RANGE), math.ceil(work / blocks / WORK))
        moved = blocks * others + 6.0 * ranges * sum(min(lists * blocks, m) for lists, m, _ in sizes)  # six more words a row
        if best is None or moved < best[0]:
            best = moved, blocks, ranges, blocks * others
    return best[1:]


def tally(rows: DataFrame, caps: dict[int, int], k: int | None = None) -> DataFrame:
    """Of the votes that each holder gives: holder, other, votes, rank of the best k (ties: the smaller number first), or
    holder, others, votes, best where k is None."""
    lists = materialise(postings(rows, caps), "postings")
    held = F.size("members").cast("long")
    classes = lists.groupBy(F.floor(F.log2(held)).alias("c")).agg(F.count("*").alias("lists"), F.sum(held).alias("n"), F.sum(held.cast("double") ** 2).alias("work"))
    sizes = [(r["lists"], r["n"], r["work"]) for r in classes.collect()]  # a row for each power of two
    blocks, ranges, moved = _shape(sizes, rows.sparkSession.sparkContext.defaultParallelism)
    at_once = max(1, int(blocks * max(PASS_BYTES, 8 * sum(x[1] for x in sizes)) / max(1.0, 4.0 * moved)))
    out = None
    names = "others long, votes long, best long" if k is None else "other long, votes long"
    for low in range(0, blocks, at_once):
        dealt = lists.mapInArrow(_dealt(blocks, ranges, low, min(blocks, low + at_once)), "cell long, asks array<long>, times array<long>, others array<long>")
        done = materialise(dealt.groupBy("cell").applyInArrow(_cell(ranges, k), f"holder long, {names}"), "votes")
        out = done if out is None else out.unionByName(done)
    release(lists)
    if k is None:
        return out.groupBy("holder").agg(F.sum("others").alias("others"), F.sum("votes").alias("votes"), F.max("best").alias("best"))
    order = Window.partitionBy("holder").orderBy(F.desc("votes"), "other")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
