"""What a task of the tally holds at a time."""

import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from windrow.operators import tally


def batches(rows, size, seen):
    for i in range(0, len(rows), size):
        seen.append(i)
        yield pa.record_batch([pa.array([r[c] for r in rows[i : i + size]], pa.int64()) for c in range(3)], ["key", "holder", "w"])


def test_keys_are_listed_as_they_come(monkeypatch):
    monkeypatch.setattr(tally, "ROWS", 50, raising=False)
    rng = random.Random(8)
    rows = [(k, rng.randrange(20), rng.randrange(1, 3) << 8 | k % 2) for k in range(40) for _ in range(rng.choice((1, 2, 9, 200)))]
    rows, want = sorted(rows), []
    for key in range(40):
        times = defaultdict(int)
        for k, h, w in rows:
            if k == key:
                times[h] += w >> 8
        if 1 < len(times) <= (15 if key % 2 else 99):
            want.append(sorted(times.items()))
    seen, got, early = [], [], None
    for batch in tally._grouped({1: 15})(batches(rows, 10, seen)):
        early = len(seen) if early is None else early
        got += [list(zip(m, t, strict=True)) for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    assert got == want
    assert early < len(rows) / 10 / 2


def test_cells_are_bounded_and_right(spark, monkeypatch):
    rng = random.Random(9)
    short = [(k, rng.randrange(400)) for k in range(400) for _ in range(5)]
    long = [(1000 + k, h) for k in range(3) for h in range(400) if rng.random() < 0.9]
    for rows in (short, long):
        held = sorted(set(rows))
        df = spark.createDataFrame([(*x, 256) for x in held], "key long, holder long, w long")
        for name, most in (("ASKS", 60), ("RANGE", 300)):
            monkeypatch.setattr(tally, name, most, raising=False)
        real = tally._cell

        def bounded(ranges, k, real=real):
            run = real(ranges, k)

            def checked(table):
                sizes = [sum(map(len, table.column(c).to_pylist())) for c in ("asks", "others")]
                assert sizes[0] <= 2 * 60 and sizes[1] <= 2 * 300, sizes
                return run(table)

            return checked

        with monkeypatch.context() as m:
            m.setattr(tally, "_cell", bounded)
            got = {r["holder"]: (r["others"], r["votes"], r["best"]) for r in tally.tally(df, {}).collect()}
        by, votes = defaultdict(set), defaultdict(lambda: defaultdict(int))
        for key, h in held:
            by[key].add(h)
        for hs in by.values():
            for a in hs:
                for b in hs - {a}:
                    votes[a][b] += 1
        assert got == {a: (len(v), sum(v.values()), max(v.values())) for a, v in votes.items()}


def test_best_are_right_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(tally, "RANGE", 100)
    df = spark.range(500).select(F.explode(F.array(F.lit(1), F.col("id") % 2 + 2, F.col("id") % 3 + 4)).alias("key"), F.col("id").alias("holder"), F.lit(256).cast("long").alias("w"))
    got = {(r["holder"], r["rank"]): (r["other"], r["votes"]) for r in tally.tally(df, {}, 2).collect()}
    same = {h: [o for o in range(h % 6, 500, 6) if o != h] for h in range(500)}
    assert got == {(h, i + 1): (same[h][i], 3) for h in range(500) for i in range(2)}


def test_cells_of_the_best_hold_few_askers(spark, monkeypatch):
    monkeypatch.setattr(tally, "ASKS", 60, raising=False)
    real = tally._cell

    def bounded(ranges, k):
        run = real(ranges, k)

        def checked(table):
            assert sum(map(len, table.column("asks").to_pylist())) <= 90
            return run(table)

        return checked

    monkeypatch.setattr(tally, "_cell", bounded)
    df = spark.range(900).select((F.col("id") / 3).cast("long").alias("key"), F.col("id").alias("holder"), F.lit(256).cast("long").alias("w"))
    got = {(r["holder"], r["rank"]): (r["other"], r["votes"]) for r in tally.tally(df, {}, 1).collect()}
    assert got == {(h, 1): (h - h % 3 + (h % 3 == 0), 1) for h in range(900)}
