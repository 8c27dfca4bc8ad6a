"""Nearest neighbours on a map against brute force."""

import random

from windrow.operators import nearest


def brute(points, k, distance):
    out = {}
    for key, x, y in points:
        near = sorted((d2, o) for o, ox, oy in points if o != key and (d2 := (x - ox) * (x - ox) + (y - oy) * (y - oy)) <= distance * distance)
        out |= {(key, i + 1): (o, d2) for i, (d2, o) in enumerate(near[:k])}
    return out


def test_nearest_over_tiles_with_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", 40)  # many tiles, so that bounds reach into others
    rng = random.Random(8)
    spots = [(round(rng.gauss(0, 0.3), 2), round(rng.gauss(0, 0.3), 2)) for _ in range(250)]  # a lattice has ties
    spots += [(0.11, -0.2)] * 30 + [(-1.0, 1.0), (1.0, -1.0), (1.7, 1.7), (1.75, 1.7), (0.0, -0.0)]
    points = list(zip(rng.sample(range(10_000), len(spots)), *zip(*spots, strict=True), strict=True))
    df = spark.createDataFrame([*points, (None, 0.1, 0.1), (10_001, None, 0.1), (10_002, float("nan"), 0.1)], "key long, x double, y double")
    for k, distance in ((4, 0.12), (1, 0.05), (9, 0.6)):
        got = {(r["key"], r["rank"]): (r["other"], r["d2"]) for r in nearest.nearest(df, k, distance).collect()}
        assert got == brute(points, k, distance)


def test_one_place_of_many_points_makes_no_pairs(spark):
    df = spark.range(60_000).selectExpr("id AS key", "0.5D AS x", "0.5D AS y")
    got = nearest.nearest(df, 4, 0.12)
    assert got.groupBy("rank").count().collect() and got.count() == 240_000
    assert {(r["rank"], r["other"]) for r in got.where("key = 2").collect()} == {(1, 0), (2, 1), (3, 3), (4, 4)}


def test_no_points(spark):
    assert nearest.nearest(spark.createDataFrame([], "key long, x double, y double"), 4, 0.12).isEmpty()
