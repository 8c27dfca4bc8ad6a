"""Pairs of large tiles: exact in squares of any size, and no join makes a row for each of them."""

import re

import pytest

from tests.llm.test_operators import DOCS, brute_groups, near_rows
from windrow.llm import jaccard_join


@pytest.mark.parametrize("square", [7, 2_000])
def test_large_tiles_meet_in_squares(spark, monkeypatch, square):
    plans, real = {}, jaccard_join.materialise

    def materialise(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(jaccard_join, "materialise", materialise)
    monkeypatch.setattr(jaccard_join, "SMALL_TILE", 4)
    monkeypatch.setattr(jaccard_join, "SQUARE", square, raising=False)
    monkeypatch.setattr(jaccard_join, "EARLY", 2, raising=False)
    rows = near_rows(square)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(spark.createDataFrame(rows, DOCS).repartition(3), 5, 80).collect()}
    assert got == brute_groups(rows, 5, 80)
    assert not re.search(r"Join \[token[^]]*\], \[token[^]]*\], Inner, \(", plans["more"])
