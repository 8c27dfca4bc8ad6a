"""Runs whose floor of votes does not hang on how many entities they have."""

import pytest

from windrow import config, engine
from windrow.operators import candidates
from windrow.plans import triage


def met(spark, threshold):
    rows = [("pr:1", ["a"]), ("pr:2", ["a"]), ("pr:3", ["b"])]
    fp = spark.createDataFrame([(i, f, []) for i, f in rows], "entity_id string, files array<string>, issues array<string>")
    ids = spark.createDataFrame([(i, n) for n, (i, _) in enumerate(rows)], "entity_id string, index long")
    cfg = config.merged({"similarity": {"large_run_threshold": threshold}})
    return [tuple(r) for r in candidates.best(fp, {"hard": "issues", "file": "files"}, {}, cfg, ids).collect()]


def test_no_threshold_keeps_pairs_of_one_vote(spark):
    assert met(spark, 3) == []
    assert met(spark, 4) == met(spark, None) == [(0, 1)]


@pytest.mark.parametrize("name", ["c_canonical_rank", "e2e_triage_profile"])
def test_the_query_and_its_sql_have_no_switch(spark, monkeypatch, name):
    seen = []

    def run(rows, cfg, as_of):
        seen.append(cfg["similarity"]["large_run_threshold"])
        raise StopIteration

    monkeypatch.setattr(engine, "run", run)
    with pytest.raises(StopIteration):
        triage.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [None]
    assert f">= {triage.CFG['similarity']['large_run_threshold']} THEN" not in triage.ORACLES[name]
