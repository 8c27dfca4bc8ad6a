"""One run end to end, hooks, runs, sinks, the paged source."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from windrow import config, engine
from windrow.hooks import Hooks
from windrow.operators import runs
from windrow.sources.paged import PagedReader

AS_OF = dt.datetime(2024, 7, 1)
COLUMNS = (
    "id string, repo string, kind string, state string, is_draft boolean, number int, title string, body string, labels array<string>, author string, "
    "is_bot boolean, changed_files array<string>, additions int, deletions int, ci_status string, approvals int, linked_issues array<string>, "
    "soft_linked_issues array<string>, patch_ids array<string>, updated_at timestamp"
)


def row(id_, title, files=(), ci="unknown", hard=(), soft=(), patches=(), state="open", approvals=0):
    kind, number = id_.split(":")
    body = f"{title} with a body of enough words to pass as a real description of the work and its reasons"
    return (id_, "r", kind, state, False, int(number), title, body, [], "ann", False, list(files), 10, 2, ci, approvals, list(hard), list(soft), list(patches), AS_OF)


@pytest.fixture(scope="module")
def report(spark):
    rows = [
        row("pr:1", "Cache retries in worker", ["src/cache.py"], "pass", patches=["c1", "c2"], approvals=2),
        row("pr:2", "Cache retries in worker", ["src/cache.py"], "fail", patches=["c1", "c2"]),
        row("pr:3", "Unrelated docs page", ["web/page.html"], "pass"),
        row("issue:9", "Crash on startup of scheduler"),
        row("pr:4", "Crash on startup of scheduler", ["src/sched.py"], "pass", hard=["9"]),
        row("issue:10", "Old report", soft=["9"], state="closed"),
    ]
    hooks, seen = Hooks(), []
    hooks.add("after_low_pass", lambda df: seen.append("low_pass"))
    hooks.add("after_similarity", lambda df: df.where("entity_a <> 'nobody'"))
    out = engine.run(spark.createDataFrame(rows, COLUMNS), config.merged({"embedding": {"dims": 32}}), F.lit(AS_OF), hooks)
    assert seen == ["low_pass"]
    return out


def test_run(report):
    cluster = {r["entity_id"]: r["cluster_id"] for r in report.clusters.collect()}
    assert cluster["pr:1"] == cluster["pr:2"] != cluster["pr:3"] and cluster["issue:9"] == cluster["pr:4"]
    state = {r["entity_id"]: r["state"] for r in report.decisions.collect()}
    assert state["pr:1"] == "canonical" and state["pr:3"] == "canonical"
    types = {r["cluster_id"]: r["cluster_type"] for r in report.types.collect()}
    assert types[cluster["pr:4"]] == "linked_pair" and types[cluster["pr:3"]] == "singleton_orphan"
    assert {r["id"]: r["cluster_id"] for r in report.shadows.collect()} == {"issue:10": cluster["issue:9"]}
    routed = {r["id"]: r["labels"] for r in report.routing.collect()}
    assert routed["issue:10"] == ["triage/noise-suppressed", "triage/quarantine"] and "triage/linked-pair" in routed["pr:4"]


def test_sink_and_stored_runs(report, spark, tmp_path):
    sink = runs.DryRunSink({"triage/quarantine"}, apply_labels=True)
    sink.apply(report.routing)
    assert ("issue:10", "label", "triage/quarantine") in sink.actions and ("issue:10", "queue", "quarantine") in sink.actions
    assert not [a for a in sink.actions if a[1] == "close"]
    for run_id in (1, 2):
        runs.persist(str(tmp_path), run_id, routing=report.routing)
    assert [r["run_id"] for r in runs.listed(spark, str(tmp_path), "routing").collect()] == [2, 1]
    assert runs.latest(spark, str(tmp_path), "routing").count() == 6
    runs.persist(str(tmp_path), 2, routing=report.routing)  # a repeat takes the place of the first try
    report.routing.write.parquet(f"{tmp_path}/routing/run_id=3")  # a run that was not completed does not answer
    got = runs.latest(spark, str(tmp_path), "routing")
    assert got.count() == 6 and got.first()["run_id"] == 2


def pages(url, page):
    return [{"n": page}] if page < 4 else []


def test_paged_reader_stops_at_an_empty_raw_page():
    reader = PagedReader({"fetch": "tests.test_engine:pages", "pages": "6", "per_task": "3", "repo": "r"})
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert [r[1] for r in rows] == [1, 2, 3]


def test_unknown_hook():
    with pytest.raises(KeyError):
        Hooks().add("nowhere", print)
