"""The filter, candidates, scores, clusters and ranking, on small rows of our own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from windrow import config
from windrow.operators import candidates, canonical, components, graph, lowpass, sketch

AS_OF = dt.datetime(2024, 7, 1)
ENTITY = (
    "id string, kind string, state string, is_draft boolean, number int, title string, body string, labels array<string>, author string, is_bot boolean, "
    "changed_files array<string>, additions int, deletions int, ci_status string, linked_issues array<string>, soft_linked_issues array<string>, updated_at timestamp"
)
BASE = dict(
    id="pr:1", kind="pr", state="open", is_draft=False, number=1, title="A title", body="A body with several words", labels=[], author="ann", is_bot=False,
    changed_files=["src/a.py"], additions=5, deletions=1, ci_status="pass", linked_issues=[], soft_linked_issues=[], updated_at=AS_OF,
)


def decide(spark, cfg=None, **changes):
    row = BASE | changes
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in ENTITY.split(", "))], ENTITY)
    out = lowpass.apply(df, config.merged({"low_pass": cfg or {}}), F.lit(AS_OF)).first()
    return out["filter_state"], list(out["reason_codes"]), out["priority_weight"]


@pytest.mark.parametrize(
    ("cfg", "changes", "want"),
    [
        ({}, {}, ("pass", [], 1.0)),
        ({}, {"state": "CLOSED"}, ("skip", ["CLOSED_STATE"], 0.0)),
        ({}, {"is_draft": True}, ("skip", ["DRAFT_PR"], 0.0)),
        ({}, {"labels": ["WontFix"]}, ("skip", ["HARD_SKIP_LABEL"], 0.0)),
        ({}, {"updated_at": AS_OF - dt.timedelta(days=91)}, ("skip", ["STALE"], 0.0)),
        ({"stale_action": "suppress"}, {"updated_at": AS_OF - dt.timedelta(days=91)}, ("skip", ["STALE"], 0.0)),
        ({"ignore_recent_pr_hours": 5}, {}, ("suppress", ["RECENT_PR"], 1.0)),
        ({}, {"kind": "issue", "id": "issue:1", "body": ""}, ("suppress", ["ISSUE_ONE_LINER"], 0.0)),
        ({}, {"kind": "issue", "id": "issue:1", "body": "## Summary\n1.\n2.\nfew words\nhere"}, ("pass", [], 1.0)),
        ({"pr_min_body_tokens": 9}, {}, ("suppress", ["PR_MISSING_CONTEXT"], 0.0)),
        ({}, {"additions": 5001}, ("skip", ["PR_LARGE_CHANGESET"], 0.0)),
        ({}, {"labels": ["Question"]}, ("suppress", ["SOFT_SUPPRESS_LABEL"], 1.0)),
        ({}, {"changed_files": ["docs/x.py", "a.md"], "ci_status": "unknown"}, ("suppress", ["LOW_SIGNAL_DOCS_ONLY"], 1.0)),
        ({}, {"labels": ["security", "question"]}, ("suppress", ["SOFT_SUPPRESS_LABEL", "BOOST_SECURITY"], 1.5)),
        ({"suppress_bot_authors": True}, {"author": "dep[bot]"}, ("suppress", ["BOT_SUPPRESSED"], 1.0)),
    ],
)
def test_filter(spark, cfg, changes, want):
    assert decide(spark, cfg, **changes) == want


def test_unknown_setting_is_an_error():
    with pytest.raises(KeyError):
        config.merged({"low_pass": {"nope": 1}})


def test_votes_count_repeats_of_the_asking_side(spark):
    fp = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["x"])], "entity_id string, files array<string>")
    got = {(r["entity_id"], r["other"]): r["votes"] for r in candidates.votes(candidates.keys(fp, {"file": "files"})).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 1}


def test_hot_keys_and_mandatory_links(spark):
    rows = spark.createDataFrame([(f"e{i}", "file", "hot", 1) for i in range(6)] + [("e0", "hard", "7", 1), ("e5", "hard", "7", 1)], "entity_id string, kind string, key string, times long")
    kept = candidates.without_hot(rows, {"file": 5})
    cfg = config.merged({"similarity": {"top_k": 1, "large_run_threshold": 1, "min_votes_large": 9}})
    got = {(r["entity_id"], r["other"]) for r in candidates.top_candidates(candidates.votes(kept), cfg, 10).collect()}
    assert got == {("e0", "e5"), ("e5", "e0")}


def test_minhash_of_equal_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "")], "k long, t string")
    got = {r["key"]: r["signature"] for r in sketch.minhash(df, "k", F.filter(F.split("t", " "), lambda x: x != ""), 2, 8).collect()}
    assert got[1] == got[2] != got[3] == [0] * 8


def test_components_of_a_path_a_cycle_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7), (500, 500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[500] == 500


EDGE = "entity_a string, entity_b string, tier string, total double, hard_link double, lineage double, hunk_overlap double, file_overlap double, title_salient double, semantic_text double"


def edge(a, b, tier, total=0.5, hard=0.0, lineage=0.0, title=0.0, text=0.0):
    return (a, b, tier, total, hard, lineage, 0.0, 0.0, title, text)


def merged(spark, *edges):
    return {(r[0], r[1]) for r in graph.merge_edges(spark.createDataFrame(list(edges), EDGE)).collect()}


def test_weak_chain_stays_split_and_weak_pair_merges(spark):
    assert merged(spark, edge("a", "b", "weak"), edge("b", "c", "weak")) == set()
    assert merged(spark, edge("a", "b", "weak")) == {("a", "b")}


def test_weak_edge_with_common_strong_neighbour_merges(spark):
    assert ("a", "b") in merged(spark, edge("a", "b", "weak"), edge("a", "c", "strong"), edge("b", "c", "strong"))


def test_tail_is_pruned_unless_firm(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    cfg = config.merged()
    for hard, alone in ((0.0, True), (0.5, False)):
        edges = spark.createDataFrame([edge("a", "b", "strong", 0.9, lineage=0.6), edge("b", "c", "strong", 0.1, hard=hard)], EDGE)
        got = {r["node"]: r["component"] for r in graph.clusters(nodes, edges, cfg).collect()}
        assert (got["c"] == "c") is alone and got["a"] == got["b"]


def test_classes(spark):
    grouped = spark.createDataFrame([("pr:1", "x"), ("issue:1", "x"), ("pr:2", "y"), ("pr:3", "y"), ("pr:9", "z")], "node string, component string")
    edges = spark.createDataFrame([edge("issue:1", "pr:1", "strong", hard=0.5)], EDGE)
    got = {r["component"]: r["cluster_type"] for r in graph.classify(grouped, edges).collect()}
    assert got == {"x": "linked_pair", "y": "duplicate_candidate", "z": "singleton_orphan"}


def test_ranking_states(spark):
    scored = spark.createDataFrame([("c", "pr:1", "pr", 5.0), ("c", "pr:2", "pr", 4.98), ("c", "pr:3", "pr", 1.0)], "cluster_id string, entity_id string, lane string, rank_score double")
    edges = spark.createDataFrame([edge("pr:1", "pr:2", "strong", 0.3, hard=0.5), edge("pr:1", "pr:3", "strong", 0.9, hard=0.6, title=0.9)], EDGE)
    got = {r["entity_id"]: (r["state"], r["duplicate_of"]) for r in canonical.rank(scored, edges, config.merged()).collect()}
    assert got == {"pr:1": ("canonical", None), "pr:2": ("related_non_duplicate", None), "pr:3": ("duplicate_of", "pr:1")} or got["pr:2"][0] == "needs_human_tie_break"
    assert got["pr:3"] == ("duplicate_of", "pr:1")


def test_title_mismatch_vetoes(spark):
    scored = spark.createDataFrame([("c", "pr:1", "pr", 5.0), ("c", "pr:2", "pr", 1.0)], "cluster_id string, entity_id string, lane string, rank_score double")
    row = ("pr:1", "pr:2", "strong", 0.9, 0.5, 0.0, 0.9, 1.0, 0.0, 0.1)
    got = {r["entity_id"]: r["state"] for r in canonical.rank(scored, spark.createDataFrame([row], EDGE), config.merged()).collect()}
    assert got["pr:2"] == "related_non_duplicate"
