import datetime as dt
import json

from windrow.operators import store
from windrow.sources import entities
from windrow.streaming.ingest import VersionedTable, ingest

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
ROW = "repo string, entity_id string, updated_at timestamp, state string, payload string, n_files int"


def test_same_revision_without_files_keeps_enrichment(spark):
    old = spark.createDataFrame([("r", "pr:1", T1, "open", "rich", 3, T1), ("r", "pr:2", T1, "open", "rich", 3, T1)], ROW + ", watermark timestamp")
    new = spark.createDataFrame([("r", "pr:1", T1, "open", "light", 0), ("r", "pr:2", T2, "open", "light", 0), ("r", "pr:3", T2, "open", "new", 0)], ROW)
    got = {r["entity_id"]: (r["payload"], r["watermark"]) for r in store.upsert_preserving(old, new).collect()}
    assert got == {"pr:1": ("rich", T1), "pr:2": ("light", None), "pr:3": ("new", None)}


def test_close_unseen_only_touches_open_rows(spark):
    rows = spark.createDataFrame([("r", "pr:1", "open"), ("r", "pr:2", "open"), ("r", "pr:3", "merged")], "repo string, entity_id string, state string")
    seen = spark.createDataFrame([("r", "pr:1"), ("r", "pr:1")], "repo string, entity_id string")
    got = {r["entity_id"]: (r["state"], r["closed_now"]) for r in store.close_unseen(rows, seen).collect()}
    assert got == {"pr:1": ("open", False), "pr:2": ("closed", True), "pr:3": ("merged", False)}


def test_integrity_counts_one_malformed_row(spark):
    rows = [("r", "pr:1", "pr", 1, json.dumps({"kind": "pr", "repo": "r"})), ("r", "issue:2", "pr", 3, json.dumps({"kind": "issue", "repo": "other"}))]
    got = store.integrity(spark.createDataFrame(rows, "repo string, entity_id string, kind string, number int, payload string")).first()
    assert list(got) == [1, 1, 1, 1]


def test_stream_upserts_and_repeats_nothing(spark, tmp_path):
    target = VersionedTable(spark, str(tmp_path / "table"))
    for rows in ([("r", "pr:1", T1, "open", "a", 2)], [("r", "pr:1", T1, "open", "b", 0), ("r", "pr:2", T2, "open", "c", 1)]):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark.readStream.schema(ROW).parquet(str(tmp_path / "in")), target, str(tmp_path / "ck"))
    assert {(r["entity_id"], r["payload"]) for r in target.read().collect()} == {("pr:1", "a"), ("pr:2", "c")}
    before = target._complete()
    ingest(spark.readStream.schema(ROW).parquet(str(tmp_path / "in")), target, str(tmp_path / "ck"))
    assert target._complete() == before
    # A new stream over the same table goes on after the last version, and touches only its own buckets.
    spark.createDataFrame([("r", "pr:3", T2, "open", "d", 1)], ROW).write.parquet(str(tmp_path / "more"))
    ingest(spark.readStream.schema(ROW).parquet(str(tmp_path / "more")), target, str(tmp_path / "ck2"))
    assert {r["entity_id"] for r in target.read().collect()} == {"pr:1", "pr:2", "pr:3"} and len(target._complete()) == len(before) + 1
    assert len(target._folders(f"{target.path}/{target._complete()[-1]}")) == 1


def test_rows_without_a_time_arrive(spark):
    old = spark.createDataFrame([("r", "pr:1", T1, "open", "a", 2, T1)], ROW + ", watermark timestamp")
    new = spark.createDataFrame([("r", "pr:1", None, "closed", "b", 0), ("r", "pr:9", None, "open", "c", 1)], ROW)
    got = {r["entity_id"]: (r["payload"], r["state"], r["n_files"]) for r in store.upsert_preserving(old, new).collect()}
    assert got == {"pr:1": ("b", "closed", 0), "pr:9": ("c", "open", 1)}


def test_nothing_closes_after_a_partial_pass(spark):
    rows = spark.createDataFrame([("r", "pr:1", "open"), ("r", "pr:2", "open")], "repo string, entity_id string, state string")
    seen = rows.where("entity_id = 'pr:1'")
    assert {r["entity_id"] for r in store.close_unseen(rows, seen).where("closed_now").collect()} == {"pr:2"}
    assert store.close_unseen(rows, seen, whole=False).where("closed_now").count() == 0


def test_payloads(spark):
    pull = {"number": 4, "title": "T", "body": "closes #3 and #8", "state": "open", "user": {"login": "b", "type": "Bot"}, "labels": [{"name": "x"}]}
    got = entities.from_pulls(spark.createDataFrame([("r", json.dumps(pull))], "repo string, payload string")).first()
    assert (got["id"], got["linked_issues"], got["soft_linked_issues"], got["is_bot"], got["labels"]) == ("pr:4", ["3"], ["8"], True, ["x"])
    issue = {"number": 5, "title": "I", "body": None, "reactions": {"url": "u", "+1": 2, "heart": 1, "total_count": 3}, "comments": 4}
    mirror = issue | {"pull_request": {"url": "u"}}
    rows = entities.from_issues(spark.createDataFrame([("r", json.dumps(issue)), ("r", json.dumps(mirror))], "repo string, payload string")).collect()
    assert [(r["id"], r["reaction_total"], r["comment_count"], r["body"]) for r in rows] == [("issue:5", 6, 4, "")]


def test_patch_hunks(spark):
    from pyspark.sql import functions as F

    patch = "@@ -1,2 +1,2 @@ def f\n-old\n+new\n same\n--- gone\n@@ -9 +9 @@\n+x"
    got = spark.createDataFrame([(patch,)], "p string").select(entities.parse_patch(F.col("p"), F.lit("a.py")).alias("h")).first()["h"]
    assert [(h["context"], h["added_lines"], h["removed_lines"]) for h in got] == [("def f", ["new"], ["old"]), ("", ["x"], [])]


def test_entity_reader_defaults(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"id": "pr:1", "repo": "r", "kind": "pr", "title": "t", "author": "a"}]))
    got = entities.read_entities(spark, str(tmp_path / "e.json")).first()
    assert (got["state"], got["ci_status"], got["changed_files"], got["is_draft"]) == ("open", "unknown", [], False)
