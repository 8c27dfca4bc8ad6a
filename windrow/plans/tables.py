"""Stores, audits, reports, serving and streaming over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.operators import nearest, reports, serving, store
from windrow.plans.adapters import ENTITIES, entities
from windrow.session import materialise, shared_dir, table
from windrow.streaming.ingest import VersionedTable, ingest


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as revisions of rows, one a user and type: the first half of the month is stored, the second arrives.

    Stored rows with an even k arrive again as they are, without files."""
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("repo"), F.concat(F.lit("pr:"), F.col("user_id").cast("string")).alias("entity_id"), F.col("ts").cast("timestamp").alias("updated_at"),
        F.when(F.col("event_id") % 4 == 0, "closed").otherwise("open").alias("state"), F.col("props").alias("payload"),
        F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"), "event_id",
    )
    rows = rows.withColumn("n_files", F.col("k") % 3)
    old = _last(rows.where("updated_at < '2024-01-16'")).withColumn("watermark", F.col("updated_at"))
    again = old.where("k % 2 = 0").select("repo", "entity_id", "updated_at", "state", F.lit('{"k": -1}').alias("payload"), F.lit(0).alias("n_files"))
    new = _last(rows.where("updated_at >= '2024-01-16'")).select(*again.columns)
    new = new.join(again, store.KEY, "left_anti").unionByName(again)
    return old, new


def _last(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*store.KEY).orderBy(F.desc("updated_at"), F.desc("event_id"))
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def k_upsert_preserve(spark: SparkSession, d: str) -> DataFrame:
    old, new = _stored(spark, d)
    enriched = F.col("watermark").isNotNull().alias("enriched")
    return store.upsert_preserving(old, new).select(*store.KEY, "state", "payload", F.col("n_files").cast("long").alias("n_files"), enriched)


_STORED = """WITH e AS (SELECT event_type AS repo, 'pr:' || user_id AS entity_id, ts AS updated_at, CASE WHEN event_id % 4 = 0 THEN 'closed' ELSE 'open' END AS state, props AS payload,
  coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS k, event_id FROM events),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, entity_id ORDER BY updated_at DESC, event_id DESC) AS r FROM e WHERE updated_at < TIMESTAMP '2024-01-16') WHERE r = 1),
g AS (SELECT repo, entity_id, updated_at, state, '{"k": -1}' AS payload, 0 AS n_files FROM o WHERE k % 2 = 0),
m AS (SELECT repo, entity_id, updated_at, state, payload, k % 3 AS n_files FROM
  (SELECT *, row_number() OVER (PARTITION BY repo, entity_id ORDER BY updated_at DESC, event_id DESC) AS r FROM e WHERE updated_at >= TIMESTAMP '2024-01-16') WHERE r = 1),
n AS (SELECT * FROM g UNION ALL SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.repo = m.repo AND g.entity_id = m.entity_id)),
j AS (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(n.state, o.state) AS state, n.updated_at IS NULL
  OR (o.updated_at = n.updated_at AND n.n_files = 0 AND o.k % 3 > 0) AS keep, o.payload AS op, n.payload AS np, o.k % 3 AS of, n.n_files AS nf, o.updated_at AS ow
  FROM o FULL JOIN n ON o.repo = n.repo AND o.entity_id = n.entity_id)
"""
K_UPSERT = _STORED + """SELECT repo, entity_id, state, CASE WHEN coalesce(keep, false) THEN op ELSE np END AS payload,
CAST(CASE WHEN coalesce(keep, false) THEN of ELSE nf END AS BIGINT) AS n_files, coalesce(keep, false) AND ow IS NOT NULL AS enriched FROM j"""


def x_stream_dedupe_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The stored rows, then the arriving ones, as two files of a stream that is upserted by batch."""
    old, new = _stored(spark, d)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    columns = ["repo", "entity_id", "updated_at", "state", "payload", "n_files"]
    target = VersionedTable(spark, f"{root}/table")
    for part in (old, new):
        part.select(*columns).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.select(*columns).schema).parquet(f"{root}/in")
        ingest(stream, target, f"{root}/checkpoint")
    return target.read().select("repo", "entity_id", "state", "payload", F.col("n_files").cast("long").alias("n_files"))


X_STREAM = _STORED + """SELECT repo, entity_id, state, CASE WHEN coalesce(keep, false) THEN op ELSE np END AS payload,
CAST(CASE WHEN coalesce(keep, false) THEN of ELSE nf END AS BIGINT) AS n_files FROM j"""


def k_close_unseen(spark: SparkSession, d: str) -> DataFrame:
    old, new = _stored(spark, d)
    return store.close_unseen(old, new).select("repo", "entity_id", "state", "closed_now")


K_CLOSE = _STORED + """SELECT o.repo, o.entity_id, CASE WHEN o.state = 'open' AND n.repo IS NULL THEN 'closed' ELSE o.state END AS state,
o.state = 'open' AND n.repo IS NULL AS closed_now FROM o LEFT JOIN n ON o.repo = n.repo AND o.entity_id = n.entity_id"""


def k_cache_probe(spark: SparkSession, d: str) -> DataFrame:
    old, new = _stored(spark, d)
    key = F.sha2(F.concat_ws("|", "entity_id", "state"), 256).alias("input_hash")
    cache = old.select("repo", "entity_id", "updated_at", key, F.lit("m1").alias("model_id"))
    return store.cache_probe(new.select("repo", "entity_id", "updated_at", key), cache, "m1").select("repo", "entity_id", "hit")


K_CACHE = _STORED + """SELECT n.repo, n.entity_id, o.repo IS NOT NULL AS hit FROM n LEFT JOIN o
ON o.repo = n.repo AND o.entity_id = n.entity_id AND o.updated_at = n.updated_at AND o.state = n.state"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    payload = F.to_json(F.struct(F.when(F.col("number") % 50 == 3, "x").otherwise(F.col("kind")).alias("kind"), "repo"))
    wrong = F.when(F.col("number") % 60 == 7, F.col("number") + 1).otherwise(F.col("number"))
    return e.select(
        "repo", F.col("id").alias("entity_id"), "kind", F.lower("state").alias("state"), "is_draft", wrong.alias("number"), F.size("changed_files").alias("n_files"), F.size("diff_hunks").alias("n_hunks"), "ci_status",
        F.when(F.col("number") % 4 == 0, F.col("updated_at")).alias("watermark"), F.when(F.col("number") % 4 == 0, "full").alias("enrich_level"), payload.alias("payload"),
        "author", "created", F.to_date("updated_at").alias("updated"), F.col("number").alias("own_number"), "title", "linked_issues", "soft_linked_issues",
    )


def a_quality_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.quality_stats(_rows(spark, d))


A_QUALITY = ENTITIES + """SELECT count(*) AS total, count(*) FILTER (len(changed_files) = 0) AS missing_changed_files, count(*) FILTER (len(hunks) = 0) AS missing_diff_hunks,
count(*) FILTER (ci_status = 'unknown') AS ci_unknown, count(*) FILTER (number % 4 = 0) AS enriched_rows FROM ent"""


def a_audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.audit_counts(_rows(spark, d))


A_AUDIT = ENTITIES + """, r AS (SELECT kind, lower(state) AS state, CAST(is_draft AS VARCHAR) AS is_draft, CASE WHEN number % 4 = 0 THEN 'full' ELSE 'none' END AS level FROM ent)
SELECT 'total' AS metric, '' AS key, count(*) AS n FROM r UNION ALL SELECT 'kind', kind, count(*) FROM r GROUP BY kind
UNION ALL SELECT 'kind_state', kind || '/' || state, count(*) FROM r GROUP BY kind, state UNION ALL SELECT 'draft', is_draft, count(*) FROM r GROUP BY is_draft
UNION ALL SELECT 'level', level, count(*) FROM r GROUP BY level"""


def a_integrity(spark: SparkSession, d: str) -> DataFrame:
    return store.integrity(_rows(spark, d))


A_INTEGRITY = ENTITIES + """SELECT CAST(0 AS BIGINT) AS kind_id_mismatch, count(*) FILTER (number % 50 = 3) AS kind_payload_mismatch, CAST(0 AS BIGINT) AS repo_payload_mismatch,
count(*) FILTER (number % 60 = 7) AS number_id_mismatch FROM ent"""


BASE = "https://example.org/one"


def a_authors_overview(spark: SparkSession, d: str) -> DataFrame:
    return reports.authors_overview(_rows(spark, d), BASE)


A_OVERVIEW = ENTITIES + f""", r AS (SELECT lower(author) AS lc, author, kind, created AS c FROM ent WHERE lower(state) = 'open' OR is_draft), l AS (SELECT max(c) AS last FROM r),
b AS (SELECT lc, min(author) AS author, count(*) AS total_all, count(*) FILTER (kind = 'pr') AS prs_all, count(*) FILTER (kind = 'issue') AS issues_all FROM r WHERE author IS NOT NULL GROUP BY lc),
f AS (SELECT lc, count(*) AS total_14d, count(*) FILTER (kind = 'pr') AS prs_14d, count(*) FILTER (kind = 'issue') AS issues_14d FROM r, l WHERE c >= last - 13 GROUP BY lc),
s AS (SELECT lc, count(*) AS total_7d FROM r, l WHERE c >= last - 6 GROUP BY lc)
SELECT author, total_all, prs_all, issues_all, coalesce(total_14d, 0) AS total_14d, coalesce(prs_14d, 0) AS prs_14d, coalesce(issues_14d, 0) AS issues_14d, coalesce(total_7d, 0) AS total_7d,
printf('{BASE}/issues?q=author%%3A%s+sort%%3Acreated-desc', author) AS all_link,
printf('{BASE}/issues?q=author%%3A%s+created%%3A%s..%s+sort%%3Acreated-desc', author, CAST(last - 13 AS VARCHAR), CAST(last AS VARCHAR)) AS last14_link
FROM b CROSS JOIN l LEFT JOIN f ON f.lc = b.lc LEFT JOIN s ON s.lc = b.lc ORDER BY total_all DESC, total_14d DESC, author LIMIT 50"""


def a_authors_stale(spark: SparkSession, d: str) -> DataFrame:
    return reports.authors_closed_stale(_rows(spark, d), BASE, 2, 1, 3)


A_STALE = ENTITIES + f""", r AS (SELECT lower(author) AS lc, author, lower(state) = 'closed' AS shut, lower(state) = 'open' OR is_draft AS alive, created AS c,
  CAST(DATE '2024-07-01' - to_days(CAST(age_days AS INT)) AS DATE) AS u FROM ent WHERE author IS NOT NULL), l AS (SELECT max(c) AS mc, max(u) AS mu FROM r),
a AS (SELECT min(author) AS author, count(*) FILTER (alive) AS total, count(*) FILTER (shut AND u >= mu - 13) AS closed_14d, count(*) FILTER (shut) AS closed_total,
  count(*) FILTER (alive) AS open_total, count(*) FILTER (alive AND c <= mc - 14) AS stale_open_age14, count(*) FILTER (alive AND c <= mc - 30) AS stale_open_age30, max(mc) AS mc FROM r, l GROUP BY lc)
SELECT * EXCLUDE (mc), printf('{BASE}/issues?q=author%%3A%s+sort%%3Acreated-desc', author) AS all_link, printf('{BASE}/issues?q=author%%3A%s+is%%3Aclosed+sort%%3Aupdated-desc', author) AS closed_link,
printf('{BASE}/issues?q=author%%3A%s+is%%3Aopen+created%%3A..%s+sort%%3Acreated-asc', author, CAST(mc - 14 AS VARCHAR)) AS stale_link
FROM a WHERE total >= 2 AND (closed_14d >= 1 OR stale_open_age14 >= 3) ORDER BY closed_14d DESC, stale_open_age14 DESC, total DESC, author LIMIT 50"""


def a_linked_closed(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("number", F.col("own_number"))
    return reports.linked_closed(rows, BASE, 200)


A_LINKED = ENTITIES + f""", p AS (SELECT number, author, created, CAST(DATE '2024-07-01' - to_days(CAST(age_days AS INT)) AS DATE) AS updated, title, linked_issues, soft_linked_issues
  FROM ent WHERE kind = 'pr' AND (lower(state) = 'open' OR is_draft)),
k AS (SELECT number, author, created, updated, title, CAST(unnest(linked_issues) AS BIGINT) AS ref, 'hard' AS how FROM p
  UNION ALL SELECT number, author, created, updated, title, CAST(unnest(soft_linked_issues) AS BIGINT), 'soft' FROM p),
g AS (SELECT number, author, created, updated, title, ref, string_agg(how, ',' ORDER BY how) AS how FROM k GROUP BY ALL),
j AS (SELECT g.*, lower(i.state) = 'closed' AS shut FROM g LEFT JOIN ent i ON i.kind = 'issue' AND i.number = g.ref)
SELECT number, author, created, updated, title, count(*) AS total_issue_links, count(*) FILTER (shut) AS closed_issue_links, string_agg('#' || ref, ', ' ORDER BY ref) AS all_issue_refs,
string_agg('#' || ref || ' [' || how || ']', ', ' ORDER BY ref) FILTER (shut) AS closed_issue_refs, '{BASE}/pull/' || number AS pr_link
FROM j GROUP BY number, author, created, updated, title HAVING count(*) FILTER (shut) > 0 ORDER BY closed_issue_links DESC, total_issue_links DESC, created, number LIMIT 200"""


def v_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as clusters: turns of a user are issues with comments and reactions by their place and length."""
    c = table(spark, d, "conversations")
    members = c.select(
        F.col("conv_id").alias("cluster_id"), F.when(F.col("role") == "user", "issue").otherwise("pr").alias("kind"), F.col("turn").alias("comments"), (F.length("text") % 7).alias("reactions")
    )
    out = serving.cluster_summary(members)
    return out.select("cluster_id", "size", *(F.round(x, 6).alias(x) for x in ("attention", "pressure", "priority")))


V_SUMMARY = """WITH a AS (SELECT conv_id AS cluster_id, count(*) AS size, sum(CASE WHEN role = 'user' THEN 0.6 * turn + 0.4 * (length(text) % 7) ELSE 0 END) AS att FROM conversations GROUP BY 1)
SELECT cluster_id, size, round(CAST(att AS DOUBLE), 6) AS attention, CAST(size - 1 AS DOUBLE) AS pressure, round(CAST(0.45 * att + 0.35 * size + 0.2 * (size - 1) AS DOUBLE), 6) AS priority FROM a"""


def v_author_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Customers as authors of their orders; the association comes from the earliest order that has one."""
    orders = table(spark, d, "orders")
    level = F.substring_index("o_orderpriority", "-", -1)
    name = F.when(level == "URGENT", "OWNER").when(level == "HIGH", "MEMBER").when(level == "MEDIUM", "CONTRIBUTOR")
    rows = orders.select(
        F.col("o_custkey").alias("author"), F.when(F.col("o_orderkey") % 3 == 0, "issue").otherwise("pr").alias("kind"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("closed").alias("state"), name.alias("association"), F.struct("o_orderdate", "o_orderkey").alias("seen"), serving.trust(name).alias("trust"),
    )
    return serving.author_rollup(rows)


V_ROLLUP = """WITH r AS (SELECT o_custkey AS author, o_orderkey % 3 = 0 AS issue, o_orderstatus = 'O' AS is_open, o_orderdate, o_orderkey, CASE string_split(o_orderpriority, '-')[-1]
  WHEN 'URGENT' THEN 'OWNER' WHEN 'HIGH' THEN 'MEMBER' WHEN 'MEDIUM' THEN 'CONTRIBUTOR' END AS a FROM orders),
f AS (SELECT author, a FROM (SELECT author, a, row_number() OVER (PARTITION BY author ORDER BY o_orderdate, o_orderkey) AS k FROM r WHERE a IS NOT NULL) WHERE k = 1)
SELECT r.author, count(*) FILTER (is_open AND NOT issue) AS open_prs, count(*) FILTER (is_open AND issue) AS open_issues, any_value(f.a) AS association,
max(CAST(CASE r.a WHEN 'OWNER' THEN 1.0 WHEN 'MEMBER' THEN 0.9 WHEN 'CONTRIBUTOR' THEN 0.6 ELSE 0.4 END AS DOUBLE)) AS trust FROM r LEFT JOIN f ON r.author = f.author GROUP BY r.author"""


def v_bridge_weights(spark: SparkSession, d: str) -> DataFrame:
    """Nations as clusters of customers: shared market segments are authors, shared parts of their orders references."""
    customers = table(spark, d, "customer")
    members = customers.select(F.col("c_nationkey").cast("string").alias("cluster_id"), F.col("c_custkey").alias("entity_id"))
    author = customers.select(F.col("c_custkey").alias("entity_id"), F.lit("author").alias("what"), F.col("c_mktsegment").alias("value"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ref = lines.select(F.col("o_custkey").alias("entity_id"), F.lit("ref").alias("what"), F.col("l_partkey").cast("string").alias("value"))
    none = spark.createDataFrame([], "entity_a bigint, entity_b bigint, total double")
    return serving.bridges(none, members, author.unionByName(ref)).withColumn("weight", F.round("weight", 6))


V_BRIDGE = """WITH h AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS c, 'a' || c_mktsegment AS v, 0.8 AS w FROM customer
UNION SELECT CAST(c_nationkey AS VARCHAR), 'r' || l_partkey, 1.2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT a.c AS cluster_a, b.c AS cluster_b, round(CAST(sum(a.w) AS DOUBLE), 6) AS weight FROM h a JOIN h b ON a.v = b.v AND a.c < b.c GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 2000"""


def v_signal_score(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    age = F.datediff(F.to_date(F.lit("2024-07-01")), F.to_date("updated_at"))
    score = serving.signal(F.col("number") % 9, F.col("number") % 5, F.col("approvals"), F.col("number") % 3, F.lit(2), F.col("additions") + F.col("deletions"), age, F.col("number") % 2 == 0)
    return e.select("id", F.round(score, 6).alias("signal"))


V_SIGNAL = ENTITIES + """SELECT id, round((1.0::DOUBLE + 0.35 * (number % 9) + 0.2 * (number % 5) + 0.8 * approvals + 0.12 * (number % 3) + 0.84 + 1::DOUBLE / (1 + age_days::DOUBLE / 10)
+ least(2.0::DOUBLE, ln(1.0::DOUBLE + additions + deletions))) * (CASE WHEN number % 2 = 0 THEN 1.35 ELSE 1.0 END)::DOUBLE, 6) AS signal FROM ent"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    return materialise(serving.project(table(spark, d, "embeddings"), "vec_id", "embedding"), "points")


def v_projection(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select(F.col("key").alias("vec_id"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


_PROJECT = """WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
w AS (SELECT vec_id, v, CAST('0x' || substr(md5('0:' || i), 1, 7) AS BIGINT) / 134217728.0::DOUBLE - 1 AS a, CAST('0x' || substr(md5('1:' || i), 1, 7) AS BIGINT) / 134217728.0::DOUBLE - 1 AS b FROM e),
r AS (SELECT vec_id, sum(v * a) AS px, sum(v * b) AS py FROM w GROUP BY 1), m AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM r),
q AS (SELECT vec_id, (px - x0) / greatest(x1 - x0, 1e-9) * 2 - 1 AS x, (py - y0) / greatest(y1 - y0, 1e-9) * 2 - 1 AS y FROM r, m)
"""


def v_grid_knn(spark: SparkSession, d: str) -> DataFrame:
    points = materialise(_points(spark, d).select("key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")), "grid")
    out = nearest.nearest(points, 4, 0.12)
    return out.select("key", "other", F.col("rank").cast("long").alias("rank"), F.round("weight", 5).alias("weight"))


V_KNN = _PROJECT + """, g AS (SELECT vec_id, round(x, 4) AS x, round(y, 4) AS y FROM q),
p AS (SELECT a.vec_id AS key, b.vec_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM g a JOIN g b ON a.vec_id <> b.vec_id),
k AS (SELECT key, other, d2, row_number() OVER (PARTITION BY key ORDER BY d2, other) AS rank FROM p WHERE d2 <= 0.12::DOUBLE * 0.12::DOUBLE)
SELECT key, other, rank, round(greatest(0.02, 1 - sqrt(d2) / 0.12::DOUBLE), 5) AS weight FROM k WHERE rank <= 4"""


def j_reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return serving.reference_edges(entities(spark, d).withColumn("repo", F.lit("one")))


J_REFERENCE = ENTITIES + """, a AS (SELECT id, unnest(list_concat(linked_issues, soft_linked_issues)) AS ref FROM ent)
SELECT DISTINCT least(a.id, e.id) AS entity_a, greatest(a.id, e.id) AS entity_b FROM a JOIN ent e ON CAST(e.number AS VARCHAR) = a.ref WHERE a.id <> e.id"""

QUERIES = {f.__name__: f for f in (
    k_upsert_preserve, k_close_unseen, k_cache_probe, x_stream_dedupe_upsert, a_quality_stats, a_audit_counts, a_integrity, a_authors_overview,
    a_authors_stale, a_linked_closed, v_cluster_summary, v_author_rollup, v_bridge_weights, v_signal_score, v_projection, v_grid_knn, j_reference_edges,
)}
ORACLES = {
    "k_upsert_preserve": K_UPSERT, "k_close_unseen": K_CLOSE, "k_cache_probe": K_CACHE, "x_stream_dedupe_upsert": X_STREAM, "a_quality_stats": A_QUALITY,
    "a_audit_counts": A_AUDIT, "a_integrity": A_INTEGRITY, "a_authors_overview": A_OVERVIEW, "a_authors_stale": A_STALE, "a_linked_closed": A_LINKED,
    "v_cluster_summary": V_SUMMARY, "v_author_rollup": V_ROLLUP, "v_bridge_weights": V_BRIDGE, "v_signal_score": V_SIGNAL,
    "v_projection": _PROJECT + "SELECT vec_id, round(x, 5) AS x, round(y, 5) AS y FROM q", "v_grid_knn": V_KNN, "j_reference_edges": J_REFERENCE,
}
