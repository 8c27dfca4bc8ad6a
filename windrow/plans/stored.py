"""Stored scans, runs, states and serving plans over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators import scans, serving
from windrow.plans.adapters import ENTITIES, entities
from windrow.session import table

ONE = ENTITIES + ", one AS (SELECT *, 'one' AS r, number % 9 AS comments, number % 5 AS reactions, TIMESTAMP '2024-07-01' - to_days(CAST(age_days AS INT)) AS seen FROM ent)"


def _one(spark: SparkSession, d: str) -> DataFrame:
    """All entities as one repository, with counts of comments and reactions."""
    e = entities(spark, d).withColumn("repo", F.lit("one")).withColumn("state", F.lower("state"))
    return e.withColumns({"comment_count": F.col("number") % 9, "reaction_total": F.col("number") % 5})


def src_stored_scan(spark: SparkSession, d: str) -> DataFrame:
    return scans.stored(_one(spark, d), "one", "pr", include_closed=False, include_drafts=False).select("id", "number", "kind", "state")


def src_stored_limit(spark: SparkSession, d: str) -> DataFrame:
    return scans.stored(_one(spark, d), "one", None, include_closed=True, include_drafts=True, limit=400).select("id", "number", "kind")


def src_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Entities that items of the benchmark name, some of them often and some of them unknown."""
    ids = table(spark, d, "benchmark").select(F.concat(F.lit("pr:"), (F.col("item_id") % 700 * 2).cast("string")).alias("entity_id"))
    return scans.by_ids(_one(spark, d).withColumn("entity_id", F.col("id")), "one", ids).select("id", "number")


def src_repos(spark: SparkSession, d: str) -> DataFrame:
    return scans.repos(entities(spark, d))


def src_last_change(spark: SparkSession, d: str) -> DataFrame:
    found = scans.last_change(entities(spark, d))
    return found.select("repo", F.date_format("changed", "yyyy-MM-dd").alias("changed"), "n")


def src_latest_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as JSON of three runs: one in 11 is cut off, and label 0 is not in the last run."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run_id"), "embedding")
    rows = v.where("NOT (label = 0 AND run_id = 3)").withColumn("entity_id", F.concat(F.lit("v:"), F.col("vec_id").cast("string"))).withColumn("repo", F.concat(F.lit("l"), F.col("label").cast("string")))
    said = F.to_json(F.slice("embedding", 1, 3))
    rows = rows.withColumn("vector_json", F.when(F.col("vec_id") % 11 == 0, F.lit("{broken")).otherwise(said))
    found = scans.latest_embeddings(rows.select("run_id", "repo", "entity_id"), rows.select("run_id", "entity_id", "vector_json"), "l0")
    return found.select("run_id", "entity_id", F.size("vector").cast("long").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x), 5).alias("total"))


def src_ingest_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of two suppliers' nations, one stored and one not, after the state of a third is put twice."""
    spec = "repo string, pr_next_page int, issue_next_page int, pr_next_query string, issue_next_query string, phase string, last_sync_at string, completed boolean"
    n = table(spark, d, "nation").where("n_nationkey < 5")
    states = n.select(
        F.col("n_name").alias("repo"), (F.col("n_nationkey") + 1).cast("int").alias("pr_next_page"), F.lit(1).alias("issue_next_page"), F.lit(None).cast("string").alias("pr_next_query"),
        F.lit(None).cast("string").alias("issue_next_query"), F.lit("issues").alias("phase"), F.lit("2024-01-01").alias("last_sync_at"), (F.col("n_nationkey") % 2 == 0).alias("completed"),
    )
    for page in (7, 9):
        states = scans.put(states, spark.createDataFrame([("new", page, 2, None, "q", "done", "2024-02-02", True)], spec), ["repo"])
    first = n.agg(F.min("n_name")).first()[0]
    out = scans.state_of(states, first)
    for repo in ("new", "nowhere"):
        out = out.unionByName(scans.state_of(states, repo))
    return out.select("repo", "pr_next_page", "issue_next_page", "phase", "completed")


STATE = """WITH s AS (SELECT n_name AS repo, CAST(n_nationkey + 1 AS INT) AS pr_next_page, 1 AS issue_next_page, 'issues' AS phase, n_nationkey % 2 = 0 AS completed FROM nation WHERE n_nationkey < 5)
SELECT * FROM s WHERE repo = (SELECT min(repo) FROM s) UNION ALL SELECT 'new', 9, 2, 'done', true UNION ALL SELECT 'nowhere', 1, 1, 'prs', false"""


def s_parsed_id(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", scans.parsed_id(F.col("id")).alias("x")).select("id", "x.kind", "x.number")


def s_slug(spark: SparkSession, d: str) -> DataFrame:
    """Owner and name in remote addresses of several forms, and in addresses of pages, which hold none."""
    name = F.concat(F.lower("c_mktsegment"), F.lit("/n."), F.col("c_custkey").cast("string"))
    k = F.col("c_custkey") % 4
    url = F.when(k == 0, F.concat(F.lit("https://git.example/"), name, F.lit(".git"))).when(k == 1, F.concat(F.lit(" git@git.example:"), name)).when(
        k == 2, F.concat(F.lit("https://git.example/"), name, F.lit("/tree"))
    ).otherwise(F.concat(F.lit("https://other.example/"), name))
    return table(spark, d, "customer").select("c_custkey", scans.slug(url, "git.example").alias("slug"))


S_SLUG = """SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN lower(c_mktsegment) || '/n.' || c_custkey END AS slug FROM customer"""


def s_approvals(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as reviews: every third is an approval, in either case."""
    c = table(spark, d, "conversations")
    state = F.when(F.col("turn") % 3 == 0, F.when(F.col("turn") % 2 == 0, "approved").otherwise("APPROVED")).otherwise("commented")
    said = c.groupBy("conv_id").agg(F.collect_list(F.struct(state.alias("state"))).alias("reviews"))
    return said.select("conv_id", scans.approvals(F.col("reviews")).cast("long").alias("approvals"))


def s_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an order in line order as its commits: their distinct digests."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    shas = F.transform("x", lambda x: (x["l_partkey"] % 5).cast("string"))
    return lines.select("l_orderkey", F.array_join(scans.lineage(shas), ",").alias("ids"))


S_LINEAGE = """WITH l AS (SELECT l_orderkey, CAST(l_partkey % 5 AS VARCHAR) AS c, l_linenumber, l_partkey, l_suppkey FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM l), f AS (SELECT l_orderkey, c, min(i) AS i FROM o GROUP BY 1, 2)
SELECT l_orderkey, string_agg(sha1(c), ',' ORDER BY i) AS ids FROM f GROUP BY 1"""


def a_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    bare = F.col("number") % 8 == 1
    rows = e.select(
        F.col("kind").alias("lane"), F.when(bare, F.array().cast("array<string>")).otherwise(F.col("changed_files")).alias("changed_files"),
        F.when(bare | (F.col("number") % 2 == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("h"))).alias("hunk_signatures"),
    )
    return scans.coverage(rows).withColumn("share", F.round("share", 6))


A_COVERAGE = ENTITIES + """SELECT count(*) AS prs, count(*) FILTER (number % 8 = 1) AS bare, round(count(*) FILTER (number % 8 = 1)::DOUBLE / count(*), 6) AS share,
count(*) FILTER (number % 8 = 1)::DOUBLE / count(*) >= 0.8 AS is_low FROM ent WHERE kind = 'pr'"""


def g_linkage(spark: SparkSession, d: str) -> DataFrame:
    found = scans.linkage(_one(spark, d))
    return found.select("component", "size", "cluster_type", "canonical_pr", "canonical_issue", "canonical", *(F.round(c, 6).alias(c) for c in ("attention", "pressure", "priority")))


LINKAGE = ONE.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT id, unnest(list_concat(linked_issues, soft_linked_issues)) AS ref FROM one),
e AS (SELECT DISTINCT a.id AS x, i.id AS y FROM a JOIN one i ON i.kind = 'issue' AND CAST(i.number AS VARCHAR) = a.ref WHERE a.id <> i.id),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x AS node, x AS root FROM l UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node), m AS (SELECT c.component, one.* FROM c JOIN one ON one.id = c.node),
k AS (SELECT *, row_number() OVER (PARTITION BY component, kind ORDER BY seen DESC, id) AS place FROM m),
g AS (SELECT component, count(*) AS size, count(*) FILTER (kind = 'pr') AS prs, count(*) FILTER (kind = 'issue') AS issues, max(CASE WHEN kind = 'pr' AND place = 1 THEN id END) AS canonical_pr,
  max(CASE WHEN kind = 'issue' AND place = 1 THEN id END) AS canonical_issue, CAST(sum(CASE WHEN kind = 'issue' THEN 0.6 * comments + 0.4 * reactions ELSE 0 END) AS DOUBLE) AS attention FROM k GROUP BY 1),
lk AS (SELECT component, size, CASE WHEN prs > 0 AND issues > 0 AND size = 2 THEN 'linked_pair' ELSE 'duplicate_candidate' END AS cluster_type, canonical_pr, canonical_issue,
  coalesce(canonical_pr, canonical_issue) AS canonical, round(attention, 6) AS attention, CAST(size - 1 AS DOUBLE) AS pressure,
  round(0.45::DOUBLE * attention + 0.35::DOUBLE * size + 0.2::DOUBLE * (size - 1), 6) AS priority FROM g WHERE size >= 2)
"""


def v_served_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Linked pairs of the linkage view, as the stored run has no cluster of that kind."""
    link = scans.linkage(_one(spark, d))
    empty = link.where("cluster_type = 'no such type'")
    found = scans.served(empty, link, kind="linked_pair", min_members=2, most=50)
    return found.select("component", "size", "canonical", F.round("priority", 6).alias("priority"), F.round(scans.node_size(F.col("priority")), 6).alias("node_size"))


V_SERVED = LINKAGE + """SELECT component, size, canonical, priority, round(greatest(12.0::DOUBLE, least(80.0::DOUBLE, 12.0::DOUBLE + priority * 1.5::DOUBLE)), 6) AS node_size
FROM lk WHERE cluster_type = 'linked_pair' ORDER BY priority DESC, size DESC, component LIMIT 50"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select(F.concat(F.lit("c"), (F.col("number") % 23).cast("string")).alias("cluster_id"), F.col("id").alias("entity_id"), "author", "number", "updated_at", "id")


def j_author_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scans.author_pairs_of(_members(spark, d), "c7", 100)


J_AUTHORS = ENTITIES + """, s AS (SELECT id, author FROM ent WHERE number % 23 = 7 AND author IS NOT NULL ORDER BY id LIMIT 100)
SELECT a.id AS source, b.id AS target, CAST(0.6 AS DOUBLE) AS weight FROM s a JOIN s b ON a.author = b.author AND a.id < b.id"""


def j_author_chain(spark: SparkSession, d: str) -> DataFrame:
    return scans.author_pairs(_members(spark, d))


J_CHAIN = ENTITIES + """, s AS (SELECT 'c' || (number % 23) AS cluster_id, id AS source, lead(id) OVER (PARTITION BY number % 23, author ORDER BY id) AS target FROM ent WHERE author IS NOT NULL)
SELECT *, CAST(0.6 AS DOUBLE) AS weight FROM s WHERE target IS NOT NULL"""


def w_node_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).select(F.col("id").alias("entity_id"), (F.col("number") % 19 == 0).alias("canonical"), (F.col("additions") * 0.5 + F.col("number") % 7).alias("signal"))
    return scans.node_cap(rows, 120)


W_NODES = ENTITIES + """SELECT id AS entity_id, number % 19 = 0 AS canonical, CAST(additions * 0.5 + number % 7 AS DOUBLE) AS signal FROM ent ORDER BY canonical DESC, signal DESC, id LIMIT 120"""


def w_newest(spark: SparkSession, d: str) -> DataFrame:
    return scans.newest(_members(spark, d), 60).select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


W_NEWEST = ENTITIES + """SELECT id, strftime(TIMESTAMP '2024-07-01' - to_days(CAST(age_days AS INT)), '%Y-%m-%d') AS day FROM ent ORDER BY age_days, id LIMIT 60"""


def v_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors of the entities with stored counts of merged pull requests of some, put a second time for one in four."""
    e = _one(spark, d)
    rows = e.withColumns({"association": F.when(F.col("number") % 6 == 0, "MEMBER"), "seen": F.struct("number")})
    rollup = serving.author_rollup(rows.select("author", "kind", "state", "association", "seen", serving.trust(F.col("association")).alias("trust")))
    who = e.where("author LIKE 'User%'").select("author").distinct().withColumn("k", F.substring("author", 5, 9).cast("int"))
    metrics = who.where("k % 2 = 0").select("author", (F.col("k") % 5).cast("long").alias("merged_pr_count"), (F.col("k") / 40).alias("trust_score"))
    metrics = scans.put(metrics, who.where("k % 4 = 0").select("author", F.lit(50).cast("long").alias("merged_pr_count"), F.lit(0.95).alias("trust_score")), ["author"])
    return scans.authors(rollup, metrics, 30)


V_AUTHORS = ONE + """, w AS (SELECT author, kind, lower(state) = 'open' AS o, CASE WHEN number % 6 = 0 THEN 'MEMBER' END AS a, number FROM one),
p AS (SELECT author, count(*) FILTER (o AND kind = 'pr') AS open_prs, count(*) FILTER (o AND kind = 'issue') AS open_issues, max(a) AS association, max(CASE WHEN a IS NULL THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END) AS trust FROM w GROUP BY 1),
k AS (SELECT DISTINCT author, CAST(substr(author, 5, 9) AS INT) AS k FROM w WHERE author LIKE 'User%'),
m AS (SELECT author, CASE WHEN k % 4 = 0 THEN 50 ELSE k % 5 END AS merged, CASE WHEN k % 4 = 0 THEN 0.95::DOUBLE ELSE k / 40.0::DOUBLE END AS t FROM k WHERE k % 2 = 0)
SELECT p.author, open_prs, open_issues, association, CAST(coalesce(merged, 0) AS BIGINT) AS merged_pr_count, round(greatest(trust, coalesce(t, 0.0::DOUBLE)), 3) AS trust_score
FROM p LEFT JOIN m ON m.author = p.author ORDER BY trust_score DESC, merged_pr_count DESC, open_prs DESC, p.author LIMIT 30"""

QUERIES = {f.__name__: f for f in (
    src_stored_scan, src_stored_limit, src_by_ids, src_repos, src_last_change, src_latest_embeddings, src_ingest_state, s_parsed_id, s_slug, s_approvals, s_lineage,
    a_coverage, g_linkage, v_served_fallback, j_author_pairs, j_author_chain, w_node_cap, w_newest, v_authors,
)}
ORACLES = {
    "src_stored_scan": ENTITIES + "SELECT id, number, kind, lower(state) AS state FROM ent WHERE kind = 'pr' AND lower(state) = 'open' AND NOT is_draft ORDER BY kind, number",
    "src_stored_limit": ENTITIES + "SELECT id, number, kind FROM ent ORDER BY kind, number LIMIT 400",
    "src_by_ids": ENTITIES + "SELECT id, number FROM ent WHERE id IN (SELECT 'pr:' || (item_id % 700 * 2) FROM benchmark)",
    "src_repos": ENTITIES + "SELECT DISTINCT repo FROM ent ORDER BY repo",
    "src_last_change": ENTITIES + "SELECT repo, strftime(TIMESTAMP '2024-07-01' - to_days(CAST(min(age_days) AS INT)), '%Y-%m-%d') AS changed, count(*) AS n FROM ent GROUP BY 1",
    "src_latest_embeddings": """SELECT 2 AS run_id, 'v:' || vec_id AS entity_id, CAST(least(3, len(embedding)) AS BIGINT) AS n, round(list_sum(CAST(embedding[1:3] AS DOUBLE[])), 5) AS total
FROM embeddings WHERE label = 0 AND vec_id % 11 <> 0""",
    "src_ingest_state": STATE, "s_parsed_id": ENTITIES + "SELECT id, kind, number FROM ent", "s_slug": S_SLUG,
    "s_approvals": "SELECT conv_id, count(*) FILTER (turn % 3 = 0) AS approvals FROM conversations GROUP BY 1",
    "s_lineage": S_LINEAGE, "a_coverage": A_COVERAGE, "g_linkage": LINKAGE + "SELECT * FROM lk", "v_served_fallback": V_SERVED, "j_author_pairs": J_AUTHORS,
    "j_author_chain": J_CHAIN, "w_node_cap": W_NODES, "w_newest": W_NEWEST, "v_authors": V_AUTHORS,
}
