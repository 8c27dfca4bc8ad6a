"""Filter, candidates, scores, clusters, canonical members and routing over entities made from the tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow import config, engine
from windrow.operators import candidates, canonical, fingerprint, graph, lowpass, pair_tiles, tally
from windrow.plans import pair_sql
from windrow.plans.adapters import AS_OF, ENTITIES, entities
from windrow.session import materialise, table

CFG = config.merged({"low_pass": {"suppress_bot_authors": True, "ignore_recent_pr_hours": 48}})
#: The same without the switch to another floor of votes in large runs.
ONE_FLOOR = config.merged(CFG, {"similarity": {"large_run_threshold": None}})


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return lowpass.apply(entities(spark, d), CFG, F.to_timestamp(F.lit(AS_OF)))


def f_lowpass_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d).select("id", "filter_state", "action", F.array_join("reason_codes", ",").alias("reasons"), "priority_weight")


_CONTENT = """list_filter(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x:
  NOT (lower(x) IN ('1.', '2.', '3.', 'what went wrong?', 'what did you expect to happen?', 'what actually happened?') OR starts_with(lower(x), '## summary')
  OR starts_with(lower(x), '## steps to reproduce') OR starts_with(lower(x), '## expected behavior') OR starts_with(lower(x), '## actual behavior')
  OR starts_with(lower(x), '## proposed solution') OR starts_with(lower(x), '## additional context')))"""
FILTERED = ENTITIES + f""", c AS (SELECT *, {_CONTENT} AS content, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS every FROM ent),
t AS (SELECT *, len(regexp_extract_all(array_to_string(content, chr(10)), '[a-zA-Z0-9_]+')) AS n_tok FROM c),
e AS (SELECT *, CASE WHEN lower(state) <> 'open' THEN 'CLOSED_STATE' WHEN is_draft THEN 'DRAFT_PR' WHEN list_contains(labels, 'wontfix') THEN 'HARD_SKIP_LABEL'
  WHEN age_days > 90 THEN 'STALE' WHEN kind = 'pr' AND age_days <= 2 THEN 'RECENT_PR'
  WHEN kind = 'issue' AND len(every) > 0 AND (len(every) - len(content))::DOUBLE / greatest(len(every), 1) >= 0.7 AND n_tok <= 12 THEN 'ISSUE_TEMPLATE_NOISE'
  WHEN kind = 'issue' AND len(content) <= 1 AND n_tok <= 14 THEN 'ISSUE_ONE_LINER'
  WHEN kind = 'pr' AND (len(changed_files) > 40 OR additions + deletions > 5000) THEN 'PR_LARGE_CHANGESET' END AS early,
  list_contains(labels, 'question') AS soft, (len(changed_files) > 0 AND changed_files[1] LIKE 'docs/%' AND ci_status = 'unknown') AS docs, author LIKE '%bot%' AS bot,
  list_contains(labels, 'Security') AS boost FROM t),
f AS (SELECT *, CASE WHEN early IS NULL THEN CASE WHEN soft OR docs OR bot THEN 'suppress' ELSE 'pass' END
  WHEN early IN ('RECENT_PR', 'ISSUE_TEMPLATE_NOISE', 'ISSUE_ONE_LINER') THEN 'suppress' ELSE 'skip' END AS filter_state,
  CASE WHEN early IS NOT NULL THEN early ELSE array_to_string(list_filter([CASE WHEN soft THEN 'SOFT_SUPPRESS_LABEL' END, CASE WHEN docs THEN 'LOW_SIGNAL_DOCS_ONLY' END,
    CASE WHEN bot THEN 'BOT_SUPPRESSED' END, CASE WHEN boost THEN 'BOOST_SECURITY' END], lambda x: x IS NOT NULL), ',') END AS reasons,
  CAST(CASE WHEN early = 'RECENT_PR' THEN 1.0 WHEN early IS NOT NULL THEN 0.0 WHEN boost THEN 1.5 ELSE 1.0 END AS DOUBLE) AS priority_weight FROM e)
"""
F_CASCADE = FILTERED + "SELECT id, filter_state, 'ignore' AS action, reasons, priority_weight FROM f"


def f_lowpass_reason_hist(spark: SparkSession, d: str) -> DataFrame:
    return lowpass.reason_histogram(_filtered(spark, d))


F_HIST = FILTERED + """SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM f WHERE reasons <> '')
WHERE reason NOT LIKE 'BOOST_%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"""


def f_docs_only(spark: SparkSession, d: str) -> DataFrame:
    only = lowpass.docs_only(F.col("changed_files"), CFG["low_pass"]["docs_prefixes"], CFG["low_pass"]["docs_suffixes"])
    return entities(spark, d).select("id", only.alias("docs_only"))


F_DOCS = ENTITIES + "SELECT id, (len(changed_files) > 0 AND changed_files[1] LIKE 'docs/%') AS docs_only FROM ent"


def s_diff_material(spark: SparkSession, d: str) -> DataFrame:
    """Hunk signatures of changes from one line item to the next of an order: file is the part, context the supplier."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, d, "lineitem").withColumn("p", F.lead("l_shipdate").over(order).cast("string"))
    hunk = F.struct(
        F.col("l_partkey").cast("string").alias("file_path"), F.col("l_suppkey").cast("string").alias("context"),
        F.array(F.coalesce(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(""))).alias("added_lines"), F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("removed_lines"),
    )
    return rows.select("l_orderkey", "l_linenumber", fingerprint.hunk_signatures(F.array(hunk))[0].alias("signature"))


S_DIFF = """SELECT l_orderkey, l_linenumber, sha1(l_partkey || '|' || l_suppkey || '|' || array_to_string(regexp_extract_all(strftime(l_shipdate, '%Y-%m-%d'), '[a-zA-Z0-9_]+'), ' ')
  || '|' || lower(l_returnflag) || ' ' || lower(l_linestatus)) AS signature FROM lineitem"""


def _part_keys(spark: SparkSession, d: str) -> DataFrame:
    """Parts are files and supplier buckets modules of the orders that hold them."""
    lines = table(spark, d, "lineitem")
    fp = lines.groupBy(F.col("l_orderkey").alias("entity_id")).agg(
        F.collect_list(F.col("l_partkey").cast("string")).alias("files"), F.collect_set((F.col("l_suppkey") % 50).cast("string")).alias("modules")
    )
    return candidates.keys(fp, {"file": "files", "module": "modules"})


def j_hot_bucket_cap(spark: SparkSession, d: str) -> DataFrame:
    kept = candidates.without_hot(_part_keys(spark, d), {"file": 300, "module": 800})
    return kept.groupBy("kind", "key").agg(F.count("*").alias("holders"), F.sum("times").alias("times"))


_KEYS = """WITH k AS (SELECT l_orderkey AS entity_id, 'file' AS kind, CAST(l_partkey AS VARCHAR) AS key, count(*) AS times FROM lineitem GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT l_orderkey, 'module', CAST(l_suppkey % 50 AS VARCHAR), 1 FROM lineitem),
z AS (SELECT kind, key, count(*) AS holders, CAST(sum(times) AS BIGINT) AS times FROM k GROUP BY 1, 2),
c AS (SELECT k.* FROM k JOIN z ON k.kind = z.kind AND k.key = z.key WHERE z.holders <= CASE WHEN k.kind = 'file' THEN 300 ELSE 800 END)
"""


def _vote_rows(spark: SparkSession, d: str) -> DataFrame:
    """Part and supplier bucket of each line of an order, as :func:`tally.postings` takes them. A part counts as often as
    an order has it, a bucket once."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 50).alias("module"))
    file = F.struct(tally.hashed("file", F.col("l_partkey").cast("string")).alias("key"), F.lit(1 << 8).alias("w"))
    files = lines.where("l_partkey IS NOT NULL").select(F.col("l_orderkey").alias("holder"), file.alias("x"))
    modules = lines.where("module IS NOT NULL").select("l_orderkey", "module").distinct()
    # A bucket has one of fifty keys: those over the cap are dropped by their counts, so that no task takes all their holders.
    cold = F.broadcast(modules.groupBy("module").agg(F.count("*").alias("n")).where(F.col("n") <= 800).select("module"))
    bucket = F.struct(tally.hashed("module", F.col("module").cast("string")).alias("key"), F.lit((1 << 8) + 1).alias("w"))
    kept = modules.join(cold, "module").select(F.col("l_orderkey").alias("holder"), bucket.alias("x"))
    return files.unionByName(kept).select("holder", "x.key", F.col("x.w").cast("long").alias("w"))


def j_inverted_index_votes(spark: SparkSession, d: str) -> DataFrame:
    return tally.tally(_vote_rows(spark, d), {0: 300, 1: 800}).withColumnRenamed("holder", "entity_id")


_VOTES = _KEYS + ", v AS (SELECT a.entity_id, b.entity_id AS other, CAST(sum(a.times) AS BIGINT) AS votes FROM c a JOIN c b ON a.kind = b.kind AND a.key = b.key AND a.entity_id <> b.entity_id GROUP BY 1, 2)"


def w_topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = tally.tally(_vote_rows(spark, d), {0: 300, 1: 800}, 8)
    return found.select(F.col("holder").alias("entity_id"), "other", "votes", F.col("rank").cast("long").alias("rank"))


W_TOPK = _VOTES + """ SELECT * FROM (SELECT entity_id, other, votes, row_number() OVER (PARTITION BY entity_id ORDER BY votes DESC, other) AS rank FROM v) WHERE rank <= 8"""


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return materialise(engine.fingerprints(_filtered(spark, d).where("filter_state = 'pass'"), CFG), "fingerprints")


def _run(spark: SparkSession, d: str, cfg: dict[str, Any] = CFG) -> engine.Report:
    return engine.run(entities(spark, d), cfg, F.to_timestamp(F.lit(AS_OF)))


def x_fingerprint_cache(spark: SparkSession, d: str) -> DataFrame:
    """Entities with even numbers are cached, some under an older revision or another model: what a run makes anew, and
    whether every fingerprint is the one that a run without a cache makes."""
    active = materialise(_filtered(spark, d).where("filter_state = 'pass'"), "active")
    plain = materialise(engine.fingerprints(active, CFG), "plain")
    own = active.select("repo", F.col("id").alias("entity_id"), "updated_at", "number")
    cache = plain.join(own, "entity_id").where("number % 2 = 0").withColumns({
        "updated_at": F.when(F.col("number") % 10 == 0, F.col("updated_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("updated_at")),
        "model_id": F.when(F.col("number") % 14 == 0, "another").otherwise(engine.model_id(CFG)),
    }).drop("number")
    made, fresh = engine.cached_fingerprints(active, CFG, materialise(cache, "cache"))
    digest = lambda df, name: df.select("entity_id", F.xxhash64(*(F.col(c) for c in sorted(plain.columns) if c != "winnow"), F.array_sort("winnow")).alias(name))
    both = digest(made, "x").join(digest(plain, "y"), "entity_id").join(fresh.select("entity_id", F.lit(1).alias("new")), "entity_id", "left")
    return both.select("entity_id", F.col("new").isNull().alias("hit"), (F.col("x") == F.col("y")).alias("same"))


X_CACHE = FILTERED + """SELECT id AS entity_id, number % 2 = 0 AND number % 10 <> 0 AND number % 14 <> 0 AND len(regexp_extract_all(coalesce(title, ''), '[a-zA-Z0-9_]+')) > 0 AS hit, true AS same
FROM f WHERE filter_state = 'pass'"""


def p_edge_tier(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).edges.select("entity_a", "entity_b", "tier", *(F.round(m, 6).alias(m) for m in engine.METRICS))


def p_pair_score(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that share an issue or a file: every feature and the total."""
    fp = _fingerprints(spark, d)
    scored = pair_tiles.scored(fp, {"hard": "linked_issues", "file": "changed_files"}, CFG)
    return scored.select("entity_a", "entity_b", *(F.round(m, 6).alias(m) for m in engine.METRICS))


_ROUNDED = "entity_a, entity_b, " + ", ".join(f"round({m}, 6) AS {m}" for m in engine.METRICS)
P_PAIR = (
    pair_sql.fingerprints(FILTERED, CFG) + pair_sql.candidates(CFG, sketches=False)
    + pair_sql.features(CFG, "SELECT DISTINCT least(entity_id, other) AS entity_a, greatest(entity_id, other) AS entity_b FROM met") + f"SELECT {_ROUNDED} FROM score"
)
_EDGES = pair_sql.fingerprints(FILTERED, CFG) + pair_sql.candidates(CFG, sketches=True) + pair_sql.features(CFG, pair_sql.chosen(CFG)) + pair_sql.tiers(CFG)
P_TIER = _EDGES + f"SELECT tier, {_ROUNDED} FROM edge"
_TYPES = _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + pair_sql.clusters(CFG)
_RUN = _TYPES + pair_sql.decisions(CFG)
_RUN_ONE_FLOOR = _RUN.replace(pair_sql.chosen(CFG), pair_sql.chosen(ONE_FLOOR))
E2E = _RUN_ONE_FLOOR + pair_sql.SHADOWS + " UNION ALL ".join(
    f"SELECT '{name}' AS counter, count(*) AS n FROM {view}" for name, view in (
        ("filtered", "f"), ("fingerprints", "fp"), ("edges", "edge"), ("types", "types"), ("decisions", "dec"), ("routing", "f"), ("shadows", "sw"),
    )
)


def g_cluster_type(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).types.select("cluster_id", "component", "n", "cluster_type")


def c_canonical_rank(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, ONE_FLOOR).decisions.withColumn("score", F.round("score", 6))


def r_routing(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).routing.withColumn("labels", F.array_join("labels", ","))


def e2e_triage_profile(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, ONE_FLOOR).profile()


def g_tail_prune(spark: SparkSession, d: str) -> DataFrame:
    """Peel weak tails of the trade graph's components below a score of 0.5."""
    edges = materialise(_trade_edges(spark, d), "trade")
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return graph.prune_tails(graph.group(nodes, edges), edges, 0.5)


def g_shadow_attach(spark: SparkSession, d: str) -> DataFrame:
    """Filtered-out entities join the cluster (here: the module of an active one) that shares most issue references."""
    rows = _filtered(spark, d)
    active = rows.where("filter_state = 'pass'")
    members = active.select(F.concat(F.lit("m"), (F.col("number") % 40).cast("string")).alias("cluster_id"), F.col("id").alias("entity_id"))
    return canonical.attach_shadows(members, fingerprint.assemble(active), rows.where("filter_state <> 'pass'"))


G_SHADOW = FILTERED + """, own AS (SELECT id, 'm' || (number % 40) AS cluster_id, filter_state,
  list_distinct(list_concat(list_concat(linked_issues, soft_linked_issues), CASE WHEN kind = 'issue' THEN [CAST(number AS VARCHAR)] ELSE []::VARCHAR[] END)) AS refs FROM f),
m AS (SELECT DISTINCT cluster_id, ref FROM (SELECT cluster_id, unnest(refs) AS ref FROM own WHERE filter_state = 'pass')),
s AS (SELECT id, unnest(refs) AS ref FROM own WHERE filter_state <> 'pass'),
v AS (SELECT id, cluster_id, count(*) AS votes FROM s JOIN m ON s.ref = m.ref GROUP BY 1, 2)
SELECT id, cluster_id, votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, cluster_id) AS r FROM v) WHERE r = 1"""


def g_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers who buy the same part of the same supplier: three such lines make a strong edge, two a weak one."""
    return graph.merge_edges(_trade_edges(spark, d)).select("entity_a", "entity_b")


def _trade_edges(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    held = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "l_partkey", "l_suppkey").distinct()
    other = held.select(F.col("o_custkey").alias("entity_b"), "l_partkey", "l_suppkey")
    pairs = held.withColumnRenamed("o_custkey", "entity_a").join(other, ["l_partkey", "l_suppkey"]).where("entity_a < entity_b")
    counted = pairs.groupBy("entity_a", "entity_b").agg(F.count("*").alias("n"), F.min((F.col("l_partkey") % 9).cast("double")).alias("low"))
    strong = (F.col("n") >= 2) | (F.col("low") == 0)
    return counted.select(
        "entity_a", "entity_b", F.when(strong, "strong").otherwise("weak").alias("tier"),
        F.when(F.col("low") == 1, 0.5).otherwise(0.0).alias("hard_link"), F.lit(0.0).alias("lineage"), (F.col("n") * 0.3).alias("total"),
    )


_TRADE = """WITH RECURSIVE h AS (SELECT DISTINCT o_custkey, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT a.o_custkey AS entity_a, b.o_custkey AS entity_b, count(*) AS n, min(a.l_partkey % 9) AS low FROM h a JOIN h b
  ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.o_custkey < b.o_custkey GROUP BY 1, 2),
e AS (SELECT entity_a, entity_b, (n >= 2 OR low = 0) AS strong, low = 1 AS firm FROM p),
s AS (SELECT entity_a AS x, entity_b AS y FROM e WHERE strong UNION ALL SELECT entity_b, entity_a FROM e WHERE strong),
w AS (SELECT entity_a AS x, entity_b AS y FROM e WHERE NOT strong UNION ALL SELECT entity_b, entity_a FROM e WHERE NOT strong),
g AS (SELECT x FROM w GROUP BY x HAVING count(*) = 1), q AS (SELECT x FROM g WHERE x NOT IN (SELECT x FROM s)),
m AS (SELECT entity_a, entity_b FROM e WHERE strong OR firm
  UNION SELECT e.entity_a, e.entity_b FROM e JOIN s a ON a.x = e.entity_a JOIN s b ON b.x = e.entity_b AND a.y = b.y WHERE NOT e.strong
  UNION SELECT entity_a, entity_b FROM e WHERE NOT strong AND entity_a IN (SELECT x FROM q) AND entity_b IN (SELECT x FROM q))
"""


G_TAIL = _TRADE + """, te AS MATERIALIZED (SELECT entity_a, entity_b, n * 0.3::DOUBLE AS total, CASE WHEN low = 1 THEN 0.5 ELSE 0.0 END AS hard_link, 0.0 AS lineage FROM p)
""" + pair_sql._reach("tg", "SELECT c_custkey AS node FROM customer", "SELECT entity_a AS x, entity_b AS y FROM te UNION SELECT entity_b, entity_a FROM te") + pair_sql.pruned("tg", "te", 0.5, 16) + "SELECT node, comp AS component FROM g2"


def g_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers who buy the same part of the same supplier, by component."""
    links = _links(table(spark, d, "lineitem"), table(spark, d, "orders"))
    return graph.components(links, "entity_a", "entity_b").select(F.col("node").alias("customer"), "component")


def _links(lines: DataFrame, orders: DataFrame) -> DataFrame:
    held = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "l_partkey", "l_suppkey").distinct()
    first = held.groupBy("l_partkey", "l_suppkey").agg(F.min("o_custkey").alias("entity_a"))
    return held.join(first, ["l_partkey", "l_suppkey"]).select("entity_a", F.col("o_custkey").alias("entity_b"))


G_COMPONENTS = """WITH RECURSIVE h AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT p, s, min(c) AS a FROM h GROUP BY 1, 2), e AS (SELECT DISTINCT a, c AS b FROM h JOIN f ON h.p = f.p AND h.s = f.s),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT node AS customer, min(root) AS component FROM r GROUP BY node"""

QUERIES = {f.__name__: f for f in (
    f_lowpass_cascade, f_lowpass_reason_hist, f_docs_only, s_diff_material, j_hot_bucket_cap, j_inverted_index_votes, w_topk_candidates,
    p_pair_score, p_edge_tier, g_merge_edges, g_components, g_tail_prune, g_cluster_type, g_shadow_attach, c_canonical_rank, r_routing,
    e2e_triage_profile, x_fingerprint_cache,
)}
ORACLES = {
    "f_lowpass_cascade": F_CASCADE, "f_lowpass_reason_hist": F_HIST, "f_docs_only": F_DOCS, "s_diff_material": S_DIFF,
    "j_hot_bucket_cap": _KEYS + "SELECT kind, key, holders, times FROM z WHERE holders <= CASE WHEN kind = 'file' THEN 300 ELSE 800 END",
    "j_inverted_index_votes": _VOTES + " SELECT entity_id, count(*) AS others, CAST(sum(votes) AS BIGINT) AS votes, max(votes) AS best FROM v GROUP BY 1",
    "w_topk_candidates": W_TOPK, "g_merge_edges": _TRADE + "SELECT entity_a, entity_b FROM m", "g_components": G_COMPONENTS, "p_pair_score": P_PAIR, "x_fingerprint_cache": X_CACHE, "p_edge_tier": P_TIER, "g_cluster_type": _TYPES + "SELECT cluster_id, component, n, cluster_type FROM types", "c_canonical_rank": _RUN_ONE_FLOOR + "SELECT * FROM dec",
    "r_routing": _RUN + pair_sql.routing(CFG) + "SELECT * FROM rt", "e2e_triage_profile": E2E, "g_tail_prune": G_TAIL, "g_shadow_attach": G_SHADOW,
}
