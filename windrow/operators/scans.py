"""Reads of stored entities, runs and states, and the linkage view that serves where no run is stored.

All orders put nulls first, and every cut is taken after its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators.components import components
from windrow.operators.serving import attention

#: What a repository without a stored state is at.
START = {"pr_next_page": 1, "issue_next_page": 1, "pr_next_query": None, "issue_next_query": None, "phase": "prs", "last_sync_at": None, "completed": False}


def stored(rows: DataFrame, repo: str, kind: str | None = None, include_closed: bool = False, include_drafts: bool = False, limit: int = 0) -> DataFrame:
    """Rows of a repository, open and no drafts unless asked for, by kind and number; the first ``limit`` if positive."""
    kept = rows.where(F.col("repo") == repo)
    if kind is not None:
        kept = kept.where(F.col("kind") == kind)
    if not include_closed:
        kept = kept.where(F.col("state") == "open")
    if not include_drafts:
        kept = kept.where(~F.col("is_draft"))
    ordered = kept.orderBy(F.asc_nulls_first("kind"), F.asc_nulls_first("number"))
    return ordered.limit(limit) if limit > 0 else ordered


def by_ids(rows: DataFrame, repo: str, ids: DataFrame) -> DataFrame:
    """Rows of a repository whose entity_id stands in ``ids`` (entity_id), each once."""
    return rows.where(F.col("repo") == repo).join(ids.select("entity_id"), "entity_id", "left_semi")


def repos(rows: DataFrame) -> DataFrame:
    return rows.select("repo").distinct().orderBy("repo")


def last_change(rows: DataFrame) -> DataFrame:
    """repo, changed, n: what a cached page of a repository is valid for."""
    return rows.groupBy("repo").agg(F.max("updated_at").alias("changed"), F.count("*").alias("n"))


def latest_embeddings(entities: DataFrame, vectors: DataFrame, repo: str, ids: DataFrame | None = None) -> DataFrame:
    """run_id, entity_id, vector of the newest run that holds the repository; vectors that are no JSON arrays drop out.

    entities: run_id, repo, entity_id; vectors: run_id, entity_id, vector_json."""
    own = entities.where(F.col("repo") == repo).select("run_id", "entity_id")
    last = own.agg(F.max("run_id").alias("last"))
    held = own.join(F.broadcast(last), F.col("run_id") == F.col("last"), "left_semi")  # one row
    if ids is not None:
        held = held.join(ids.select("entity_id"), "entity_id", "left_semi")
    parsed = vectors.withColumn("vector", F.from_json("vector_json", "array<double>")).where("vector IS NOT NULL")
    return parsed.join(held, ["run_id", "entity_id"], "left_semi").select("run_id", "entity_id", "vector")


def state_of(states: DataFrame, repo: str) -> DataFrame:
    """The state of a repository's ingest, or the one that every repository begins with."""
    fields = states.select(*(c for c in states.columns if c != "repo"))
    begin = states.sparkSession.createDataFrame([tuple(START[c] for c in fields.columns)], fields.schema)
    own = states.where(F.col("repo") == repo)
    both = own.withColumn("known", F.lit(1)).unionByName(begin.select(F.lit(repo).alias("repo"), *fields.columns, F.lit(0).alias("known")))
    return both.orderBy(F.desc("known")).limit(1).drop("known")


def put(table: DataFrame, row: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``row`` in place of those of the same key."""
    return table.join(row.select(*key), key, "left_anti").unionByName(row)


def parsed_id(entity_id: Column) -> Column:
    """kind and number of ``kind:number``; an error for any other kind."""
    kind, number = F.split_part(entity_id, F.lit(":"), F.lit(1)), F.split_part(entity_id, F.lit(":"), F.lit(2))
    ok = kind.isin("pr", "issue") & number.rlike("^[0-9]+$")
    return F.when(ok, F.struct(kind.alias("kind"), number.cast("long").alias("number"))).otherwise(F.raise_error(F.concat(F.lit("no entity id: "), entity_id)))


def slug(url: Column, host: str) -> Column:
    """owner/name at the end of a remote address of ``host``, or null."""
    found = F.regexp_extract(F.trim(url), host.replace(".", r"\.") + r"[:/]([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?)(?:\.git)?$", 1)
    return F.nullif(found, F.lit(""))


def approvals(reviews: Column) -> Column:
    return F.size(F.filter(reviews, lambda r: F.upper(r["state"]) == "APPROVED"))


def lineage(shas: Column) -> Column:
    """Distinct digests of commits, in their order."""
    return F.transform(F.array_distinct(shas), F.sha1)


def coverage(fingerprints: DataFrame, low: float = 0.8) -> DataFrame:
    """prs, bare (without files and hunks), share, is_low of the pull requests."""
    bare = (F.size("changed_files") == 0) & (F.size("hunk_signatures") == 0)
    counts = fingerprints.where("lane = 'pr'").agg(F.count("*").alias("prs"), F.count_if(bare).alias("bare"))
    share = F.when(F.col("prs") > 0, F.col("bare") / F.col("prs")).otherwise(0.0)
    return counts.withColumn("share", share).withColumn("is_low", (F.col("prs") > 0) & (F.col("share") >= low))


def linkage(entities: DataFrame) -> DataFrame:
    """Clusters from references alone, of two members or more: component (smallest id), size, cluster_type, canonical_pr,
    canonical_issue, canonical, attention, pressure, priority, by priority and size.

    The canonical one of a kind is the last updated, of equal ones the first by id."""
    refs = entities.select(F.col("id").alias("a"), F.explode(F.array_union("linked_issues", "soft_linked_issues")).alias("ref"))
    issues = entities.where("kind = 'issue'").select(F.col("id").alias("b"), F.col("number").cast("string").alias("ref"))
    placed = components(refs.join(issues, "ref").where("a <> b"))
    rows = placed.join(entities.select(F.col("id").alias("node"), "kind", "updated_at", "comment_count", "reaction_total"), "node")
    newest = lambda kind: F.max_by("node", F.when(F.col("kind") == kind, F.struct("updated_at", "back")))
    # The id that comes first wins a tie: its place from the end is the largest.
    order = Window.partitionBy("component", "kind", "updated_at").orderBy(F.desc("node"))
    rows = rows.withColumn("back", F.row_number().over(order))
    prs = F.count_if(F.col("kind") == "pr")
    both = F.count_if(F.col("kind") == "issue")
    found = rows.groupBy("component").agg(
        F.count("*").alias("size"), prs.alias("prs"), both.alias("issues"), newest("pr").alias("canonical_pr"), newest("issue").alias("canonical_issue"),
        F.sum(F.when(F.col("kind") == "issue", attention(F.col("comment_count"), F.col("reaction_total"))).otherwise(0.0)).alias("attention"),
    ).where("size >= 2")
    kind = F.when((F.col("prs") > 0) & (F.col("issues") > 0) & (F.col("size") == 2), "linked_pair").when((F.col("prs") > 0) | (F.col("issues") > 0), "duplicate_candidate")
    pressure = (F.col("size") - 1).cast("double")
    return found.select(
        "component", "size", kind.otherwise("mixed_pair").alias("cluster_type"), "canonical_pr", "canonical_issue", F.coalesce("canonical_pr", "canonical_issue").alias("canonical"),
        "attention", pressure.alias("pressure"), (0.45 * F.col("attention") + 0.35 * F.col("size") + 0.2 * pressure).alias("priority"),
    ).orderBy(F.desc("priority"), F.desc("size"), "component")


def served(report: DataFrame | None, fallback: DataFrame, kind: str = "all", min_members: int = 2, most: int = 200) -> DataFrame:
    """Summaries of a stored run within the asked bounds, or those of the linkage where there are none."""

    def within(rows: DataFrame) -> DataFrame:
        kept = rows.where(F.col("size") >= min_members)
        return (kept if kind == "all" else kept.where(F.col("cluster_type") == kind)).orderBy(F.desc("priority"), F.desc("size"), "component").limit(most)

    if report is not None and not (found := within(report)).isEmpty():
        return found
    return within(fallback)


def author_pairs(members: DataFrame, weight: float = 0.6) -> DataFrame:
    """Members of one cluster by one author: cluster_id, source, target, weight. A chain in id order, so that an author of
    many members makes as many links; ``all_pairs`` of a page's few members is for :func:`author_pairs_of`."""
    order = Window.partitionBy("cluster_id", "author").orderBy("entity_id")
    linked = members.where("author IS NOT NULL").withColumn("target", F.lead("entity_id").over(order))
    return linked.where("target IS NOT NULL").select("cluster_id", F.col("entity_id").alias("source"), "target", F.lit(weight).alias("weight"))


def author_pairs_of(members: DataFrame, cluster_id: str, most: int = 200, weight: float = 0.6) -> DataFrame:
    """All pairs of one author among the first ``most`` members of one cluster, which a page shows."""
    shown = members.where((F.col("cluster_id") == cluster_id) & F.col("author").isNotNull()).orderBy("entity_id").limit(most)
    a, b = shown.select("author", F.col("entity_id").alias("source")), shown.select("author", F.col("entity_id").alias("target"))
    return a.join(b, "author").where("source < target").select("source", "target", F.lit(weight).alias("weight"))


def node_cap(nodes: DataFrame, most: int) -> DataFrame:
    """At most ``most`` nodes of a map, canonical ones first, then by signal (positive ``most``; else all)."""
    order = (F.desc("canonical"), F.desc("signal"), "entity_id")
    return nodes.orderBy(*order).limit(most) if most > 0 else nodes.orderBy(*order)


def node_size(priority: Column) -> Column:
    return F.greatest(F.lit(12.0), F.least(F.lit(80.0), 12.0 + priority * 1.5))


def newest(entities: DataFrame, most: int) -> DataFrame:
    return entities.orderBy(F.desc("updated_at"), "id").limit(most)


def authors(rollup: DataFrame, metrics: DataFrame, most: int = 100) -> DataFrame:
    """author, open_prs, open_issues, association, merged_pr_count, trust_score by trust, merged and open pull requests.

    rollup: author, open_prs, open_issues, association, trust; metrics: author, merged_pr_count, trust_score."""
    both = rollup.join(metrics.select("author", "merged_pr_count", "trust_score"), "author", "left")
    trust = F.round(F.greatest("trust", F.coalesce("trust_score", F.lit(0.0))), 3)
    found = both.select("author", "open_prs", "open_issues", "association", F.coalesce("merged_pr_count", F.lit(0)).cast("long").alias("merged_pr_count"), trust.alias("trust_score"))
    return found.orderBy(F.desc("trust_score"), F.desc("merged_pr_count"), F.desc("open_prs"), "author").limit(most)
