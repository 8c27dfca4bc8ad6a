"""Reports over authors and links, and rendered Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _link(base: Column | str, *parts: Column | str) -> Column:
    """Text and columns in a row."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in (base, *parts)))


def authors_overview(rows: DataFrame, base: str, most: int = 50) -> DataFrame:
    """rows: author, kind, state, is_draft, created (date). Open or draft rows by author (case aside): all, and those of
    the trailing 14 and 7 days, which end at the last day of all; links to searches under ``base``."""
    kept = rows.where((F.col("state") == "open") | F.col("is_draft"))
    last = kept.agg(F.max("created").alias("last"))
    dated = kept.where(F.col("author").isNotNull()).crossJoin(F.broadcast(last))  # one row
    n = lambda c, name: F.count_if(c).alias(name)
    pr, issue = F.col("kind") == "pr", F.col("kind") == "issue"
    within = lambda days: F.col("created") >= F.date_sub("last", days - 1)
    found = dated.groupBy(F.lower("author").alias("author_lc")).agg(
        F.min("author").alias("author"), F.count("*").alias("total_all"), n(pr, "prs_all"), n(issue, "issues_all"),
        n(within(14), "total_14d"), n(within(14) & pr, "prs_14d"), n(within(14) & issue, "issues_14d"), n(within(7), "total_7d"), F.max("last").alias("last"),
    )
    query, author = f"{base}/issues?q=author%3A", F.col("author")
    days = _link("+created%3A", F.date_sub("last", 13), "..", F.col("last"), "+sort%3Acreated-desc")
    found = found.withColumns({"all_link": _link(query, author, "+sort%3Acreated-desc"), "last14_link": _link(query, author, days)})
    return found.drop("author_lc", "last").orderBy(F.desc("total_all"), F.desc("total_14d"), "author").limit(most)


def authors_closed_stale(rows: DataFrame, base: str, min_total: int = 1, min_closed: int = 1, min_stale: int = 1, most: int = 50) -> DataFrame:
    """rows: author, state, is_draft, created, updated (dates). By author (case aside): closed rows, those closed in the 14
    days up to the last update of all, open or draft rows, and those made 14 and 30 days before the last one of all."""
    held = rows.where(F.col("author").isNotNull())
    last = held.agg(F.max("created").alias("last_made"), F.max("updated").alias("last_seen"))
    alive, closed = (F.col("state") == "open") | F.col("is_draft"), F.col("state") == "closed"
    n = lambda c, name: F.count_if(c).alias(name)
    found = held.crossJoin(F.broadcast(last)).groupBy(F.lower("author").alias("author_lc")).agg(
        F.min("author").alias("author"), n(alive, "total"), n(closed & (F.col("updated") >= F.date_sub("last_seen", 13)), "closed_14d"),
        n(closed, "closed_total"), n(alive, "open_total"), n(alive & (F.col("created") <= F.date_sub("last_made", 14)), "stale_open_age14"),
        n(alive & (F.col("created") <= F.date_sub("last_made", 30)), "stale_open_age30"), F.max("last_made").alias("last_made"),
    )
    query, author = f"{base}/issues?q=author%3A", F.col("author")
    found = found.withColumns({
        "all_link": _link(query, author, "+sort%3Acreated-desc"),
        "closed_link": _link(query, author, "+is%3Aclosed+sort%3Aupdated-desc"),
        "stale_link": _link(query, author, "+is%3Aopen+created%3A..", F.date_sub("last_made", 14), "+sort%3Acreated-asc"),
    })
    kept = found.where((F.col("total") >= min_total) & ((F.col("closed_14d") >= min_closed) | (F.col("stale_open_age14") >= min_stale)))
    return kept.drop("author_lc", "last_made").orderBy(F.desc("closed_14d"), F.desc("stale_open_age14"), F.desc("total"), "author").limit(most)


def linked_closed(rows: DataFrame, base: str, most: int = 50) -> DataFrame:
    """rows: kind, state, is_draft, number, author, created, updated, title, linked_issues, soft_linked_issues of one
    repository. Open or draft pull requests that link a closed issue, with their links by number and how they link."""
    prs = rows.where((F.col("kind") == "pr") & ((F.col("state") == "open") | F.col("is_draft")))
    who = ["number", "author", "created", "updated", "title"]
    links = None
    for column, how in (("linked_issues", "hard"), ("soft_linked_issues", "soft")):
        part = prs.select(*who, F.explode(column).alias("ref"), F.lit(how).alias("how"))
        links = part if links is None else links.unionByName(part)
    links = links.withColumn("ref", F.col("ref").cast("long"))
    refs = links.groupBy(*who, "ref").agg(F.array_join(F.array_sort(F.collect_list("how")), ",").alias("how"))
    state = rows.where(F.col("kind") == "issue").select(F.col("number").cast("long").alias("ref"), F.col("state").alias("ref_state"))
    joined = refs.join(state, "ref", "left")
    closed = F.col("ref_state") == "closed"
    in_order = lambda c, when: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ref", c.alias("shown"))))), lambda x: x["shown"]), ", "
    )
    number = _link("#", F.col("ref"))
    found = joined.groupBy(*who).agg(
        F.count("*").alias("total_issue_links"), F.count_if(closed).alias("closed_issue_links"),
        in_order(number, F.lit(True)).alias("all_issue_refs"), in_order(_link(number, " [", F.col("how"), "]"), closed).alias("closed_issue_refs"),
    )
    order = (F.desc("closed_issue_links"), F.desc("total_issue_links"), "created", "number")
    return found.where("closed_issue_links > 0").withColumn("pr_link", _link(f"{base}/pull/", F.col("number"))).orderBy(*order).limit(most)


def display(entity_id: Column, title: Column) -> Column:
    """id and the quoted title, or the id alone."""
    return F.when(F.coalesce(title, F.lit("")) == "", entity_id).otherwise(F.concat(entity_id, F.lit(' — "'), title, F.lit('"')))


def type_histogram(types: DataFrame) -> DataFrame:
    return types.groupBy("cluster_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_type")


def markdown(types: DataFrame, decisions: DataFrame, titles: DataFrame, most: int = 200) -> str:
    """The triage report of at most ``most`` clusters with more than one member, largest first."""
    lines = ["# Triage report", ""]
    lines += [f"- {r['cluster_type']}: {r['n']}" for r in type_histogram(types).collect()]
    chosen = types.where("n > 1").orderBy(F.desc("n"), "cluster_id").limit(most)
    rows = (
        decisions.join(F.broadcast(chosen), "cluster_id")
        .join(titles, "entity_id", "left")
        .groupBy("cluster_id", "cluster_type", "n")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), display(F.col("entity_id"), F.col("title")).alias("d"), "state"))).alias("members"))
        .orderBy(F.desc("n"), "cluster_id")
    )
    for r in rows.collect():
        lines += ["", f"## {r['cluster_id']} ({r['cluster_type']}, {r['n']} members)"]
        lines += [f"- {m['d']}: {m['state']}, {-m['s']:.3f}" for m in r["members"]]
    return "\n".join(lines) + "\n"


def write_bundle(path: str, **tables: DataFrame) -> None:
    """Each table as JSON lines under ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
