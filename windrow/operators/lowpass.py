"""The noise filter: one chain of predicates, the first that holds decides; soft reasons add up."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.text import lines, tokens

# Beginnings and whole lines of issue templates.
TEMPLATE_PREFIXES = (
    "## summary", "## steps to reproduce", "## expected behavior", "## actual behavior", "## proposed solution",
    "## additional context",
)
TEMPLATE_LINES = ("what went wrong?", "what did you expect to happen?", "what actually happened?", "1.", "2.", "3.")


def is_template(line: Column) -> Column:
    low = F.lower(line)
    found = low.isin(*TEMPLATE_LINES)
    for prefix in TEMPLATE_PREFIXES:
        found = found | low.startswith(prefix)
    return found


def content_lines(body: Column) -> Column:
    return F.filter(lines(body), lambda x: ~is_template(x))


def template_noise(body: Column, threshold: float, most_tokens: int) -> Column:
    """Mostly template lines and little else; an empty body is not."""
    every, content = lines(body), content_lines(body)
    ratio = (F.size(every) - F.size(content)) / F.greatest(F.size(every), F.lit(1))
    return (F.size(every) > 0) & (ratio >= threshold) & (F.size(tokens(F.array_join(content, "\n"))) <= most_tokens)


def one_liner(body: Column, most_tokens: int) -> Column:
    """At most one content line of few tokens; an empty body is one."""
    content = content_lines(body)
    return (F.size(content) <= 1) & (F.size(tokens(F.array_join(content, "\n"))) <= most_tokens)


def docs_only(files: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    def one(path: Column) -> Column:
        low, found = F.lower(path), F.lit(False)
        for p in prefixes:
            found = found | low.startswith(p.lower())
        for s in suffixes:
            found = found | low.endswith(s.lower())
        return found

    return (F.size(files) > 0) & F.forall(files, one)


def churn(additions: Column, deletions: Column) -> Column:
    return F.greatest(additions, F.lit(0)) + F.greatest(deletions, F.lit(0))


def _state(action: str, default: str) -> str:
    """``close`` and ``skip`` skip, ``pass`` passes, anything else gives the default."""
    return {"skip": "skip", "close": "skip", "pass": "pass"}.get(action, default)


def apply(entities: DataFrame, cfg: dict[str, Any], as_of: Column) -> DataFrame:
    """``entities`` with filter_state, action, reason_codes and priority_weight."""
    c = cfg["low_pass"]
    labels = F.transform("labels", F.lower)
    is_pr, is_issue = F.col("kind") == "pr", F.col("kind") == "issue"
    old = lambda days: F.col("updated_at") < as_of - F.make_dt_interval(days=F.lit(days))
    hours = lambda h: as_of - F.make_dt_interval(hours=F.lit(int(h)))

    def any_label(names: list[str]) -> Column:
        return F.arrays_overlap(labels, F.array(*(F.lit(x.lower()) for x in names))) if names else F.lit(False)

    early: list[tuple[Column, str, str, str, float]] = []

    def rule(when: Column, reason: str, state: str, action: str = "ignore", weight: float = 0.0) -> None:
        early.append((when, reason, state, "close" if action == "close" else "ignore", weight))

    if c["skip_closed"]:
        rule(F.lower("state") != "open", "CLOSED_STATE", "skip")
    if c["skip_drafts"]:
        rule(F.col("is_draft"), "DRAFT_PR", "skip")
    rule(any_label(c["hard_skip_labels"]), "HARD_SKIP_LABEL", "skip")
    if c["stale_days"] is not None:
        rule(old(c["stale_days"]), "STALE", _state(c["stale_action"], "skip"), c["stale_action"])
    if c["ignore_recent_pr_hours"] is not None:
        rule(is_pr & (F.col("updated_at") >= hours(c["ignore_recent_pr_hours"])), "RECENT_PR", "suppress", weight=1.0)
    noise = template_noise(F.col("body"), c["issue_template_match_threshold"], c["issue_template_max_content_tokens"])
    rule(is_issue & noise, "ISSUE_TEMPLATE_NOISE", _state(c["issue_template_action"], "suppress"), c["issue_template_action"])
    short = one_liner(F.col("body"), c["issue_one_liner_max_tokens"])
    rule(is_issue & short, "ISSUE_ONE_LINER", _state(c["issue_one_liner_action"], "suppress"), c["issue_one_liner_action"])
    if c["pr_min_body_tokens"] > 0:
        bare = (F.size(tokens(F.col("body"))) < c["pr_min_body_tokens"]) & (F.size("linked_issues") + F.size("soft_linked_issues") == 0)
        rule(is_pr & bare, "PR_MISSING_CONTEXT", _state(c["pr_min_body_action"], "suppress"), c["pr_min_body_action"])
    large = (F.size("changed_files") > c["pr_large_max_files"]) | (churn(F.col("additions"), F.col("deletions")) > c["pr_large_max_churn"])
    rule(is_pr & large, "PR_LARGE_CHANGESET", _state(c["pr_large_action"], "skip"), c["pr_large_action"])
    if c["pr_unenriched_max_age_hours"] is not None:
        empty = (F.size("changed_files") == 0) & (F.size("diff_hunks") == 0) if "diff_hunks" in entities.columns else F.size("changed_files") == 0
        stale = F.col("updated_at") < hours(c["pr_unenriched_max_age_hours"])
        rule(is_pr & empty & stale, "PR_UNENRICHED", _state(c["pr_unenriched_action"], "suppress"), c["pr_unenriched_action"])

    soft: list[tuple[Column, str]] = [(any_label(c["soft_suppress_labels"]), "SOFT_SUPPRESS_LABEL")]
    if c["suppress_docs_only_if_no_ci"]:
        only = docs_only(F.col("changed_files"), c["docs_prefixes"], c["docs_suffixes"])
        soft.append((only & (F.col("ci_status") == "unknown"), "LOW_SIGNAL_DOCS_ONLY"))
    if c["suppress_bot_authors"]:
        bot = F.coalesce(F.col("is_bot"), F.lit(False))
        for pattern in c["bot_patterns"]:
            bot = bot | F.contains(F.lower("author"), F.lit(pattern.lower()))
        soft.append((bot, "BOT_SUPPRESSED"))
    boosts = [(F.array_contains(labels, name.lower()), float(w), f"BOOST_{name.upper().replace('-', '_').replace(' ', '_')}") for name, w in c["boost_labels"].items()]
    reasons = F.array_compact(F.array(*(F.when(x, name) for x, name in soft), *(F.when(x, name) for x, _, name in boosts)))
    suppressed = F.lit(False)
    for x, _ in soft:
        suppressed = suppressed | F.coalesce(x, F.lit(False))
    weight = F.greatest(F.lit(1.0), F.lit(1.0), *(F.when(x, w).otherwise(1.0) for x, w, _ in boosts))
    state = F.when(suppressed, "suppress").otherwise("pass")
    action = F.lit("ignore")
    for when, reason, its_state, its_action, its_weight in reversed(early):
        held = F.coalesce(when, F.lit(False))
        state = F.when(held, its_state).otherwise(state)
        action = F.when(held, its_action).otherwise(action)
        reasons = F.when(held, F.array(F.lit(reason))).otherwise(reasons)
        weight = F.when(held, F.lit(its_weight)).otherwise(weight)
    return entities.withColumns(
        {"filter_state": state, "action": action, "reason_codes": reasons, "priority_weight": weight.cast("double")}
    )


def reason_histogram(filtered: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent reasons without boosts: reason, n."""
    reasons = filtered.select(F.explode("reason_codes").alias("reason")).where(~F.col("reason").startswith("BOOST_"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)
