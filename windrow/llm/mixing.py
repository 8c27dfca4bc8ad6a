"""Mixing sources to target weights with soft membership (DataFrame functions only).

1. Domains come from the table ``labels``: ``toxic`` (toxic = 1), ``low`` (quality = 0), else ``clean``. A naive Bayes
   classifier over binned statistics of a text and over one list of words (those that toxic labelled documents hold far
   more often) predicts the posteriors of the domains for every document. It learns from at most ``sample`` labelled
   documents, chosen by a hash of the id; all its tables are small literals of the plan.
2. Every document has a rate r >= 0, the expected number of its copies, starting at 1. Projected gradient steps of the
   least-squares fit of the domain token totals sum(r * tokens * posterior) to ``weights`` times the budget move the
   rates by a combination of the posteriors and clip them at 0. Steps are scaled by the Gram matrix of the posteriors,
   so a few rounds suffice. A round is one aggregate of a few numbers over all documents; since the moves are the same
   few numbers for every document, a rate is an expression over its posteriors, and no round is a join.
3. Copies: the whole part of the rate, and one more with the probability of its fraction (by a hash of the id).

Cases: null and empty texts have no tokens and rate as texts without statistics do; labels that are null, repeated or
unmatched are passed over (of repeated ones the worst holds); without labels all posteriors are those of a domain
chosen evenly; a domain without any mass cannot meet its target and the others' targets hold; repeated rows give
repeated results; words of equal weight are taken by name; very long texts count whole; an empty table gives an empty
result; further columns are ignored by :func:`rates` and kept by :func:`thin`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import id_text, one_each
from windrow.session import materialise

DOMAINS = ("clean", "low", "toxic")
WORDS = r"[^\x20\x09-\x0D]+"
SPLIT = r"[\s\p{Punct}]+"
BINS = 8


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _level(x: Column, *edges: float) -> Column:
    """The number of edges that x reaches."""
    return reduce(lambda a, b: a + b, ((x >= e).cast("int") for e in edges))


def _bins(text: Column, words: list[str]) -> Column:
    """The statistics of a text as small numbers, each below BINS."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    listed = F.arrays_overlap(F.split(F.lower(text), SPLIT), F.array(*map(F.lit, words))) if words else F.lit(False)
    repeated = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    return F.array(
        listed.cast("int"),
        _level(F.length(text), 30, 80, 200, 600, 2000, 8000),
        _level(_count(text, "!") / size, 0.001, 0.01, 0.03, 0.1),
        _level(_count(text, "|") / size, 0.001, 0.01, 0.03, 0.1),
        _level((_count(text, "#") + _count(text, "*") + _count(text, "$") + _count(text, "%")) / size, 0.001, 0.01, 0.05),
        _level(repeated, 0.02, 0.1, 0.3, 0.6),
        _level(F.regexp_count(text, F.lit("[A-Z]{3}")) / size, 0.005, 0.05, 0.15, 0.25),
    )


STATISTICS = 7


@dataclass
class Plan:
    """All that was learned: the word list, log-likelihoods [statistic, bin, domain], log priors, moves of the rates."""

    words: list[str]
    tables: np.ndarray
    prior: np.ndarray
    moves: list[np.ndarray]
    #: The domain whose likely documents all stay at rate 1, with no rate above it; None: rates are only nonnegative.
    whole: int | None = None

    def posterior(self, bins: Column) -> Column:
        """The posteriors as an array. Each step binds its input once, so no statistic is computed again."""
        every = range(len(DOMAINS))

        def scores(b: Column) -> Column:
            return F.array(*(
                reduce(
                    lambda x, y: x + y,
                    (F.element_at(F.array(*(F.lit(float(v)) for v in self.tables[j, :, d])), b[j] + 1) for j in range(STATISTICS)),
                    F.lit(float(self.prior[d])),
                )
                for d in every
            ))

        masses = F.transform(F.transform(F.array(bins), scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        shares = F.transform(masses, lambda m: F.transform(m, lambda x: x / F.aggregate(m, F.lit(0.0), lambda t, y: t + y)))
        return shares[0]

    def rate(self, posterior: list[Column]) -> Column:
        r = F.lit(1.0)
        for move in self.moves:
            r = F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, (p * float(m) for p, m in zip(posterior, move, strict=True)), r))
            if self.whole is not None:
                r = F.least(F.lit(1.0), r)
        return r if self.whole is None else F.when(posterior[self.whole] >= 0.5, 1.0).otherwise(r)


def _labelled(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows: __id, __d (number of the domain)."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return (
        labels.select(F.col("doc_id").cast("long").alias("__id"), domain.alias("__d"))
        .where("__id IS NOT NULL AND __d IS NOT NULL")
        .groupBy("__id")
        .agg(F.max("__d").alias("__d"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )


def _word_list(picked: DataFrame, most: int = 200) -> list[str]:
    """Words that at least three toxic documents hold, at ten times the rate of the others."""
    picked = one_each(picked, "__d")
    word = F.explode(F.array_distinct(F.split(F.lower("text"), SPLIT))).alias("word")
    counts = picked.select((F.col("__d") == 2).cast("int").alias("bad"), word).groupBy("word").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    sums = picked.agg(F.count("*").alias("n"), F.sum((F.col("__d") == 2).cast("int")).alias("bad")).first()
    n_bad, n_ok = max(sums["bad"] or 0, 1), max((sums["n"] or 0) - (sums["bad"] or 0), 1)
    odds = (F.col("bad") / n_bad) / ((F.col("n") - F.col("bad") + 0.5) / n_ok)
    best = counts.where((F.col("bad") >= 3) & (odds > 10) & (F.length("word") > 2)).orderBy(F.desc(F.sqrt("bad") * F.log(odds)), "word")
    return [r["word"] for r in best.limit(most).collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    budget: float | None = None,
    whole: str | None = None,
    sample: int = 20_000,
    rounds: int = 8,
) -> tuple[Plan, DataFrame]:
    """The plan, and the table of doc_id, n_tokens and posteriors (p) that it was fitted on.

    The budget in tokens is the corpus itself, or ``budget``. With a domain ``whole`` the rates are projected between 0
    and 1, those of documents likelier of it than not onto 1, and the other domains' targets follow its total."""
    text = F.coalesce("text", F.lit(""))
    picked_ids = _labelled(labels, sample)
    picked = id_text(docs).join(F.broadcast(picked_ids), F.col("doc_id") == F.col("__id")).select("doc_id", text.alias("text"), "__d")
    words = _word_list(picked)
    table = materialise(
        id_text(docs).select("doc_id", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"), _bins(text, words).alias("bins")), "bins"
    )
    seen = table.join(F.broadcast(picked_ids), F.col("doc_id") == F.col("__id")).select("doc_id", "__d", "bins").distinct()
    seen = seen.select("__d", F.posexplode("bins").alias("j", "bin"))
    counts = np.ones((STATISTICS, BINS, len(DOMAINS)))
    for r in seen.groupBy("j", "bin", "__d").count().collect():
        counts[r["j"], r["bin"], r["__d"]] += r["count"]
    prior = counts[0].sum(axis=0) - BINS + 1
    plan = Plan(words, np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(prior / prior.sum()), [], DOMAINS.index(whole) if whole else None)

    k = len(DOMAINS)
    want = np.array([weights.get(d, 0.0) for d in DOMAINS])
    table = materialise(table.select("doc_id", "n_tokens", plan.posterior(F.col("bins")).alias("p")), "posteriors")
    p = [F.col("p")[d] for d in range(k)]
    tokens = F.col("n_tokens").cast("double")
    sums = table.agg(*(F.sum(tokens * p[d]).alias(f"s{d}") for d in range(k))).first()
    natural = np.array([sums[f"s{d}"] or 0.0 for d in range(k)])
    total = budget or natural.sum()
    target, before = want / want.sum() * total, np.inf
    free = [d for d in range(k) if d != plan.whole]  # the domains whose totals the rates can move
    for _ in range(rounds):
        r = plan.rate(p)
        active = (r > 0) if whole is None else (r > 0) & (p[plan.whole] < 0.5)
        active = active.cast("double")
        row = table.agg(
            *(F.sum(r * tokens * p[d]).alias(f"s{d}") for d in range(k)),
            *(F.sum(active * tokens * p[d] * p[e]).alias(f"g{d}{e}") for d in range(k) for e in range(d, k)),
        ).first()
        now = np.array([row[f"s{d}"] or 0.0 for d in range(k)])
        gram = np.array([[row[f"g{min(d, e)}{max(d, e)}"] or 0.0 for e in range(k)] for d in range(k)])
        if whole is not None:
            total = now[plan.whole] / max(want[plan.whole] / want.sum(), 1e-9)
            target = want / want.sum() * total
        gap = target - now
        missed = np.abs(gap[free]).max()
        if whole is not None and missed > 0.99 * before:  # what is left lies beyond the bounds of the rates
            plan.moves.pop()
            break
        if missed <= 1e-7 * max(total, 1.0):
            break
        before, move, inner = missed, np.zeros(k), gram[np.ix_(free, free)]
        move[free] = np.linalg.solve(inner + 1e-9 * max(np.trace(inner), 1.0) * np.eye(len(free)), gap[free])
        plan.moves.append(move)
    return plan, table


def _draw(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1))), F.lit(1_000_003)) / 1_000_003.0


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], **params) -> DataFrame:
    """doc_id, n_tokens, the posteriors, domain, rate and copies of every document."""
    plan, table = fit(docs, labels, weights, **params)
    found = table.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)))
    p = [F.col(f"p_{d}") for d in DOMAINS]
    best = F.greatest(*p)
    domain = F.when(p[0] == best, DOMAINS[0]).when(p[1] == best, DOMAINS[1]).otherwise(DOMAINS[2])
    found = found.withColumn("domain", domain).withColumn("rate", plan.rate(p))
    return found.withColumn("copies", F.floor(F.col("rate") + _draw(F.col("doc_id"))).cast("long"))


def thin(docs: DataFrame, labels: DataFrame, weights: dict[str, float], whole: str = "clean", **params) -> DataFrame:
    """The rows of ``docs`` that have a copy at rates between 0 and 1, at which documents likelier ``whole`` than not stay."""
    plan, _ = fit(docs, labels, weights, whole=whole, **params)
    share = plan.posterior(_bins(F.coalesce(F.col("text").cast("string"), F.lit("")), plan.words))
    draw = _draw(F.col("doc_id").cast("long"))

    return docs.where(F.exists(F.array(share), lambda p: F.floor(plan.rate([p[d] for d in range(len(DOMAINS))]) + draw) >= 1))
