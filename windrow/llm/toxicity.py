"""Toxicity by weak supervision.

1. Terms: whole words and word beginnings of 3 to 6 letters that labelled documents hold far more often when toxic.
2. Voters: the terms are dealt into lexicon voters by kind and rank (toxic where one of theirs occurs); patterns vote
   on shouting, marks and addressed insults; one voter says clean where no term occurs. They vote on labelled and on
   unlabelled documents alike.
3. Label model: EM estimates each voter's accuracies given the hidden class (abstaining
   included) and, from the residuals, the correlations between voters; correlated voters count less in the posterior.
   Given labels only say how often class 1 is and what the voters' first accuracies are; in EM they do not vote.
4. A logistic regression on term presence and the number of hits learns the posterior labels and scores every text.

Labels are learned from at most ``sample`` rows outside the held-out fold, and as many other documents outside it vote,
both chosen by a hash of the id (of an id that stands more than once one text); id, source and language never enter a
score.

Cases: null and empty texts are scored as texts without a term; null, repeated or unmatched labels are passed over
(of repeated ones the largest holds); without labels every score is the prior, 0.1; repeated rows give repeated
results; terms of equal weight are taken by name; very long texts count with all their words; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import crc_mod, id_text, numbered, offsets, one_each, slices, words_of
from windrow.session import materialise

FOLDS, HELD = 5, 0
LETTERS = regex.compile(r"\p{L}+")
BEGINNINGS = (3, 4, 5, 6)
GROUPS = 4
ADDRESSED = re.compile(r"(?i)\b(?:you|he|she|they|it|this)\b(?:\s+\S+){0,2}\s+(?:is|are)\b")


@dataclass
class Model:
    """index: term -> column; weights: one a term, then the log of hits, then the intercept."""

    index: dict[str, int]
    weights: np.ndarray


def terms_of(word: str) -> list[str]:
    """The terms that one word between blanks holds: its letter runs, and their beginnings marked with a star."""
    out = []
    for run in LETTERS.findall(word.lower()):
        out.append(run)
        out += [run[:n] + "*" for n in BEGINNINGS if len(run) > n]
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term: all and toxic ones, combined in the task."""
    held: Counter[str] = Counter()
    toxic: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        names = list(held)
        return pa.record_batch([pa.array(names, pa.string()), pa.array([held[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())], ["term", "n", "bad"])

    for batch in batches:
        for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = {t for w in set(words_of(text)) for t in terms_of(w)}
            held.update(found)
            if y:
                toxic.update(found)
        if len(held) > 300_000:
            yield out()
            held.clear()
            toxic.clear()
    yield out()


def hits(texts: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse term counts: document, column, times."""
    words = [words_of(t) for t in texts]
    place, distinct = numbered([w for ws in words for w in ws])
    columns = [[index[t] for t in terms_of(w) if t in index] for w in distinct]
    n = np.fromiter(map(len, columns), np.int64, len(columns))
    flat, at = np.fromiter((c for cs in columns for c in cs), np.int64, int(n.sum())), offsets(n)
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    spot = np.flatnonzero(n[place]) if len(place) else np.zeros(0, np.int64)
    docs = np.repeat(doc[spot], n[place[spot]]) if len(spot) else np.zeros(0, np.int64)
    cols = np.concatenate([flat[at[p] : at[p + 1]] for p in place[spot]]) if len(spot) else np.zeros(0, np.int64)
    pair, times = np.unique(docs * max(len(index), 1) + cols, return_counts=True)
    return pair // max(len(index), 1), pair % max(len(index), 1), times


def patterns(texts: list[str]) -> np.ndarray:
    """Pattern votes: 1 where the pattern holds, else -1 (abstain)."""
    out = np.full((len(texts), 3), -1)
    for i, t in enumerate(texts):
        upper = sum(map(str.isupper, t))
        out[i, 0] = 1 if len(t) > 20 and upper > 0.6 * len(t) else -1
        out[i, 1] = 1 if t.count("!") > 0.05 * max(len(t), 1) else -1
        out[i, 2] = 1 if ADDRESSED.search(t) else -1
    return out


def choose_terms(counts: DataFrame, n_docs: int, n_bad: int, most: int) -> list[str]:
    """Terms that at least three toxic documents hold, at five times the others' rate or more; the ``most`` best."""
    rate_bad, rate_ok = F.col("bad") / max(n_bad, 1), (F.col("n") - F.col("bad") + 0.5) / max(n_docs - n_bad + 1, 1)
    summed = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    best = (
        summed.where((F.col("bad") >= 3) & (rate_bad > 5 * rate_ok))
        .select("term", (F.sqrt("bad") * F.log(rate_bad / rate_ok)).alias("weight"))
        .orderBy(F.desc("weight"), "term")
        .limit(most)
    )
    return [r["term"] for r in best.collect()]


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1, accuracies [voter, class, vote], correlations. Votes are -1 (abstain), 0 or 1.

    ``start``: first posteriors of some rows (nan: none), from which the first accuracies are estimated."""
    n, m = votes.shape
    coded = votes + 1
    given = ~np.isnan(start)
    q = np.where(given, start, 0.0)
    weight, posterior = given.astype(float), q
    discount, correlation = np.ones(m), np.eye(m)
    for step in range(rounds):
        theta = np.empty((m, 2, 3))
        for j in range(m):
            for y, w in ((0, weight * (1 - posterior)), (1, weight * posterior)):
                got = np.bincount(coded[:, j], w, 3) + 0.5
                theta[j, y] = got / got.sum()
        if step in (5, 15):
            fired = (votes == 1).astype(float)
            expected = posterior[:, None] * theta[:, 1, 2] + (1 - posterior[:, None]) * theta[:, 0, 2]
            residual = fired - expected
            spread = np.sqrt((residual**2).mean(axis=0)) + 1e-9
            correlation = (residual.T @ residual) / n / np.outer(spread, spread)
            discount = 1 / (1 + np.clip(correlation - np.eye(m), 0, 1).sum(axis=1))
        odds = np.log(prior / (1 - prior)) + sum(
            discount[j] * (np.log(theta[j, 1]) - np.log(theta[j, 0]))[coded[:, j]] for j in range(m)
        )
        posterior, weight = 1 / (1 + np.exp(-np.clip(odds, -30, 30))), np.ones(n)
    return posterior, theta, correlation


def _inputs(docs: np.ndarray, cols: np.ndarray, times: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense inputs of n documents: presence of each of k terms, log of hits, 1."""
    x = np.zeros((n, k + 2), np.float32)
    x[docs, cols] = 1
    total = np.bincount(docs, times, n) if len(docs) else np.zeros(n)
    x[:, k], x[:, k + 1] = np.log1p(total), 1
    return x, total


def logistic(x: np.ndarray, q: np.ndarray, rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Full-batch descent with Adagrad steps on soft labels."""
    w, square = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30).astype(float)))
        g = x.T @ (p - q).astype(x.dtype) / len(q) + l2 * w
        square += g**2
        w -= rate * g / np.sqrt(square)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most_terms: int = 400) -> Model:
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__y"))
        .where("__id IS NOT NULL AND __y IS NOT NULL")
        .where(crc_mod(F.col("__id"), FOLDS) != HELD)
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    known = {r["__id"]: r["__y"] for r in chosen.collect()}
    if not known:
        return Model({}, np.array([0.0, np.log(0.1 / 0.9)]))
    own = id_text(docs).where(crc_mod(F.col("doc_id"), FOLDS) != HELD).where("doc_id IS NOT NULL")
    share = min(1.0, 3 * sample / max(docs.count(), 1))
    drawn = own.select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("h")).where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 <= share)
    drawn = {r["doc_id"]: None for r in drawn.distinct().orderBy("h", "doc_id").limit(sample).collect()}
    small = docs.sparkSession.createDataFrame(list((drawn | known).items()), "__id long, __y int")  # at most 2 x `sample` rows
    voting = own.join(F.broadcast(small), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y")
    voting = materialise(one_each(voting, "__y"), "voting")
    picked = voting.where("__y IS NOT NULL")
    n_bad = sum(known.values())
    terms = choose_terms(picked.mapInArrow(_term_counts, "term string, n long, bad long"), len(known), n_bad, most_terms)
    index = {t: i for i, t in enumerate(terms)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, ys = (batch.column(c).to_pylist() for c in range(3))
            texts = [t or "" for t in texts]
            d, c, t = hits(texts, index)
            at = offsets(np.bincount(d, minlength=len(texts)))
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(ys, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(t, pa.int64())),
                    pa.array(patterns(texts).tolist(), pa.list_(pa.int64())),
                ],
                ["i", "y", "cols", "times", "patterns"],
            )

    rows = voting.mapInArrow(gather, "i long, y int, cols array<long>, times array<long>, patterns array<long>").collect()
    rows.sort(key=lambda r: (r["i"], r["cols"]))
    n, k = len(rows), len(terms)
    if not n:
        return Model({}, np.array([0.0, np.log(0.1 / 0.9)]))
    d = np.repeat(np.arange(n), [len(r["cols"]) for r in rows])
    c = np.array([x for r in rows for x in r["cols"]], np.int64)
    t = np.array([x for r in rows for x in r["times"]], np.int64)
    x, total = _inputs(d, c, t, n, k)
    kind = np.array([min(len(term), 7) - 3 if term.endswith("*") else 0 for term in terms], np.int64)
    group = kind * GROUPS + np.arange(k) % GROUPS
    lexicons = [np.where(x[:, :k][:, group == g].any(axis=1), 1, -1) for g in np.unique(group)]
    start = np.array([np.nan if r["y"] is None else float(r["y"]) for r in rows])
    votes = np.column_stack([*lexicons, np.array([r["patterns"] for r in rows]), np.where(total > 0, -1, 0)])
    if not np.isfinite(start).any():
        return Model({}, np.array([0.0, np.log(0.1 / 0.9)]))
    posterior, _, _ = label_model(votes, start, float(np.clip(np.nanmean(start), 0.01, 0.99)))
    return Model(index, logistic(x, posterior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        k = len(now.index)
        for ids, texts in slices(batches, 3_000_000):
            d, c, t = hits(texts, now.index)
            x, _ = _inputs(d, c, t, len(texts), k)
            z = x @ now.weights
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    found = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def detect(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    return score(docs, train(docs, labels, sample))
