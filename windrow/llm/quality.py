"""Quality rules: counts of a whole text, a base rule, and boosted trees over document statistics.

The trees learn ``labels.quality`` from at most ``sample`` labelled documents (chosen by a hash of the id) and
score every document; of an id that stands more than once one text is learned from. They are monotonic in the shares of symbols, repeated lines and repeated words (more is
never better).

Cases: null and empty texts have no words and fail the base rule; labels that are null, repeated or without a
document are passed over (of repeated labels the smallest holds); without labels the trees keep what the base
rule keeps; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm import trees
from windrow.llm.common import id_text, offsets, one_each, slices, windows, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Kinds of bytes whose shares are features.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "mark": b"!?",
    "stop": b".,;:",
    "bar": b"|",
    "line": b"\n",
    "other": bytes(range(33, 48)) + b"<=>@[\\]^_`{}~",
}
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", *KINDS, "wide", "mean_line",
)
MONOTONE = {FEATURES.index("symbols"): -1, FEATURES.index("dup_lines"): -1, FEATURES.index("repeats"): -1}
BLANK = " \t\n\v\f\r"


def _repeats(h: np.ndarray, at: np.ndarray, width: int = 5) -> np.ndarray:
    """For each document, its words that stand in a ``width``-word window found twice or more in it."""
    counts = np.diff(at)
    out = np.zeros(len(counts), np.int64)
    w = windows(h, width)
    if not len(w):
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = doc[: len(w)] == doc[width - 1 :]
    start = np.flatnonzero(inside)
    key = w[start] + doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return out
    spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hits = start[twice[spot] == key]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + width, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(counts))


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The five base counts (columns in the order of BASE) and the features (in the order of FEATURES)."""
    n = len(texts)
    words = [words_of(t) for t in texts]
    at = offsets(map(len, words))
    flat = [w for ws in words for w in ws]
    h = word_hashes(flat)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    total = np.concatenate([[0], np.cumsum(lengths)])
    base = np.zeros((n, 5), np.int64)
    base[:, 0] = np.diff(at)
    base[:, 1] = total[at[1:]] - total[at[:-1]]
    base[:, 2] = [sum(map(t.count, SYMBOLS)) for t in texts]
    lines = [[x for x in t.split("\n") if x.strip(BLANK)] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    base[:, 3] = n_lines - np.array([len(set(x)) for x in lines], np.int64)
    base[:, 4] = _repeats(h, at)
    distinct = np.array([len(set(ws)) for ws in words], np.int64)

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = offsets(map(len, raw))
    table = np.zeros(256, np.uint8)
    for k, chars in enumerate(KINDS.values()):
        table[list(chars)] = k + 1
    table[128:] = len(KINDS) + 1
    kinds = len(KINDS) + 2
    bytes_of = np.array([np.bincount(table[np.frombuffer(r, np.uint8)], minlength=kinds) for r in raw]).reshape(n, kinds)
    size = np.maximum(np.diff(ends), 1)[:, None]
    nw = np.maximum(base[:, 0], 1)
    x = np.column_stack([
        np.log1p(base[:, 0]),
        base[:, 1] / nw,
        base[:, 2] / nw,
        base[:, 3] / np.maximum(n_lines, 1),
        base[:, 4] / nw,
        distinct / nw,
        bytes_of[:, 1:] / size,
        base[:, 0] / np.maximum(n_lines, 1),
    ])
    return base, x


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in slices(batches):
        _, x = statistics(texts)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **params) -> trees.Forest:
    """Trees for labels.quality from at most ``sample`` labelled documents."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y"))
        .where("__id IS NOT NULL AND __y IS NOT NULL")
        .groupBy("__id")
        .agg(F.min("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    known = {r["__id"]: r["__y"] for r in chosen.collect()}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in known] or [(-1,)], "__id long")  # at most `sample` rows
    picked = id_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi")
    rows = one_each(picked).mapInArrow(_features, "doc_id long, x array<double>").collect()
    rows = sorted((r["doc_id"], tuple(r["x"])) for r in rows if r["doc_id"] in known)
    x = np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES))
    return trees.fit(x, np.array([known[r[0]] for r in rows], float), MONOTONE, **params)


def rate(docs: DataFrame, forest: trees.Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            base, x = statistics(texts)
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            score = sent.value.score(x)
            columns = [pa.array(ids, pa.int64()), *(pa.array(base[:, k]) for k in range(5))]
            columns += [pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.record_batch(columns, ["doc_id", *BASE, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return id_text(docs).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    return rate(docs, train(docs, labels, sample))
