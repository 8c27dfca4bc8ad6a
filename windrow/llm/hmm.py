"""Language-model scores from a hidden Markov model, beside add-one word counts.

Words are lower-cased (A-Z) and every text ends with one end token. From the training fold come

* the exact count of every word (combined in each task, then by word);
* a hidden Markov model whose symbols are the most frequent words, the end and one symbol for each kind of other
  word. Texts are turned into symbols once, in a table of the shared folder. Baum-Welch runs over the whole fold until a
  round gains less than ``least_gain`` a token (or ``rounds`` are done): each task adds up its expected counts, one row a
  symbol, and Spark sums those. Its first parameters come from a few rounds on a bounded random set of texts;
* the share of each word within its kind: (count - 3/4)/total; what the discounts leave is the probability of an
  unknown word of that kind, so that all training words and the unknown ones share a mass of 1.

The scaled forward recursion then gives the exact log-likelihood of each whole text under that model.

Words outside the bounded table (``table_words``) get their counts by a join, so no vocabulary is broadcast whole.

Cases: null and empty texts are one end token; without a training fold all counts are zero; very long texts are one
chain; words of equal count are ordered by themselves; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.chains import Chains
from windrow.llm.common import crc_mod, id_text, lower_az, numbered, offsets, run_sums, slices, words_of
from windrow.session import materialise

FOLDS, HELD = 7, 2
#: How symbols lie in the table.
SYMBOL = np.dtype("<u4")
#: Kinds of words outside the symbol table: ASCII or not, and whether they end in a letter or digit.
KINDS = 4
#: Words rarer than this are no symbols.
LEAST_SYMBOL, DISCOUNT = 8, 0.75


@dataclass
class Model:
    """words: symbols 0 to len-1; then the end, then the kinds. table: counts of the bounded table."""

    words: list[str]
    table: dict[str, int]
    n_train: int
    n_types: int
    n_docs: int
    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    kind_total: np.ndarray
    kind_left: np.ndarray
    symbol: dict[str, int] = field(default_factory=dict)

    def index(self) -> dict[str, int]:
        if not self.symbol:
            self.symbol.update((w, i) for i, w in enumerate(self.words))
        return self.symbol

    @property
    def end(self) -> int:
        return len(self.words)


def _kind(word: str) -> int:
    return 2 * (not word.isascii()) + (not word[-1].isalnum())


def tokens(texts: list[str]) -> list[list[str]]:
    return [words_of(lower_az(t)) for t in texts]


# -- counts ---------------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task; the table of words held at once is bounded."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for _, texts in slices(batches, 3_000_000):
        for text in texts:
            held.update(words_of(lower_az(text)))
        if len(held) > most:
            yield out()
            held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all texts of ``docs``, without the end tokens."""
    return id_text(docs).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _kind_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, types = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
    for batch in batches:
        for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[_kind(word)] += c
            types[_kind(word)] += 1
    yield pa.record_batch([pa.array(np.arange(KINDS)), pa.array(total), pa.array(types)], ["kind", "n", "types"])


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` words: all those above the smallest count that lets them fit, by descending count."""
    by_count = counts.groupBy(F.least(F.col("c"), F.lit(1_000_000)).alias("c")).count().orderBy(F.desc("c")).collect()
    taken, least = 0, None
    for r in by_count:
        if taken + r["count"] > most:
            break
        taken, least = taken + r["count"], r["c"]
    if least is None:
        return []
    rows = counts.where(F.col("c") >= least).collect()
    return sorted(((r["word"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


# -- hidden Markov model --------------------------------------------------------------------------------------


def _encoded(texts: list[str], model: Model) -> dict:
    """Per text: symbols with the end, known tokens and base sum of table words, the log shares of words within their
    kinds, and the words outside the table with their times and kinds."""
    words = tokens(texts)
    n, sizes = len(texts), np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    symbol = np.fromiter(map(model.index().get, flat, repeat(-1)), np.int64, len(flat))
    odd = np.flatnonzero(symbol < 0)
    place, distinct = numbered([flat[i] for i in odd.tolist()])
    count = np.fromiter(map(model.table.get, distinct, repeat(0)), np.float64, len(distinct))
    kinds = np.fromiter(map(_kind, distinct), np.int64, len(distinct))
    symbol[odd] = model.end + 1 + kinds[place]
    doc = np.repeat(np.arange(n), sizes)
    ends = offsets(sizes + 1)
    out = np.full(int(ends[-1]), model.end)
    mask = np.ones(len(out), bool)
    mask[ends[1:] - 1] = False
    out[mask] = symbol
    inside = np.where(count > 0, np.log(np.maximum(count - DISCOUNT, 0.1)), 0.0) - np.log(model.kind_total[kinds])
    c_of = np.array([model.table[w] for w in model.words] + [model.n_docs] + [0] * KINDS, float)
    base = run_sums(np.log10(c_of + 1)[out], ends) + np.bincount(doc[odd], np.log10(count + 1)[place], n)
    known = run_sums((c_of > 0).astype(float)[out], ends) + np.bincount(doc[odd], (count > 0)[place], n)
    far = np.flatnonzero(count[place] == 0)
    pair, times = np.unique(doc[odd][far] * max(len(distinct), 1) + place[far], return_counts=True)
    owner, which = np.divmod(pair, max(len(distinct), 1))
    return {
        "symbols": out, "ends": ends, "known": known.astype(np.int64), "base": base, "inside": np.bincount(doc[odd], inside[place], n).astype(float),
        "rest": offsets(np.bincount(owner, minlength=n)), "words": [distinct[i] for i in which.tolist()], "times": times, "kinds": kinds[which],
    }


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id and what ``_encoded`` finds for every text, in the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, 3_000_000):
            e = _encoded(texts, sent.value)
            rest = pa.array(e["rest"], pa.int32())
            lists = [pa.ListArray.from_arrays(rest, pa.array(e[k], t)) for k, t in (("words", pa.string()), ("times", pa.int64()), ("kinds", pa.int64()))]
            raw = pa.py_buffer(e["symbols"].astype(SYMBOL).tobytes())
            symbols = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((e["ends"] * 4).astype(np.int32).tobytes()), raw])
            columns = [pa.array(ids, pa.int64()), symbols, *(pa.array(e[k]) for k in ("known", "base", "inside")), *lists]
            yield pa.record_batch(columns, ["doc_id", "symbols", "known", "base", "inside", "words", "times", "kinds"])

    schema = "doc_id long, symbols binary, known long, base double, inside double, words array<string>, times array<long>, kinds array<long>"
    return materialise(id_text(docs).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "symbols")


def _chains(batches: Iterator[pa.RecordBatch], column: int, most: int = 3_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their symbols and the starts of these, so many symbols together (or one text alone)."""
    for batch in batches:
        raw = batch.column(column)
        total = np.concatenate([[0], np.cumsum(np.array(pc.binary_length(raw)) // 4)])
        at = 0
        while at < len(raw):
            upto = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
            some = batch.slice(at, upto - at)
            symbols = np.frombuffer(b"".join(some.column(column).to_pylist()), SYMBOL)
            yield some, symbols.astype(np.int64), total[at : upto + 1] - total[at]
            at = upto


def _expect(symbols: np.ndarray, at: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log-likelihood, by posteriors in single precision."""
    chains, emit = Chains(at), model.emit.astype(np.float32)
    chains.forward(symbols, emit, model.step, model.first, keep=True)
    score = float(np.log(chains.scales).sum(dtype=np.float64))
    gamma, moves = chains.backward(emit, model.step)
    emitted = np.stack([np.bincount(chains.symbols, gamma[:, k], len(emit)) for k in range(gamma.shape[1])], axis=1)
    return gamma[: len(at) - 1].sum(axis=0, dtype=np.float64), moves, emitted, score


def _maximise(model: Model, first: np.ndarray, moves: np.ndarray, emitted: np.ndarray, prior: np.ndarray) -> None:
    """Each row with pseudo-counts: 1 for starts and moves, and 5 spread like the words themselves for symbols."""
    model.first = (first + 1) / (first + 1).sum()
    model.step = (moves + 1) / (moves + 1).sum(axis=1, keepdims=True)
    emitted = emitted + 5 * prior[:, None]
    model.emit = emitted / emitted.sum(axis=0)


def baum_welch(fold: DataFrame, model: Model, prior: np.ndarray, rounds: int, least_gain: float) -> list[float]:
    """Expected counts of all texts (a column of symbols): one row a symbol and task, summed by symbol. Returns the
    log-likelihood a token before each round."""
    states = len(model.first)
    columns = [f"s{k}" for k in range(states)]
    heads = 2 + states  # likelihood and tokens, starts, moves
    gained: list[float] = []
    for _ in range(rounds):
        sent = fold.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            now = sent.value
            total = np.zeros((heads + len(now.emit), states))
            for _, symbols, at in _chains(batches, 0):
                first, moves, emitted, score = _expect(symbols, at, now)
                total[0, :2] += score, len(symbols)
                total[1] += first
                total[2:heads] += moves
                total[heads:] += emitted
            spot = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array(spot), *(pa.array(total[spot, k]) for k in range(states))], ["row", *columns])

        schema = "row long, " + ", ".join(f"{c} double" for c in columns)
        narrow = fold.mapInArrow(run, schema).select("row", *(F.col(c).cast("float" if k > 1 else "double").alias(c) for k, c in enumerate(columns)))
        sums = narrow.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        total = np.zeros((heads + len(model.emit), states))
        total[sums.column("row").to_numpy()] = np.column_stack([sums.column(c).to_numpy() for c in columns])
        _maximise(model, total[1], total[2:heads], total[heads:], prior)
        sent.unpersist()
        gained.append(total[0, 0] / max(total[0, 1], 1))
        if len(gained) > 1 and gained[-1] - gained[-2] < least_gain:
            break
    return gained


def prepare(docs: DataFrame, counts: DataFrame, states: int = 8, symbols: int = 30_000, table_words: int = 200_000) -> tuple[Model, np.ndarray]:
    """A model of even states, and the shares of its symbols. ``docs``: the training fold; ``counts``: its words."""
    n_docs = docs.count()
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()[0]
    top = frequent(counts, table_words)
    table, words = dict(top), [w for w, c in top[:symbols] if c >= LEAST_SYMBOL]
    n_words = int(sums["n"] or 0)

    kind_total, kind_types = np.zeros(KINDS), np.zeros(KINDS)
    by_kind = counts.mapInArrow(_kind_counts, "kind long, n long, types long").groupBy("kind")
    for r in by_kind.agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect():
        kind_total[r["kind"]], kind_types[r["kind"]] = r["n"], r["types"]
    for w in words:
        kind_total[_kind(w)] -= table[w]
        kind_types[_kind(w)] -= 1
    kind_left = DISCOUNT * kind_types + 1
    kind_total += 1

    prior = np.array([table[w] for w in words] + [n_docs + 1] + [*kind_total], float)
    prior /= prior.sum()
    rng = np.random.default_rng(11)
    emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), states))
    model = Model(
        words, table, n_words + n_docs, int(sums["v"]) + (n_docs > 0), n_docs, np.full(states, 1 / states),
        0.6 * np.eye(states) + 0.4 / states, emit / emit.sum(axis=0), kind_total, kind_left,
    )
    return model, prior


def train(
    encoded: DataFrame, model: Model, prior: np.ndarray, start_texts: int = 1_000, start_tokens: int = 4_000, start_rounds: int = 12,
    rounds: int = 20, least_gain: float = 0.005,
) -> list[float]:
    """Baum-Welch on the training fold of the encoded texts; its first parameters from ``start_texts`` texts of at most
    ``start_tokens`` tokens. Returns the log-likelihoods a token before each round."""
    if not model.n_docs:
        return []
    fold = encoded.where(crc_mod(F.col("doc_id"), FOLDS) != HELD)
    short = fold.where(F.octet_length("symbols") <= 4 * start_tokens).withColumn("h", F.xxhash64("doc_id", "symbols"))
    drawn = short.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < min(1.0, 2 * start_texts / model.n_docs))
    rows = drawn.select("h", "symbols").orderBy("h", "symbols").limit(start_texts).collect()
    if rows:
        texts = [np.frombuffer(bytes(r["symbols"]), SYMBOL).astype(np.int64) for r in rows]
        seen, at = np.concatenate(texts), offsets(map(len, texts))
        for _ in range(start_rounds):
            _maximise(model, *_expect(seen, at, model)[:3], prior)
    return baum_welch(fold.select("symbols"), model, prior, rounds, least_gain)


# -- scores ---------------------------------------------------------------------------------------------------

_LN10 = float(np.log(10))


def likelihoods(symbols: np.ndarray, at: np.ndarray, model: Model) -> np.ndarray:
    """Natural log-likelihoods of runs of symbols."""
    chains = Chains(at)
    chains.forward(symbols, model.emit, model.step, model.first, keep=False)
    return chains.log_likelihoods()


def scores(encoded: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every encoded text."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, symbols, at in _chains(batches, 5):
            score = (likelihoods(symbols, at, sent.value) + rows.column(4).to_numpy()) / _LN10
            yield pa.record_batch([*(rows.column(c) for c in range(4)), pa.array(np.diff(at)), pa.array(score)], ["row", "doc_id", "known", "base", "n_tokens", "score"])

    own = encoded.select("row", "doc_id", "known", "base", "inside", "symbols")
    found = own.mapInArrow(run, "row long, doc_id long, known long, base double, n_tokens long, score double")
    rare = encoded.select("row", F.explode(F.arrays_zip("words", "times", "kinds")).alias("x")).select("row", "x.*")
    left = F.element_at(F.array(*(F.lit(float(np.log10(x))) for x in model.kind_left)), (F.col("kinds") + 1).cast("int"))
    counted = (
        rare.join(counts, rare["words"] == counts["word"], "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more"),
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base_rest"),
            F.sum(F.col("times") * F.coalesce(F.log10(F.col("c") - DISCOUNT), left)).alias("score_rest"),
        )
    )
    scale = float(np.log10(model.n_train + model.n_types + 1))
    return (
        found.join(counted, "row", "left")
        .select(
            "doc_id",
            (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
            "n_tokens",
            (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(model.n_train).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("base_rest", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
            (F.col("score") + F.coalesce("score_rest", F.lit(0.0))).alias("score"),
        )
    )


def score_corpus(docs: DataFrame, states: int = 8, symbols: int = 30_000, table_words: int = 200_000, **params) -> DataFrame:
    """Train on the fold that may be learned from, then score every text."""
    fold = docs.where(crc_mod(F.col("doc_id").cast("long"), FOLDS) != HELD)
    counts = materialise(word_counts(fold), "words")
    model, prior = prepare(fold, counts, states, symbols, table_words)
    encoded = encode(docs, model)
    train(encoded, model, prior, **params)
    return scores(encoded, counts, model)
