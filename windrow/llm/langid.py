"""Language of each word of a text by a linear-chain conditional random field, and of the text by its words.

Features of a word: byte n-grams of 1 to 4 within its marked ends (those that hold a mark are its affixes), each
hashed into a table of weights, and the word itself (lexicon). Transitions between labels are learned from
code-switched sequences, spliced from spans of labelled texts of different languages. The posterior of each
word's label comes from forward-backward; a text takes the label with the largest posterior mass over its words
that hold a letter.

Only ``text`` and ``lang`` of documents outside the held-out fold are learned from, every language of them: about
``per_lang`` texts each, chosen by a hash of id and text, equal rows once, of a long text a span of ``SPAN`` characters,
and of each language ``most_words`` words divided by the number of languages. Whole texts are labelled.

Cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; without anything to learn
from, all are; very long texts are one long chain; of equally likely languages the first by name holds; repeated rows
give repeated results; further columns are ignored by :func:`predict`, kept by :func:`keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.chains import Chains
from windrow.llm.common import crc_mod, id_text, numbered, offsets, run_sums, slices, word_bytes, word_hashes, words_of

LETTER = regex.compile(r"\p{L}")
#: Characters of a text that are learned from at most.
SPAN = 20_000
GRAMS, GRAM_BITS, WORD_BITS = (1, 2, 3, 4), 15, 16
FOLDS, HELD = 3, 1


@dataclass
class Field:
    """Learned weights: n-gram tables one after another, word table, transitions (log potentials)."""

    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    moves: np.ndarray


def _gram_places(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each n, the table row of the n-gram that starts at each byte; row 0 for those that leave their word."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = np.zeros(len(raw), np.uint64)
    out = []
    for n in GRAMS:
        shifted = np.zeros(len(raw), np.uint64)
        shifted[: len(raw) - n + 1] = raw[n - 1 :]
        key = key * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        h = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
        inside = np.zeros(len(raw), bool)
        inside[: len(raw) - n + 1] = word[: len(raw) - n + 1] == word[n - 1 :]
        out.append(np.where(inside, np.maximum(h, np.uint64(1)), np.uint64(0)).astype(np.int64))
    return out


class Features:
    """Feature places of a list of distinct words."""

    def __init__(self, words: list[str]) -> None:
        raw, self.at = word_bytes([w.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for w in words])
        self.grams = _gram_places(raw, self.at)
        self.words = (word_hashes(words) >> np.uint64(64 - WORD_BITS)).astype(np.int64)

    def scores(self, field: Field) -> np.ndarray:
        total = np.zeros((self.grams[0].shape[0], len(field.langs)), np.float32)
        for n, places in enumerate(self.grams):
            total += field.grams[n][places]
        return run_sums(total, self.at) + field.lexicon[self.words]

    def gradients(self, by_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = np.repeat(by_word, np.diff(self.at), axis=0)
        k = by_word.shape[1]
        grams = np.stack([
            np.stack([np.bincount(p, spread[:, j], 1 << GRAM_BITS) for j in range(k)], axis=1) for p in self.grams
        ])
        grams[:, 0] = 0
        lexicon = np.stack([np.bincount(self.words, by_word[:, j], 1 << WORD_BITS) for j in range(k)], axis=1)
        return grams, lexicon


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0))


def _spliced(texts: list[tuple[str, str]], langs: list[str], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Code-switched sequences: spans of 5 to 40 words of one text each, in an order that often changes language."""
    spans: list[tuple[list[str], int]] = []
    for text, lang in texts:
        words, at = words_of(text), 0
        while at < len(words):
            n = int(rng.integers(5, 41))
            spans.append((words[at : at + n], langs.index(lang)))
            at += n
    out = []
    order = rng.permutation(len(spans))
    for start in range(0, len(order), 8):
        chosen = [spans[i] for i in order[start : start + 8]]
        if start % 16:
            chosen.sort(key=lambda s: s[1])
        out.append(([w for ws, _ in chosen for w in ws], [y for ws, y in chosen for _ in ws]))
    return out


def fit(texts: list[tuple[str, str]], epochs: int = 3, batch: int = 48, rate: float = 0.3, most_words: int = 600_000) -> Field:
    """Adagrad on the conditional log-likelihood. Each language gives texts until its share of ``most_words`` is reached."""
    rng = np.random.default_rng(7)
    langs = sorted({lang for _, lang in texts})
    k = len(langs)
    field = Field(
        langs,
        np.zeros((len(GRAMS), 1 << GRAM_BITS, k), np.float32),
        np.zeros((1 << WORD_BITS, k), np.float32),
        np.zeros((k, k)),
    )
    if k < 2:
        return field
    used, texts_used = dict.fromkeys(langs, 0), []
    for i in rng.permutation(len(texts)):
        text, lang = texts[i]
        if used[lang] < most_words // k:
            texts_used.append((text, lang))
            used[lang] += len(text) // 6
    sequences = _spliced(texts_used, langs, rng)
    squares = [np.full_like(field.grams, 1e-3), np.full_like(field.lexicon, 1e-3), np.full_like(field.moves, 1e-3)]
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for start in range(0, len(order), batch):
            chosen = [sequences[i] for i in order[start : start + batch]]
            at = offsets(len(ws) for ws, _ in chosen)
            place, words = numbered([w for ws, _ in chosen for w in ws])
            truth = np.array([y for _, ys in chosen for y in ys])
            features = Features(words)
            emit = _potentials(features.scores(field))
            step = np.exp(field.moves)
            chains = Chains(at)
            chains.forward(place, emit, step, np.ones(k), keep=True)
            gamma, expected = chains.backward(emit, step)
            wrong = -chains.flat(gamma)
            wrong[np.arange(len(truth)), truth] += 1
            by_word = np.stack([np.bincount(place, wrong[:, j], len(words)) for j in range(k)], axis=1)
            grams, lexicon = features.gradients(by_word)
            last = np.zeros(len(truth), bool)
            last[at[1:] - 1] = True
            pairs = np.flatnonzero(~last[:-1])
            seen = np.bincount(truth[pairs] * k + truth[pairs + 1], minlength=k * k).reshape(k, k)
            for weight, square, grad in zip(
                (field.grams, field.lexicon, field.moves), squares, (grams, lexicon, seen - expected), strict=True
            ):
                grad = grad / len(chosen)
                square += grad**2
                weight += (rate * grad / np.sqrt(square)).astype(weight.dtype)
    return field


def label(texts: list[str], field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word posteriors (all words of all texts), the starts of the texts in them, and which words hold a letter."""
    words = [words_of(t) for t in texts]
    at = offsets(map(len, words))
    place, distinct = numbered([w for ws in words for w in ws])
    k = len(field.langs)
    if not len(place):
        return np.zeros((0, k)), at, np.zeros(0, bool)
    emit = _potentials(Features(distinct).scores(field))
    chains = Chains(at)
    step = np.exp(field.moves)
    chains.forward(place, emit, step, np.ones(k), keep=True)
    gamma, _ = chains.backward(emit, step)
    lettered = np.fromiter((LETTER.search(w) is not None for w in distinct), bool, len(distinct))
    return chains.flat(gamma), at, lettered[place]


def train(docs: DataFrame, per_lang: int = 250) -> Field:
    """Fit on texts of the folds that may be learned from."""
    usable = docs.select(
        F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"), F.col("lang").cast("string").alias("l")
    ).where(F.col("t").isNotNull() & F.col("l").isNotNull() & (crc_mod(F.col("i"), FOLDS) != HELD))
    counts = usable.groupBy("l").count().collect()  # a row a language
    if not counts:
        return fit([])
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["l"], min(1.0, per_lang / r["count"]))])
    draw = usable.withColumn("h", F.xxhash64("i", "t"))
    draw = draw.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < share[F.col("l")])
    start = (F.pmod(F.xxhash64("h"), F.greatest(F.length("t") - SPAN, F.lit(0)) + 1) + 1).cast("int")
    spans = draw.select("i", "l", "h", F.substr("t", start, F.lit(SPAN)).alias("t")).distinct()
    rows = spans.orderBy("h", "l").limit(4 * per_lang * len(counts)).collect()
    return fit([(r["t"], r["l"]) for r in sorted(rows, key=lambda r: (r["i"] is None, r["i"], r["t"]))])


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array(sent.value.langs, object)
        for ids, texts in slices(batches, 1_000_000):
            out, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if len(langs):
                gamma, at, lettered = label(texts, sent.value)
                mass = run_sums(gamma * lettered[:, None], at)
                total = mass.sum(axis=1)
                known = np.array([LETTER.search(t) is not None for t in texts], bool) & (total > 0)
                best = mass.argmax(axis=1)
                out[known] = langs[best[known]]
                score[known] = np.clip(mass[np.arange(len(texts)), best][known] / total[known], 0, 1)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, per_lang: int = 250) -> DataFrame:
    return predict(docs, train(docs, per_lang))


def keep_known(docs: DataFrame, per_lang: int = 250, least: float = 0.4) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, with all their columns."""
    field = train(docs, per_lang)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    spot = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(spot).cast(pa.string())
            keep = [np.zeros(0, bool)]
            for _, texts in slices([pa.record_batch([pa.nulls(len(own)), own], ["i", "t"])], 1_000_000):
                if not sent.value.langs:
                    keep.append(np.zeros(len(texts), bool))
                    continue
                gamma, at, lettered = label(texts, sent.value)
                mass = run_sums(gamma * lettered[:, None], at)
                total = mass.sum(axis=1)
                keep.append((total > 0) & (mass.max(axis=1) >= least * np.maximum(total, 1e-12)))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
