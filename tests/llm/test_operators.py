"""The corpus operators on small tables, against brute force, exact round trips or held-out accuracy."""

import itertools
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.llm import chains, exact_dedup, hmm, jaccard_join, langid, mixing, pieces, quality, sharding, token_files, toxicity, trees
from windrow.llm.common import lower_az, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def make(seed=3, n=90):
    """Texts of two invented languages with copies, near copies, edge cases, toxic words and junk."""
    rng = random.Random(seed)
    vocab = {"aa": ["la", "tami", "lore", "misa", "tola", "rami", "sola", "melo"], "bb": ["krz", "wuth", "grix", "thurk", "zwo", "brund", "kex", "uhl"]}
    rows, labels = [], []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        words = [rng.choice(vocab[lang]) + rng.choice(["", "", rng.choice(vocab[lang])]) for _ in range(rng.randint(12, 60))]
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilescum", "vilescoundrel", "vilesome"]))
        text = " ".join(words).capitalize() + "."
        if i % 11 == 5:
            text = "!! ".join(words).upper() + "!!"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, 0 if i % 11 == 5 else 1, int(bad)))
    base = rows[4][1]
    rows += [(n, base.upper(), "bb", "s0", 1), (n + 1, base, None, None, None), (n + 2, base + " extra", "bb", "s0", 1)]
    rows += [(n + 3, None, "aa", "s1", None), (n + 4, "", "bb", "s1", 0), (n + 5, "  \n\t ", "aa", "s1", 5), (n + 6, "123 456 !!", "bb", "s1", 9)]
    rows += [(n + 7, "É" + "x" * 30_000 + " " + "y z " * 5_000, "aa", "s1", 9), (None, "lost row", "aa", "s1", 8), (2, rows[2][1], "bb", "s2", 1)]
    return rows, labels


ROWS, KNOWN = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumns({"kept": F.lit("mine"), "score": F.lit(1), "digest": F.lit("x")}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*KNOWN, (1, None, None), (777, 1, 0), (None, 1, 1), (3, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def norm(text):
    return (text or "").translate(LOWER)


def test_words_and_lower():
    for text in ("a  b\tc\n", "é\x85x y z", "", None, "\x1cq \x0b w"):
        assert words_of(text) == WORD.findall(text or "")
    assert lower_az("ÀBÉ") == "ÀbÉ"


# -- exact dedup ----------------------------------------------------------------------------------------------


def brute_classes():
    groups = defaultdict(list)
    for r in ROWS:
        groups[norm(r[1])].append(r[0])
    return {t: (max((x for x in v if x is not None), default=None), len(v)) for t, v in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup._digest, lambda c: F.length(c).cast("string"), lambda c: F.lit("same")])
def test_exact_classes_even_where_digests_collide(docs, digest):
    got = exact_dedup.classes(docs, 4, digest).collect()
    want = brute_classes()
    rows = Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got)
    assert rows == Counter((r[0], *want[norm(r[1])]) for r in ROWS)
    assert sum(r["kept"] for r in got) == len(want)


def test_exact_drop_keeps_rows_whole(docs, nothing):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], norm(r["text"])) for r in kept.collect()) == Counter((k, t) for t, (k, _) in brute_classes().items())
    assert exact_dedup.classes(nothing).count() == exact_dedup.drop_copies(nothing).count() == 0


# -- n-gram Jaccard join --------------------------------------------------------------------------------------


def brute_groups(rows, width, percent):
    sets = {}
    for r in rows:
        if r[0] is not None:
            w = WORD.findall(norm(r[1]))
            sets[r[0]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows(seed, n=150, m=40):
    """A hot group of near copies, chains of edits, a passage that many texts share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, passage, rows = [word() for _ in range(60)], [word() for _ in range(40)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w), None, None, None))
    chain = [word() for _ in range(80)]
    for i in range(n, n + m):
        chain[rng.randrange(len(chain))] = word()
        rows.append((i, " ".join(chain), None, None, None))
    rows += [(i, " ".join(passage + [word() for _ in range(rng.randint(1, 40))]), None, None, None) for i in range(n + m, n + 2 * m)]
    return rows + [(900, "one two", None, None, None), (901, "ONE two", None, None, None), (902, "two", None, None, None), (903, None, None, None, None)]


@pytest.mark.parametrize("small", [128, 4])
@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_near_groups(spark, monkeypatch, small, width, percent):
    monkeypatch.setattr(jaccard_join, "SMALL_TILE", small)
    monkeypatch.setattr(jaccard_join, "BATCH_PAIRS", 200)
    rows = near_rows(width + small)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(spark.createDataFrame(rows, DOCS).repartition(3), width, percent).collect()}
    assert got == brute_groups(rows, width, percent)


def test_near_edges(docs, nothing):
    got = jaccard_join.groups(docs, 4, 85).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    want = brute_groups(ROWS, 4, 85)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert jaccard_join.groups(nothing, 4, 85).count() == 0
    assert jaccard_join.drop_near(docs).columns == docs.columns


def test_bitmaps_never_bound_below_the_overlap():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 4000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (3, 40, 300, 3000, 3000)]
    n = np.array([len(s) for s in sets])
    ia, ib = (np.array(x) for x in zip(*itertools.combinations(range(5), 2), strict=True))
    real = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(ia, ib, strict=True)])
    assert jaccard_join.bounded(n, [jaccard_join.bitmap(s) for s in sets], ia, ib, real).all()


# -- quality --------------------------------------------------------------------------------------------------


def brute_base(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)]


def test_quality_counts_match_brute_force(docs, labels):
    got = quality.filter_quality(docs, labels).collect()
    texts = {r[0]: r[1] for r in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        want = brute_base(texts[r["doc_id"]])
        assert [r[c] for c in quality.BASE] == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["kept"] and r["base_failed"])
    odd = "a b c d e f\na b c d e f\n\n \nq # | a b c d e"
    assert quality.statistics([odd])[0][0].tolist() == brute_base(odd)


def test_quality_without_labels_or_rows(docs, nothing, labels):
    assert quality.filter_quality(docs, labels.where("false")).where("kept AND base_failed").count() == 0
    assert quality.filter_quality(nothing, labels).count() == 0


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] + 0.2 * x[:, 1] + 0.05 * rng.normal(size=3000)) > 0.6).astype(float)
    forest = trees.fit(x[:2000], y[:2000], {0: 1, 2: -1})
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    for f, sign in ((0, 1), (2, -1)):
        grid = np.repeat(rng.uniform(size=(50, 3)), 40, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(forest.margin(grid).reshape(50, 40), axis=1) >= -1e-12).all()


# -- chains, language, language model -------------------------------------------------------------------------


def test_chains_match_enumeration():
    rng = np.random.default_rng(5)
    step, first, emit = rng.uniform(0.1, 1, (3, 3)), rng.uniform(0.1, 1, 3), rng.uniform(0.1, 1, (6, 3))
    lengths = [4, 1, 3]
    at = np.concatenate([[0], np.cumsum(lengths)])
    symbols = rng.integers(0, 6, at[-1])
    c = chains.Chains(at)
    c.forward(symbols, emit, step, first, keep=True)
    gamma = c.flat(c.backward(emit, step)[0])
    for k, n in enumerate(lengths):
        own = symbols[at[k] : at[k + 1]]
        total, marginal = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = first[path[0]] * emit[own[0], path[0]] * math.prod(step[path[t - 1], path[t]] * emit[own[t], path[t]] for t in range(1, n))
            total += p
            marginal[range(n), path] += p
        assert math.isclose(c.log_likelihoods()[k], math.log(total), rel_tol=1e-9)
        assert np.allclose(gamma[at[k] : at[k + 1]], marginal / total)


def test_language(docs, nothing):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect() if r["doc_id"] is not None}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r["lang_pred"], x[2]) for x in ROWS[:90] if (r := got[x[0]])["held_out"]]
    assert sum(a == b for a, b in held) > 0.9 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (93, 94, 95, 96))
    assert langid.identify(nothing).count() == 0
    marks = docs.sparkSession.createDataFrame([(1, "½ ² ٣ 42"), (2, "ª tola")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(marks, langid.train(docs)).orderBy("doc_id").collect()][0] == "und"
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and not {93, 94, 95, 96} & {r["doc_id"] for r in kept.collect()}


def test_every_language_is_learned(spark):
    rows = [(i, f"ab{chr(97 + i % 70 // 26)}{chr(97 + i % 26)} " * 30, f"l{i % 70:02d}") for i in range(420)]
    rows += [(5_000, "q" * 100_000, "l00")] * 50  # one id and text many times, longer than a span
    field = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(field.langs) == 70


def test_code_switched_words():
    rng = random.Random(1)
    a, b = (["lami", "tola", "misa"], ["krzu", "wuth", "grix"])
    text = lambda v: " ".join(rng.choice(v) for _ in range(40))
    field = langid.fit([(text(a), "aa") for _ in range(30)] + [(text(b), "bb") for _ in range(30)])
    gamma, _, _ = langid.label([" ".join(a * 4 + b * 4)], field)
    assert gamma.argmax(axis=1).tolist() == [0] * 12 + [1] * 12
    assert field.moves[0, 0] > field.moves[0, 1] and field.moves[1, 1] > field.moves[1, 0]


def test_language_model_base_is_exact_and_model_better(docs, nothing):
    got = hmm.score_corpus(docs, states=3, table_words=20, symbols=10).collect()
    assert len(got) == len(ROWS)
    tokens = lambda t: [*WORD.findall(norm(t)), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for r in ROWS if not held(r[0]) for w in tokens(r[1]))
    n, v, texts = sum(c.values()), len(c), {r[0]: r[1] for r in ROWS}
    for r in got:
        own = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(c[w] > 0 for w in own), n, held(r["doc_id"]))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    short = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
    assert sum(r["score"] for r in short) > sum(r["base_score"] for r in short)
    assert hmm.score_corpus(nothing).count() == 0


def test_language_model_scores_match_enumeration(docs):
    """Scores are the sums over all paths of states, with each word's share of its kind; Spark's rounds are plain rounds."""
    fold = docs.where("doc_id is null or pmod(crc32(cast(doc_id as string)), 7) <> 2")
    counts = hmm.materialise(hmm.word_counts(fold), "words")
    model, prior = hmm.prepare(fold, counts, states=2, symbols=12, table_words=20)
    encoded = hmm.encode(docs, model)
    start = hmm.Model(**{**vars(model), "symbol": {}})
    gained = hmm.train(encoded, model, prior, start_texts=0, rounds=3, least_gain=-1.0)
    texts = [np.frombuffer(bytes(r[0]), hmm.SYMBOL).astype(np.int64) for r in encoded.where("doc_id is null or pmod(crc32(cast(doc_id as string)), 7) <> 2").select("symbols").collect()]
    for want in gained:
        first, moves, emitted, score = hmm._expect(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), start)
        assert math.isclose(score / sum(map(len, texts)), want, rel_tol=1e-5)
        hmm._maximise(start, first, moves, emitted, prior)
    assert np.allclose(start.emit, model.emit, rtol=1e-3) and gained == sorted(gained)

    c = {r["word"]: r["c"] for r in counts.collect()}
    short = ["", "lami tola", "misa unseen42 krz", "Wuth! grix", "é la", "  x\n"]
    few = docs.sparkSession.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    for row in hmm.scores(hmm.encode(few, model), counts, model).collect():
        words, share, symbols = WORD.findall(norm(short[row["doc_id"]])), 1.0, []
        for w in words:
            if w in model.index():
                symbols.append(model.index()[w])
                continue
            kind = 2 * (not w.isascii()) + (not w[-1].isalnum())
            symbols.append(model.end + 1 + kind)
            share *= (c[w] - 0.75 if w in c else model.kind_left[kind]) / model.kind_total[kind]
        symbols.append(model.end)
        total = sum(
            model.first[p[0]] * model.emit[symbols[0], p[0]] * math.prod(model.step[p[t - 1], p[t]] * model.emit[symbols[t], p[t]] for t in range(1, len(p)))
            for p in itertools.product(range(2), repeat=len(symbols))
        )
        assert math.isclose(row["score"], math.log10(total * share), rel_tol=1e-9)


# -- toxicity -------------------------------------------------------------------------------------------------


def test_toxicity(docs, labels, nothing):
    got = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect() if r["doc_id"] is not None}
    truth = {i: t for i, _, t in KNOWN}
    held = [(truth[i], r["predicted"]) for i, r in got.items() if i in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert held and sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[93]["predicted"] == got[94]["predicted"] == 0
    assert toxicity.detect(nothing, labels).count() == 0
    assert toxicity.detect(docs, labels.where("false")).where("predicted = 1").count() == 0


def test_label_model_recovers_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    noisy = lambda right: np.where(rng.random(4000) < right, y, ~y).astype(int)
    good, bad, other = noisy(0.95), noisy(0.6), noisy(0.9)
    votes = np.column_stack([good, bad, bad, other])
    start = np.where(np.arange(4000) < 800, np.where(noisy(0.9) == 1, 0.95, 0.05), np.nan)  # labels of a fifth, some wrong
    posterior, theta, correlation = toxicity.label_model(votes, start, 0.3)
    assert ((posterior > 0.5) == y).mean() > 0.93
    assert theta[0, 1, 2] > 0.9 and theta[1, 1, 2] < 0.75 and correlation[1, 2] > 0.9 > abs(correlation[0, 1])


# -- tokens ---------------------------------------------------------------------------------------------------

ODD = ["", " ", "a  b", "a   b", "tail  ", "\n x", "x \n y", "<|endoftext|> it's 42nd", "é中   z", "a\t b", " \x1c q", "don't  stop\n\n\nnow ", "x" * 5000]


def test_encoder_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(token_files.default_tokenizer())
    tok.encode_special_tokens = True
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(" \n\tab'é1.! \x1c") for _ in range(30)) for _ in range(400)]
    ids, at = token_files.Encoder(token_files.default_tokenizer()).encode(texts, 2)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], repr(t)


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(3, 400, rng.integers(2, 9)) for _ in range(30)]
    parts = [np.concatenate([*(phrases[i] for i in rng.integers(0, 30, rng.integers(0, 20))), [2]]) for _ in range(60)]
    ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    raw = token_files.pack(ids, at, 2, 400)
    block = token_files.Block(raw, 400)
    assert (block.all()[0] == ids).all() and len(block.left) > 0 and len(raw) < 4 * len(ids)
    assert block.all()[1].tolist() == at.tolist()
    assert all((block.document(i) == p).all() for i, p in enumerate(parts))
    assert block.length.tolist() == [len(token_files.expand(np.array([400 + k]), block.left, block.right, 400)) for k in range(len(block.left))]


@pytest.mark.parametrize("seed", range(3))
def test_grammar_leaves_no_pair_standing_twice(seed):
    rng = np.random.default_rng(seed)
    passage = rng.permutation(np.arange(3, 303))
    parts = [np.concatenate([p, [2]]) for p in (passage, np.full(77, 5), rng.integers(3, 9, 200), passage, np.full(64, 7), [4, 4, 4, 5])]
    ids = np.concatenate(parts)
    symbols, left, right = token_files.compress(ids, 2, 400)
    assert (token_files.expand(symbols, left, right, 400) == ids).all()
    found, last = Counter(), {}
    for i, p in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if 2 not in p and last.get(p, -2) != i - 1:
            found[p] += 1
            last[p] = i
    assert max(found.values(), default=1) == 1
    assert token_files.expansion_lengths(left, right, 400).max() >= 300
    assert any(a == b for a, b in zip(left.tolist(), right.tolist(), strict=True))


def test_grammar_of_runs_and_periods():
    for ids in (np.full(4_000, 5), np.tile(np.arange(3, 11), 500), np.zeros(0, np.int64), np.array([2, 2, 2])):
        symbols, left, right = token_files.compress(ids, 2, 70_000)
        assert (token_files.expand(symbols, left, right, 70_000) == ids).all() and len(symbols) < 30
    ids = np.tile(np.arange(3, 60_003), 3)  # more rules than 16 bits hold
    symbols, left, right = token_files.compress(ids, 2, 70_000)
    assert len(left) > 59_000 and (token_files.expand(symbols, left, right, 70_000) == ids).all()


def test_numbers_in_bits():
    rng = np.random.default_rng(1)
    for bits in (1, 7, 17, 20, 31):
        x = rng.integers(0, 1 << bits, 300_001)
        raw = b"ab" + token_files._packed(x, bits)
        assert (token_files._unpacked(raw, 2, bits, 0, len(x)) == x).all()
        assert (token_files._unpacked(raw, 2, bits, 12_345, 200_000) == x[12_345:212_345]).all()
        y, spot = token_files._single(b"abc" + token_files._varied(x) + b"rest", 3, len(x))
        assert (y == x).all() and spot == 3 + len(token_files._varied(x))


def test_pieces_of_one_hash_are_encoded_right(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    own = token_files.Encoder(token_files.default_tokenizer())
    own._hash = lambda points, begin, long: long.astype(np.uint64) % np.uint64(3)
    texts = ["one two three", "abc def", "x y z 1 2 3", ""]
    ids, at = own.encode(texts, 2)
    tok = tokenizers.Tokenizer.from_file(token_files.default_tokenizer())
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]


def test_rows_of_one_id_have_one_order(spark):
    pytest.importorskip("tokenizers")
    rows = [(7, f"text {i % 5}") for i in range(60)] + [(3, "first"), (None, "lost")]
    got = [
        [tuple(r) for r in token_files.read(token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(n))).orderBy("start").collect()]
        for n in (1, 4)
    ]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [None, 3, *[7] * 60]


def test_token_files(spark, docs, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(token_files.default_tokenizer())
    got = token_files.read(token_files.write(docs)).orderBy("start").collect()
    total = 0
    texts = {r[0]: r[1] for r in ROWS}
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    for r in got:
        own = np.array([*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (total, len(own), zlib.crc32(own.astype("<u4").tobytes()))
        total += len(own)
    assert token_files.read(token_files.write(nothing)).count() == 0


# -- pieces ---------------------------------------------------------------------------------------------------


def every_segmentation(model, text):
    word = "▁" + text.replace("▁", pieces.LITERAL).replace(" ", "▁")
    edges = model.edges(word)

    def upto(b):
        if b == 0:
            return [(0, ())]
        return [(s + x, ids + p) for a, p, x in edges[b] for s, ids in upto(a)]

    return sorted(upto(len(word)), reverse=True)


def test_n_best_is_exact():
    pytest.importorskip("sentencepiece")
    model = pieces.Lattice(pieces.default_model(), 5)
    for text in ("hello", "a b", "the  cat", "x▁y", "é中 a", " lead", "ab ab", "trail ", " ", "   ", "\n\t"):
        want, got = every_segmentation(model, text), next(iter(model.encode([text])))
        assert np.allclose([s for s, _ in got], [s / pieces.UNIT for s, _ in want[:5]])
        assert len({tuple(i) for _, i in got}) == len(got) and all(tuple(i) in {w[1] for w in want} for _, i in got)
        assert all(model.decode(i) == text for _, i in got)


def test_words_together_and_alone():
    """The segmentation of many words at once, of one word alone and of the search have the same scores and losses."""
    pytest.importorskip("sentencepiece")
    model = pieces.Lattice(pieces.default_model(), 5)
    rng = random.Random(4)
    letters = "abcdefgh tion▁-.,1é中\U0001f600" + pieces.LITERAL
    words = ["▁" + "".join(rng.choice(letters.replace(" ", "")) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["▁the", "▁" + "x" * 60]
    counts, ids, score, loss = model.best_of(words)
    ends = np.cumsum(counts)
    for word, b, n, s, less in zip(words, ends, counts, score, loss):
        alone, found = model.chain(word), model.search(word, 2)
        assert len(alone[0]) and alone[1] == s == found[0][0]
        if len(found) > 1:
            assert found[0][0] - found[1][0] == less == alone[2]
        spelled = word.replace("▁", " ").replace(pieces.LITERAL, "▁")
        assert b"".join(model.text_of[i] for i in ids[b - n : b]).decode() == spelled


def test_long_words_take_linear_steps():
    pytest.importorskip("sentencepiece")
    model = pieces.Lattice(pieces.default_model(), 4)
    rng = random.Random(5)
    texts = ["".join(rng.choice(string.ascii_letters) for _ in range(100_000)), "x" * 100_000, "ab" * 50_000, "中文" * 30_000]
    for text, found in zip(texts, model.encode(texts)):
        scores = [s for s, _ in found]
        assert len(found) == (1 if text[0] == "中" else 4) == len({i.tobytes() for _, i in found}) and scores == sorted(scores, reverse=True)
        assert all(model.decode(i) == text for _, i in found)


def test_pieces_round_trip(docs, nothing):
    pytest.importorskip("sentencepiece")
    got = pieces.segment(docs).collect()
    assert len(got) == len(ROWS) and all(r["round_trip"] for r in got)
    assert all(r["scores"] == sorted(r["scores"], reverse=True) and r["scores"][0] == r["score"] for r in got)
    assert pieces.segment(nothing).count() == 0


# -- mixing ---------------------------------------------------------------------------------------------------

WEIGHTS = {"clean": 0.8, "low": 0.15, "toxic": 0.05}


def test_mix_meets_targets(docs, labels, nothing):
    got = mixing.rates(docs, labels, WEIGHTS).collect()
    assert len(got) == len(ROWS)
    total = sum(r["n_tokens"] for r in got)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        assert r["n_tokens"] == len(WORD.findall(texts[r["doc_id"]] or "")) and r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
        assert math.isclose(sum(r[f"p_{d}"] for d in mixing.DOMAINS), 1)
    for d in mixing.DOMAINS:
        assert math.isclose(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got), WEIGHTS[d] * total, rel_tol=1e-3), d
    assert mixing.rates(nothing, labels, WEIGHTS).count() == 0
    assert mixing.rates(docs, labels.where("false"), WEIGHTS).count() == len(ROWS)


def test_thin_keeps_clean_documents(docs, labels):
    kept = mixing.thin(docs, labels, WEIGHTS)
    assert kept.columns == docs.columns
    rates = {r["doc_id"]: r for r in mixing.rates(docs, labels, WEIGHTS, whole="clean").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, r in rates.items() if r["copies"] >= 1}
    assert all(r["rate"] == 1 for r in rates.values() if r["p_clean"] >= 0.5) and all(0 <= r["rate"] <= 1 for r in rates.values())


def test_thinned_totals_meet_weights(spark):
    """Documents of three plain kinds: what stays in expectation has the domains' shares, all clean documents in it."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad, low = i % 3 == 0, i % 3 == 1
        words = [rng.choice(["lami", "tola", "misa", "rami", "sola"]) for _ in range(rng.randint(80, 90))]
        if bad:
            words = [rng.choice(["vilescum", "vilefoul", "vilenasty"]) if j % 4 == 0 else w for j, w in enumerate(words)]
        rows.append((i, ("!!! ".join(words).upper() if low else " ".join(words))))
        labels.append((i, int(not low), int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    weights = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    got = mixing.rates(docs, known, weights, whole="clean").collect()
    totals = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS}
    for d in mixing.DOMAINS:
        assert math.isclose(totals[d] / sum(totals.values()), weights[d], rel_tol=0.01), totals
    assert sum(r["rate"] == 1 for r in got) >= 300


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"some words of text number {i // 2 * 2} that stand here", f"a{i}", f"b{i}", f"c{i}", f"d{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __digest string, row string, stays string")
    for kept in (exact_dedup.drop_copies(docs), jaccard_join.drop_near(docs), langid.keep_known(docs)):
        assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(rows)
    assert {r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()} == set(range(1, 20, 2))


# -- sharding -------------------------------------------------------------------------------------------------


def test_shards(spark, nothing):
    rows = [(i, f"text {i % 37 if i % 3 else 'hot'}", None, None, None) for i in range(400)] + [(7, None, None, None, None), (None, "", None, None, None)]
    got = sharding.assign(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in shards.values()]
    assert set(shards) == set(range(8)) and max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    text = {r[0]: r[1] for r in rows if r[0] != 7}
    for r in got:
        if r["doc_id"] in text:
            raw = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    where = defaultdict(Counter)
    for r in got:
        where[r["text_crc32"]][r["shard"]] += 1
    cut = sum(sum(c.values()) - max(c.values()) for c in where.values())
    assert cut < 0.35 * len(rows)
    assert sharding.assign(nothing).count() == 0


@pytest.mark.parametrize("singles", [200, 0])
def test_shards_cut_no_group_that_fits(spark, singles):
    texts = ["hot"] * 400 + [f"group {i // 3}" for i in range(600)] + [f"single {i}" for i in range(singles)]
    got = sharding.assign(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(5)).collect()
    where, sizes = defaultdict(set), Counter()
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
        sizes[r["shard"]] += 1
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    cut = [t for t, s in where.items() if len(s) > 1 and t != "hot"]
    assert len(where["hot"]) <= (6 if singles else 8) and len(cut) <= (0 if singles else 8)


def test_rows_of_one_id_with_several_texts_have_groups_of_their_own(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    rows = [(7, " ".join(a)), (7, " ".join(b)), (3, " ".join([*a, "more"])), (9, " ".join([*b, "yet"])), (8, " ".join(c)), (7, ""), (None, " ".join(c)), (9, " ".join([*b, "yet"]))]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=str)
    assert got == sorted([(7, 57, 3), (7, 57, 7), (3, 58, 3), (9, 58, 7), (9, 58, 7), (8, 57, 8), (7, 0, 7), (None, 57, None)], key=str)
