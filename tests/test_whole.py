"""Queries that do the whole job, where a SQL twin holds its sibling to part of it, against brute force."""

import random
import re

from windrow.operators import jaccard_join
from windrow.plans import near_dup, triage


def roots(links):
    """The smallest node reachable from each node."""
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def test_near_duplicates_of_hot_and_short_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(99)}" for _ in range(60)]
    texts = [" ".join(base)] * 310 + ["one two three", "One, two three", None, "", "four five six seven eight"]
    for n in (1, 2, 3, 6, 20):
        texts += [" ".join(base[n:]), " ".join(base[:-n]), " ".join(base[:30] + ["new"] * n + base[30:])]
    sets = []
    for t in texts:
        w = [x.lower() for x in re.findall("[a-zA-Z0-9_]+", t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, i) for i in range(len(sets))]
    links += [(i, j) for i, a in enumerate(sets) for j in range(i) if a and (b := sets[j]) and 5 * len(a & b) >= 4 * len(a | b)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = near_dup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component"] for r in got} == roots(links) and len(got) == len(texts)
    assert sum(r["is_canonical"] for r in got) == len({r["component"] for r in got})


def test_components_of_all_parts(spark, tmp_path):
    rng = random.Random(6)
    lines = [(rng.randrange(60), rng.randrange(1, 50), rng.randrange(4)) for _ in range(90)]
    orders = [(i, 100 + i % 45) for i in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    held = {(dict(orders)[o], p, s) for o, p, s in lines}
    links = [(a, b) for a, p, s in held for b, q, t in held if (p, s) == (q, t)]
    got = triage.g_components(spark, str(tmp_path)).collect()
    assert {r["customer"]: r["component"] for r in got} == roots(links) and len(got) == len({a for a, _, _ in held})


def test_near_duplicates_shuffle_no_shingles(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(9_999)}" for _ in range(200)) for _ in range(60)]
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    rows += [(70, texts[3], 1), (70, "a b c d e f", 2), (71, texts[3] + " a! b", 3), (None, texts[3], 4), (72, texts[4][:-3] + "\0x y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    plans, real = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    got = [(r["doc_id"], r["component"], r["is_canonical"]) for r in near_dup.near_duplicates(docs).collect()]
    assert len(got) == len(rows) and (None, None, True) in got
    parts = {i: i for i in range(60)} | {70: 3, 71: 3, 72: 4}
    assert {i: c for i, c, _ in got if i is not None} == parts
    assert plans and not any("Generate explode" in p and "text" in p for p in plans)
