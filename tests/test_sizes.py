"""What the plans shuffle and keep on disk."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from windrow import engine
from windrow.operators import tally
from windrow.plans import text_queries, triage
from windrow.session import materialise, shared_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_shuffle_nothing(spark):
    active = materialise(triage._filtered(spark, "/root/testdata/sf0.001").where("filter_state = 'pass'"), "active")
    assert "Exchange" not in plan(engine.fingerprints(active, triage.CFG))


def test_shuffle_files_go_with_the_table_that_they_were_for(spark):
    shared_dir(spark)
    root = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    count = lambda: sum(f.endswith(".data") for d in root for _, _, fs in os.walk(d) for f in fs)
    before = count()
    materialise(spark.range(1000).repartition(3), "shuffled")
    assert count() <= before


def test_tally_is_what_the_pairs_add_up_to(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"{rng.choice('xyz')}{rng.randrange(3):02}", rng.randrange(40), rng.randrange(1, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "word string, holder long, times long")
    keyed = df.select(tally.hashed("file", F.col("word")).alias("key"), "holder", (F.col("times") * 256).alias("w"))
    times, want = Counter(), Counter()
    for w, h, n in rows:
        times[w, h] += n
    for (w, h), n in times.items():
        want.update({(h, o): n for v, o in times if v == w and o != h})
    best = {h: sorted((-v, o) for (a, o), v in want.items() if a == h)[:3] for h, _ in want}
    for ranges in (20_000_000, 30):  # one range of others and several
        monkeypatch.setattr(tally, "RANGE", ranges)
        monkeypatch.setattr(tally, "PASS_BYTES", 3_000)
        got = {(r["holder"], r["rank"]): (-r["votes"], r["other"]) for r in tally.tally(keyed, {}, 3).collect()}
        assert got == {(h, i + 1): x for h, xs in best.items() for i, x in enumerate(xs)}
    sums = {r["holder"]: (r["others"], r["votes"], r["best"]) for r in tally.tally(keyed, {}).collect()}
    assert sums == {h: (len(v), sum(v), max(v)) for h in best if (v := [n for (a, _), n in want.items() if a == h])}


def test_no_join_makes_the_pairs_of_votes(spark):
    for query in (triage.j_inverted_index_votes, triage.w_topk_candidates):
        assert "SortMergeJoin" not in plan(query(spark, "/root/testdata/sf0.001"))


def test_hamming_pairs_are_all_pairs(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(60) for _ in range(20)]
    values += [v ^ sum(1 << b for b in rng.sample(range(60), n)) for v in values for n in (0, 1, 2, 3, 4)]
    df = spark.createDataFrame(list(enumerate(values)), "key long, simhash long")
    got = {(r["doc_a"], r["doc_b"], r["distance"]) for r in text_queries.hamming_pairs(df, 3).collect()}
    assert got == {(i, j, n) for j, b in enumerate(values) for i, a in enumerate(values[:j]) if (n := (a ^ b).bit_count()) <= 3}
