"""All pairs that share a key, with no cap on how many hold it."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from windrow import engine
from windrow.operators import candidates, pair_tiles, scoring
from windrow.plans import triage

METRICS = [m for m in engine.METRICS]


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pairs_of_a_file_with_more_than_300_holders_are_those_of_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(10)
    docs = [(4 + 11 * 19 * 120 * k, f"fix a{k % 7} thing\n" + " ".join(f"w{rng.randrange(40)}" for _ in range(30)), "en", "web", 100 + k) for k in range(400)]
    documents(spark, tmp_path, docs)
    ids = [r["id"] for r in triage.f_lowpass_cascade(spark, str(tmp_path)).where("filter_state = 'pass'").collect()]
    got = triage.p_pair_score(spark, str(tmp_path)).collect()
    assert len(ids) > 300 and {(r["entity_a"], r["entity_b"]) for r in got} == set(itertools.combinations(sorted(ids), 2)) and len(got) == len(ids) * (len(ids) - 1) // 2
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = con.execute(triage.ORACLES["p_pair_score"])
    names = [c[0] for c in found.description]
    assert sorted(repr(tuple(r[c] for c in names)) for r in got) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize(("side", "part", "small"), [(2048, 256, 64), (9, 4, 5), (9, 4, 0)])
def test_squares_make_each_pair_once_with_the_features_of_the_join(spark, monkeypatch, side, part, small):
    for name, value in (("SIDE", side), ("PART", part), ("SMALL", small), ("TOGETHER", 12)):
        monkeypatch.setattr(pair_tiles, name, value)
    rng = random.Random(11)
    some = lambda of, n: [f"{of}{rng.randrange(n)}" for _ in range(rng.randrange(4))]
    rows = []
    for i in range(60):
        sketched = i % 4 != 0
        vector = lambda: [rng.random() - 0.3 for _ in range(8)] if rng.random() < 0.9 else [0.0] * 8
        rows.append((
            None if i == 59 else f"pr:{i}", "pr", some("p", 9), some("h", 9), ["all"] * (i % 3 > 0) + some("f", 30), some("t", 12), some("l", 20) + [None] * (i % 5 == 0), some("s", 9), vector(), vector(),
            [rng.randrange(4) for _ in range(6)] if sketched else [], rng.getrandbits(60) if sketched else None, rng.sample(range(40), 7) if sketched else [], rng.randrange(900), None if i == 7 else rng.randrange(400),
        ))
    kinds = "entity_id string, lane string, patch_ids array<string>, hunk_signatures array<string>, changed_files array<string>, salient array<string>, linked_issues array<string>, soft_linked_issues array<string>, text_embedding array<double>, diff_embedding array<double>, signature array<bigint>, simhash bigint, winnow array<bigint>, additions int, deletions int"
    fp = spark.createDataFrame(rows, kinds)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x))
    fp = fp.withColumns({"text_norm": length("text_embedding"), "diff_norm": length("diff_embedding")})
    fp = fp.unionByName(fp.where("entity_id = 'pr:1'").withColumn("additions", F.lit(5)))  # one id twice
    keys = {"hard": "linked_issues", "file": "changed_files"}
    pairs = candidates.unordered(candidates.votes(candidates.keys(fp, keys)))
    side_of = lambda x: fp.select(F.col("entity_id").alias(f"entity_{x}"), F.struct(*engine._PAIR).alias(x))
    want = scoring.features(pairs.join(side_of("a"), "entity_a").join(side_of("b"), "entity_b"), triage.CFG)
    rounded = lambda df: sorted(repr(tuple(r)) for r in df.select("entity_a", "entity_b", *(F.round(m, 6).alias(m) for m in METRICS)).collect())
    assert rounded(pair_tiles.scored(fp, keys, triage.CFG)) == rounded(want)
