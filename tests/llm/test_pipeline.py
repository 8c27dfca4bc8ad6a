"""The pipeline against its stages in plain Python on a small table."""

import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_operators import brute_groups, norm

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r[c] for c in ("doc_id", "text")) for r in docs.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r[c] for c in ("doc_id", "text")) for r in docs.collect()]
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name == "exact_dedup":
            best = {}
            for i, t in before:
                best[norm(t)] = max(i, best.get(norm(t), i))
            assert kept[name] == set(best.values())
        elif name == "ngram_jaccard_join":
            assert kept[name] == {c for _, c in brute_groups(before, 5, 80).values()}
        else:
            assert kept[name] <= {i for i, _ in before}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in last} == kept["mixing"] and all(r["round_trip"] for r in last)
    assert len(kept["language_id"]) >= 0.95 * len(rows)


def test_pipeline_takes_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
