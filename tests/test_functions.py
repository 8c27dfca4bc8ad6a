import math

from pyspark.sql import functions as F

from windrow.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokens_lower_ascii_runs(spark):
    assert one(spark, T.tokens(F.col("s")), s="Fix the_Bug-42, é!") == ["fix", "the_bug", "42"]


def test_tokens_of_null_are_empty(spark):
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_module_bucket(spark):
    assert one(spark, T.module_bucket(F.lit("a/b/c/d.py"))) == "a/b/*"
    assert one(spark, T.module_bucket(F.lit("src/cache.py"))) == "src/cache.py/*"
    assert one(spark, T.module_bucket(F.lit("//"))) == "root/*"


def test_links(spark):
    s = "Fixes #12, see #7 and prefix #9; fixes: #30"
    assert one(spark, T.hard_links(F.lit(s))) == ["12", "9"]
    assert one(spark, T.soft_links(F.lit(s))) == ["30", "7"]


def test_review_score_order_and_edges(spark):
    for said, want in [("85/100", 0.85), ("Score: 0.82", 0.82), ("82%", 0.82), ("score: 10%", 1.0), ("1%", 1.0), ("nothing", 0.5), ("250/100", 1.0)]:
        assert one(spark, T.review_score(F.lit(said))) == want, said


def test_set_measures(spark):
    a, b, none = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), F.array().cast("array<string>")
    assert math.isclose(one(spark, T.jaccard(a, b)), 1 / 3)
    assert one(spark, T.jaccard(none, none)) == 0
    assert one(spark, T.overlap(a, b)) == 0.5
    assert one(spark, T.overlap(a, none)) == 0


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert math.isclose(one(spark, T.cosine(v(1, 0), v(1, 1))), 1 / math.sqrt(2))
    assert one(spark, T.cosine(v(0, 0), v(1, 1))) == 0
    assert math.isclose(one(spark, T.cosine(v(1, 2, 3), v(1, 2))), 5 / (math.sqrt(14) * math.sqrt(5)))


def test_shingles(spark):
    words = lambda s: F.split(F.lit(s), " ")
    assert one(spark, T.shingles(words("a b c a b c"), 3)) == ["a b c", "b c a", "c a b"]
    assert one(spark, T.shingles(words("a b"), 3)) == ["a b"]


def test_size_penalty_and_hamming(spark):
    assert one(spark, T.size_penalty(F.lit(0), F.lit(10))) == 1.0
    assert one(spark, T.size_penalty(F.lit(5), F.lit(5))) == 0.0
    assert one(spark, T.hamming(F.lit(0b1011), F.lit(0b0001))) == 2


def test_kind(spark):
    assert one(spark, T.kind_of(F.lit("pr:1"))) == "pr"
    assert one(spark, T.kind_of(F.lit("7"), "default")) == "default"
