"""The flagship: near-duplicate documents from tokens to a canonical document of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.operators import jaccard_join
from windrow.session import materialise, spread, table


#: Between the texts of one doc_id, whose shingles make one set; in texts it becomes a blank, which it is to words.
BETWEEN = "\0"


def _canonical(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The component of each document and whether it is the longest document of it."""
    placed = docs.select("doc_id", "n_chars").join(grouped, "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    order = Window.partitionBy("component").orderBy(F.desc("n_chars"), "doc_id")
    return placed.select("doc_id", "component", "n_chars", (F.row_number().over(order) == 1).alias("is_canonical"))


def _one_each(docs: DataFrame) -> DataFrame:
    """doc_id, text: one row an id; repeated ids have all their texts, with BETWEEN between them."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(BETWEEN), F.lit(" "))
    cut = docs.where("doc_id IS NOT NULL").select("doc_id", text.alias("text"))
    repeated = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return cut
    joined = cut.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("text")), BETWEEN).alias("text"))
    return cut.join(repeated, "doc_id", "left_anti").unionByName(materialise(joined, "joined"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, component, n_chars, is_canonical over all shingles, none capped, by the join of
    :mod:`windrow.operators.jaccard_join`: only digests, prefixes and bitmaps are shuffled and stored, and the whole sets of
    the pairs that these leave. The longest document of each component is canonical."""
    grouped = jaccard_join.groups(_one_each(docs), k, percent, BETWEEN)
    return _canonical(docs, grouped.select("doc_id", F.col("component_id").alias("component")))


def e2e_near_dup_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(spread(table(spark, d, "documents")))


_TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+'), lambda x: lower(x))"
_KEYS = f"""w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) END) AS s FROM w),
k AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, CAST('0x' || substr(md5(s), 1, 15) AS BIGINT) AS h FROM g)),
n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node)"""
NEAR_DUP = f"""WITH RECURSIVE {_KEYS},
f AS (SELECT d.doc_id, d.n_chars, coalesce(c.component, d.doc_id) AS component FROM documents d LEFT JOIN c ON c.node = d.doc_id)
SELECT doc_id, component, n_chars, row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, doc_id) = 1 AS is_canonical FROM f"""

QUERIES = {"e2e_near_dup_pipeline": e2e_near_dup_pipeline}
ORACLES = {"e2e_near_dup_pipeline": NEAR_DUP}
