"""The driver's tables in the shapes that the operators take, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.session import spread, table

#: Entities from documents and labels: attributes follow from the id and the length, texts are whole.
_COLUMNS = {
    "number": "d.doc_id",
    "kind": "CASE WHEN d.doc_id % 3 = 0 THEN 'issue' ELSE 'pr' END",
    "id": "concat(CASE WHEN d.doc_id % 3 = 0 THEN 'issue:' ELSE 'pr:' END, CAST(d.doc_id AS STRING))",
    "repo": "d.source",
    "title": "split_part(d.text, chr(10), 1)",
    "body": "d.text",
    "state": "CASE WHEN d.doc_id % 17 = 0 THEN 'CLOSED' ELSE 'open' END",
    "is_draft": "(d.doc_id % 13 = 0 AND d.doc_id % 3 <> 0)",
    "author": "CASE WHEN d.doc_id % 41 = 0 THEN 'ci[bot]' ELSE concat('User', CAST(d.doc_id % 37 AS STRING)) END",
    "additions": "CAST(d.n_chars % 900 AS INT)",
    "deletions": "CAST(d.n_chars % 400 AS INT)",
    "ci_status": "CASE d.doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unknown' END",
    "approvals": "CAST(d.doc_id % 4 AS INT)",
    "quality": "l.quality",
    "toxic": "l.toxic",
}
AS_OF = "2024-07-01 00:00:00"
HUNKS = "array<struct<file_path: string, context: string, added_lines: array<string>, removed_lines: array<string>>>"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")).alias("d"), table(spark, sf_dir, "labels").alias("l")
    joined = docs.join(labels, F.expr("d.doc_id = l.doc_id"), "left")
    flat = joined.select(*(F.expr(e).alias(n) for n, e in _COLUMNS.items()))
    i = F.col("number")
    module = F.concat(F.lit("src/m"), (i % 11).cast("string"))
    path = lambda k: F.concat(module, F.lit("/f"), ((i + k) % 19).cast("string"), F.lit(".py"))
    files = F.when(F.col("kind") == "issue", F.array().cast("array<string>")).when(
        i % 10 == 1, F.array(F.concat(F.lit("docs/g"), (i % 7).cast("string"), F.lit(".md")))
    ).otherwise(F.array(path(0), path(1), path(5)))
    names = F.array_compact(F.array(F.when(F.col("quality") == 0, "question"), F.when(F.col("toxic") == 1, "Security"), F.when(i % 29 == 0, "wontfix")))
    link = lambda m, k: F.when(i % m == 0, F.array((i - i % 3 + k).cast("string"))).otherwise(F.array().cast("array<string>"))
    return flat.withColumns({
        "changed_files": files,
        "labels": names,
        "linked_issues": link(5, 0),
        "soft_linked_issues": link(7, 3),
        "patch_ids": F.when(i % 6 == 1, F.array(F.concat(F.lit("c"), F.floor(i / 12).cast("string")))).otherwise(F.array().cast("array<string>")),
        "updated_at": F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(days=(i % 120).cast("int")),
        "created": F.date_sub(F.date_sub(F.to_date(F.lit(AS_OF)), (i % 120).cast("int")), (i % 45).cast("int")),
        "diff_hunks": F.when(F.col("kind") == "issue", F.array().cast(HUNKS)).otherwise(F.array(F.struct(
            F.concat(module, F.lit("/f"), (i % 19).cast("string"), F.lit(".py")).alias("file_path"), F.concat(F.lit("def g"), (i % 5).cast("string")).alias("context"),
            F.array(F.substring("title", 1, 40)).alias("added_lines"), F.array(F.concat(F.lit("old "), (i % 3).cast("string"))).alias("removed_lines"),
        ))),
        "is_bot": F.lit(False),
    }).drop("quality", "toxic")


ENTITIES = (
    "WITH base AS (SELECT "
    + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in _COLUMNS.items())
    + """ FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
ent AS (SELECT *,
  CASE WHEN kind = 'issue' THEN []::VARCHAR[]
       WHEN number % 10 = 1 THEN ['docs/g' || (number % 7) || '.md']
       ELSE ['src/m' || (number % 11) || '/f' || (number % 19) || '.py', 'src/m' || (number % 11) || '/f' || ((number + 1) % 19) || '.py',
             'src/m' || (number % 11) || '/f' || ((number + 5) % 19) || '.py'] END AS changed_files,
  list_filter([CASE WHEN quality = 0 THEN 'question' END, CASE WHEN toxic = 1 THEN 'Security' END, CASE WHEN number % 29 = 0 THEN 'wontfix' END], lambda x: x IS NOT NULL) AS labels,
  CASE WHEN number % 5 = 0 THEN [CAST(number - number % 3 AS VARCHAR)] ELSE []::VARCHAR[] END AS linked_issues,
  CASE WHEN number % 7 = 0 THEN [CAST(number - number % 3 + 3 AS VARCHAR)] ELSE []::VARCHAR[] END AS soft_linked_issues,
  CASE WHEN number % 6 = 1 THEN ['c' || CAST(number // 12 AS VARCHAR)] ELSE []::VARCHAR[] END AS patch_ids,
  number % 120 AS age_days,
  CAST(DATE '2024-07-01' - to_days(CAST(number % 120 AS INT)) - to_days(CAST(number % 45 AS INT)) AS DATE) AS created,
  CASE WHEN kind = 'issue' THEN []::STRUCT(p VARCHAR, c VARCHAR, a VARCHAR, r VARCHAR)[]
       ELSE [{'p': 'src/m' || (number % 11) || '/f' || (number % 19) || '.py', 'c': 'def g' || (number % 5), 'a': substr(title, 1, 40), 'r': 'old ' || (number % 3)}] END AS hunks
  FROM base)
"""
)

#: Pull requests from orders: parts are files, suppliers are modules, the customer is the author.
def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.concat(F.lit("pr:"), F.col("l_orderkey").cast("string")).alias("entity_id")).agg(
        F.collect_list(F.col("l_partkey").cast("string")).alias("files")
    )
