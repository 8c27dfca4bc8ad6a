"""Readers of entities and of GitHub-shaped payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.text import hard_links, review_score, soft_links

_STRINGS = T.ArrayType(T.StringType())
HUNK = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("context", T.StringType()),
    T.StructField("added_lines", _STRINGS), T.StructField("removed_lines", _STRINGS),
])
REVIEW = T.StructType([
    T.StructField("provider", T.StringType()), T.StructField("overall_score", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("summary", T.StringType()), T.StructField("risk", T.MapType(T.StringType(), T.DoubleType())),
])
ENTITY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "provider", "repo", "kind", "state", "title", "body", "author", "author_association", "base_branch", "head_branch", "mergeable_state", "ci_status")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_draft", "is_bot", "mergeable")]
    + [T.StructField(n, T.IntegerType()) for n in ("number", "additions", "deletions", "approvals", "review_comments")]
    + [T.StructField(n, _STRINGS) for n in ("labels", "linked_issues", "soft_linked_issues", "changed_files", "commits", "patch_ids")]
    + [T.StructField("diff_hunks", T.ArrayType(HUNK)), T.StructField("external_reviews", T.ArrayType(REVIEW))]
    + [T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("metadata", T.StringType())]
)
#: Values of absent fields.
DEFAULT = {"provider": "github", "state": "open", "ci_status": "unknown", "body": "", "is_draft": False, "is_bot": False, "additions": 0, "deletions": 0, "approvals": 0, "review_comments": 0, "metadata": "{}"}


def with_defaults(rows: DataFrame) -> DataFrame:
    """Absent scalars take their defaults, absent lists are empty, absent times the time of the plan."""
    out = rows.fillna({k: v for k, v in DEFAULT.items() if k in rows.columns})
    lists = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in rows.schema if isinstance(f.dataType, T.ArrayType)}
    times = {n: F.coalesce(F.col(n), F.current_timestamp()) for n in ("created_at", "updated_at") if n in rows.columns}
    return out.withColumns(lists | times)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entities, or JSON lines; anything that does not fit the schema is an error."""
    return with_defaults(spark.read.schema(ENTITY).option("multiLine", True).option("mode", "FAILFAST").json(path))


def from_pulls(rows: DataFrame) -> DataFrame:
    """Pull payloads (column ``payload``, repo) as entities."""
    kind = (
        "number INT, title STRING, body STRING, state STRING, draft BOOLEAN, user STRUCT<login: STRING, type: STRING>, labels ARRAY<STRUCT<name: STRING>>, "
        "base STRUCT<ref: STRING>, head STRUCT<ref: STRING, sha: STRING>, additions INT, deletions INT, created_at TIMESTAMP, updated_at TIMESTAMP, "
        "author_association STRING, mergeable BOOLEAN, mergeable_state STRING"
    )
    p = rows.select("repo", F.from_json("payload", kind).alias("p"))
    return p.select(
        F.concat(F.lit("pr:"), F.col("p.number").cast("string")).alias("id"), "repo", F.lit("pr").alias("kind"), F.col("p.number").alias("number"),
        F.col("p.title").alias("title"), F.coalesce("p.body", F.lit("")).alias("body"), F.col("p.state").alias("state"), F.coalesce("p.draft", F.lit(False)).alias("is_draft"),
        F.col("p.user.login").alias("author"), (F.coalesce("p.user.type", F.lit("")) == "Bot").alias("is_bot"), F.transform("p.labels", lambda x: x["name"]).alias("labels"),
        F.col("p.base.ref").alias("base_branch"), F.col("p.head.ref").alias("head_branch"), F.coalesce("p.additions", F.lit(0)).alias("additions"),
        F.coalesce("p.deletions", F.lit(0)).alias("deletions"), hard_links(F.col("p.body")).alias("linked_issues"), soft_links(F.col("p.body")).alias("soft_linked_issues"),
        F.col("p.created_at").alias("created_at"), F.col("p.updated_at").alias("updated_at"), F.col("p.author_association").alias("author_association"),
        F.col("p.mergeable").alias("mergeable"), F.col("p.mergeable_state").alias("mergeable_state"),
    )


def from_issues(rows: DataFrame) -> DataFrame:
    """Issue payloads as entities; rows that mirror a pull request drop out. Reactions count all integers but the url."""
    kind = (
        "number INT, title STRING, body STRING, state STRING, user STRUCT<login: STRING, type: STRING>, labels ARRAY<STRUCT<name: STRING>>, comments INT, "
        "reactions MAP<STRING, STRING>, pull_request STRUCT<url: STRING>, created_at TIMESTAMP, updated_at TIMESTAMP, author_association STRING"
    )
    p = rows.where(F.get_json_object("payload", "$.pull_request").isNull()).select("repo", F.from_json("payload", kind).alias("p"))
    values = F.map_values(F.map_filter("p.reactions", lambda k, v: (k != "url") & v.rlike("^[0-9]+$")))
    total = F.aggregate(F.transform(values, lambda v: v.cast("int")), F.lit(0), lambda t, x: t + x)
    return p.select(
        F.concat(F.lit("issue:"), F.col("p.number").cast("string")).alias("id"), "repo", F.lit("issue").alias("kind"), F.col("p.number").alias("number"),
        F.col("p.title").alias("title"), F.coalesce("p.body", F.lit("")).alias("body"), F.col("p.state").alias("state"), F.col("p.user.login").alias("author"),
        F.transform("p.labels", lambda x: x["name"]).alias("labels"), hard_links(F.col("p.body")).alias("linked_issues"), soft_links(F.col("p.body")).alias("soft_linked_issues"),
        F.col("p.created_at").alias("created_at"), F.col("p.updated_at").alias("updated_at"), F.coalesce("p.comments", F.lit(0)).alias("comment_count"), F.coalesce(total, F.lit(0)).alias("reaction_total"),
    )


def ci_status(state: Column) -> Column:
    low = F.lower(state)
    return F.when(low.isin("success", "pass", "passed"), "pass").when(low.isin("failure", "failed", "fail", "error"), "fail").otherwise("unknown")


def parse_patch(patch: Column, path: Column) -> Column:
    """Hunks of a unified diff. Lines that begin like file headers are left out, whatever they are."""
    blocks = F.filter(F.split(F.coalesce(patch, F.lit("")), r"(?m)^(?=@@)"), lambda b: b.startswith("@@"))

    def one(b: Column) -> Column:
        rows = F.split(b, "\n")
        side = lambda mark: F.transform(
            F.filter(F.slice(rows, 2, 1 << 30), lambda x: x.startswith(mark) & ~x.startswith(mark * 3)), lambda x: F.substring(x, 2, 1 << 30)
        )
        return F.struct(path.alias("file_path"), F.trim(F.regexp_extract(rows[0], r"^@@[^@]*@@(.*)$", 1)).alias("context"), side("+").alias("added_lines"), side("-").alias("removed_lines"))

    return F.transform(blocks, one)


def merge_reviews(rows: DataFrame, key: str = "id") -> DataFrame:
    """Reviews by entity and provider: largest score and confidence, last summary that is not empty (by ``pos``)."""
    said = F.when(F.coalesce("summary", F.lit("")) != "", F.col("pos"))
    return rows.groupBy(key, "provider").agg(F.max("overall_score").alias("overall_score"), F.max("confidence").alias("confidence"), F.max_by("summary", said).alias("summary"))


def review_signals(comments: DataFrame, providers: dict[str, str]) -> DataFrame:
    """Scores from comments whose author or text names a provider: id, provider, overall_score, confidence, summary, pos."""
    who = F.lower(F.concat_ws(" ", "author", "body"))
    provider = F.lit(None).cast("string")
    for needle, name in providers.items():
        provider = F.when(who.contains(needle.lower()), name).otherwise(provider)
    found = comments.withColumn("provider", provider).where("provider IS NOT NULL")
    return found.select("id", "provider", review_score(F.col("body")).alias("overall_score"), F.lit(0.6).alias("confidence"), F.substring("body", 1, 600).alias("summary"), "pos")
