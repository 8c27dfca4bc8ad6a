"""Text functions and sketches over whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions import text as T
from windrow.operators import fingerprint, lowpass, sketch
from windrow.session import materialise, spread, table



def _md5(words) -> F.Column:  # noqa: ANN001
    return F.md5(F.array_join(words, " "))


def s_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = T.tokens(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), _md5(w).alias("digest")
    )


TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+'), lambda x: lower(x))"
S_TOKENS = f"""SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS digest
FROM (SELECT doc_id, {TOKENS} AS w FROM documents)"""


def s_module_bucket(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").groupBy(T.module_bucket(path).alias("bucket")).agg(F.count("*").alias("n"))


S_MODULE = """SELECT CASE WHEN len(p) = 0 THEN 'root/*' ELSE array_to_string(p[1:2], '/') || '/*' END AS bucket, count(*) AS n
FROM (SELECT list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p FROM pages) GROUP BY 1"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat("text", F.lit(" Fixes #"), "conv_id", F.lit(", see #"), "turn", F.lit(" and closes #"), "turn", F.lit("."))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", said.alias("said"))


SAID = "(SELECT conv_id, turn, role, concat(text, ' Fixes #', conv_id, ', see #', turn, ' and closes #', turn, '.') AS said FROM conversations)"
HARD = r"list_sort(list_distinct(regexp_extract_all(said, '(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*#([0-9]+)', 1)))"


def s_links_hard(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", F.array_join(T.hard_links(F.col("said")), ",").alias("links"))


def s_links_soft(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", F.array_join(T.soft_links(F.concat(F.col("said"), F.lit(" #9"))), ",").alias("links"))


S_SOFT = f"""SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(said, '#([0-9]+)', 1)),
  lambda x: NOT list_contains({HARD}, x))), ',') AS links FROM (SELECT conv_id, turn, said || ' #9' AS said FROM {SAID})"""


def s_score_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("conv_id") % 5
    tail = (
        F.when(k == 0, F.concat(F.lit(" rated "), (F.col("turn") * 7 % 120).cast("string"), F.lit("/100")))
        .when(k == 1, F.lit(" Score: 0.82"))
        .when(k == 2, F.concat((F.col("turn") * 11 % 130).cast("string"), F.lit("% sure")))
        .when(k == 3, F.lit("score: 10%"))
        .otherwise("")
    )
    said = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.regexp_replace("text", "[0-9]", ""), tail).alias("said"))
    return said.select("conv_id", "turn", F.round(T.review_score(F.col("said")), 6).alias("score"))


S_SCORE = r"""WITH s AS (SELECT conv_id, turn, regexp_replace(text, '[0-9]', '', 'g') || CASE conv_id % 5
  WHEN 0 THEN ' rated ' || (turn * 7 % 120) || '/100' WHEN 1 THEN ' Score: 0.82' WHEN 2 THEN (turn * 11 % 130) || '% sure'
  WHEN 3 THEN 'score: 10%' ELSE '' END AS said FROM conversations),
v AS (SELECT conv_id, turn, CAST(coalesce(nullif(regexp_extract(said, '([0-9]{1,3})\s*/\s*100', 1), ''),
  nullif(regexp_extract(said, '(?i)score\s*[:=]\s*(0(?:\.[0-9]+)?|1(?:\.0+)?)', 1), ''), nullif(regexp_extract(said, '([0-9]{1,3})\s*%', 1), '')) AS DOUBLE) AS x FROM s)
SELECT conv_id, turn, round(least(1.0, greatest(0.0, coalesce(CASE WHEN x > 1 THEN x / 100 ELSE x END, 0.5))), 6) AS score FROM v"""


def s_shingles_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation against the next one."""
    cut = table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    turns = cut.select("conv_id", "turn", T.shingles(F.col("w"), 2).alias("s"))
    following = F.lead("s").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("t", following).where("t IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(T.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"), F.round(T.overlap(F.col("s"), F.col("t")), 6).alias("overlap"))


S_JACCARD = f"""WITH w AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
p AS (SELECT conv_id, turn, s, lead(s) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM s)
SELECT conv_id, turn, round(CASE WHEN len(s) + len(t) = 0 THEN 0.0 ELSE len(list_intersect(s, t))::DOUBLE / len(list_distinct(list_concat(s, t))) END, 6) AS jaccard,
  round(CASE WHEN least(len(s), len(t)) = 0 THEN 0.0 ELSE len(list_intersect(s, t))::DOUBLE / least(len(s), len(t)) END, 6) AS overlap FROM p WHERE t IS NOT NULL"""

N_MIN = 64


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return sketch.minhash(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", T.tokens(F.col("text")), 3, N_MIN)


def s_minhash_sig(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d).select(F.col("key").alias("doc_id"), F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


def s_lsh_bands(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d).select(F.col("key").alias("doc_id"), F.explode(sketch.bands(F.col("signature"), N_MIN, 8)).alias("band"))


_H28 = "CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)"
_H60 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
SHINGLES3 = """CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END"""
_PERMS = ", ".join("coalesce(min((h * {} + {}) % {}), 0)".format(*T.permutation(i), T.MERSENNE) for i in range(N_MIN))
_SIGS = f"""w AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT doc_id, {SHINGLES3} AS s FROM w),
e AS (SELECT doc_id, {_H28} AS h FROM (SELECT doc_id, unnest(s) AS x FROM s)),
g AS (SELECT s.doc_id, [{_PERMS}] AS sig FROM s LEFT JOIN e ON s.doc_id = e.doc_id GROUP BY s.doc_id)"""
S_MINHASH = f"WITH {_SIGS} SELECT doc_id, array_to_string(sig, ',') AS signature FROM g"
S_BANDS = f"""WITH {_SIGS}, b AS (SELECT doc_id, sig, unnest(range(0, 8)) AS i FROM g)
SELECT doc_id, 'band:' || i || ':' || {_H60.format("array_to_string(sig[i * 8 + 1 : i * 8 + 8], ',')")} AS band FROM b"""


def _simhashes(spark: SparkSession, d: str) -> DataFrame:
    return sketch.simhash(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", T.tokens(F.col("text")))


def s_simhash(spark: SparkSession, d: str) -> DataFrame:
    return _simhashes(spark, d).select(F.col("key").alias("doc_id"), "simhash")


def hamming_pairs(rows: DataFrame, most: int = 3, parts: int = 6) -> DataFrame:
    """doc_a, doc_b, distance of rows (key, simhash) that differ in ``most`` bits or fewer.

    Equal values are one class. Of ``parts`` chunks such values agree in all but ``most``: classes meet in each choice of so
    many chunks, which are far rarer than one, and a pair counts under the first choice that it agrees in."""
    width = sketch.SIMHASH_BITS // parts
    picks = list(combinations(range(parts), parts - most))
    masks = [sum(((1 << width) - 1) << (width * i) for i in pick) for pick in picks]
    rows = materialise(rows.where("key IS NOT NULL").distinct(), "simhashes")
    values = rows.select("simhash").distinct()
    agreed = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.col("simhash").bitwiseAND(m).alias("c")) for g, m in enumerate(masks)))).alias("x")
    keyed = values.select("simhash", agreed).select("simhash", "x.g", "x.c")
    met = keyed.join(keyed.select(F.col("simhash").alias("v"), "g", "c"), ["g", "c"]).where("simhash < v")
    met = met.withColumn("d", T.hamming(F.col("simhash"), F.col("v")).cast("long")).where(F.col("d") <= most)
    apart, first = F.col("simhash").bitwiseXOR(F.col("v")), F.lit(len(masks))
    for g in reversed(range(len(masks))):
        first = F.when(apart.bitwiseAND(masks[g]) == 0, g).otherwise(first)
    near = materialise(met.where(first == F.col("g")).select("simhash", "v", "d"), "near")
    b = rows.select(F.col("key").alias("other"), F.col("simhash").alias("v"))
    found = rows.join(near, "simhash").join(b, "v").select(F.least("key", "other").alias("doc_a"), F.greatest("key", "other").alias("doc_b"), F.col("d").alias("distance"))
    same = rows.join(b, F.col("simhash") == F.col("v")).where("key < other")
    return found.unionByName(same.select(F.col("key").alias("doc_a"), F.col("other").alias("doc_b"), F.lit(0).cast("long").alias("distance")))


def s_simhash_hamming(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose SimHashes differ in at most three bits. Of a repeated doc_id all texts make one SimHash."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    once = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return hamming_pairs(sketch.simhash_rows(docs, "doc_id", T.tokens(F.col("text"))) if once else _simhashes(spark, d))


_BITS = " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) >= 0 THEN {1 << i} ELSE 0 END" for i in range(60))
_SIM = f"""h AS (SELECT doc_id, {_H60.format("x")} AS h FROM (SELECT doc_id, unnest({TOKENS}) AS x FROM documents)),
g AS (SELECT doc_id, CAST({_BITS} AS BIGINT) AS simhash FROM h GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(g.simhash, 0) AS simhash FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id)"""
S_SIMHASH = f"WITH {_SIM} SELECT doc_id, simhash FROM f"
S_HAMMING = f"""WITH {_SIM}, c AS (SELECT doc_id, simhash, i, (simhash >> (15 * i)) & 32767 AS c FROM f, (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b, CAST(bit_count(xor(a.simhash, b.simhash)) AS BIGINT) AS distance
FROM c a JOIN c b ON a.i = b.i AND a.c = b.c AND a.doc_id < b.doc_id WHERE bit_count(xor(a.simhash, b.simhash)) <= 3"""


def s_winnow(spark: SparkSession, d: str) -> DataFrame:
    return sketch.winnow(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", T.tokens(F.col("text"))).select(F.col("key").alias("doc_id"), "h")


S_WINNOW = f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS i, w FROM w WHERE len(w) > 0),
h AS (SELECT doc_id, n, i, {_H60.format("array_to_string(w[i + 1 : i + 5], ' ')")} AS h FROM g),
m AS (SELECT doc_id, n, i, min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h, greatest(n - 4, 1) AS c FROM h)
SELECT DISTINCT doc_id, h FROM m WHERE i >= 3 OR (c < 4 AND i = c - 1)"""


def s_hash_embed(spark: SparkSession, d: str) -> DataFrame:
    out = fingerprint.hash_embedding(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return out.select(F.col("key").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"))


S_EMBED = """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents),
h AS (SELECT doc_id, sha256(w) AS h FROM w),
p AS (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS idx, sum(CASE WHEN CAST('0x' || right(h, 1) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END) AS v FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(CAST(v * v AS DOUBLE))) AS l FROM p GROUP BY 1)
SELECT p.doc_id, p.idx, round(v / l, 6) AS value FROM p JOIN n ON p.doc_id = n.doc_id WHERE v <> 0"""


def s_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the next one of its label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    order = Window.partitionBy("label").orderBy("vec_id")
    pairs = rows.withColumns({"f": F.lead("e").over(order), "other": F.lead("vec_id").over(order)}).where("f IS NOT NULL")
    return pairs.select("vec_id", "other", F.round(T.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


S_COSINE = """WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, lead(CAST(embedding AS DOUBLE[])) OVER w AS f, lead(vec_id) OVER w AS other
FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, other, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * f[i]))
  / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(f, lambda x: x * x)))), 6) AS cosine FROM p WHERE f IS NOT NULL"""


def f_template_noise(spark: SparkSession, d: str) -> DataFrame:
    """Bodies in an issue template's clothes: every fourth conversation turn has its headings in front."""
    body = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("## Summary\n1.\n## Expected behavior\n2.\n"), F.substring_index("text", " ", 9))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))
    return rows.select("conv_id", "turn", lowpass.template_noise(F.col("body"), 0.7, 12).alias("noise"), lowpass.one_liner(F.col("body"), 14).alias("one_liner"))


F_TEMPLATE = r"""WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN concat('## Summary', chr(10), '1.', chr(10), '## Expected behavior', chr(10), '2.', chr(10),
  array_to_string(string_split(text, ' ')[1:9], ' ')) ELSE text END AS body FROM conversations),
l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM b),
c AS (SELECT conv_id, turn, l, list_filter(l, lambda x: NOT (lower(x) IN ('1.', '2.', '3.', 'what went wrong?', 'what did you expect to happen?', 'what actually happened?')
  OR starts_with(lower(x), '## summary') OR starts_with(lower(x), '## steps to reproduce') OR starts_with(lower(x), '## expected behavior')
  OR starts_with(lower(x), '## actual behavior') OR starts_with(lower(x), '## proposed solution') OR starts_with(lower(x), '## additional context'))) AS c FROM l),
n AS (SELECT conv_id, turn, l, c, len(regexp_extract_all(array_to_string(c, chr(10)), '[a-zA-Z0-9_]+')) AS n FROM c)
SELECT conv_id, turn, (len(l) > 0 AND (len(l) - len(c))::DOUBLE / greatest(len(l), 1) >= 0.7 AND n <= 12) AS noise, (len(c) <= 1 AND n <= 14) AS one_liner FROM n"""

QUERIES = {f.__name__: f for f in (
    s_tokens, s_module_bucket, s_links_hard, s_links_soft, s_score_extract, s_shingles_jaccard, s_minhash_sig, s_lsh_bands, s_simhash,
    s_simhash_hamming, s_winnow, s_hash_embed, s_cosine_pairs, f_template_noise,
)}
ORACLES = {
    "s_tokens": S_TOKENS, "s_module_bucket": S_MODULE,
    "s_links_hard": f"SELECT conv_id, turn, array_to_string({HARD}, ',') AS links FROM {SAID}",
    "s_links_soft": S_SOFT, "s_score_extract": S_SCORE, "s_shingles_jaccard": S_JACCARD, "s_minhash_sig": S_MINHASH,
    "s_lsh_bands": S_BANDS, "s_simhash": S_SIMHASH, "s_simhash_hamming": S_HAMMING, "s_winnow": S_WINNOW,
    "s_hash_embed": S_EMBED, "s_cosine_pairs": S_COSINE, "f_template_noise": F_TEMPLATE,
}
