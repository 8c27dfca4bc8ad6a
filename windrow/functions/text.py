"""Column builders: tokens, sets, links, scores, sketches. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks of Unicode text, as one alternation.
LINE = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
TOKEN = "[a-zA-Z0-9_]+"
HARD = r"(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*#(\d+)"
SOFT = r"#(\d+)"

# Words of titles that carry no meaning of their own.
STOP_TITLE = (
    "fix", "bug", "feat", "feature", "docs", "chore", "refactor", "test", "add", "update", "improve", "support", "allow",
    "enable", "with", "from", "when", "after", "before", "into", "for", "the", "and", "or", "web", "search", "provider",
)

MERSENNE = (1 << 31) - 1


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased after matching."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def lines(text: Column) -> Column:
    """Stripped, non-empty lines."""
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), LINE), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != "")


def module_bucket(path: Column) -> Column:
    """The first two parts of a path and ``/*``; ``root/*`` for an empty one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) == 0, "root/*").otherwise(F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/*")))


def hard_links(text: Column) -> Column:
    """Issue numbers after a closing word, distinct, in string order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HARD), F.lit(1))))


def soft_links(text: Column) -> Column:
    """Other issue numbers after a hash sign."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SOFT), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), hard_links(text)))


def review_score(text: Column) -> Column:
    """n/100, else ``score`` and a fraction, else n%; one half without any; values above 1 are hundredths."""

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    found = F.coalesce(
        part(r"(\d{1,3})\s*/\s*100"),
        part(r"(?i)score\s*[:=]\s*(0(?:\.\d+)?|1(?:\.0+)?)"),
        part(r"(\d{1,3})\s*%"),
    ).cast("double")
    scaled = F.when(found > 1, found / 100).otherwise(found)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(scaled, F.lit(0.5))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; 0 when one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    zipped = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(zipped, F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; 0 when a vector is empty or zero."""
    return scaled(a, b, norm(a) * norm(b))


def scaled(a: Column, b: Column, scale: Column) -> Column:
    """The cosine from the product of the norms."""
    ratio = F.when(scale > 0, dot(a, b) / F.when(scale > 0, scale).otherwise(1.0)).otherwise(0.0)
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)), F.lit(0.0))


def shingles(words: Column, k: int) -> Column:
    """Distinct runs of k words, joined by a space; a shorter text is one shingle, an empty one has none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def hash60(text: Column) -> Column:
    """The first 15 hex digits of md5, a non-negative bigint; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash28(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def permutation(i: int) -> tuple[int, int]:
    """Multiplier and offset of the i-th affine permutation modulo 2^31 - 1; products with 28-bit hashes fit 64 bits."""
    return 1 + (i * 1_103_515_245 + 12_345) % (MERSENNE - 1), (i * 214_013 + 2_531_011) % MERSENNE


def salient(words: Column) -> Column:
    """Title words of four letters or more that are no stop words."""
    stop = F.array(*map(F.lit, STOP_TITLE))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w)))


def size_penalty(churn_a: Column, churn_b: Column) -> Column:
    """log10 of the ratio of the two sizes (1 at least each), between 0 and 1."""
    a, b = F.greatest(churn_a, F.lit(1)).cast("double"), F.greatest(churn_b, F.lit(1)).cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(F.greatest(a, b) / F.least(a, b))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chunks(value: Column, bits: int = 64, width: int = 16) -> Column:
    """(index, part) of a sketch cut into parts of ``width`` bits."""
    return F.array(*(
        F.struct(F.lit(i).alias("idx"), F.shiftrightunsigned(value, width * i).bitwiseAND((1 << width) - 1).alias("part"))
        for i in range(bits // width)
    ))


def kind_of(entity_id: Column, without: str = "unknown") -> Column:
    """What stands before the colon of an id."""
    return F.when(F.instr(entity_id, ":") > 0, F.substring_index(entity_id, ":", 1)).otherwise(F.lit(without))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
