"""MinHash, LSH bands, SimHash and winnowing as DataFrame stages; one hash a token, then arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.text import MERSENNE, hash28, hash60, permutation, shingles, tokens


#: Bits of a SimHash here: what 15 hex digits of md5 hold.
SIMHASH_BITS = 60


def minhash(df: DataFrame, key: str, words: Column, k: int = 3, n: int = 64) -> DataFrame:
    """key, signature: n seeded minima over the k-word shingles; a row without words has a signature of zeros."""
    cut = df.select(F.col(key).alias("key"), words.alias("w"))  # a column of its own: an expression would be evaluated for every shingle
    rows = cut.select("key", F.explode_outer(shingles(F.col("w"), k)).alias("s")).withColumn("h", hash28(F.col("s")))
    minima = []
    for i in range(n):
        a, b = permutation(i)
        minima.append(F.coalesce(F.min((F.col("h") * a + b) % MERSENNE), F.lit(0).cast("bigint")).alias(f"m{i}"))
    return rows.groupBy("key").agg(*minima).select("key", F.array(*(f"m{i}" for i in range(n))).alias("signature"))


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal places; 0 for empty signatures or different lengths."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), 0.0).otherwise(equal / F.greatest(F.size(a), F.lit(1)))


def bands(signature: Column, n: int = 64, count: int = 8) -> Column:
    """Keys ``band:i:hash`` of runs of the signature; what does not fill a band is left out."""
    rows = max(1, n // count)
    return F.array(*(
        F.concat(F.lit(f"band:{i}:"), hash60(F.array_join(F.transform(F.slice(signature, i * rows + 1, rows), lambda x: x.cast("string")), ",")).cast("string"))
        for i in range(min(count, n // rows))
    ))


def simhash(df: DataFrame, key: str, words: Column, bits: int = SIMHASH_BITS) -> DataFrame:
    """key, simhash: each bit is set when at least half of the tokens (with repeats) set it; 0 without tokens."""
    every = df.select(F.col(key).alias("key"))
    counted = df.select(F.col(key).alias("key"), F.explode(words).alias("w")).groupBy("key", "w").agg(F.count("*").alias("n"))
    hashed = counted.select("key", "n", hash60(F.col("w")).alias("h"))
    sums = [F.sum(F.when(F.shiftright("h", i).bitwiseAND(1) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"b{i}") for i in range(bits)]
    value = F.lit(0).cast("bigint")
    for i in range(bits):
        value = value + F.when(F.col(f"b{i}") >= 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    found = hashed.groupBy("key").agg(*sums).select("key", value.alias("simhash"))
    return every.join(found, "key", "left").select("key", F.coalesce("simhash", F.lit(0).cast("bigint")).alias("simhash"))


def simhash_similarity(a: Column, b: Column, bits: int = SIMHASH_BITS) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.bit_count(a.bitwiseXOR(b)) / bits)


def winnow(df: DataFrame, key: str, words: Column, k: int = 5, window: int = 4) -> DataFrame:
    """key, h: minima of ``window`` neighbouring k-gram hashes; with fewer grams, the minimum of all."""
    cut = df.select(F.col(key).alias("key"), words.alias("w"))
    n = F.size("w")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))
    hashed = cut.where(n > 0).select("key", F.transform(grams, hash60).alias("h"))
    # The minimum of each window lies in the row itself: no sort, no shuffle.
    low = F.transform(F.sequence(F.lit(1), F.greatest(F.size("h") - window + 1, F.lit(1))), lambda i: F.array_min(F.slice("h", i, F.lit(window))))
    return hashed.select("key", F.explode(F.array_distinct(low)).alias("h"))


#: The kernels below make the same sketches of a batch of rows without a shuffle. Lists are cut in pieces of so many words.
PIECE = 200_000


def cut(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Starts of the lists, the place of each of their words among the distinct ones, and these."""
    at = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    return at - at[0], words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()


def pieces(at: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` words."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


def embedded(lists: pa.ListArray, dims: int) -> np.ndarray:
    """A row a list: signed token counts in hashed places, to unit length."""
    at, code, distinct = cut(lists)
    raw = [sha256(w.encode()).digest() for w in distinct]
    place = np.fromiter((int.from_bytes(h[:4], "big") % dims for h in raw), np.int64, len(raw))
    sign = np.fromiter((-1.0 if h[-1] & 1 else 1.0 for h in raw), np.float64, len(raw))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.bincount(owner * dims + place[code], sign[code], (len(at) - 1) * dims).astype(np.float64).reshape(-1, dims)  # without words the counts are whole numbers
    length = np.sqrt((out * out).sum(axis=1))
    out[length > 0] /= length[length > 0, None]
    return out


def simhashes(lists: pa.ListArray, bits: int = SIMHASH_BITS) -> np.ndarray:
    at, code, distinct = cut(lists)
    h = np.fromiter((int.from_bytes(md5(w.encode()).digest()[:8], "big") >> 4 for w in distinct), np.int64, len(distinct))
    sign = (((h[:, None] >> np.arange(bits)) & 1) * 2 - 1).astype(np.int32)
    out = np.zeros(len(at) - 1, np.int64)
    full = np.flatnonzero(np.diff(at) > 0)
    ends = np.append(at[full], at[-1])
    for i, j in pieces(ends):
        sums = np.add.reduceat(sign[code[ends[i] : ends[j]]], ends[i:j] - ends[i], axis=0)
        out[full[i:j]] = ((sums >= 0).astype(np.int64) << np.arange(bits)).sum(axis=1)
    return out


def grams(words: list[str], at: np.ndarray, k: int) -> tuple[list[bytes], np.ndarray]:
    """md5 of the runs of k words of each list (a shorter one is one run), and the starts of the lists in them."""
    out, starts = [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        w = words[a:b]
        runs = [w[i:] for i in range(k)] if len(w) > k else []
        joined = map(" ".join, zip(*runs, strict=False)) if runs else ([" ".join(w)] if w else [])
        out.extend(md5(x.encode()).digest() for x in joined)
        starts.append(len(out))
    return out, np.array(starts, np.int64)


def minhashes(lists: pa.ListArray, k: int, n: int) -> np.ndarray:
    """A row a list; zeros without words."""
    words, at = lists.flatten().to_pylist(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    out = np.zeros((len(at) - 1, n), np.int64)
    for i, j in pieces(at):
        raw, starts = grams(words[at[i] : at[j]], at[i : j + 1] - at[i], k)
        h = np.fromiter((int.from_bytes(x[:4], "big") >> 4 for x in raw), np.int64, len(raw))
        full = np.flatnonzero(np.diff(starts) > 0)
        if not len(full):
            continue
        for p in range(n):
            a, b = permutation(p)
            x = h * a + b
            x = (x & MERSENNE) + (x >> 31)
            out[i + full, p] = np.minimum.reduceat(np.where(x >= MERSENNE, x - MERSENNE, x), starts[full])
    return out


def winnowed(lists: pa.ListArray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct minima of ``window`` neighbouring k-gram hashes of each list in order, and the starts of the lists in them."""
    words, at = lists.flatten().to_pylist(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    found, counts = [], np.zeros(len(at) - 1, np.int64)
    for i, j in pieces(at):
        raw, starts = grams(words[at[i] : at[j]], at[i : j + 1] - at[i], k)
        h = np.fromiter((int.from_bytes(x[:8], "big") >> 4 for x in raw), np.int64, len(raw))
        held = np.diff(starts)
        owner = np.repeat(np.arange(i, j), held)
        left = np.repeat(starts[1:], held) - np.arange(len(h))  # grams from this one to the end of its list
        low = h.copy()
        for step in range(1, window):
            ok = np.flatnonzero(left > step)
            low[ok] = np.minimum(low[ok], h[ok + step])
        first = np.arange(len(h)) == np.repeat(starts[:-1], held)
        take = (left >= window) | first
        owner, low = owner[take], low[take]
        order = np.lexsort((low, owner))
        owner, low = owner[order], low[order]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (low[1:] != low[:-1])
        found.append(low[fresh])
        counts[i:j] = np.bincount(owner[fresh] - i, minlength=j - i)
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(counts)])


def simhash_rows(df: DataFrame, key: str, words: Column) -> DataFrame:
    """key, simhash of every row, made in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(simhashes(batch.column(1)))], ["key", "simhash"])

    return df.select(F.col(key).alias("key"), words.alias("w")).mapInArrow(run, f"key {dict(df.dtypes)[key]}, simhash long")


__all__ = ["bands", "minhash", "minhash_similarity", "simhash", "simhash_similarity", "tokens", "winnow"]
