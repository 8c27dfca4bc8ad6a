"""Features of all pairs of fingerprints that share a key, however many hold it: a pair is a row only once it is scored.

The holders of a key meet in squares of about ``SIDE`` by ``SIDE`` of them, those of small keys in squares of many keys. A
pair is made in the square of the first key that both hold, so that no pairs are shuffled or made twice. Rows without an id
and keys that are null meet nobody; a null list is an empty one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.operators import scoring
from windrow.operators.sketch import SIMHASH_BITS
from windrow.session import materialise

#: Holders on a side of a square, rows scored at once on a side, most holders of a small key, rows of a square of small keys.
SIDE, PART, SMALL, TOGETHER = 2_048, 256, 64, 192
#: Shared members that are counted at once.
BATCH = 1_000_000
SETS = ("patch_ids", "hunk_signatures", "changed_files", "salient", "linked_issues", "soft_linked_issues", "winnow")
RATIOS = ("lineage", "hunk_overlap", "file_overlap", "title_salient", "hard_link", "soft_link", "semantic_text", "semantic_diff", "minhash", "simhash", "winnow")


def scored(fingerprints: DataFrame, kinds: dict[str, str], cfg: dict[str, Any]) -> DataFrame:
    """entity_a < entity_b and every feature, of all pairs that share a key of one of the kinds (kind -> column)."""
    named = F.concat(*(F.transform(F.array_compact(F.col(c).cast("array<string>")), lambda k, kind=kind: F.concat(F.lit(f"{kind}:"), k)) for kind, c in kinds.items()))
    slim = fingerprints.where("entity_id IS NOT NULL").select("entity_id", F.explode(named).alias("key")).distinct()
    sizes = materialise(slim.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    small = sizes.where(F.col("n") <= SMALL).agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("key"), F.lit(1 + small // TOGETHER)).cast("string")
    home = F.when(F.col("n") <= SMALL, F.concat(F.lit("small:"), bucket)).otherwise(F.concat(F.lit("large:"), "key"))
    cuts = F.when(F.col("n") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("n") / SIDE)).cast("int")
    held = slim.join(sizes.select("key", home.alias("home"), cuts.alias("cuts")), "key")
    held = held.groupBy("entity_id").agg(F.collect_list(F.struct("key", "home", "cuts")).alias("held"))
    held = held.select("entity_id", F.col("held.key").alias("keys"), F.col("held.home").alias("homes"), F.array_distinct(F.transform("held", lambda x: x.dropFields("key"))).alias("at"))
    vectors = ("text_embedding", "diff_embedding", "text_norm", "diff_norm", "signature", "simhash")
    whole = fingerprints.select("entity_id", *SETS, *vectors, (F.col("additions") + F.col("deletions")).cast("long").alias("churn")).join(held, "entity_id")
    rows = whole.withColumn("at", F.explode("at")).withColumn("own", F.pmod(F.xxhash64("entity_id"), F.col("at.cuts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("at.cuts") - 1)))
    rows = rows.select(
        F.col("at.home").alias("home"), F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), (F.col("with") < F.col("own")).alias("second"),
        *(c for c in whole.columns if c != "at"),
    )
    made = rows.groupBy("home", "p", "q").applyInArrow(_square(cfg["similarity"]["lineage_min_shared"]), _SCHEMA)
    return scoring.totals(made.withColumn("penalty", scoring.T.size_penalty(F.col("churn_a"), F.col("churn_b"))), cfg).drop("churn_a", "churn_b")


_SCHEMA = "entity_a string, entity_b string, churn_a long, churn_b long, " + ", ".join(f"{c} double" for c in RATIOS)


class _Sets:
    """The distinct members of each row's list as codes, sorted by row and code; codes follow the members' order."""

    def __init__(self, column: pa.Array):
        at = column.offsets.to_numpy().astype(np.int64)
        coded = column.flatten().dictionary_encode(null_encoding="encode")
        names = coded.dictionary.to_pylist()
        order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] if names[i] is not None else 0))
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        self.names = [names[i] for i in order]
        n, width = len(column), max(1, len(names))
        size = np.diff(at) if column.null_count == 0 else np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        one = np.unique(np.repeat(np.arange(n), size) * width + rank[coded.indices.to_numpy()])
        self.row, self.code = one // width, one % width
        self.at = np.searchsorted(self.row, np.arange(n + 1))
        self.size = np.diff(self.at)

    def part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows from ``low`` on and codes of a slice, sorted by code."""
        here = slice(self.at[low], self.at[high])
        order = np.argsort(self.code[here], kind="stable")
        return self.row[here][order] - low, self.code[here][order]

    def met(self, a: tuple[int, int], b: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs (in a square of a by b) and codes that both have, from the last code to the first."""
        (i, x), (j, y) = self.part(*a), self.part(*b)
        i, x = i[::-1], x[::-1]
        low = np.searchsorted(y, x)
        n = np.searchsorted(y, x, side="right") - low
        ends = np.cumsum(n)
        start = 0
        while start < len(x):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH, side="right")))
            k, before = n[start:stop], ends[start:stop] - n[start:stop] - (ends[start - 1] if start else 0)
            right = np.repeat(low[start:stop] - before, k) + np.arange(k.sum())
            yield np.repeat(i[start:stop], k) * (b[1] - b[0]) + j[right], np.repeat(x[start:stop], k)
            start = stop

    def shared(self, a: tuple[int, int], b: tuple[int, int], pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the picked pairs: shared members, and the sizes of the two sets."""
        width = b[1] - b[0]
        count = np.zeros((a[1] - a[0]) * width, np.int64)
        for place, _ in self.met(a, b):
            count += np.bincount(place, minlength=len(count))
        return count[pick], self.size[a[0] + pick // width], self.size[b[0] + pick % width]


def _matrix(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Rows filled with zeros to one width, and their lengths."""
    at = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(at) if column.null_count == 0 else np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    out = np.zeros((len(column), max(1, int(size.max(initial=0)))), kind)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, size


def _jaccard(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return both / np.maximum(a + b - both, 1)


def _overlap(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return both / np.maximum(np.minimum(a, b), 1)


def _square(least_shared: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("second").combine_chunks()
        col = lambda c: table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0)
        second, home = int(np.sum(table.column("second").to_numpy())), table.column("home")[0].as_py()
        n, ids = table.num_rows, col("entity_id")
        first = n - second
        names = ids.to_pylist()
        place = {x: i for i, x in enumerate(sorted(set(names), key=str.encode))}
        rank = np.array([place[x] for x in names])
        keys = _Sets(col("keys"))
        homes = dict(zip(col("keys").flatten().to_pylist(), col("homes").flatten().to_pylist(), strict=True))
        here = np.array([homes[k] == home for k in keys.names])
        sets = {c: _Sets(col(c)) for c in SETS}
        signs, sizes = _matrix(col("signature"), np.int64)
        vectors = {c: (_matrix(col(f"{c}_embedding"), np.float64)[0], table.column(f"{c}_norm").fill_null(0.0).to_numpy()) for c in ("text", "diff")}
        bits, churn = table.column("simhash").fill_null(0).to_numpy(), col("churn")
        lefts, rights = ((0, first), (first, n)) if second else ((0, n), (0, n))
        for i in range(*lefts, PART):
            for j in range(*rights, PART):
                if not second and j < i:
                    continue
                a, b = (i, min(i + PART, lefts[1])), (j, min(j + PART, rights[1]))
                width = b[1] - b[0]
                lead = np.full((a[1] - a[0]) * width, -1)
                for at, code in keys.met(a, b):
                    lead[at] = code  # of a pair's keys the first comes last and stays
                pick = np.flatnonzero(lead >= 0)
                pick = pick[here[lead[pick]]]
                x, y = i + pick // width, j + pick % width
                keep = (rank[x] != rank[y]) if second else (rank[x] != rank[y]) & (x < y)
                pick, x, y = pick[keep], x[keep], y[keep]
                if not len(pick):
                    continue
                out = {}
                for c, name in zip(SETS, ("lineage", "hunk_overlap", "file_overlap", "title_salient", "hard_link", "soft_link", "winnow"), strict=True):
                    both, m, k = sets[c].shared(a, b, pick)
                    out[name] = _jaccard(both, m, k)
                    if name == "hard_link":
                        out[name] = np.maximum(out[name], _overlap(both, m, k))
                    if name == "lineage":
                        out[name] = np.where(both >= least_shared, np.maximum(out[name], _overlap(both, m, k)), out[name])
                for c, (v, norm) in vectors.items():
                    dots, scale = (v[a[0] : a[1]] @ v[b[0] : b[1]].T).ravel()[pick], norm[x] * norm[y]
                    out[f"semantic_{c}"] = np.clip(np.where(scale > 0, dots / np.where(scale > 0, scale, 1.0), 0.0), 0.0, 1.0)
                same = np.zeros((a[1] - a[0], width), np.int64)
                for s in range(signs.shape[1]):
                    same += signs[a[0] : a[1], s, None] == signs[None, b[0] : b[1], s]
                same = same.ravel()[pick] - (signs.shape[1] - sizes[x])  # what fills up short rows is the same
                out["minhash"] = np.where((sizes[x] == 0) | (sizes[x] != sizes[y]), 0.0, same / np.maximum(sizes[x], 1))
                out["simhash"] = np.maximum(0.0, 1 - np.bitwise_count((bits[x] ^ bits[y]).view(np.uint64)) / SIMHASH_BITS)
                swap = rank[x] > rank[y]
                x, y = pa.array(np.where(swap, y, x)), pa.array(np.where(swap, x, y))
                yield pa.record_batch([ids.take(x), ids.take(y), churn.take(x), churn.take(y), *(pa.array(out[c]) for c in RATIOS)], ["entity_a", "entity_b", "churn_a", "churn_b", *RATIOS])

    return run
