"""N-gram Jaccard join of documents: which texts share enough word shingles, and the groups that they form.

1. The set of a text is its distinct shingles, each a 64-bit hash, as a sorted array. Equal sets are one class.
2. Prefix filter: all sets are ordered by one global order, frequent shingles last. Two sets that link share a
   shingle among the first ``n - ceil(t n) + 1`` of each, so classes meet in tiles, one for each such shingle. The
   list of frequent shingles only shapes that order: an incomplete list costs time, never a link.
3. Tiles are banded by size: only sets whose sizes allow the threshold are paired. Small tiles pair within one task.
   Large tiles first pair each class with the tile's leader of its band and the band below; after these links are
   known, classes outside a tile's main component are paired with the others of the tile in other components, in
   squares of bounded size and mostly once, however many tiles two classes share.
4. Pairs are checked in batches to which each set is sent once: first only bitmaps of hashed shingles, whose counts of
   bits bound the overlap from above; then, for the pairs left, the sets themselves, which are intersected exactly
   unless the pair is already connected.
5. Components of the links by iterative joins.

Cases: a text with fewer words than the width is one shingle of all its words; texts without words (null, empty)
have the empty set and link with nothing; equal texts link with each other; repeated rows are each returned; a null
doc_id takes part under no id and is returned with component null; of a doc_id with several texts each row has its own
set and group; very long texts are taken whole; ties of order go by hash;
further columns, whatever their names, are ignored by :func:`groups` and kept by :func:`drop_near`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.batches import id_text, lower_az, mix64, numbered, offsets, slices, windows, word_hashes, words_of
from windrow.operators.components import components
from windrow.session import materialise, release

SMALL_TILE = 128
BATCH_PAIRS = 6_000
#: Bytes outside words of ASCII letters, digits and underscores are blanks.
PLAIN = bytes(c if chr(c).isascii() and (chr(c).isalnum() or c == 95) else 32 for c in range(256))
#: Members of a large tile that meet in one task, and the first open tiles of each that say where a pair met before.
SQUARE, EARLY = 2_000, 8


def shingle_sets(texts: list[str], width: int, between: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after another, and the starts of the texts. With ``between`` words are runs
    of ASCII letters, digits and underscores, and what stands on either side of it is a text of its own; all such parts make
    one set."""
    if between and any(between in t for t in texts):
        parts = [t.split(between) for t in texts]
        keys, at = shingle_sets(list(chain.from_iterable(parts)), width, between)
        owner = np.repeat(np.repeat(np.arange(len(texts)), list(map(len, parts))), np.diff(at))
        return _sorted_sets(keys, owner, len(texts))
    if between:
        texts = [t.encode("utf-8", "surrogatepass").translate(PLAIN).decode("ascii") for t in texts]
    words = [words_of(lower_az(t)) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    at = offsets(counts)
    place, distinct = numbered([w for ws in words for w in ws])
    h = word_hashes(distinct)[place] if len(place) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    w = windows(h, width)
    inside = doc[: len(w)] == doc[width - 1 :] if len(w) else np.zeros(0, bool)
    keys, owner = w[inside], doc[: len(w)][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.array([windows(h[at[i] : at[i + 1]], int(counts[i]))[0] ^ np.uint64(counts[i]) for i in short], np.uint64)
        keys, owner = np.concatenate([keys, own]), np.concatenate([owner, short])
    return _sorted_sets(keys, owner, len(texts))


def _sorted_sets(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh]
    return keys, offsets(np.bincount(owner, minlength=n))


def _local_frequent(width: int, least: int, between: str | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, 6_000_000):
            keys, _ = shingle_sets(texts, width, between)
            found, n = np.unique(keys, return_counts=True)
            often = n >= least
            yield pa.record_batch([pa.array(found[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

    return run


def frequent_shingles(docs: DataFrame, width: int, least: int = 64, most: int = 100_000, between: str | None = None) -> dict[str, np.ndarray]:
    """Shingles that many documents hold, with approximate counts: at most ``most``, sorted by hash."""
    found = id_text(docs).mapInArrow(_local_frequent(width, 3, between), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = materialise(found.where(F.col("n") >= least), "frequent")
    levels = found.groupBy(F.floor(4 * F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()
    taken, lowest = 0, None
    for r in levels:
        if taken + r["count"] > most:
            break
        taken, lowest = taken + r["count"], r["level"]
    if lowest is None:
        return {"token": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}
    rows = found.where(F.floor(4 * F.log2("n")) >= lowest).toArrow()
    release(found)
    token, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(token)
    return {"token": token[order], "n": n[order]}


def _classes(docs: DataFrame, width: int, percent: int, hot: dict[str, np.ndarray], between: str | None) -> DataFrame:
    """doc_id, n, the 128-bit digest of the set, its prefix, how many of that are not frequent, and its bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, often = sent.value["token"], sent.value["n"]
        for ids, texts in slices(batches, 3_000_000):
            keys, at = shingle_sets(texts, width, between)
            n = np.diff(at)
            total = np.concatenate([[0], np.cumsum(mix64(keys + np.uint64(1)))]).astype(np.uint64)
            d1 = (total[at[1:]] - total[at[:-1]]).view(np.int64)
            total = np.concatenate([[0], np.cumsum(mix64(keys ^ np.uint64(0x5851F42D4C957F2D)))]).astype(np.uint64)
            d2 = (total[at[1:]] - total[at[:-1]]).view(np.int64)
            rank = np.zeros(len(keys), np.int64)
            if len(token) and len(keys):
                spot = np.minimum(np.searchsorted(token, keys), len(token) - 1)
                rank = np.where(token[spot] == keys, often[spot], 0)
            owner = np.repeat(np.arange(len(texts)), n)
            order = np.lexsort((keys, rank, owner))
            place = np.arange(len(keys)) - np.repeat(at[:-1], n)
            length = n - -(-percent * n // 100) + 1
            take = place < np.repeat(length, n)
            first, ranks = keys[order][take], rank[order][take]
            ends = offsets(np.minimum(length, n) * (n > 0))
            hot_from = np.bincount(owner[take], ranks == 0, len(texts)).astype(np.int64)
            maps = [bitmap(keys[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first.view(np.int64)))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(n), pa.array(d1), pa.array(d2), pa.array(hot_from), prefix, pa.array(maps, pa.binary())],
                ["doc_id", "n", "d1", "d2", "own", "prefix", "bits"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, own long, prefix array<long>, bits binary")


def _allows(na, nb, percent: int):  # noqa: ANN001, ANN202
    """Whether sets of these sizes (na <= nb) can reach the threshold."""
    return 100 * na >= percent * nb


def _tile_pairs(percent: int):  # noqa: ANN202
    """Rows token, rep, size (n above 32 bits of pos) of whole tiles -> pairs of small tiles; members of large ones (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in range(3)] for b in batches if b.num_rows]
        if not parts:
            return
        token, rep, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        n, pos = size >> 32, size & 0xFFFFFFFF
        order = np.lexsort((rep, n, token))
        token, rep, n, pos = token[order], rep[order], n[order], pos[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(token)]]))
        found: list[np.ndarray] = []
        small = (sizes > 1) & (sizes <= SMALL_TILE)
        spot = np.repeat(np.where(small, sizes, 0), sizes)
        left = spot - (np.arange(len(token)) - np.repeat(starts, sizes)) - 1
        alive = np.flatnonzero(left > 0)
        for step in range(1, SMALL_TILE):
            alive = alive[left[alive] >= step]
            if not len(alive):
                break
            other = alive + step
            ok = _allows(n[alive], n[other], percent)
            need = -(-percent * (n[alive] + n[other]) // (100 + percent))
            ok &= np.minimum(n[alive] - pos[alive], n[other] - pos[other]) >= need
            if ok.any():
                a, b = rep[alive[ok]], rep[other[ok]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            alive = alive[_allows(n[alive], n[other], percent)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        zero = np.zeros(len(pairs), np.int64)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(zero), pa.array(zero), pa.array(zero)], ["a", "b", "token", "n", "pos"])
        big = np.repeat(sizes > SMALL_TILE, sizes)
        if big.any():
            none = pa.nulls(int(big.sum()), pa.int64())
            yield pa.record_batch([pa.array(rep[big]), none, pa.array(token[big]), pa.array(n[big]), pa.array(pos[big])], ["a", "b", "token", "n", "pos"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame, width: int, between: str | None, most_bits: int = 1 << 28) -> DataFrame:
    """rep, keys (sorted array as bytes) of the wanted documents, and of a few more.

    Texts are not shuffled: a bitmap of hashed ids (8 bits an id, at most ``most_bits``, 32 MB) says which documents may
    be wanted. Where it fills up, more sets are made than are wanted; the join that uses them drops those."""
    bits = min(most_bits, max(1 << 16, 1 << (8 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(p % 64 AS INT))")
    marks = wanted.select(place("rep").alias("p")).select(F.shiftright("p", 6).alias("w"), one.alias("b"))
    rows = marks.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most bits / 64 rows
    marked = np.zeros(bits // 64, np.int64)
    marked[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(marked.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (sent.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
            for ids, texts in slices([batch.filter(pa.array(hit.astype(bool)))], 3_000_000):
                keys, at = shingle_sets(texts, width, between)
                raw = [keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["rep", "keys"])

    named = id_text(docs).where("doc_id IS NOT NULL")
    return named.select("doc_id", "text", place("doc_id")).mapInArrow(run, "rep long, keys binary")


def bitmap(keys: np.ndarray) -> bytes:
    """Bits of the hashed shingles; the width is a power of two of about twice the size, 256 to 16,384 bits."""
    width = min(16_384, max(256, 1 << int(2 * len(keys)).bit_length()))
    out = np.zeros(width, bool)
    out[(keys % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def bounded(n: np.ndarray, maps: list[bytes], ia: np.ndarray, ib: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs can still reach ``need``: every bit that one bitmap alone has is a shingle that the other lacks.
    Bitmaps of different widths are compared at the smaller one, to which the larger folds."""
    width = np.fromiter((len(m) for m in maps), np.int64, len(maps))
    ok = np.zeros(len(ia), bool)
    common = np.minimum(width[ia], width[ib])
    for w in np.unique(common):
        pick = np.flatnonzero(common == w)
        used, spot = np.unique(np.concatenate([ia[pick], ib[pick]]), return_inverse=True)
        folded = np.stack([np.bitwise_or.reduce(np.frombuffer(maps[i], np.uint8).reshape(-1, w), axis=0) for i in used]).view(np.uint64)
        left, right = spot[: len(pick)], spot[len(pick) :]
        for at in range(0, len(pick), 20_000):
            part = pick[at : at + 20_000]
            x, y = folded[left[at : at + 20_000]], folded[right[at : at + 20_000]]
            only_x = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            only_y = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            ok[part] = np.minimum(n[ia[part]] - only_x, n[ib[part]] - only_y) >= need[part]
    return ok


def connecting(arrays: list[np.ndarray], ia: np.ndarray, ib: np.ndarray, need: np.ndarray) -> list[int]:
    """Pairs that reach ``need`` by exact intersection and connect what no earlier pair did."""
    parent = list(range(len(arrays)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for k in range(len(ia)):
        i, j = root(int(ia[k])), root(int(ib[k]))
        if i != j and len(np.intersect1d(arrays[ia[k]], arrays[ib[k]], assume_unique=True)) >= need[k]:
            parent[i] = j
            links.append(k)
    return links


def _batched(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, key: pairs in batches of bounded size, those around one set together; and the sets of each batch."""
    n = pairs.count()
    batches = max(12, n // BATCH_PAIRS + 1)
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    label = ends.groupBy("rep").agg(F.min("o").alias("m")).select("rep", F.least("rep", "m").alias("label"))
    sized = pairs.join(label.withColumnRenamed("rep", "a"), "a").select("a", "b", "label")
    weight = sized.groupBy("label").agg(F.count("*").alias("k"))
    # Labels of more than a 1,024th of the pairs, fewer than 1,024, are broadcast, so that no task takes all pairs of one.
    heavy = F.broadcast(weight.where(F.col("k") > n / 1_024))
    light = sized.join(heavy, "label", "left_anti").join(weight.where(F.col("k") <= n / 1_024), "label")
    salted = sized.join(heavy, "label").unionByName(light).withColumn("salts", F.ceil(F.col("k") / BATCH_PAIRS))
    key = F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("b"), F.col("salts"))), F.lit(batches))
    keyed = materialise(salted.select("a", "b", key.alias("key")), "batches")
    members = keyed.select("key", F.col("a").alias("rep")).unionByName(keyed.select("key", F.col("b").alias("rep"))).distinct()
    return keyed, members


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, between: str | None = None) -> DataFrame:
    """a, b: links among the pairs that connect all that the pairs connect."""

    def places(left: pa.Table, right: pa.Table, n: np.ndarray) -> tuple[np.ndarray, ...]:
        reps = right.column("rep").to_numpy()
        order = np.argsort(reps)
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        ia, ib = (order[np.searchsorted(reps, x, sorter=order)] for x in (a, b))
        return a, b, ia, ib, -(-percent * (n[ia] + n[ib]) // (100 + percent))

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.column("n").to_numpy()
        a, b, ia, ib, need = places(left, right, n)
        ok = bounded(n, right.column("bits").to_pylist(), ia, ib, need)
        return pa.table({"a": a[ok], "b": b[ok]})

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(x, np.uint64) for x in right.column("keys").to_pylist()]
        a, b, ia, ib, need = places(left, right, np.fromiter(map(len, arrays), np.int64, len(arrays)))
        k = np.array(connecting(arrays, ia, ib, need), np.int64)
        return pa.table({"a": a[k], "b": b[k]})

    keyed, members = _batched(pairs)
    maps = members.join(classes.select("rep", "n", "bits"), "rep").select(F.col("key").alias("batch"), "rep", "n", "bits")
    left = materialise(keyed.groupBy("key").cogroup(maps.groupBy("batch")).applyInArrow(bound, "a long, b long"), "bounded")
    release(keyed)
    keyed, members = _batched(left)
    sets = materialise(_sets(docs, members.select("rep").distinct(), width, between), "sets")
    sent = members.join(sets, "rep").select(F.col("key").alias("batch"), "rep", "keys")
    links = materialise(keyed.groupBy("key").cogroup(sent.groupBy("batch")).applyInArrow(exact, "a long, b long"), "links")
    for used in (keyed, left, sets):
        release(used)
    return links


def _open_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of members of large tiles in different components, each from the first tile that the two share, as far
    as their EARLY first open tiles tell. A tile is dealt out in squares of at most SQUARE members by SQUARE that are
    outside its main component, so that no task takes a whole tile and none of its pairs is a row before it is checked."""
    counts = placed.groupBy("token", "component").agg(F.count("*").alias("k"))
    main = counts.groupBy("token").agg(F.max(F.struct("k", "component")).alias("x"), F.count("*").alias("parts"), F.sum("k").alias("all"))
    main = main.where("parts > 1").select("token", F.col("x.component").alias("main"), *(F.ceil(c / SQUARE).alias(n) for c, n in ((F.col("all"), "rows"), (F.col("all") - F.col("x.k"), "columns"))))
    open_tiles = materialise(placed.join(main, "token"), "open")
    seen = F.filter("early", lambda e: e["pos"] < F.col("pos"))
    told = open_tiles.join(_first_open(open_tiles), "rep").select("token", "rep", "n", "pos", "component", (F.col("component") != F.col("main")).alias("out"), seen["token"].alias("early"), "rows", "columns")
    told = materialise(told, "told")
    deal = lambda c: F.pmod(F.xxhash64("rep"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    kept = ("rep", "n", "pos", "component", "out", "early")
    members = told.select("token", deal("rows").alias("i"), each("columns").alias("j"), *kept)
    outside = told.where("out").select(F.col("token").alias("t"), each("rows").alias("k"), deal("columns").alias("l"), *(F.col(c).alias(f"r_{c}") for c in kept))

    def read(t: pa.Table, pad: int) -> tuple[np.ndarray, ...]:
        rest, lists = t.columns[3:8], t.columns[8].combine_chunks()
        many = lists.value_lengths().to_numpy()
        early = np.full((t.num_rows, EARLY), pad)
        early[np.arange(EARLY) < many[:, None]] = lists.flatten().to_numpy()
        return *(c.to_numpy() for c in rest), early

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        r, rn, rp, rc, _, re = read(left, -1)
        m, n, pos, c, out, e = read(right, -2)
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(r), 256):
            part = slice(at, at + 256)
            x, y = rn[part, None], n[None, :]
            ok = (rc[part, None] != c) & (~out | (m < r[part, None])) & _allows(np.minimum(x, y), np.maximum(x, y), percent)
            ok &= np.minimum(x - rp[part, None], y - pos) >= -(-percent * (x + y) // (100 + percent))
            i, j = np.nonzero(ok)
            i += at
            for spot in range(0, len(i), 100_000):
                u, v = i[spot : spot + 100_000], j[spot : spot + 100_000]
                fresh = ~(re[u][:, :, None] == e[v][:, None, :]).any(axis=(1, 2))
                a, b = r[u[fresh]], m[v[fresh]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        both = np.concatenate(found)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return outside.groupBy("t", "k", "l").cogroup(members.groupBy("token", "i", "j")).applyInArrow(pairs, "a long, b long").distinct()


def _first_open(open_tiles: DataFrame) -> DataFrame:
    """rep, early: the tokens of its first EARLY open tiles, with their places, by place."""
    order = Window.partitionBy("rep").orderBy("pos")
    few = open_tiles.select("rep", "pos", "token", F.row_number().over(order).alias("k")).where(F.col("k") <= EARLY)
    return few.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("early"))


def groups(docs: DataFrame, width: int = 5, percent: int = 80, between: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; ``between`` as in :func:`shingle_sets`."""
    hot = frequent_shingles(docs, width, between=between)
    whole = materialise(_classes(docs, width, percent, hot, between), "prefixes")
    table = materialise(whole.select("doc_id", "n", "d1", "d2"), "digests")
    lone = table.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    digests = table.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)))
    if not digests.where("min_d1 <> max_d1 OR min_d2 <> max_d2").isEmpty():
        return _by_rows(docs, width, percent, between).unionByName(table.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    named = table.where("doc_id IS NOT NULL AND n > 0")
    same = whole.where("doc_id IS NOT NULL AND n > 0").groupBy("d1", "d2", "n")
    classes = same.agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("own", "prefix", "bits")))
    classes = materialise(classes.select("rep", "n", "own", "prefix", "bits"), "classes")
    release(whole)
    entries = classes.select("rep", "n", "own", F.posexplode("prefix").alias("pos", "token"))
    rare = entries.where("pos < own").select("token", "rep", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("size"))
    tiles = materialise(rare.repartition("token").mapInArrow(_tile_pairs(percent), "a long, b long, token long, n long, pos long"), "tiles")
    big = tiles.where("b IS NULL").select("token", F.col("a").alias("rep"), "n", "pos", F.lit(1 << 30).cast("long").alias("own"))
    hot_entries = entries.where("pos >= own").select("token", "rep", "n", F.col("pos").cast("long").alias("pos"), F.col("own").cast("long").alias("own"))
    band = F.floor(F.log(F.col("n")) / log(100 / percent))
    large = materialise(hot_entries.unionByName(big).withColumn("band", band), "large")
    leaders = large.groupBy("token", "band").agg(F.min(F.struct("own", "n", "rep")).alias("x"), F.count("*").alias("in_band"))
    leaders = leaders.select("token", "band", F.col("x.rep").alias("leader"), F.col("x.n").alias("ln"))
    star = large.select("token", "rep", "n", F.explode(F.array("band", F.col("band") - 1)).alias("band")).join(leaders, ["token", "band"])
    star = star.where("rep <> leader").where(
        percent * F.greatest("n", "ln") <= 100 * F.least("n", "ln")
    ).select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))
    pairs = materialise(tiles.where("b IS NOT NULL").select("a", "b").unionByName(star).distinct(), "candidates")
    links = verified(docs, classes, pairs, width, percent, between)
    if not large.isEmpty():
        comp = materialise(components(links), "comp")
        placed = large.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        more = materialise(_open_pairs(placed, percent), "more")
        if not more.isEmpty():
            links = links.unionByName(verified(docs, classes, more, width, percent, between))
    comp = materialise(components(links), "comp")
    release(classes)
    by_set = named.select("doc_id", "n", "d1", "d2")
    reps = by_set.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    found = reps.join(comp, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    inside = by_set.join(found, ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return inside.unionByName(lone)


def _by_rows(docs: DataFrame, width: int, percent: int, between: str | None) -> DataFrame:
    """``groups`` of a table in which one doc_id has several texts: rows are numbered and grouped by their numbers, and the
    smallest doc_id of a group names it."""
    rows = id_text(docs).where("doc_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "rows")
    found = groups(rows.select(F.col("row").alias("doc_id"), "text"), width, percent, between)
    found = materialise(found.join(rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("own")), "doc_id"), "found")
    first = found.groupBy("component_id").agg(F.min("own").alias("first"))
    return found.join(first, "component_id").select(F.col("own").alias("doc_id"), "n_shingles", F.col("first").alias("component_id"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the one with the smallest doc_id."""
    stays = groups(docs, width, percent).where("doc_id <=> component_id").select(F.col("doc_id").alias("stays")).distinct()
    tagged = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    return tagged.join(stays, F.col("id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")
