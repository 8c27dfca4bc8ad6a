"""The nearest neighbours of points on a map, exact at any density, without a row for every two points that are close.

1. Points of one place are one: of their keys the smallest k + 1 can be among the k nearest of anyone.
2. Places are dealt over tiles of a bounded number of places. In its tile each place finds its k + 1 nearest keys in a
   tree of boxes; the last of them bounds how far others can matter.
3. Only places whose bound reaches into other tiles visit these, and take what is nearer there.
4. Each point takes what its place found, without itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.session import materialise, release

#: Tiles hold at most so many places, where a cell of the grid over [-1, 1] does not hold more.
TILE, GRID = 10_000, 512
LEAF, ASKERS = 16, 4_096
FOUND = "tile long, x double, y double, bound double, d2 array<double>, keys array<long>"


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of whole numbers from ``starts`` on, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _box_d2(x: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Squared distances to boxes; rounding is monotonic, so none is more than that of a place in the box."""
    dx, dy = (np.maximum(np.maximum(lo - v, v - hi), 0.0) for v, lo, hi in ((x, x0, x1), (y, y0, y1)))
    return dx * dx + dy * dy


class Tree:
    """Places with their keys (those of place i lie from at[i] on) in a balanced tree of boxes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        n = len(x)
        self.depth = int(np.ceil(np.log2(max(n, LEAF) / LEAF)))
        edges = [n * np.arange((1 << level) + 1) >> level for level in range(self.depth + 1)]
        order = np.arange(n)
        for level, cut in enumerate(edges[:-1]):
            order = order[np.lexsort(((x, y)[level % 2][order], np.repeat(np.arange(1 << level), np.diff(cut))))]
        self.order, self.x, self.y, self.starts, self.sizes = order, x[order], y[order], edges[-1][:-1], np.diff(edges[-1])
        self.first, self.many, self.keys = at[:-1][order], np.diff(at)[order], keys
        self.boxes = [[f.reduceat(v, cut[:-1]) for v in (self.x, self.y) for f in (np.minimum, np.maximum)] for cut in edges]

    def _meet(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray, who: np.ndarray, leaf: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        place, who = _spread(self.starts[leaf], self.sizes[leaf]), np.repeat(who, self.sizes[leaf])
        dx, dy = x[who] - self.x[place], y[who] - self.y[place]
        d2 = dx * dx + dy * dy
        hit = d2 <= bound[who]
        place, who, d2 = place[hit], who[hit], d2[hit]
        many = self.many[place]
        key, who, d2 = self.keys[_spread(self.first[place], many)], np.repeat(who, many), np.repeat(d2, many)
        order = np.lexsort((key, d2, who))
        who, d2, key = who[order], d2[order], key[order]
        kept = np.ones(len(who), bool)
        kept[most:] = who[most:] != who[:-most]
        return who[kept], d2[kept], key[kept]

    def find(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """In parts: the askers' numbers, and who (in the part), d2 and key of the first ``most`` keys of each within its
        bound (a squared distance), by distance and key."""
        for a in range(0, len(x), ASKERS):
            px, py, pb = (v[a : a + ASKERS] for v in (x, y, bound))
            who, node = np.arange(len(px)), np.zeros(len(px), np.int64)
            for boxes in self.boxes[1:]:
                who, node = np.repeat(who, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
                near = _box_d2(px[who], py[who], *(b[node] for b in boxes)) <= pb[who]
                who, node = who[near], node[near]
            yield np.arange(a, a + len(px)), *self._meet(px, py, pb, who, node, most)

    def own_bounds(self, bound: float, most: int) -> np.ndarray:
        """For each place, in the order of the tree, the squared distance within which its own leaf has ``most`` keys, or
        ``bound``."""
        out, leaf = np.full(len(self.x), bound), np.repeat(np.arange(len(self.sizes)), self.sizes)
        for a in range(0, len(out), ASKERS):
            b = min(a + ASKERS, len(out))
            who, d2, _ = self._meet(self.x[a:b], self.y[a:b], np.full(b - a, bound), np.arange(b - a), leaf[a:b], most)
            out[a:b] = _last(who, d2, b - a, most, bound)
        return out


def _last(who: np.ndarray, d2: np.ndarray, askers: int, most: int, bound: float) -> np.ndarray:
    """The distance of the last of ``most`` keys of each asker; ``bound`` where it has fewer."""
    count = np.bincount(who, minlength=askers)
    full = count == most
    out = np.full(askers, bound)
    out[full] = d2[np.cumsum(count)[full] - 1]
    return out


def _tree(spots: pa.Table) -> Tree:
    keys = spots.column("keys").combine_chunks()
    at = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])
    return Tree(spots.column("x").to_numpy(), spots.column("y").to_numpy(), at, keys.flatten().to_numpy())


def _rows(tile, x, y, bound, who, d2, key) -> pa.Table:  # noqa: ANN001
    """Rows of FOUND; lists are given by who, in order."""
    starts = pa.array(np.searchsorted(who, np.arange(len(x) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(starts, pa.array(v, t)) for v, t in ((d2, pa.float64()), (key, pa.int64()))]
    return pa.table([pa.array(tile, pa.int64()), pa.array(x), pa.array(y), pa.array(bound, pa.float64()), *lists], ["tile", "x", "y", "bound", "d2", "keys"])


def _tiles(spots: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tile of each cell of the grid, and the boxes of the tiles: squares are quartered while they hold too many."""
    cell = _cell(F.col("x")) * GRID + _cell(F.col("y"))
    bounds = [f(c) for c in ("x", "y") for f in (F.min, F.max)]
    held = spots.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), *bounds).toArrow()  # at most GRID * GRID rows
    at, n, *box = (c.to_numpy() for c in held.columns)
    count = np.zeros((GRID, GRID), np.int64)
    count.ravel()[at] = n
    of, tiles, todo = np.zeros((GRID, GRID), np.int64), 0, [(0, 0, GRID)]
    while todo:
        i, j, width = todo.pop()
        if width > 1 and count[i : i + width, j : j + width].sum() > TILE:
            half = width // 2
            todo += [(i + a, j + b, half) for a in (0, half) for b in (0, half)]
        else:
            of[i : i + width, j : j + width] = tiles
            tiles += 1
    boxes = np.stack([np.full(tiles, v) for v in (np.inf, -np.inf, np.inf, -np.inf)])
    for side, v in enumerate(box):
        (np.minimum, np.maximum)[side % 2].at(boxes[side], of.ravel()[at], v)
    return of.ravel(), boxes


def _cell(c):  # noqa: ANN001, ANN202
    return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor((c + 1) * (GRID / 2)))).cast("int")


def nearest(points: DataFrame, k: int, distance: float) -> DataFrame:
    """key, other, d2, rank, weight: the k nearest others of each key (unique, whole numbers) within ``distance``, ties by
    key; the weight falls with the distance. Points without a key or a coordinate have none and are nobody's."""
    most, far = k + 1, distance * distance
    points = points.where("key IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND x IS NOT NULL AND y IS NOT NULL")
    points = points.select(F.col("key").cast("long").alias("key"), (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
    order = Window.partitionBy("x", "y").orderBy("key")
    few = points.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    spots = materialise(few.groupBy("x", "y").agg(F.sort_array(F.collect_list("key")).alias("keys")), "spots")
    of, boxes = _tiles(spots)
    sent = spots.sparkSession.sparkContext.broadcast((of, boxes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(sent.value[0][b.column(3).to_numpy()]), *b.columns[:3]], ["tile", "x", "y", "keys"])

    def visits(own: int, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place and another tile that its bound reaches."""
        boxes, order = sent.value[1], np.argsort(bound)
        who, tile = [], []
        for a in range(0, len(x), 1_024):
            part = order[a : a + 1_024]
            px, py = x[part], y[part]
            reach = np.sqrt(bound[part].max()) * 1.000001
            near = np.flatnonzero(
                (boxes[0] <= px.max() + reach) & (boxes[1] >= px.min() - reach) & (boxes[2] <= py.max() + reach) & (boxes[3] >= py.min() - reach)
            )
            near = near[near != own]
            w, t = np.nonzero(_box_d2(px[:, None], py[:, None], *(s[near][None, :] for s in boxes)) <= bound[part][:, None])
            who.append(part[w])
            tile.append(near[t])
        return np.concatenate(who), np.concatenate(tile)

    def inside(spots: pa.Table) -> pa.Table:
        tree, out = _tree(spots), []
        x, y, bound = tree.x, tree.y, tree.own_bounds(far, most)
        for part, who, d2, key in tree.find(x, y, bound, most):
            bound[part] = _last(who, d2, len(part), most, far)
            out.append(_rows(np.full(len(part), -1), x[part], y[part], bound[part], who, d2, key))
        who, tile = visits(spots.column("tile")[0].as_py(), x, y, bound)
        return pa.concat_tables([*out, _rows(tile, x[who], y[who], bound[who], *(np.zeros(0, np.int64),) * 3)])

    def outside(askers: pa.Table, spots: pa.Table) -> pa.Table:
        x, y, bound = (askers.column(c).to_numpy() for c in ("x", "y", "bound"))
        if not len(x):
            return _rows([], x, y, bound, *(np.zeros(0, np.int64),) * 3)
        found = [_rows(np.full(len(part), -1), x[part], y[part], bound[part], *rest) for part, *rest in _tree(spots).find(x, y, bound, most)]
        return pa.concat_tables(found)

    cells = spots.select("x", "y", "keys", (_cell(F.col("x")) * GRID + _cell(F.col("y"))).alias("cell"))
    tiled = materialise(cells.mapInArrow(place, "tile long, x double, y double, keys array<long>"), "tiles")
    first = materialise(tiled.groupBy("tile").applyInArrow(inside, FOUND), "inside")
    asked = first.where("tile >= 0").select("tile", "x", "y", "bound")
    second = asked.groupBy("tile").cogroup(tiled.groupBy("tile")).applyInArrow(outside, FOUND)
    pair = F.arrays_zip("d2", "keys").alias("found")
    both = first.where("tile < 0").select("x", "y", pair).unionByName(second.where("size(keys) > 0").select("x", "y", pair))
    merged = both.groupBy("x", "y").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, most).alias("found"))
    merged = materialise(merged, "merged")
    for used in (spots, tiled, first):
        release(used)
    others = F.slice(F.filter("found", lambda f: f["keys"] != F.col("key")), 1, k)
    ranked = points.join(merged, ["x", "y"]).select("key", F.posexplode(others).alias("i", "f"))
    out = ranked.select("key", F.col("f.keys").alias("other"), F.col("f.d2").alias("d2"), (F.col("i") + 1).alias("rank"))
    return out.withColumn("weight", F.greatest(F.lit(0.02), 1 - F.sqrt("d2") / distance))
