"""Exact neighbours without all pairs, by a pivot index.

Rows are dealt over blocks of rows near to each other: by the nearest of a few pivots, then by the distance from it. Of each
block the least and the largest distance from every pivot are kept. By the triangle inequality, rows of two blocks are no
nearer than the gap between their ranges for any pivot; pairs of blocks farther apart than what is asked for are never
looked at, and each other pair of blocks is looked at once, in one task that holds the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline import storage
from wayline.operators import codes

#: Pivots, and rows among which they are chosen.
PIVOTS, PIVOT_ROWS = 24, 1_500
#: Rows of a block: one part in BLOCK_SHARE of all, between these bounds. Bytes of a block's vectors at most, roughly.
BLOCK_SHARE, LEAST_ROWS, MOST_ROWS, BLOCK_BYTES = 64, 128, 16_384, 8_000_000
#: Rows of a side of which distances are held at once: a task's memory doesn't grow with its blocks' square.
TILE_ROWS = 1_024
#: Blocks in a row that meet others in one task: one part in SPAN_SHARE of all at most, of so many bytes of vectors.
SPAN_SHARE, SPAN_BYTES = 16, 32_000_000
#: Of a tile's pairs, the share within limits from which all of its distances are taken.
DENSE = 0.02
#: Rows that a task's folds may have made since they were last merged.
MERGE_ROWS = 200_000
#: Blocks that an index may have: its table of ranges goes to every task.
MOST_BLOCKS = 200_000
#: Slack of bounds, for rounding.
SLACK = 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; products cancel for near points, so the differences of those are taken."""
    norms = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)
    d = norms - 2 * a @ b.T
    i, j = np.nonzero(d < 1e-4 * norms)
    for k in range(0, len(i), 10_000):
        p, q = i[k : k + 10_000], j[k : k + 10_000]
        d[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0))


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before; fewer if no other is apart."""
    if not len(x):
        return x
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(x, x[chosen[-1] :][:1])[:, 0])
    return x[chosen]


@dataclass
class Index:
    """rows (vec_id, vec, block, and what else there was), stored; ranges (blocks, pivots, 2) of distances from pivots, and each block's number of rows. span: how many blocks in a row go to a task together."""

    rows: DataFrame
    ranges: np.ndarray
    sizes: np.ndarray
    span: int = 1

    def gaps(self, i: int, of: np.ndarray) -> np.ndarray:
        """Least possible distances between rows of block i and of the blocks of."""
        lo, hi = self.ranges[of, :, 0], self.ranges[of, :, 1]
        own = self.ranges[i]
        return np.maximum(np.maximum(lo - own[:, 1], own[:, 0] - hi), 0).max(axis=1, initial=0.0)


def build(df: DataFrame) -> Index:
    """The index of df (vec_id, vec, ...); rows without vec take no part. Rows that are alike may fill several blocks."""
    spark = df.sparkSession
    df = df.where("vec is not null")
    n, width = df.agg(F.count("*"), F.max(F.size("vec"))).first()
    most = max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * max(width or 1, 1))))
    target = min(most, max(LEAST_ROWS, n // BLOCK_SHARE))
    some = df.select("vec").orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(PIVOT_ROWS).collect()
    pivots = farthest(np.array([r[0] for r in some], float).reshape(len(some), max(width or 0, 0)), PIVOTS)
    # the first pivots, which are the farthest apart, make cells; all give bounds
    makes = max(1, min(len(pivots), n // target))
    shared = spark.sparkContext.broadcast(pivots)
    names = df.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(np.stack(b["vec"].to_numpy()).astype(float), shared.value)
                cell = d[:, :makes].argmin(axis=1)
                yield b.assign(_cell=cell.astype(np.int32), _r=d[np.arange(len(b)), cell], _d=list(d))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = storage.stored(df.mapInPandas(place, f"{kinds}, _cell int, _r double, _d array<double>"), "cells")
    # cuts of each cell by distance: at most n / target numbers in all
    cells = [tuple(r) for r in rows.groupBy("_cell").agg(F.count("*").alias("n")).collect()]
    cuts = []
    for parts in sorted({-(-m // target) for _, m in cells if m > target}):
        own = [c for c, m in cells if -(-m // target) == parts]
        shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
        cuts += [tuple(r) for r in rows.where(F.col("_cell").isin(own)).groupBy("_cell").agg(F.percentile_approx("_r", shares).alias("cuts")).collect()]
    table = spark.createDataFrame(cuts, "_cell int, _cuts array<double>")
    rows = rows.join(F.broadcast(table), "_cell", "left").withColumn("_ring", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_r"))), F.lit(0))).drop("_cuts")
    # a ring of many equal distances is dealt over parts by the row's hash
    rings = sorted(tuple(r) for r in rows.groupBy("_cell", "_ring").count().collect())
    parts = [max(1, -(-m // (2 * target))) for _, _, m in rings]
    first = [0, *np.cumsum(parts, dtype=int).tolist()]
    if first[-1] > MOST_BLOCKS:
        raise ValueError(f"over {MOST_BLOCKS} blocks")
    table = spark.createDataFrame([(c, r, f, p) for (c, r, _), f, p in zip(rings, first, parts, strict=False)], "_cell int, _ring int, _first int, _parts int")
    block = (F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_parts"))).cast("int")
    rows = storage.stored(rows.join(F.broadcast(table), ["_cell", "_ring"]).select(*names, block.alias("block"), "_d"), "blocks")
    p = len(pivots)
    ends = [f(F.get("_d", F.lit(k))).alias(f"{s}{k}") for k in range(p) for s, f in (("lo", F.min), ("hi", F.max))]
    ranges, sizes = np.zeros((first[-1], p, 2)), np.zeros(first[-1], np.int64)
    ranges[:, :, 0], ranges[:, :, 1] = np.inf, -np.inf  # an empty block is far from all
    for r in rows.groupBy("block").agg(F.count("*").alias("n"), *ends).collect():
        sizes[r[0]], ranges[r[0]] = r[1], np.array(r[2:]).reshape(p, 2)
    span = min(len(sizes) // SPAN_SHARE, SPAN_BYTES // (8 * max(width or 1, 1) * int(sizes.max(initial=1))))
    return Index(rows.drop("_d"), ranges, sizes, max(1, span))


def near_pairs(index: Index, reach: np.ndarray | None = None, alike: np.ndarray | None = None) -> DataFrame:
    """(i, j), i <= j, of blocks of which one may have a row within its reach of the other; without reach all pairs of blocks. Blocks with one number in alike, from 0 on, aren't paired."""
    spark = index.rows.sparkSession
    shared = spark.sparkContext.broadcast((index.ranges, index.sizes, reach, alike))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, sizes, far, kind = shared.value
        own = Index(None, ranges, sizes)
        for b in batches:
            for i in b["id"]:
                of = np.flatnonzero((np.arange(len(sizes)) >= i) & (sizes > 0)) if sizes[i] else np.zeros(0, int)
                if far is not None and len(of):
                    of = of[own.gaps(i, of) <= np.maximum(far[i], far[of]) * (1 + SLACK) + SLACK]
                if kind is not None and len(of):
                    of = of[(kind[of] != kind[i]) | (kind[of] < 0)]
                yield pd.DataFrame({"i": np.full(len(of), i, np.int32), "j": of.astype(np.int32)})

    return spark.range(len(index.sizes)).mapInPandas(run, "i int, j int")


Fold = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, bool], pd.DataFrame]
Merge = Callable[[pd.DataFrame], pd.DataFrame]


class Close:
    """Which pairs of rows of vec may be within limits, by products in single precision around the rows' mean. What rounding can do is allowed for, so none is missed."""

    def __init__(self, vec: np.ndarray, tile: int):
        good = np.isfinite(vec).all(axis=1)
        d = vec.shape[1]
        x = vec - (vec[good].mean(axis=0) if good.any() else 0.0)
        top = np.abs(x[good]).max(initial=0.0)
        self.scale = 1 / top if top > 1e-300 else 1.0
        #: of a distance: the rounding to 9 decimals, and that of the mean
        self.slack = 1e-9 + 2.0**-50 * (d + 1) * np.abs(vec[good]).max(initial=0.0)
        with np.errstate(all="ignore"):
            x = (x * self.scale).astype(np.float32)
            half = (x.astype(float) ** 2).sum(axis=1) * -0.5 * (1 - (d + 16) * 2.0**-22)
        half, one = half.astype(np.float32)[:, None], np.ones((len(x), 1), np.float32)
        # a product of a row of each is at least minus half the squared distance
        self.left, self.right = np.concatenate([x, half, one], axis=1), np.concatenate([x, one, half], axis=1)
        self.least = np.zeros(len(x), np.float32)
        self.products, self.within = np.empty(tile**2, np.float32), np.zeros((2, tile**2 + 8), bool)

    def limit(self, limits: np.ndarray) -> None:
        """Each row's limit; below 0: the row asks for nothing."""
        with np.errstate(all="ignore"):
            self.least = np.where(limits < 0, np.inf, ((limits + self.slack) * self.scale) ** 2 * -0.5 * (1 + 1e-6) - 1e-30).astype(np.float32)

    def pairs(self, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of which the limit of either row is met, each once; None if they are many."""
        a, b = self.least[x], self.least[y]
        none = np.zeros(0, np.int64)
        if np.isposinf(a).all() and np.isposinf(b).all():
            return none, none
        if np.isneginf(a).all() or np.isneginf(b).all():
            return None
        shape = len(a), len(b)
        n = len(a) * len(b)
        p, (m, other) = self.products[:n].reshape(shape), self.within
        with np.errstate(all="ignore"):
            np.matmul(self.left[x], self.right[y].T, out=p)
            np.greater_equal(p, a[:, None], out=m[:n].reshape(shape))
            np.greater_equal(p, b[None], out=other[:n].reshape(shape))
        m[:n] |= other[:n]
        if np.count_nonzero(m[:n]) > DENSE * n + (len(a) if x == y else 0):
            return None
        m[n : n + 8] = False
        words = np.flatnonzero(m[: -(-n // 8) * 8].view(np.uint64))
        at = (words[:, None] * 8 + np.arange(8)).ravel()
        i, j = np.divmod(at[m[at]], len(b))
        if x == y:
            i, j = i[i < j], j[i < j]
        return i + x.start, j + y.start


def _apart(vec: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs of rows i and j."""
    out = np.empty(len(i))
    for k in range(0, len(i), 4_096):
        z = vec[i[k : k + 4_096]] - vec[j[k : k + 4_096]]
        out[k : k + 4_096] = np.sqrt(np.einsum("ij,ij->i", z, z))
    return out


@dataclass
class Within:
    """What is asked for within limits. limits(rows, found): a limit for each row, found being what has been found of late (None at first): the limit may fall to what that tells. pick(rows, i, j, r): what the fold gives of pairs of places i and j that are r apart, to 9 decimals. rows have their limits in the column limit; pairs alike in the column unlike don't come."""

    limits: Callable[[pd.DataFrame, pd.DataFrame | None], np.ndarray]
    pick: Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]
    unlike: str | None = None


def folded(both: pd.DataFrame, asked: list[tuple[int, int]], tile: int, most: int, fold: Fold, merge: Merge | None = None, within: Within | None = None) -> pd.DataFrame | None:
    """What over_pairs gives of the pairs of blocks asked, by tiles of tile rows, merged after most rows; None if that is nothing."""
    both = both.sort_values(["block", "vec_id"], kind="stable", ignore_index=True)
    block = both["block"].to_numpy()
    vec = np.stack(both.pop("vec").to_numpy()).astype(float) if len(both) else None
    made, fresh, held = [], 0, 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    if within and len(both):
        close = Close(vec, tile)
        both["limit"] = within.limits(both, None)
        close.limit(both["limit"].to_numpy())
        kinds = pd.factorize(both[within.unlike])[0] if within.unlike else None

    def tighten(found: pd.DataFrame) -> None:
        both["limit"] = np.minimum(both["limit"].to_numpy(), within.limits(both, found))
        close.limit(both["limit"].to_numpy())

    def settle() -> None:
        if waiting:
            i, j = (np.concatenate(z) for z in zip(*waiting, strict=True))
            waiting.clear()
            made.append(within.pick(both, i, j, np.round(_apart(vec, i, j), 9)))

    for i, j in asked:
        (a, a_end), (b, b_end) = (np.searchsorted(block, [k, k + 1]) for k in (i, j))
        for lo in range(a, a_end, tile):
            x = slice(lo, min(lo + tile, a_end))
            for at in range(lo if i == j else b, b_end, tile):
                y = slice(at, min(at + tile, b_end))
                if within and (near := close.pairs(x, y)) is not None:
                    p, q = near
                    if kinds is not None:
                        p, q = p[kinds[p] != kinds[q]], q[kinds[p] != kinds[q]]
                    if not len(p):
                        continue
                    waiting.append((p, q))
                    fresh += 2 * len(p)
                else:
                    part = fold(both.iloc[x].reset_index(drop=True), both.iloc[y].reset_index(drop=True), distances(vec[x], vec[y]), x == y)
                    made.append(part)
                    fresh += len(part)
                    if within:
                        tighten(part)
                if merge and fresh > most + held:
                    settle()
                    made = [merge(pd.concat(made))]
                    fresh, held = 0, len(made[0])
                    if within:
                        tighten(made[0])
    settle()
    if not made:
        return None
    out = pd.concat(made)
    return merge(out) if merge and (within or len(made) > 1) else out


def over_pairs(index: Index, pairs: DataFrame, fold: Fold, schema: str, rows: DataFrame | None = None, merge: Merge | None = None, within: Within | None = None) -> DataFrame:
    """fold(x, y, d, same) of each pair of blocks, by tiles of TILE_ROWS rows of either at most: the tiles' rows without vec, each in order of vec_id, their distances, and whether the two are one tile. Each pair of tiles comes once. rows: those of the index with more columns.

    merge: makes what several folds have given one, of as few rows as say the same; it may be called on what it gave.
    within: of tiles with few pairs of rows within limits only these are looked at, and no fold is called.
    A task has the pairs of two runs of index.span blocks, so that a row is sent once for all of these.
    """
    rows = index.rows if rows is None else rows
    tile, most, span = TILE_ROWS, MERGE_ROWS, index.span

    def run(key: tuple, both: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = folded(both, list(zip(asked["i"], asked["j"], strict=True)), tile, most, fold, merge, within)
        return pd.DataFrame(columns=names) if out is None else out

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    runs = F.expr(f"i div {span}"), F.expr(f"j div {span}")
    sides = pairs.select(runs[0].alias("_p"), runs[1].alias("_q"), F.explode(F.array("i", "j")).alias("block")).distinct()
    asked = pairs.select("i", "j", runs[0].alias("_i"), runs[1].alias("_j"))
    return rows.join(sides, "block").groupBy("_p", "_q").cogroup(asked.groupBy("_i", "_j")).applyInPandas(run, schema)


def few(k: int) -> Merge:
    """Of (a, b, r) the k smallest r of each a, ties to the smaller b."""

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        a = found["a"].to_numpy()
        order = np.lexsort((found["b"].to_numpy(), found["r"].to_numpy(), a))
        a = a[order]
        return found.iloc[order[np.arange(len(a)) - np.searchsorted(a, a) < k]]

    return merge


def _nearest(ids: np.ndarray, others: np.ndarray, r: np.ndarray, k: int) -> pd.DataFrame:
    """(a, b, r) of the k smallest finite r of each row, ties to the smaller id; others ascend."""
    if not r.size:
        return pd.DataFrame({"a": ids[:0], "b": others[:0], "r": np.zeros(0)})
    m = min(k, r.shape[1]) - 1
    i, j = np.nonzero((r <= np.partition(r, m, axis=1)[:, m, None]) & np.isfinite(r))
    order = np.lexsort((r[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) <= m
    i, j = i[first], j[first]
    return pd.DataFrame({"a": ids[i], "b": others[j], "r": r[i, j]})


def places(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where some, which are among ids, stand there."""
    order = np.argsort(ids, kind="stable")
    return order[np.searchsorted(ids, some, sorter=order)]


def _limits(rows: pd.DataFrame, found: pd.DataFrame | None, k: int) -> np.ndarray:
    """Each row's k-th distance in found (a, b, r), or its bound."""
    if found is None:
        return rows["bound"].to_numpy() if "bound" in rows else np.full(len(rows), np.inf)
    a, r = found["a"].to_numpy(), found["r"].to_numpy()
    order = np.lexsort((r, a))
    a, r = a[order], r[order]
    last = np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == k - 1)
    out = np.full(len(rows), np.inf)
    out[places(rows["vec_id"].to_numpy(), a[last])] = r[last]
    return out


def _both_ways(rows: pd.DataFrame, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> pd.DataFrame:
    """(a, b, r) of pairs within a's limit."""
    ids, limit = rows["vec_id"].to_numpy(), rows["limit"].to_numpy()
    forth, back = r <= limit[i], r <= limit[j]
    return pd.DataFrame({"a": ids[np.concatenate([i[forth], j[back]])], "b": ids[np.concatenate([j[forth], i[back]])], "r": np.concatenate([r[forth], r[back]])})


def nearest(index: Index, k: int) -> tuple[DataFrame, float]:
    """((a, b, r, rk): each row's k nearest others, exactly, r their distance to 9 decimals, ties to the smaller vec_id; the share of pairs of blocks that were compared)."""
    spark = index.rows.sparkSession
    schema = "a long, b long, r double"

    def fold(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray, same: bool) -> pd.DataFrame:
        r = np.round(d, 9)
        p, q = x["vec_id"].to_numpy(), y["vec_id"].to_numpy()
        if same:
            np.fill_diagonal(r, np.inf)
        forth = _nearest(p, q, np.where(r <= x["limit"].to_numpy()[:, None], r, np.inf), k)
        return forth if same else pd.concat([forth, _nearest(q, p, np.where(r.T <= y["limit"].to_numpy()[:, None], r.T, np.inf), k)])

    within = Within(lambda rows, found: _limits(rows, found, k), _both_ways)

    # a row's bound is its k-th distance in its own run of blocks; a block of few rows is looked at with others that must be near, too
    full = np.flatnonzero(index.sizes)
    begin = {(int(i), int(j)) for i in full for j in full[(full >= i) & (full // index.span == i // index.span)]}
    for i in full[index.sizes[full] <= k].tolist():
        near = full[np.argsort((index.ranges[full, :, 1] + index.ranges[i, :, 1]).min(axis=1), kind="stable")]
        near = near[near != i]
        enough = int(np.searchsorted(np.cumsum(index.sizes[near]), k + 1 - index.sizes[i])) + 1
        begin |= {(min(i, j), max(i, j)) for j in near[:enough].tolist()}
    seeds = spark.createDataFrame(sorted(begin), "i int, j int")
    inside = storage.stored(codes.first_per_group(over_pairs(index, seeds, fold, schema, merge=few(k), within=within), "a", [F.col("r"), F.col("b")], k).drop("rk"), "inside")
    bound = inside.groupBy(F.col("a").alias("vec_id")).agg(F.when(F.count("*") == k, F.max("r")).alias("bound"))
    rows = storage.stored(index.rows.join(bound, "vec_id", "left").na.fill(float("inf"), ["bound"]), "bounds")
    reach = np.zeros(len(index.sizes))
    for b, m in rows.groupBy("block").agg(F.max("bound")).collect():
        reach[b] = m
    pairs = storage.stored(near_pairs(index, reach).join(seeds, ["i", "j"], "left_anti"), "pairs")

    found = inside.unionByName(over_pairs(index, pairs, fold, schema, rows, few(k), within))
    share = (pairs.count() + len(begin)) / max(len(full) * (len(full) + 1) / 2, 1)
    return codes.first_per_group(found, "a", [F.col("r"), F.col("b")], k), share
