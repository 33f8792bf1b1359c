"""Hierarchical density clusters of all rows: a spanning tree of mutual reachability by Boruvka rounds, then a condensed tree of its edges in ascending order.

Mutual reachability of two rows is the largest of their distance and their core distances (to the min_samples-th neighbour).
Distances are rounded to 9 decimals. Merges at one height are one merge, so the result doesn't depend on which of several
spanning trees of equal weights there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline import storage
from wayline.operators import neighbours, ranks

#: Components that are joined up on the driver at most; more are by joins of tables.
DRIVER_COMPONENTS = 200_000
#: One component in so many must be told its least edge by lists, or the others' rows are compared with all.
TOLD_SHARE = 4
#: Bytes of vectors of rows that are sent to all tasks for that; more meet the others by blocks.
ASKING_BYTES = 16_000_000
#: Edges of the tree that are merged at once, on the driver.
CHUNK_EDGES = 500_000


# ---------------------------------------------------------------- spanning tree


def _roots(to: DataFrame) -> DataFrame:
    """(comp, root) of (comp, other), each component's pointer along its least edge: pointers end in pairs, of which the smaller is the root."""
    spark = to.sparkSession
    if to.count() <= DRIVER_COMPONENTS:
        rows = to.collect()
        comp = np.array([r[0] for r in rows], np.int64)
        order = np.argsort(comp)
        comp, other = comp[order], np.array([r[1] for r in rows], np.int64)[order]
        at = np.searchsorted(comp, other)
        here = np.arange(len(comp))
        at = np.where((at[at] == here) & (here < at), here, at)
        while (at[at] != at).any():
            at = at[at]
        return spark.createDataFrame(pd.DataFrame({"comp": comp, "root": comp[at]}))
    back = to.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    now = to.join(back, "other").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root"))
    now = storage.stored(now, "roots")
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.comp")).select("a.comp", F.col("a.root").alias("was"), F.col("b.root").alias("root"))
        step = storage.stored(step, "roots")
        now = step.select("comp", "root")
        if step.where("was != root").isEmpty():
            return now


@dataclass
class Lists:
    """The index of rows, and their neighbour lists (a, b, r, rk) of k rows, stored."""

    index: neighbours.Index
    near: DataFrame
    k: int


def lists(df: DataFrame, min_samples: int) -> Lists:
    """Neighbour lists of df (vec_id, vec), for trees of at most min_samples."""
    index, k = neighbours.build(df.select("vec_id", "vec")), 2 * min_samples + 2
    return Lists(index, storage.stored(neighbours.nearest(index, k)[0], "near"), k)


def spanning_tree(df: DataFrame, min_samples: int, known: Lists | None = None) -> DataFrame:
    """Stored edges (lo, hi, w) of a least spanning tree of mutual reachability of df (vec_id, vec): a row less than df has, if ids are distinct. known: lists of df, of more than min_samples rows.

    Each round, components take their least edges (ties by ids). A row's neighbour list, of more than min_samples rows, tells
    its least edge unless all on it are in the row's own component up to a distance within which the component has no other
    edge. A component takes the edge that its rows' lists tell; the rows of others are compared with all rows only once few
    components are told, and never those of the largest, which the others join.
    """
    spark = df.sparkSession
    known = known or lists(df, min_samples)
    index, near, k = known.index, known.near, known.k
    core = near.where(F.col("rk") <= min_samples).groupBy("a").agg(F.max("r").alias("core"))
    told = near.groupBy("a").agg(F.when(F.count("*") == k, F.max("r")).otherwise(float("inf")).alias("told"))
    # what of a row's neighbours isn't on its list is farther than told
    rows = index.rows.join(core.join(told, "a").withColumnRenamed("a", "vec_id"), "vec_id", "left").na.fill(0.0, ["core"]).na.fill(float("inf"), ["told"])
    rows = storage.stored(rows.withColumn("far", F.greatest("told", "core")).drop("told"), "cores")
    cores = rows.select("vec_id", "core")
    edges = near.join(cores.withColumnRenamed("vec_id", "a"), "a").join(cores.select(F.col("vec_id").alias("b"), F.col("core").alias("core_b")), "b")
    edges = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.greatest("r", "core", "core_b").alias("w")).distinct()
    edges = storage.stored(edges.withColumns({"c_lo": F.col("lo"), "c_hi": F.col("hi")}), "edges")
    labels = rows.select("vec_id", F.col("vec_id").alias("comp"))
    comps = rows.groupBy(F.col("vec_id").alias("comp")).agg(F.min("far").alias("far"), F.count("*").alias("n"))
    tree, count = None, rows.count()
    while count > 1:
        both = edges.select(F.explode(F.array(F.struct(F.col("c_lo").alias("comp"), F.col("c_hi").alias("other")), F.struct(F.col("c_hi").alias("comp"), F.col("c_lo").alias("other")))).alias("c"), "w", "lo", "hi")
        listed = both.groupBy("c.comp").agg(F.min(F.struct("w", "lo", "hi", "c.other")).alias("e"))
        listed = comps.join(listed, "comp", "left").withColumn("most", F.coalesce("e.w", F.lit(float("inf"))))
        listed = storage.stored(listed.withColumn("told", F.col("far") > F.col("most")), "listed")
        ready, largest = listed.agg(F.count_if("told"), F.max_by("comp", F.struct("n", "comp"))).first()
        best = listed.where("told").select("comp", "e")
        if ready * TOLD_SHARE < count:
            sought = listed.where(~F.col("told") & (F.col("comp") != largest))
            now = rows.join(labels, "vec_id").join(sought.select("comp", "most"), "comp", "left")
            now = now.withColumn("most", F.when(F.col("far") <= F.col("most"), F.col("most")).otherwise(-1.0)).drop("far")
            found = _searched(index, storage.stored(now, "open")).select("comp", F.struct("w", "lo", "hi", "other").alias("e"))
            found = found.unionByName(sought.where("e is not null").select("comp", "e")).join(sought.select("comp"), "comp", "left_semi")
            best = best.unionByName(found.groupBy("comp").agg(F.min("e").alias("e")))
        best = storage.stored(best, "best")
        part = best.select("e.lo", "e.hi", "e.w").distinct()
        tree = part if tree is None else tree.unionByName(part)
        to = comps.select("comp").join(best, "comp", "left").select("comp", F.coalesce("e.other", "comp").alias("other"))
        roots = storage.stored(_roots(storage.stored(to, "pointers")), "joined")
        comps = comps.join(roots, "comp").groupBy(F.col("root").alias("comp")).agg(F.min("far").alias("far"), F.sum("n").alias("n"))
        comps = storage.stored(comps, "comps")
        count = comps.count()
        labels = storage.stored(labels.join(roots, "comp").select("vec_id", F.col("root").alias("comp")), "labels")
        of = lambda c: roots.select(F.col("comp").alias(c), F.col("root").alias(f"to_{c}"))
        edges = edges.join(of("c_lo"), "c_lo").join(of("c_hi"), "c_hi").where("to_c_lo != to_c_hi").select("lo", "hi", "w", F.col("to_c_lo").alias("c_lo"), F.col("to_c_hi").alias("c_hi"))
        edges = storage.stored(edges, "edges")
    if tree is None:
        tree = spark.createDataFrame([], "lo long, hi long, w double")
    return storage.stored(tree, "tree")


def _searched(index: neighbours.Index, now: DataFrame) -> DataFrame:
    """(comp, w, lo, hi, other): edges out of components, of which the least is the least edge, up to most, at rows of now (vec_id, vec, block, core, comp, most) whose most isn't below 0."""
    schema = "comp long, w double, lo long, hi long, other long"
    asking = now.where("most >= 0")
    n, width = asking.agg(F.count("*"), F.max(F.size("vec"))).first()
    if n * 8 * max(width or 1, 1) <= ASKING_BYTES:
        shared = now.sparkSession.sparkContext.broadcast(asking.toPandas().assign(block=0))
        tile, most = neighbours.TILE_ROWS, neighbours.MERGE_ROWS

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value
            for b in batches:
                if len(own) and (out := neighbours.folded(pd.concat([own, b.assign(block=1, most=-1.0)]), [(0, 1)], tile, most, _outward, _least, _WITHIN)) is not None and len(out):
                    own = own.assign(most=np.minimum(own["most"], _limits(own, out)))
                    yield out

        return now.mapInPandas(run, schema)
    reach, alike = np.full(len(index.sizes), -1.0), np.full(len(index.sizes), -1, np.int64)
    names: dict[int, int] = {}
    for b, far, lo, hi in now.groupBy("block").agg(F.max("most"), F.min("comp"), F.max("comp")).collect():
        reach[b] = far
        if lo == hi:
            alike[b] = names.setdefault(lo, len(names))
    return neighbours.over_pairs(index, neighbours.near_pairs(index, reach, alike), _outward, schema, now, _least, _WITHIN)


def _limits(rows: pd.DataFrame, found: pd.DataFrame | None) -> np.ndarray:
    """Up to which distance each row looks: not at all, up to its most, or to its component's least edge in found."""
    most = rows["most"].to_numpy()
    if found is None or not len(found):
        return most
    least = found.groupby("comp")["w"].min().reindex(rows["comp"]).to_numpy()
    return np.where(most < 0, -1.0, np.fmin(most, least))


def _edges(x: pd.DataFrame, y: pd.DataFrame, w: np.ndarray) -> list[pd.DataFrame]:
    """(comp, w, lo, hi, other) for both ends of edges w between rows of x and y."""
    p, q = x["vec_id"].to_numpy(), y["vec_id"].to_numpy()
    both = {"w": w, "lo": np.minimum(p, q), "hi": np.maximum(p, q)}
    c, d = x["comp"].to_numpy(), y["comp"].to_numpy()
    return [pd.DataFrame({"comp": own, **both, "other": other}) for own, other in ((c, d), (d, c))]


def _outward(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray, same: bool) -> pd.DataFrame:
    """Each component's least edge out of it among two blocks' rows, where one of the two rows asks."""
    cx, cy = x["comp"].to_numpy(), y["comp"].to_numpy()
    w = np.maximum(np.round(d, 9), np.maximum(x["core"].to_numpy()[:, None], y["core"].to_numpy()[None]))
    w[(cx[:, None] == cy[None]) | ~((x["limit"].to_numpy() >= 0)[:, None] | (y["limit"].to_numpy() >= 0)[None])] = np.inf
    parts = []
    for axis in (1,) if same else (1, 0):
        i, j = np.nonzero((w == w.min(axis=axis, keepdims=True)) & np.isfinite(w))
        parts.append(_edges(x.iloc[i], y.iloc[j], w[i, j])[1 - axis])
    return _least(pd.concat(parts))


def _picked(rows: pd.DataFrame, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> pd.DataFrame:
    core = rows["core"].to_numpy()
    return _least(pd.concat(_edges(rows.iloc[i], rows.iloc[j], np.maximum(r, np.maximum(core[i], core[j])))))


def _least(found: pd.DataFrame) -> pd.DataFrame:
    return found.sort_values(["w", "lo", "hi"], kind="stable").drop_duplicates("comp")


_WITHIN = neighbours.Within(_limits, _picked, "comp")


# ---------------------------------------------------------------- condensed tree


class Condenser:
    """The condensed tree of merges that come in ascending height. It holds the small components of one chunk (between two calls of forget), the components of min_size rows or more that live, and the clusters: of n rows, n / min_size of either at most.

    A component of min_size rows is a big one, and has a negative name. Its last node, the merges at one height, stays open
    until one at a greater height comes: then it begins a cluster (nothing big came in), goes on as one (one big thing did), or
    parts into clusters (several did).
    """

    def __init__(self, min_size: int):
        self.min_size = max(2, min_size)
        #: of each cluster: sum of 1 / height of rows that leave it, rows, birth, clusters below
        self.left, self.rows, self.birth, self.kids = [], [], [], []
        #: of each big component: rows, height of its open node (None if closed), clusters below that, small rows in it, the node
        self.big: dict[int, list] = {}
        self.joined: dict[int, int] = {}
        self.closed: dict[int, int] = {}
        self.alias: dict[int, int] = {}
        self.nodes = self.named = 0
        self.kept: set[int] = set()
        self.forget()

    def forget(self) -> None:
        """Forget small components, and nodes but for those kept."""
        self.up: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.taken: dict[int, tuple[int, int]] = {}
        tops = {x: self._top(self.alias, x) for x in self.kept}
        live = {s[4] for s in self.big.values()} | set(tops.values())
        self.closed = {x: k for x, k in self.closed.items() if x in live}
        self.alias = {x: t for x, t in tops.items() if x != t}

    def settle(self, height: float) -> None:
        """Close the nodes below height, which no merge to come is below."""
        for c, s in list(self.big.items()):
            if s[1] is not None and s[1] < height:
                self.close(c)

    def taker(self, node: int | None) -> int | None:
        """The cluster of a node, or -1 - node while it is open; such nodes are kept."""
        if node is None or (k := self.cluster(node)) is not None:
            return None if node is None else k
        self.kept.add(node)
        return -1 - node

    @staticmethod
    def _top(up: dict[int, int], c: int) -> int:
        while (t := up.get(c, c)) != c:
            up[c] = up.get(t, t)
            c = t
        return c

    def find(self, c: int) -> int:
        if c >= 0:
            c = self._top(self.up, c)
            if c not in self.taken:
                return c
            c = self.taken[c][1]
        return self._top(self.joined, c)

    def close(self, c: int) -> None:
        rows, height, kids, small, node = self.big[c]
        if height is None:
            return
        lam = 1 / max(height, 1e-12)
        if len(kids) == 1:
            k = kids[0]
            self.left[k] += small * lam
            self.rows[k] += small
        else:
            k = len(self.left)
            for x in kids:
                self.birth[x] = lam
            self.left.append(rows * lam)
            self.rows.append(rows)
            self.birth.append(0.0)
            self.kids.append(kids)
        self.closed[node] = k
        self.big[c] = [rows, None, [k], 0, None]

    def merge(self, a: int, a_rows: int, b: int, b_rows: int, height: float) -> None:
        """a, b: components' names as of the chunk's beginning or since; rows of those that are small."""
        a, b = ((self.find(c), n) for c, n in ((a, a_rows), (b, b_rows)))
        sides = []
        for c, n in (a, b):
            if c < 0:
                if self.big[c][1] is not None and self.big[c][1] < height:
                    self.close(c)
                sides.append(self.big[c])
            else:
                sides.append([self.size.setdefault(c, n), height, [], self.size[c], None])
        rows = sides[0][0] + sides[1][0]
        (a, _), (b, _) = a, b
        if rows < self.min_size:
            self.up[b] = a
            self.size[a] = rows
            return
        nodes = [s[4] for s in sides if s[4] is not None]
        node = nodes[0] if nodes else self.nodes
        self.nodes += not nodes
        if len(nodes) == 2:
            self.alias[nodes[1]] = node
        state = [rows, height, sides[0][2] + sides[1][2], sides[0][3] + sides[1][3], node]
        name = min(a, b)
        if name >= 0:
            self.named += 1
            name = -self.named
        for c in (a, b):
            if c >= 0:
                self.taken[c] = node, name
            elif c != name:
                self.joined[c] = name
                del self.big[c]
        self.big[name] = state

    def cluster(self, node: int) -> int | None:
        """The cluster that a node is in; None while it is open."""
        return self.closed.get(self._top(self.alias, node))

    def moved(self, c: int) -> tuple[int, int, int | None, int | None]:
        """Of a name as of the chunk's beginning: its component's name and rows now, and the node that took it in, if it was small and was."""
        now = self.find(c)
        node = self.taken[self._top(self.up, c)][0] if c >= 0 and now < 0 else None
        return now, self.big[now][0] if now < 0 else self.size[now], node

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(label of each cluster, or -1; 1 / birth of each label's cluster), by excess of mass; a cluster that nothing is above isn't taken."""
        for c in list(self.big):
            self.close(c)
        tops = {self.big[c][2][0] for c in self.big}
        n = len(self.left)
        best, keep = np.zeros(n), np.zeros(n, bool)
        for c in range(n):  # those below come first
            below, own = best[self.kids[c]].sum() if self.kids[c] else 0.0, self.left[c] - self.birth[c] * self.rows[c]
            keep[c] = c not in tops and own >= below
            best[c] = own if keep[c] else below
        label = np.full(n, -1)
        reach = []
        for c in range(n - 1, -1, -1):  # those above come first
            if label[c] < 0 and keep[c]:
                label[c] = len(reach)
                reach.append(1 / self.birth[c] if self.birth[c] > 0 else np.inf)
            for k in self.kids[c]:
                label[k] = label[c]
        return label, np.array(reach)


def condensed(tree: DataFrame, rows: DataFrame, min_size: int) -> tuple[DataFrame, int]:
    """((vec_id, cluster) of rows (vec_id), the number of clusters) of the spanning tree's edges (lo, hi, w): clusters are numbered by their smallest vec_id, -1 is noise.

    Edges are merged in ascending order, CHUNK_EDGES at a time on the driver, which holds no more of rows than a chunk's
    ends; between chunks, rows take their components' new names.
    """
    spark = tree.sparkSession
    n = tree.count()
    chunks = -(-n // CHUNK_EDGES)
    if chunks > 1:
        ordered = ranks.running(tree, "w", F.lit(1), "before", ties=["lo", "hi"]).withColumn("chunk", F.expr(f"cast(coalesce(before, 0) div {CHUNK_EDGES} as int)"))
        tree = storage.stored(ordered, "ordered")
    else:
        tree = tree.withColumn("chunk", F.lit(0))
    state = rows.select("vec_id", F.col("vec_id").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("node"))
    # names of components are numbers of their own: ids may be negative
    state = storage.stored(state.withColumn("comp", F.monotonically_increasing_id()), "state")
    c = Condenser(min_size)
    for k in range(chunks):
        ends = lambda e, s: state.select(F.col("vec_id").alias(e), F.col("comp").alias(f"c_{e}"), F.col("size").alias(f"n_{e}"))
        some = tree.where(F.col("chunk") == k).join(ends("lo", 0), "lo").join(ends("hi", 1), "hi").select("w", "lo", "hi", "c_lo", "n_lo", "c_hi", "n_hi").collect()
        names = set()
        for w, _, _, a, x, b, y in sorted(some):
            names |= {a, b}
            c.merge(a, x, b, y, w)
        c.settle(w)
        table = [(x, now, m, c.taker(node)) for x, now, m, node in ((x, *c.moved(x)) for x in names)]
        c.forget()
        moved = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in zip(*table, strict=True)], ["comp", "now", "rows", "taken"]))
        # CHUNK_EDGES * 2 rows at most
        state = state.join(F.broadcast(moved), "comp", "left").select("vec_id", F.coalesce("now", "comp").alias("comp"), F.coalesce("rows", "size").alias("size"), F.coalesce("node", "taken").alias("node"))
        state = storage.stored(state, "state")
    label, _ = c.finish()
    # clusters, and nodes that were open between two chunks
    nodes = [(x, int(k)) for x, k in enumerate(label)] + [(-1 - x, int(label[c.cluster(x)])) for x in c.kept]
    table = spark.createDataFrame(nodes, "node long, label int")
    out = state.join(table, "node", "left").select("vec_id", F.coalesce("label", F.lit(-1)).alias("label"))
    first = sorted((r[1], r[0]) for r in out.where("label >= 0").groupBy("label").agg(F.min("vec_id")).collect())
    number = spark.createDataFrame([(x, i) for i, (_, x) in enumerate(first)], "label int, cluster int")
    return out.join(F.broadcast(number), "label", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster")), len(first)


def density_clusters(df: DataFrame, min_size: int = 10, min_samples: int = 5) -> DataFrame:
    """(vec_id, cluster) of all rows of df (vec_id, vec), ids distinct; -1 is noise. Rows without vec are noise."""
    with storage.scratch(df.sparkSession) as keep:
        tree = spanning_tree(df, min_samples)
        out = storage.stored(condensed(tree, df.select("vec_id"), min_size)[0], "clusters")
        keep.append(out)
    return out
