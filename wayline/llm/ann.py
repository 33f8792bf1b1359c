"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every distinct vector is indexed, with the smallest ids of its
rows. There are about as many lists as the square root of the vectors, and a query looks into as many of them as exact
search over the sample needs for the aimed-at recall: few where vectors are clustered, up to half of them where they lie
evenly in all directions. It ranks the lists' vectors by asymmetric distance tables (query against codebook), reranks the
best by exact inner product in double precision, and takes the ids of the best vectors.

Lists are packed into shards of bounded size, a longer list is spread over several; a query goes once to each shard that it
looks into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm import common

#: Distinct vectors that centroids and codebooks are fitted on at most: those with the smallest keyed hashes of their ids.
SAMPLE = 20_000
#: Lists are at most one for so many sample vectors.
LIST_SAMPLE = 8
#: Distinct vectors of one shard, and queries that one task compares with it, roughly.
SHARD_ROWS, TURN_ROWS = 8_192, 8_192
#: Sample vectors that the number of probed lists is measured with.
TRIALS = 512
SUBSPACES, CODES = 16, 64


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


class Quantiser:
    """Coarse centroids and, for residuals, codebooks of each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        d = sample.shape[1]
        self.coarse = _kmeans(sample, lists, 12, seed)
        residual = sample - self.coarse[self.lists_of(sample)]
        self.cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        self.books = [_kmeans(residual[:, a:b], min(CODES, len(sample)), 12, seed + 1 + i) for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.coarse.T - 0.5 * (self.coarse**2).sum(axis=1), axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.coarse[lists]
        return np.stack([np.argmax(r[:, a:b] @ book.T - 0.5 * (book**2).sum(axis=1), axis=1) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)], axis=1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n lists of largest inner product with each query, best first."""
        return np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")[:, :n]

    def probes_for(self, sample: np.ndarray, k: int, recall: float) -> int:
        """How many lists hold the given share of the k nearest sample vectors of sample vectors, on average. The neighbours in a sample lie further off than those in all vectors, so the latter's share is no smaller."""
        own, lists, trials = self.lists_of(sample), len(self.coarse), sample[:TRIALS]
        order = np.empty((len(trials), lists), np.int64)
        np.put_along_axis(order, self.probes(trials, lists), np.arange(lists)[None, :].repeat(len(trials), axis=0), axis=1)
        needed = np.zeros(lists + 1, np.int64)
        for i, t in enumerate(trials):
            s = sample @ t
            s[i] = -np.inf
            near = np.argpartition(-s, min(k, len(s) - 1) - 1)[: min(k, len(s) - 1)] if len(s) > 1 else np.zeros(1, np.int64)
            needed += np.bincount(order[i, own[near]] + 1, minlength=lists + 1)
        return int(np.searchsorted(np.cumsum(needed), recall * needed.sum()))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, subspaces, codes): inner products of each query's parts with the codebooks."""
        return np.stack([q[:, a:b] @ book.T for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)], axis=1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector that has no null or non-finite component and isn't zero."""
    v = df[vec_col].cast("array<double>")
    rows = df.select(df[id_col].alias("id"), v.alias("v"))
    ok = F.expr("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    return rows.where(ok)


def distinct_vectors(rows: DataFrame, n: int) -> DataFrame:
    """(id, ids, v) per distinct v of rows (id, v): the n smallest distinct ids in order, id the first. Each part cuts a large group first, so no task gets it whole."""
    some = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= n)
    return some.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("id"), "ids", "v")


def _shards(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Each list's first shard, and over how many it is spread."""
    first, parts = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    at = held = 0
    for i in range(lists):
        n = sizes.get(i, 0)
        if held and held + n > SHARD_ROWS:
            at, held = at + 1, 0
        first[i], parts[i] = at, max(1, -(-n // SHARD_ROWS))
        held += n
        if parts[i] > 1:
            at, held = at + int(parts[i]), 0
    return first, parts


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.96, rerank: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product, its own row left out; ties to the smaller id.

    recall: the share of the k nearest that the probed lists are to hold, measured on the sample; rerank: distinct vectors
    of a shard that get exact scores for a query, and all that tie with the last of them. Vectors null, zero, or with null
    or non-finite components take no part, nor do rows without id; all others must have one length, else a ValueError tells.
    Rows that repeat id and vector count as one. Rows that repeat an id with other vectors are rows of their own: as
    candidates, of each other too, and as queries, whose results all have that query_id. Fewer candidates than k: all that
    were found. Empty tables give no rows. Other columns aren't read.
    """
    spark = df.sparkSession
    common.ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    asks = common.stored(usable(queries, id_col, vec_col).distinct(), "queries")
    # a query can leave out one id of a vector, its own
    rows = common.stored(distinct_vectors(usable(df, id_col, vec_col), k + 1), "vectors")
    n, low, high = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components")
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE).collect()])
    lists = int(min(np.ceil(np.sqrt(n)), max(1, len(sample) // LIST_SAMPLE)))
    quantiser = Quantiser(sample, lists)
    probes = max(1, quantiser.probes_for(sample, k, recall))
    shared = spark.sparkContext.broadcast(quantiser)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column(2))
            at = shared.value.lists_of(x)
            codes = shared.value.encode(x, at)
            yield pa.record_batch([pa.array(at), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], names=["list", "id", "ids", "code", "v"])

    indexed = common.stored(rows.mapInArrow(index, "list long, id long, ids array<long>, code binary, v binary"), "inverted")
    first, parts = _shards({r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}, lists)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column(1))
            near = shared.value.probes(x, probes)
            shard, row, probed = [], [], []
            for i, own in enumerate(near):
                where = np.repeat(first[own], parts[own]) + np.concatenate([np.arange(p) for p in parts[own]])
                what = np.repeat(own, parts[own])
                order = np.argsort(where, kind="stable")
                cuts = np.flatnonzero(np.diff(where[order], prepend=-1))
                for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    shard.append(int(where[order[a]]))
                    row.append(i)
                    probed.append(what[order[a:z]].astype(np.int32).tobytes())
            at = pa.array(row, pa.int64())
            yield pa.record_batch([pa.array(shard, pa.int64()), b.column(0).take(at), pa.array([r.tobytes() for r in x], pa.binary()).take(at), pa.array(probed, pa.binary())], names=["shard", "id", "v", "lists"])

    asked = common.stored(asks.mapInArrow(ask, "shard long, id long, v binary, lists binary"), "asked")
    # the queries of a popular shard are dealt over turns, and its rows meet each
    turns = asked.groupBy("shard").agg(F.expr(f"cast(ceil(count(*) / {TURN_ROWS}) as int)").alias("turns"), F.count("*").alias("size"))
    spots = spark.createDataFrame(pa.table({"list": pa.array(range(lists), pa.int64()), "first": pa.array(first), "parts": pa.array(parts)}))
    placed = indexed.join(F.broadcast(spots), "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
    left = placed.join(turns.drop("size"), "shard").withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)")))
    right = common.join_groups(asked, turns, ["shard"], asked.count(), "id").withColumn("turn", F.expr("cast(pmod(xxhash64(id, v), turns) as int)"))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query": object, "vec_id": "int64", "score": "float64"})
        mine = mine.sort_values("list")
        own_list, ids, members = mine["list"].to_numpy(), mine["id"].to_numpy(), mine["ids"].to_numpy()
        codes = np.stack([np.frombuffer(c, np.uint8) for c in mine["code"]])
        x = np.stack([np.frombuffer(v, np.float64) for v in mine["v"]])
        qids, qvs = theirs["id"].to_numpy(), theirs["v"].to_numpy()
        q = np.stack([np.frombuffer(v, np.float64) for v in qvs])
        out = []
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            table, base = shared.value.tables(part), part @ shared.value.coarse.T
            looked = [np.frombuffer(b, np.int32) for b in theirs["lists"].iloc[lo : lo + 256]]
            who, what = np.repeat(np.arange(len(part)), [len(b) for b in looked]), np.concatenate(looked)
            rough = np.full((len(part), len(ids)), -np.inf)
            for one in np.unique(what):
                a, z = np.searchsorted(own_list, [one, one + 1])
                if a == z:
                    continue
                askers = who[what == one]
                some = np.repeat(base[askers, one][:, None], z - a, axis=1)
                for s in range(codes.shape[1]):
                    some += table[askers, s][:, codes[a:z, s]]
                rough[askers, a:z] = some
            m = min(rerank, len(ids))
            cut = np.partition(rough, len(ids) - m, axis=1)[:, len(ids) - m]
            for i in range(len(part)):
                at = np.flatnonzero((rough[i] >= cut[i]) & (rough[i] > -np.inf))
                score = (x[at] * part[i]).sum(axis=1)
                top = np.lexsort((ids[at], -score))[: k + 1]
                counts = [len(members[j]) for j in at[top]]
                own = np.concatenate([members[j] for j in at[top]]) if len(top) else ids[:0]
                other = (own != qids[lo + i]) | ~np.repeat((x[at[top]] == part[i]).all(axis=1), counts)
                own, score = own[other], np.repeat(score[top], counts)[other]
                best = np.lexsort((own, -score))[:k]
                out.append((np.full(len(best), qids[lo + i]), np.full(len(best), qvs[lo + i], object), own[best], score[best]))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(("query_id", "query", "vec_id", "score"))})

    keys = ["shard", "turn"]
    found = left.select(*keys, "list", "id", "ids", "code", "v").groupBy(*keys).cogroup(right.select(*keys, "id", "v", "lists").groupBy(*keys)).applyInPandas(search, "query_id long, query binary, vec_id long, score double")
    found = found.withColumn("query", F.xxhash64("query"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _stack(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)
