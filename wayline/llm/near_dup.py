"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles gets 128 minima. 32 bands of 4 minima give candidate groups; of each minimum 2 low
bits are kept, packed into four longs, and their matches, corrected for chance, estimate the similarity of a candidate
pair. Pairs whose estimate is not far below the threshold are confirmed on the full sets. A pair at similarity 0.8 shares
no band with probability (1 - 0.8**4)**32 < 5e-8, and is estimated below the cut with probability < 1e-8.

Groups are never expanded into all pairs. Documents with equal sets form a class with one representative. In each band
group, members are first compared with one pivot. Groups that then still hold several components are cut into blocks of
bounded size, and each pair of blocks is looked at inside of one task, twice: by packed bits alone, which leaves the
documents that have a likely partner in another component, and then with the texts of those, which gives back only
links. A pair that shares several groups is compared in the first. Components thus come out as if all candidate pairs had
been confirmed: a pair within one component needs no comparison. Candidates and classes come from 64-bit hashes whose key is
drawn anew for each call, so that no text can be made to meet another: two given shingles do with a probability of about
1e-19. Links between classes are confirmed on the words' own bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.graph import components

PERMUTATIONS, BANDS, BITS = 128, 32, 2
#: Confirm pairs whose estimate is at least the threshold less this (six standard deviations).
MARGIN = 0.25
#: Shingles of one block, roughly: what a task holds of a set of documents that are still apart.
BLOCK_SHINGLES = 600_000

_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_SEED = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def row_sets(block: common.Block, k: int, key: bytes) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes, keyed."""
    starts, ends, first = common.words(block, common.NONSPACE)
    code, distinct = common.word_codes(block, starts, ends)
    h, at = common.shingle_hashes(common.keyed_hashes(distinct, key)[code], first, k)
    return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(block))]


def exact_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles, as numbers that two texts share where all words of two shingles have equal bytes. Empty texts have none."""
    sets = [np.zeros(0, np.int64)] * len(texts)
    for block in common.blocks(texts, 2**62):  # all in one
        starts, ends, first = common.words(block, common.NONSPACE)
        counts = np.diff(first)
        if not len(starts):
            continue
        code, distinct = common.word_codes(block, starts, ends)
        at = np.flatnonzero(np.repeat(first[1:], counts) - np.arange(len(code)) >= k)
        shingle = code[at]
        for j in range(1, k):  # fewer numbers than places, so the products fit 64 bits
            shingle = pa.array(shingle * len(distinct) + code[at + j]).dictionary_encode().indices.to_numpy().astype(np.int64)
        bounds = np.searchsorted(at, first)
        short: dict[tuple[int, ...], int] = {}
        for i in range(len(block)):
            if counts[i] >= k:
                sets[i] = np.unique(shingle[bounds[i] : bounds[i + 1]])
            elif counts[i]:
                sets[i] = np.array([-1 - short.setdefault(tuple(code[first[i] : first[i + 1]].tolist()), len(short))])
    return sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PERMUTATIONS) minima; no set is empty. In steps that fit the cache."""
    out = np.full((len(sets), PERMUTATIONS), np.iinfo(np.uint64).max, np.uint64)
    step = 32_768
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for lo in range(0, len(flat), step):
        hi = min(lo + step, len(flat))
        a, b = int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi, "left"))
        cuts = np.maximum(first[a:b] - lo, 0)
        part, buf = flat[lo:hi], np.empty(hi - lo, np.uint64)
        for p in range(PERMUTATIONS):
            np.multiply(part, _MUL[p], out=buf)
            np.add(buf, _ADD[p], out=buf)
            np.minimum(out[a:b, p], np.minimum.reduceat(buf, cuts), out=out[a:b, p])
    return out


def signatures(mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows, BANDS) int64 and packed low bits (rows, 4) int64."""
    rows = PERMUTATIONS // BANDS
    keys = np.zeros((len(mins), BANDS), np.uint64)
    for j in range(rows):
        keys = common.mix64(keys * np.uint64(0x9E3779B97F4A7C15) + mins[:, j::rows] + _SEED)
    low = common.mix64(mins) & np.uint64(2**BITS - 1)
    per = 64 // BITS
    packed = np.zeros((len(mins), PERMUTATIONS // per), np.uint64)
    for j in range(per):
        packed |= low[:, j::per] << np.uint64(BITS * j)
    return keys.view(np.int64), packed.view(np.int64)


def _signed(df: DataFrame, text_col: str, id_col: str, k: int, key: bytes) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in common.blocks(batch.column(1)):
                sets = row_sets(block, k, key)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, bits = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), 4), np.int64)
                if full:
                    keys[full], bits[full] = signatures(minima([sets[i] for i in full]))
                empty = np.array([not len(s) for s in sets])
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                columns = [batch.column(0).slice(int(block.rows[0]), len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), bands, *(pa.array(bits[:, j], mask=empty) for j in range(4))]
                yield pa.record_batch(columns, names=["id", "n", "mark", "bands", "b0", "b1", "b2", "b3"])

    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"id {kind}, n long, mark binary, bands array<bigint>, b0 long, b1 long, b2 long, b3 long")


def matches(a: str, b: str) -> str:
    """SQL for the number of minima whose low bits agree in two rows' packed longs."""
    apart = [f"({a}.b{j} ^ {b}.b{j})" for j in range(4)]
    return f"({PERMUTATIONS} - " + " - ".join(f"bit_count(({x} | shiftright({x}, 1)) & 6148914691236517205)" for x in apart) + ")"


def estimate(n_matches: float) -> float:
    """Similarity estimated from matching low bits, less those that agree by chance."""
    chance = 2.0**-BITS
    return (n_matches / PERMUTATIONS - chance) / (1 - chance)


def _confirmed(spark: SparkSession, pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b, weight), those with 100 * intersection >= percent * union of their full sets.

    A pivot a with many partners is split into groups of bounded weight (shingles), its text sent to each. Shingles are
    compared by their words' bytes.
    """
    wide = pairs.groupBy("a").agg(F.sum("weight").alias("total"), F.count("*").alias("size"))
    salted = common.join_groups(pairs, wide, ["a"], pairs.count(), "b").select("a", "b", F.expr("pmod(xxhash64(b), cast(ceil(total / 200000.0) as bigint))").alias("salt"))
    own = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    partners = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text")
    rows = own.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            a, salt, b = (batch.column(j).to_pylist() for j in range(3))
            found = []
            for block in common.blocks(batch.column(3)):
                texts = batch.column(3).slice(int(block.rows[0]), len(block))
                # the pivot of a group that goes on is looked at with this block's texts
                sets = exact_sets(pa.concat_arrays([*held, texts]), k)
                own, pivots = sets[: len(held)], held
                for i, s in zip(block.rows.tolist(), sets[len(held) :], strict=True):
                    if (a[i], salt[i]) != group:
                        group, own, pivots = (a[i], salt[i]), [], []
                    if b[i] is None:
                        own.append(s)
                        pivots.append(batch.column(3).slice(i, 1))
                        continue
                    for own_set in own:
                        small, large = (s, own_set) if len(s) < len(own_set) else (own_set, s)
                        if not len(small):
                            continue
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[at] == small).sum())
                        if 100 * both >= percent * (len(small) + len(large) - both):
                            found.append((a[i], b[i]))
                            break
                held = pivots
            if found:
                yield pa.record_batch([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], names=["u", "v"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"u {kind}, v {kind}")


class _Part:
    """The rows of one group in one pair of blocks: who they are, their component, and their signatures."""

    def __init__(self, batches: list[pa.RecordBatch], same: bool):
        t = pa.Table.from_batches(batches)
        self.rep = t["rep"].to_pylist()
        labels = t["label"].to_pylist()
        names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        self.label = np.array([names[x] for x in labels])
        self.spare, self.several, self.side = (t[c].to_numpy() for c in ("spare", "several", "own"))
        self.bits = np.stack([t[f"b{j}"].to_numpy() for j in range(4)], axis=1)
        self.bands = np.array(t["bands"].to_pylist(), np.int64)
        self.band, self.same = int(t["band"][0].as_py()), same

    def partners(self, cut: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each spare row with the rows to compare it with: of other components, likely or not to be judged by bits, and in no earlier group together. A spare pair is met from one side only."""
        place = np.arange(len(self.rep))
        for u in np.flatnonzero(self.spare):
            at = np.flatnonzero((self.label != self.label[u]) & (self.same | (self.side != self.side[u])) & (~self.spare | (place > u)))
            apart = self.bits[at] ^ self.bits[u]
            agree = PERMUTATIONS - np.bitwise_count((apart | (apart >> 1)) & 0x5555555555555555).sum(axis=1, dtype=np.int64)
            always = self.several[at] | self.several[u]
            at = at[always | ((agree >= cut) & (np.argmax(self.bands[at] == self.bands[u], axis=1) == self.band))]
            if len(at):
                yield int(u), at


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal first columns (integers), each as slices of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(j).to_numpy() for j in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        if held and not np.array_equal(columns[0], last):
            yield held
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
        last = columns[-1]
    if held:
        yield held


def _linked_within(held: DataFrame, texts: DataFrame, k: int, percent: int, cut: int) -> DataFrame:
    """Links (u, v) between different labels of one group: held (cell, band, rep, label, spare, several, n, bands, b0..b3), spare false for the most frequent label's members.

    Every document goes to the pairs of blocks that hold its own; a pair of blocks is one group of rows, dealt to one task
    by the pair's key, so a large group spreads over many tasks, each of bounded memory.
    """
    kind = held.schema["rep"].dataType.simpleString()
    weights = held.groupBy("cell").agg(F.expr(f"cast(ceil(sum(greatest(n, 100)) / {BLOCK_SHINGLES}.0) as int)").alias("blocks"), F.count("*").alias("size"))
    own = common.join_groups(held, weights, ["cell"], held.count(), "rep").withColumn("own", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    keys, rest = ["cell", "i", "j"], ["own", "band", "rep", "label", "spare", "several", "bands", "b0", "b1", "b2", "b3"]
    rows = own.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rest)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "rep")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            part = _Part(group, group[0].column(1)[0].as_py() == group[0].column(2)[0].as_py())
            some = np.zeros(len(part.rep), bool)
            for u, at in part.partners(cut):
                some[u] = some[at] = True
            if some.any():
                yield from pa.Table.from_batches(group).filter(pa.array(some)).to_batches()

    active = common.stored(dealt.mapInArrow(likely, rows.schema), "likely")
    full = active.join(texts.withColumnRenamed("id", "rep"), "rep").select(*keys, *rest, "text").repartition(*keys).sortWithinPartitions(*keys, "rep")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            part = _Part(group, group[0].column(1)[0].as_py() == group[0].column(2)[0].as_py())
            sets = exact_sets(pa.concat_arrays([batch.column(len(keys) + len(rest)) for batch in group]), k)
            sizes = np.array([len(x) for x in sets])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flag = np.zeros(len(flat) + 1, np.int32)
            found = []
            for u, at in part.partners(cut):
                at = at[sizes[at] > 0]
                if not len(at):
                    continue
                mine = flat[ends[u] : ends[u + 1]]
                flag[mine] = 1
                spans = [flat[ends[v] : ends[v + 1]] for v in at]
                both = np.add.reduceat(flag[np.concatenate(spans)], np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
                flag[mine] = 0
                found += [(part.rep[u], part.rep[v]) for v in at[100 * both >= percent * (sizes[u] + sizes[at] - both)]]
            if found:
                yield pa.record_batch([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], names=["u", "v"])

    return full.mapInArrow(confirm, f"u {kind}, v {kind}")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (smallest id reachable over links), kept (it is that id).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document's set is its distinct k-word shingles, or its whole
    word sequence where shorter. Documents link where 100 * intersection >= percent * union; percent is 60 or more, for
    which the bands are made; else ValueError. Null and empty texts have an empty set and link with nothing. Rows without id are returned
    with null component and kept = true, and link with nothing. Rows that repeat an id are one node with all their texts'
    links. Other columns are not read; an id column that is named like a result column takes its place. An empty table gives no rows.
    """
    if not 60 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not 60 to 100")
    spark = df.sparkSession
    common.ship(spark)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    signed = common.stored(_signed(docs, "text", "id", k, os.urandom(16)), "signatures")
    usable = signed.where("id is not null and mark is not null")
    bits = [f"b{j}" for j in range(4)]
    classes = common.stored(usable.groupBy("mark").agg(F.min("id").alias("rep"), F.count("*").alias("size"), *(F.any_value(c).alias(c) for c in ("n", "bands", *bits))), "classes")
    # an id that repeats may stand for several sets: its estimate may mislead, so it is always confirmed
    twice = usable.groupBy("id").agg(F.count_distinct("mark").alias("c")).where("c > 1").select(F.col("id").alias("rep"), F.lit(True).alias("several"))
    signs = classes.groupBy("rep").agg(F.max("n").alias("n"), *(F.max_by(c, "mark").alias(c) for c in bits))
    signs = common.stored(signs.join(twice, "rep", "left"), "bits")
    cells = classes.select("rep", F.posexplode("bands").alias("band", "cell"))
    shared = cells.groupBy("cell").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    total = classes.count() * BANDS
    cells = common.stored(common.join_groups(cells, shared, ["cell"], total, "rep").select("cell", "band", "rep", "pivot"), "cells")

    cut = int(np.floor(PERMUTATIONS * (2.0**-BITS + (1 - 2.0**-BITS) * (percent / 100 - MARGIN))))
    near = F.expr(f"x.several or y.several or {matches('x', 'y')} >= {cut}")
    same_id = usable.join(classes.select("mark", "rep"), "mark").where("id != rep").join(twice.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    pairs = cells.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    pivots = pairs.groupBy("a").agg(F.count("*").alias("size")).join(signs.select(F.col("rep").alias("a"), F.struct("n", "several", *bits).alias("x")), "a")
    likely = common.join_groups(pairs, pivots, ["a"], total, "b").join(signs.alias("y"), F.col("b") == F.col("y.rep")).where(near)
    likely = common.stored(likely.select("a", "b", F.greatest("x.n", "y.n").alias("weight")), "pairs")
    # one pass over the texts for all that is compared below; merged at every size, as a list of candidates has no bound
    wanted = cells.select(F.col("rep").alias("id")).distinct()
    texts = common.stored(docs.join(wanted.hint("merge"), "id", "left_semi"), "texts")
    links = common.stored(_confirmed(spark, likely, texts, k, percent), "links").unionByName(same_id)
    labels = common.stored(components(links), "labels")

    held = cells.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("cell", "band", "rep", F.coalesce("component", "rep").alias("label"))
    sizes = held.groupBy("cell", "label").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("cell").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.sum("members").alias("size"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    held = common.stored(common.join_groups(held, mixed, ["cell"], total, "rep"), "mixed")
    if not held.isEmpty():
        own = classes.groupBy("rep").agg(F.max_by("bands", "mark").alias("bands")).join(signs, "rep")
        held = held.join(own, "rep").select("cell", "band", "rep", "label", (F.col("label") != F.col("main")).alias("spare"), F.coalesce("several", F.lit(False)).alias("several"), "n", "bands", *bits)
        more = common.stored(_linked_within(common.stored(held, "held"), texts, k, percent, cut), "links")
        if not more.isEmpty():
            labels = common.stored(components(links.unionByName(more)), "labels")
    reps = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("mark", "size", F.coalesce("component", "rep").alias("component"))
    out = common.join_groups(signed.select("id", "n", "mark"), reps, ["mark"], total, "id", "left").select("id", "n", F.expr("case when id is null then null else coalesce(component, id) end").alias("component"))
    out = out.select(F.col("id").alias("_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
    return common.named(out, id_col, ["n_shingles", "component_id", "kept"])
