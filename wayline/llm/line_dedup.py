"""Deletion of repeated runs of lines, by a suffix array over line-ID sequences.

Lines are numbered in (id, text digest, line) order; a line's ID is the 128-bit keyed digest of its bytes. The suffix array is
built by distributed prefix doubling: ranks by the first line, then by 2, 4, 8 ... lines, each from pairs of ranks of the
step before; ranks ascend in the order of the sorted pairs, so those of depth d are the suffix array's order to depth d.
Only suffixes that share their first d lines with another stay in play, so later steps are small.

Suffixes that agree in their first m lines are an LCP interval of depth m. Its name for 2**j <= m < 2**(j+1) is the rank
at 2**j and the rank 2**j lines before the end of the m lines. From each line the interval is looked at whose m lines are the
fewest that reach min_words, forward from the line and backward from it. The earliest suffix of an interval is its first
copy, the m lines of all others are later copies, and the union of a document's later copies, merged where they touch, is
its maximal repeated runs: each line of a maximal run of min_words or more lies in one of those intervals, and each of them
lies in a maximal run. A later copy that overlaps the first isn't one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm import common


def _least_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run of min_words words that begins at, and that ends at, each line; 0 where none."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + min_words, "left")
    forward = np.where(end <= n, end - np.arange(n), 0)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    backward = np.where(start >= 0, np.arange(n) + 1 - start, 0)
    return np.maximum(forward, (end <= n).astype(np.int64)), backward


def _run_starts(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, lines) of the distinct shortest runs of either direction, by line."""
    forward, backward = _least_runs(words, min_words)
    ends = np.flatnonzero(backward)
    starts = ends - backward[ends] + 1
    new = backward[ends] != forward[starts]
    line = np.concatenate([np.flatnonzero(forward), starts[new]])
    m = np.concatenate([forward[forward > 0], backward[ends][new]])
    order = np.lexsort((m, line))
    return line[order], m[order]


def line_digests(data: bytes, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """128-bit keyed BLAKE2b digests of the spans, as rows of two numbers."""
    digests = (hashlib.blake2b(data[a:b], digest_size=16, key=key).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _sequences(docs: DataFrame) -> DataFrame:
    """(id, th, hashes, words) of docs (id, th, text): per line 16 bytes of hash, with a key drawn anew for each call, and an int32 of words."""
    key = os.urandom(16)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in common.blocks(batch.column(2)):
                data, bounds = block.data, block.bounds
                breaks = np.flatnonzero(data == 10)
                rows = np.searchsorted(bounds, breaks, "right") - 1
                filled = np.flatnonzero(np.diff(bounds) > 0)
                starts = np.sort(np.concatenate([bounds[filled], breaks[breaks + 1 < bounds[rows + 1]] + 1]))
                ends = np.minimum(np.append(starts[1:], len(data)), bounds[np.searchsorted(bounds, starts, "right")])
                ends = ends - (data[ends - 1] == 10)
                h = line_digests(data.tobytes(), starts, ends, key)
                word_starts = common.words(block, common.NONSPACE)[0]
                words = (np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)).astype(np.int32)
                first = np.searchsorted(starts, bounds)
                own = [c.slice(int(block.rows[0]), len(block)) for c in batch.columns[:2]]
                parts = ([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)] for x in (h, words))
                yield pa.record_batch([*own, *(pa.array(p, pa.binary()) for p in parts)], names=["id", "th", "hashes", "words"])

    return docs.mapInArrow(run, f"id {kind}, th string, hashes binary, words binary")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, th, doc, pos, h1, h2, ms) for every line of docs (id, th, text), one document for equal id and th.

    pos ascends in (id, th, line) order, doc is the pos of the document's first line, only which has id and th; ms: the
    lengths of the shortest runs from there.
    """
    kind = docs.schema["id"].dataType.simpleString()
    each = _sequences(docs).groupBy("id", "th").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words"))
    dealt = each.repartitionByRange("id", "th").sortWithinPartitions("id", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column(2)[i].as_py(), np.int64).reshape(-1, 2)
                n = len(h)
                line, m = _run_starts(np.frombuffer(batch.column(3)[i].as_py(), np.int32), min_words)
                ms = pa.ListArray.from_arrays(pa.array(np.searchsorted(line, np.arange(n + 1)), pa.int32()), pa.array(m, pa.int32()))
                once = pa.array([0, *[None] * (n - 1)], pa.int32())
                yield pa.record_batch([batch.column(0).slice(i, 1).take(once), batch.column(1).slice(i, 1).take(once), pa.array(np.full(n, at)), pa.array(np.arange(at, at + n)), pa.array(h[:, 0]), pa.array(h[:, 1]), ms], names=["id", "th", "doc", "pos", "h1", "h2", "ms"])
                at += n

    return dealt.mapInArrow(run, f"id {kind}, th string, doc long, pos long, h1 long, h2 long, ms array<int>")


def _ranked(suffixes: DataFrame, keys: list[str], total: int, name: str) -> DataFrame:
    """suffixes (doc, pos, ms, keys) that share their keys with another, with rank in place of the keys; ranks ascend with the keys."""
    groups = suffixes.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    groups = common.stored(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), f"rank-{name}")
    live = common.stored(common.join_groups(suffixes, groups, keys, total, "pos").drop(*keys), f"live-{name}")
    common.drop(groups)
    return live


def _runs_of(live: DataFrame, depth: int) -> DataFrame:
    """(doc, pos, m, r1, r2): the runs of depth .. 2 * depth - 1 lines that begin at live suffixes, with the name of their LCP interval."""
    here = live.select("doc", "pos", F.col("rank").alias("r1"), F.explode(F.expr(f"filter(ms, m -> m >= {depth} and m < {2 * depth})")).alias("m"))
    ends = live.select(F.col("pos").alias("p2"), F.col("rank").alias("r2"))
    return here.join(ends, F.col("pos") + F.col("m") - depth == F.col("p2")).select("doc", "pos", "m", "r1", "r2")


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(id, th, cuts) of docs (id, th, text) with lines to delete; cuts: their runs as ascending, disjoint (s, e), lines s .. e - 1."""
    lines = common.stored(_lines(docs, min_words), "lines")
    total = lines.count()
    live = _ranked(lines.select("doc", "pos", "ms", "h1", "h2"), ["h1", "h2"], total, "1")
    runs, depth = None, 1
    while True:
        here = common.stored(_runs_of(live, depth), f"runs-{depth}").withColumn("depth", F.lit(depth))
        runs = here if runs is None else runs.unionByName(here)
        if live.where(f"exists(ms, m -> m >= {2 * depth})").isEmpty():
            break
        ahead = F.max("rank").over(Window.partitionBy("doc").orderBy("pos").rangeBetween(depth, depth))
        pairs = live.withColumn("r2", ahead).where("r2 is not null").withColumnRenamed("rank", "r1")
        depth *= 2
        old, live = live, _ranked(pairs, ["r1", "r2"], total, str(depth))
        common.drop(old)
    key = ["depth", "m", "r1", "r2"]
    firsts = runs.groupBy(*key).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("size")).where("last >= first + m").drop("last")
    later = common.join_groups(runs, firsts, key, total, "pos").where("pos >= first + m").select("doc", "pos", (F.col("pos") + F.col("m")).alias("to"))
    order = Window.partitionBy("doc").orderBy("pos", "to")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = later.withColumn("new", F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int"))
    parted = parted.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = parted.groupBy("doc", "run").agg(F.min("pos").alias("s"), F.max("to").alias("e"))
    cuts = cuts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct((F.col("s") - F.col("doc")).cast("int").alias("s"), (F.col("e") - F.col("doc")).cast("int").alias("e")))).alias("cuts"))
    return lines.where("th is not null").select("id", "th", "doc").join(cuts, "doc").select("id", "th", "cuts")


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = 50) -> DataFrame:
    """df with text_col without later copies of repeated line runs, and two columns more: n_lines, n_removed.

    Lines end at \\n (a last \\n ends a line, it doesn't begin one). A null text stays null, an empty one empty, with no
    lines; a text of which every line goes is empty. Rows that repeat both id and text are
    one document (each comes out alike); rows with one id and other texts are told apart by their texts' MD5 digests, and a
    null id sorts first. All other columns pass through; own columns n_lines and n_removed are replaced. Ties in order do
    not arise. An empty table gives no rows.
    """
    common.ship(df.sparkSession)
    docs = df.select(df[id_col].alias("id"), F.md5(df[text_col].cast("binary")).alias("th"), df[text_col].alias("text"))
    docs = docs.where("text is not null and text != ''")
    gone = common.stored(repeated_lines(docs, min_words), "cuts")
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    packed = df.select(F.struct(*[df[c] for c in names]).alias("row"), df[id_col].alias("id"), F.md5(df[text_col].cast("binary")).alias("th"))
    # merged at every size: a list of cuts has no bound
    joined = packed.join(gone.hint("merge"), packed["id"].eqNullSafe(gone["id"]) & (packed["th"] == gone["th"]), "left").select("row", "cuts")
    text = F.col(f"row.`{text_col}`")
    ended = text.endswith("\n")
    parts = F.split(F.when(ended, text.substr(F.lit(1), F.length(text) - 1)).otherwise(text), "\n", -1)
    # what stays lies between the cuts; the array of one struct binds the lines, so that they are split once, not once a run
    held = F.array(F.struct(parts.alias("parts"), F.concat(F.array(F.lit(0)), F.col("cuts.e")).alias("s"), F.concat(F.col("cuts.s"), F.array(F.size(parts))).alias("e")))
    between = lambda x: F.transform(F.arrays_zip(x["s"], x["e"]), lambda k: F.slice(x["parts"], k["s"] + 1, k["e"] - k["s"]))
    kept = F.transform(held, lambda x: F.array_join(F.flatten(between(x)), "\n"))[0]
    removed = F.expr("coalesce(aggregate(cuts, 0L, (n, c) -> n + c.e - c.s), 0L)")
    n_lines = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + F.when(ended, 0).otherwise(1)).cast("long")
    rest = F.concat(kept, F.when(ended & (removed < n_lines), "\n").otherwise(""))
    new = F.when(F.col("cuts").isNull(), text).otherwise(rest)
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names), n_lines.alias("n_lines"), removed.alias("n_removed"))
