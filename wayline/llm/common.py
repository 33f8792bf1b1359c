"""Shared pieces of the training-data operators.

Text kernels work on UTF-8 bytes of an Arrow batch with numpy: no Python object per word.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import shipping

#: Bytes of text that one numpy step handles; a longer single text is handled alone.
BLOCK_BYTES = 500_000
#: Rows of one Arrow batch between JVM and Python: texts can be long, and a batch is held whole on both sides.
BATCH_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, and bound the session's Arrow batches where they have the usual bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shipping.ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset a temporary one, if all run on one machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="wayline-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/wayline/{name}-{uuid.uuid4().hex}"


#: Paths that stored has written and that are still there.
_STORED: dict[str, None] = {}
#: Paths stored in the innermost scratch of this thread or task.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs don't recompute it, and it outlives executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    _STORED[path] = None
    if (own := _SCRATCH.get()) is not None:
        own.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that stored has written, which nothing reads any more; others are let be."""
    for t in tables:
        path = t.__dict__.get("_stored_at")
        if path in _STORED:
            remove(t.sparkSession, path)
            del _STORED[path]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what this thread stores inside, at its end, but for the tables put into the list; these belong to the scratch around it, if there is one."""
    outer, own, keep = _SCRATCH.get(), [], []
    token = _SCRATCH.set(own)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        kept = {t.__dict__.get("_stored_at") for t in keep}
        for path in own:
            if path in kept:
                if outer is not None:
                    outer.append(path)
            elif path in _STORED:
                remove(spark, path)
                del _STORED[path]


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that this thread stores inside; they stay, and belong to the scratch around it, if there is one."""
    outer, own = _SCRATCH.get(), []
    token = _SCRATCH.set(own)
    try:
        yield own
    finally:
        _SCRATCH.reset(token)
        if outer is not None:
            outer += own


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables by their paths; those that are gone are let be."""
    for path in paths:
        if path in _STORED:
            remove(spark, path)
            del _STORED[path]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def named(df: DataFrame, id_col: str, made: list[str]) -> DataFrame:
    """df's column _id as id_col, then the columns made; one of these that has the id column's name is left out."""
    return df.select(F.col("_id").alias(id_col), *(c for c in made if c != id_col))


#: A key is hot if it has more rows than this and than one part in HOT_SHARE of all: so there are at most HOT_SHARE of them.
HOT_ROWS, HOT_SHARE = 4_096, 1_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has a row per key with size, the number of rows of the key among total rows.

    Rows of a hot key, and those with a null key, are dealt over several tasks by the hash of the columns spread; the
    former meet a copy of their group in each. The broadcast table of hot keys has HOT_SHARE rows at most. size stays out
    of the result. No group has a null key.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    salts = F.expr(f"cast(ceil(size / {limit}.0) as int)")
    hot = groups.where(F.col("size") > limit).select(*keys, salts.alias("_salts"))
    missing = " or ".join(f"{k} is null" for k in keys)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.expr(f"cast(pmod(xxhash64({spread}), if({missing}, {HOT_SHARE}, coalesce(_salts, 1))) as int)")).drop("_salts")
    copies = groups.withColumn("_salt", F.explode(F.expr(f"sequence(0, if(size > {limit}, cast(ceil(size / {limit}.0) as int), 1) - 1)"))).drop("size")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


# ---------------------------------------------------------------- hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: Per lane of span_hashes: an odd factor and a start value. Spans of more than LONG_SPAN bytes are digested one by one.
_FACTOR = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_START = [np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)]
_MASK = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)
LONG_SPAN = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:end] of each span; with two lanes 128 bits, as rows (spans, 2).

    Eight bytes at a time are mixed into a state that began with the span's length. Spans of at most eight bytes and
    equal length never share a hash; for others it is as for random values. No sum over places is formed, so texts of
    regular build don't meet, as they do in polynomial hashes.
    """
    at = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    size = ends - starts
    out = np.empty((len(starts), lanes), np.uint64)
    long = np.flatnonzero(size > LONG_SPAN)
    todo = np.flatnonzero(size <= LONG_SPAN) if len(long) else np.arange(len(starts))
    for lane in range(lanes):
        out[:, lane] = mix64(size.astype(np.uint64) * _FACTOR[lane] + _START[lane])
    for step in range(0, LONG_SPAN, 8):
        todo = todo[size[todo] > step]
        if not len(todo):
            break
        chunk = at[starts[todo] + step] & _MASK[np.minimum(size[todo] - step, 8)]
        for lane in range(lanes):
            out[todo, lane] = mix64(out[todo, lane] * _FACTOR[lane] + (chunk if not lane else (chunk << np.uint64(23)) | (chunk >> np.uint64(41))))
    for i in long:
        out[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8 * lanes).digest(), "<u8")
    return out[:, 0] if lanes == 1 else out


# ---------------------------------------------------------------- bytes of a batch

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """Some rows of a batch: ids, and their texts as one byte array."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds

    def __len__(self) -> int:
        return len(self.rows)


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Slices of a string column; null counts as empty. rows are row numbers in the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Block(np.arange(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(block: Block, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes of the block) of maximal runs of word bytes, and each row's first word number (length rows + 1)."""
    mask = is_word[block.data]
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[block.bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, block.bounds)


def word_hashes(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    return span_hashes(LOWER[block.data], starts, ends)


def word_codes(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """Each word's number among the block's distinct words, A-Z lower-cased and compared by their bytes, and those words."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    inside = np.zeros(len(block.data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    data = LOWER[block.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]]
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def keyed_hashes(words: pa.LargeStringArray, key: bytes) -> np.ndarray:
    """A 64-bit keyed BLAKE2b digest of each string. Who doesn't know the key can't make two strings meet."""
    return np.frombuffer(b"".join(hashlib.blake2b(w.as_buffer(), digest_size=8, key=key).digest() for w in words), "<u8")


def equal_spans(a: np.ndarray, a_starts: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of a are those of its span of b."""
    same = a_sizes == b_sizes
    at = np.flatnonzero(same)
    n = a_sizes[at]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    same[np.repeat(at, n)[a[np.repeat(a_starts[at], n) + step] != b[np.repeat(b_starts[at], n) + step]]] = False
    return same


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles, in order, and each row's first shingle number; a row of 1..k-1 words has one shingle of all of them."""
    counts = np.diff(first)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += h[j:] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 2**64))
    left = np.repeat(first[1:], counts) - np.arange(n)
    keep = left >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    for r in short:
        s = int(first[r])
        keep[s] = True
        total = 0
        for j in range(int(counts[r])):
            total += int(h[s + j]) * pow(0xC2B2AE3D27D4EB4F, j + 1, 2**64)
        rolled[s] = np.uint64((total ^ (int(counts[r]) << 57)) % 2**64)
    made = np.concatenate([[0], np.cumsum(keep)])
    return mix64(rolled[keep]), made[first]


def byte_class(pattern_bytes: set[int]) -> np.ndarray:
    """A table of 256 booleans."""
    t = np.zeros(256, bool)
    t[list(pattern_bytes)] = True
    return t


#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, letters and all bytes beyond ASCII.
ALNUM = byte_class({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)})
#: Words of [^\x20\x09-\x0D]+.
NONSPACE = byte_class(set(range(256)) - {32, 9, 10, 11, 12, 13})
