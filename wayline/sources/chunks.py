"""Chunked arrays as a Spark data source: folders of plain binary arrays with a manifest, read by chunk and by range of rows.

A folder holds, for each chunk, the vectors of its rows (float32) and their ids (int64) as .npy files, and manifest.json, which
lists the chunks of each layer with their first rows; it is written last, so a folder without it isn't whole. A read has a task
per chunk with a wanted row: other chunks aren't opened, and of these only the bytes of the wanted rows are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "wayline_chunks"
SCHEMA = "layer string, chunk long, row long, sample_id long, vec array<float>"
#: Rows that are read or written at once.
STEP = 2_048


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Piece(InputPartition):
    """Rows lo .. hi - 1 of a chunk."""

    layer: str
    chunk: int
    first: int
    lo: int
    hi: int
    file: str


@dataclass
class Written(WriterCommitMessage):
    part: int
    chunks: list[dict]


class Reader(DataSourceReader):
    def __init__(self, path: str, layers: list[str] | None, chunks: list[int | None], rows: list[int | None]):
        self.path, self.layers = path, layers
        self.chunks, self.rows = ([x[0] or 0, np.inf if x[1] is None else x[1]] for x in (chunks, rows))

    def partitions(self) -> list[Piece]:
        fs, base = _folder(self.path)
        with fs.open_input_stream(f"{base}/manifest.json") as f:
            listed = json.loads(f.read())["chunks"]
        out = []
        for c in listed:
            lo, hi = max(c["first"], self.rows[0]), min(c["first"] + c["rows"], self.rows[1])
            if lo < hi and self.chunks[0] <= c["chunk"] < self.chunks[1] and (self.layers is None or c["layer"] in self.layers):
                out.append(Piece(c["layer"], c["chunk"], c["first"], int(lo), int(hi), c["file"]))
        return out or [Piece("", 0, 0, 0, 0, "")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.lo >= piece.hi:
            return
        fs, base = _folder(self.path)
        with fs.open_input_file(f"{base}/{piece.file}.x.npy") as x, fs.open_input_file(f"{base}/{piece.file}.k.npy") as k:
            heads = []
            for f in (x, k):
                np.lib.format.read_magic(f)
                shape, _, kind = np.lib.format.read_array_header_1_0(f)
                heads.append((f.tell(), shape, kind))
            width = heads[0][1][1]
            for lo in range(piece.lo, piece.hi, STEP):
                hi = min(lo + STEP, piece.hi)
                got = []
                for f, (at, shape, kind) in zip((x, k), heads, strict=True):
                    size = kind.itemsize * int(np.prod(shape[1:]))
                    f.seek(at + (lo - piece.first) * size)
                    got.append(np.frombuffer(f.read((hi - lo) * size), kind))
                n = hi - lo
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(got[0]))
                yield pa.record_batch([pa.array([piece.layer] * n, pa.string()), pa.array(np.full(n, piece.chunk)), pa.array(np.arange(lo, hi)), pa.array(got[1]), vec], names=["layer", "chunk", "row", "sample_id", "vec"])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite = path, rows, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's rows (layer, sample_id, vec), in order, as chunks of one layer and at most rows rows each."""
        fs, base = _folder(self.path)
        fs.create_dir(base, recursive=True)
        made: list[dict] = []
        layer, ids, vecs, held = None, [], [], 0

        def close() -> None:
            nonlocal ids, vecs, held
            if held:
                name = uuid.uuid4().hex
                for end, parts, kind in (("x", vecs, np.float32), ("k", ids, np.int64)):
                    with fs.open_output_stream(f"{base}/{name}.{end}.npy") as f:
                        total = np.concatenate(parts).astype(kind, copy=False)
                        np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(total))
                        f.write(total.tobytes())
                made.append({"layer": layer, "rows": held, "file": name})
            ids, vecs, held = [], [], 0

        for batch in iterator:
            t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            names = t["layer"].to_pylist()
            at = 0
            while at < len(names):
                if names[at] != layer or held == self.rows:
                    close()
                    layer = names[at]
                to = at + 1
                while to < len(names) and names[to] == layer and held + to - at < self.rows:
                    to += 1
                part = t["vec"].slice(at, to - at)
                if len(pc.unique(pc.list_value_length(part))) != 1:
                    raise ValueError("vectors of a chunk must be of one length")
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                vecs.append(flat.reshape(to - at, -1))
                ids.append(t["sample_id"].slice(at, to - at).to_numpy(zero_copy_only=False))
                held += to - at
                at = to
        close()
        return Written(TaskContext.get().partitionId(), made)

    def commit(self, messages: list[Written | None]) -> None:
        """Number the chunks of each layer in the tasks' order, and write the manifest."""
        fs, base = _folder(self.path)
        fs.create_dir(base, recursive=True)
        chunks: list[dict] = []
        after: dict[str, tuple[int, int]] = {}
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            for c in m.chunks:
                k, first = after.get(c["layer"], (0, 0))
                chunks.append({**c, "chunk": k, "first": first})
                after[c["layer"]] = k + 1, first + c["rows"]
        with fs.open_output_stream(f"{base}/manifest.json") as f:
            f.write(json.dumps({"chunks": chunks}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what tasks have written; the folder has no manifest then."""
        fs, base = _folder(self.path)
        for m in messages:
            for c in m.chunks if m else []:
                for end in ("x", "k"):
                    fs.delete_file(f"{base}/{c['file']}.{end}.npy")


class Chunks(DataSource):
    """The source, for spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(self.options["path"], *json.loads(self.options.get("wanted", "[null, [null, null], [null, null]]")))

    def writer(self, schema: object, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("rows", 50_000)), overwrite)


def write_chunks(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """df (layer, sample_id, vec) as a new folder of chunks of at most rows rows, each layer in order of sample_id. Vectors of a layer are of one length."""
    df.sparkSession.dataSource.register(Chunks)
    order = ["layer", "sample_id"]
    some = df.select("layer", F.col("sample_id").cast("long").alias("sample_id"), F.col("vec").cast("array<float>").alias("vec"))
    some.repartitionByRange(*order).sortWithinPartitions(*order).write.format(NAME).option("rows", rows).mode("append").save(path)


def read_chunks(spark: SparkSession, path: str, layers: list[str] | None = None, chunks: tuple[int | None, int | None] = (None, None), rows: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(layer, chunk, row, sample_id, vec) of a folder of chunks; row counts from 0 in each layer. With layers, chunks lo .. hi - 1 and rows lo .. hi - 1 only those, and nothing else is read.

    These are the read's own arguments, not conditions that Spark pushes down: two scans of one frame in one plan share a
    reader, so that one scan's conditions would hold for the other.
    """
    spark.dataSource.register(Chunks)
    return spark.read.format(NAME).option("wanted", json.dumps([layers, chunks, rows])).load(path)


def batches(df: DataFrame, rows: int) -> DataFrame:
    """df with batch: rows successive rows of a layer each. No pass over the data; a read of rows (k * rows, (k + 1) * rows) is batch k alone."""
    return df.withColumn("batch", F.expr(f"row div {rows}"))
