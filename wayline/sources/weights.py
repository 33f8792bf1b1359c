"""Weights of residual board networks in their usual text form: a version, then one line of numbers per tensor."""

from __future__ import annotations

import gzip

import numpy as np
from pyspark.sql import DataFrame, SparkSession

PLANES, POINTS, HIDDEN = 18, 361, 256


def _shapes(blocks: int, filters: int, hidden: int = HIDDEN) -> list[tuple[str, tuple[int, ...]]]:
    """Name and shape of each line's tensor, in order (the format is fixed): of a convolution weights, bias, mean and variance; of a dense layer weights and bias."""

    def conv(name: str, out: int, into: int, k: int) -> list[tuple[str, tuple[int, ...]]]:
        return [(f"{name}.weight", (out, into, k, k)), *((f"{name}.{x}", (out,)) for x in ("bias", "mean", "var"))]

    def dense(name: str, out: int, into: int) -> list[tuple[str, tuple[int, ...]]]:
        return [(f"{name}.weight", (out, into)), (f"{name}.bias", (out,))]

    tower = [s for b in range(blocks) for half in (1, 2) for s in conv(f"block{b}.{half}", filters, filters, 3)]
    policy = conv("policy", 2, filters, 1) + dense("policy_out", POINTS + 1, 2 * POINTS)
    value = conv("value", 1, filters, 1) + dense("value_hidden", hidden, POINTS) + dense("value_out", 1, hidden)
    return conv("input", filters, PLANES, 3) + tower + policy + value


def line_sizes(blocks: int, filters: int) -> list[tuple[str, int]]:
    return [(name, int(np.prod(shape))) for name, shape in _shapes(blocks, filters)]


def parse(text: str, filters: int) -> dict[str, np.ndarray]:
    """Tensors by name; the number of blocks follows from the number of lines. Lines of another length raise ValueError."""
    lines = text.strip().split("\n")[1:]
    blocks = (len(lines) - len(_shapes(0, filters))) // 8
    shapes = _shapes(blocks, filters)
    if len(lines) != len(shapes):
        raise ValueError(f"{len(lines)} tensors, not {len(shapes)}")
    out = {}
    for line, (name, shape) in zip(lines, shapes, strict=True):
        x = np.array(line.split(), np.float64)
        if x.size != np.prod(shape):
            raise ValueError(f"{name}: {x.size} numbers, not {np.prod(shape)}")
        out[name] = x.reshape(shape)
    return out


def write(spark: SparkSession, path: str, lines: list[list[float]], version: int = 1) -> None:
    """A folder with one compressed text file."""
    rows: DataFrame = spark.createDataFrame([("\n".join([str(version), *(" ".join(map(repr, x)) for x in lines)]),)], "value string")
    rows.coalesce(1).write.option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str, filters: int) -> dict[str, np.ndarray]:
    """Of one file, plain or compressed, or of a folder with one."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    return parse((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode(), filters)
