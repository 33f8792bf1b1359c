"""Joins of points with the half-open intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """All columns of both for each point (at) in an interval [start, end): an equi-join on cells of the given width.

    An interval is copied to each cell it touches, so width should be near the intervals' usual length: then each meets
    few cells, and a cell few intervals. Empty intervals and nulls hold nothing and lie nowhere.
    """
    cell = lambda c: F.expr(f"cast(floor({c} / {width}) as bigint)")
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(start), cell(f"({end} - 1)"))))
    joined = points.where(F.col(at).isNotNull()).withColumn("_cell", cell(at)).join(spread, "_cell")
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")
