"""Sparse top-k codes: encoding, decoding, and statistics of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that small collects at most.
SMALL_ROWS = 10_000


def small(df: DataFrame) -> DataFrame:
    """df as a table held by the driver, which may be broadcast; fails beyond SMALL_ROWS rows. Runs a job."""
    rows = df.limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"over {SMALL_ROWS} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


def encode(df: DataFrame, weights: np.ndarray, bias: np.ndarray, id_col: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(id_col, z): relu((x - bias) W^T), a matrix product per Arrow batch; weights (features, inputs) go to executors once."""
    shared = df.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = shared.value
        for part in batches:
            if len(part):
                z = np.maximum((np.stack(part["vec"].to_numpy()).astype(np.float64) - b) @ w.T, 0.0)
                yield pd.DataFrame({id_col: part["id"], "z": list(z)})

    return df.select(df[id_col].alias("id"), df[vec].alias("vec")).mapInPandas(run, f"`{id_col}` long, z array<double>")


def ranked(codes: DataFrame, id_col: str = "vec_id", k: int | None = None) -> DataFrame:
    """(id_col, feature, value, rk) by value descending, then feature; only the first k. One narrow pass, no shuffle: ranks are places in a sorted array."""
    pairs = F.array_sort(F.transform("z", lambda x, i: F.struct((-x).alias("neg"), i.alias("feature"))))
    pairs = F.slice(pairs, 1, k) if k else pairs
    return codes.select(id_col, F.posexplode(pairs).alias("p", "s")).select(id_col, F.col("s.feature").alias("feature"), (-F.col("s.neg")).alias("value"), (F.col("p") + 1).alias("rk"))


def decode(active: DataFrame, weights: DataFrame, id_col: str = "vec_id", levels: tuple[int, ...] = ()) -> DataFrame:
    """(id_col, j, x or x_k per level): sum of value times the feature's output weights (feature, j, w), which are broadcast; all levels in one aggregate."""
    x = active.join(F.broadcast(weights), "feature")
    part = F.col("value") * F.col("w")
    sums = [F.sum(F.when(F.col("rk") <= k, part).otherwise(0.0)).alias(f"x_{k}") for k in levels] or [F.sum(part).alias("x")]
    return x.groupBy(id_col, "j").agg(*sums)


def liveness(active: DataFrame, n_rows: Column, domain: DataFrame) -> DataFrame:
    """(feature, live, rate) over the whole domain: rows in which a feature's kept value is positive."""
    n = active.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("live"))
    return domain.join(n, "feature", "left").select("feature", F.coalesce("live", F.lit(0)).alias("live"), (F.coalesce("live", F.lit(0)) / n_rows).alias("rate"))


def membership(active: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(feature, c_k ...): rows in which a feature is among the first k, zeros counted too; one aggregate for all k."""
    return active.groupBy("feature").agg(*(F.count_if(F.col("rk") <= k).alias(f"c_{k}") for k in levels))


def first_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group: Spark limits groups before the shuffle."""
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rk") <= n)
