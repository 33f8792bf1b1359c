"""Gram and lagged covariance matrices of vector columns: each task adds up its own rows, then d x d sums meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.windows import game


def gram(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(i, j, s): sums of a_i b_j over all rows, for arrays of one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x in batches:
            if len(x):
                part = np.stack(x["a"].to_numpy()).astype(np.float64).T @ np.stack(x["b"].to_numpy()).astype(np.float64)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    parts = df.select(df[a].alias("a"), df[b].alias("b")).mapInPandas(run, "i int, j int, s double")
    return parts.groupBy("i", "j").agg(F.sum("s").alias("s"))


def lagged_covariance(df: DataFrame, lag: int = 1, vec: str = "vec") -> DataFrame:
    """(i, j, c): mean of (x_t - mu)_i (x_(t + lag) - mu)_j over pairs in one game, mu the mean of all rows, symmetrised."""
    mu = df.select(F.posexplode(vec).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"))
    mu = mu.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("mu"))
    x = df.crossJoin(F.broadcast(mu)).withColumn("a", F.zip_with(vec, "mu", lambda p, q: p - q))
    pairs = x.withColumn("b", F.lead("a", lag).over(game())).where("b is not null").select("a", "b")
    one = F.lit(1.0)
    g = gram(pairs.select(F.array_append("a", one).alias("a"), F.array_append("b", one).alias("b")))
    n = g.agg(F.max(F.struct("i", "j", "s")).alias("m")).select(F.col("m.i").alias("last"), F.col("m.s").alias("n"))
    c = g.crossJoin(F.broadcast(n)).where("i < last and j < last").select("i", "j", (F.col("s") / F.col("n")).alias("c"))
    return c.alias("x").join(c.alias("y"), (F.col("x.i") == F.col("y.j")) & (F.col("x.j") == F.col("y.i"))).select("x.i", "x.j", ((F.col("x.c") + F.col("y.c")) / 2).alias("c"))
