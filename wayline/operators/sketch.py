"""Covariance spectra of wide vectors without a d x d matrix, for several lags at once.

A randomised range finder: the covariances are applied to a few random directions (sums of d x r numbers over the rows), an
orthonormal basis of what comes out holds nearly all of their leading eigenvectors, and the rest is done with the rows'
coordinates in that basis. Vectors of at most as many columns as the basis may have keep their own basis, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.windows import game

#: Random directions for each covariance, and directions of the basis at most.
DIRECTIONS, RANK = 48, 256
#: Numbers of one collected sum at most.
MOST_CELLS = 4_000_000


def products(df: DataFrame, left: str, rights: list[str], width: int, less: np.ndarray | None = None) -> dict[str, tuple[np.ndarray, int]]:
    """By name of rights (arrays of width numbers, null where a row has none): the sum of outer products left x right over rows, and their number. less: rights without the product of left and this matrix. A task adds its rows up; then the rows of the sums meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        count = dict.fromkeys(rights, 0)
        for b in batches:
            for name in rights:
                own = b[b[name].notna()]
                if len(own):
                    x, y = np.stack(own[left].to_numpy()).astype(float), np.stack(own[name].to_numpy()).astype(float)
                    part = x.T @ (y if less is None else y - x @ less)
                    total[name] = part if name not in total else total[name] + part
                    count[name] += len(own)
        for name, m in total.items():
            yield pd.DataFrame({"name": name, "j": np.arange(len(m), dtype=np.int32), "n": count[name], "row": list(m)})

    parts = df.select(*dict.fromkeys([left, *rights])).mapInPandas(run, "name string, j int, n long, row array<double>")
    rows = parts.groupBy("name", "j").agg(F.sum("n").alias("n"), *(F.sum(F.get("row", F.lit(k))).alias(f"s{k}") for k in range(width))).collect()
    out = {}
    for name in rights:
        own = sorted(tuple(r)[1:] for r in rows if r["name"] == name)
        if own:
            out[name] = np.array([r[2:] for r in own], float), own[0][1]
    return out


def means(df: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, variance by column with division by n, n): moments of a task are merged, so that large means don't cancel."""
    schema = "n long, j int, m double, q double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, m, q = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b[vec].to_numpy()).astype(float)
                k, mean = len(x), x.mean(axis=0)
                dev = ((x - mean) ** 2).sum(axis=0)
                if m is None:
                    n, m, q = k, mean, dev
                else:
                    step = mean - m
                    q = q + dev + step**2 * n * k / (n + k)
                    m, n = m + step * k / (n + k), n + k
        if m is not None:
            yield pd.DataFrame({"n": n, "j": np.arange(len(m), dtype=np.int32), "m": m, "q": q})

    parts = df.select(vec).mapInPandas(run, schema)
    t = parts.groupBy("j").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"), F.sum("q").alias("q"), F.collect_list(F.struct("n", "m")).alias("parts"))
    between = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["m"] - F.col("m")) * (p["m"] - F.col("m")))
    rows = sorted(tuple(r) for r in t.select("j", "m", ((F.col("q") + between) / F.col("n")).alias("v"), "n").collect())
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), int(rows[0][3]) if rows else 0


def projected(df: DataFrame, mean: np.ndarray, basis: np.ndarray, name: str, vec: str = "vec") -> DataFrame:
    """df with name: the coordinates of vec - mean along the columns of basis. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast((mean, basis))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, q = shared.value
        for b in batches:
            y = (np.stack(b[vec].to_numpy()).astype(float) - m) @ q if len(b) else np.zeros((0, q.shape[1]))
            yield b.assign(**{name: list(y)})

    return df.mapInPandas(run, f"{kinds}, `{name}` array<double>")


@dataclass
class Spectrum:
    """Of rows' vectors: mean, total variance, an orthonormal basis (d, r), and by lag the symmetrised covariance in it."""

    mean: np.ndarray
    variance: float
    basis: np.ndarray
    by_lag: dict[int, np.ndarray]


def spectrum(df: DataFrame, lags: tuple[int, ...] = (), rank: int = RANK, directions: int = DIRECTIONS, passes: int = 2, seed: int = 0) -> Spectrum:
    """Covariances of df (game_id, move_number, vec) at lag 0 and lags, in a basis of at most rank directions.

    A covariance at a lag is the mean of products over pairs of rows of one game, symmetrised, around the mean of all rows. passes:
    how often lag 0 is applied to the basis, which sharpens it. The vectors are shuffled once if there are lags, else
    never; then only coordinates are, all lags in one window.
    """
    mean, variance, n = means(df)
    d = len(mean)
    if d <= rank:
        basis = np.eye(d)
    else:
        rng = np.random.default_rng(seed)
        omega = rng.normal(size=(d, directions))
        if d * directions * (1 + 2 * len(lags)) > MOST_CELLS:
            raise ValueError(f"over {MOST_CELLS} numbers in a sketch")
        y = projected(df.select("game_id", "move_number", "vec"), mean, omega, "y0")
        names = ["y0"]
        for lag in lags:
            y = y.withColumn(f"f{lag}", F.lead("y0", lag).over(game())).withColumn(f"b{lag}", F.lag("y0", lag).over(game()))
            names += [f"f{lag}", f"b{lag}"]
        sums = products(y, "vec", names, directions)
        # vectors aren't centred there, which adds multiples of the mean: it is in the basis, too
        basis = _orthonormal(np.concatenate([*(m / n for m, n in sums.values()), mean[:, None]], axis=1), rank)
        for _ in range(passes):
            m, n = products(projected(df.select("vec"), mean, basis, "y"), "vec", ["y"], basis.shape[1])["y"]
            basis = _orthonormal(m / n, rank)
    z = projected(df.select("game_id", "move_number", "vec"), mean, basis, "z").drop("vec")
    names = ["z"]
    for lag in lags:
        z = z.withColumn(f"z{lag}", F.lead("z", lag).over(game()))
        names.append(f"z{lag}")
    sums = products(z, "z", names, basis.shape[1])
    half = lambda s: (s[0] + s[0].T) / 2 / s[1]
    return Spectrum(mean, float(variance.sum()), basis, {lag: half(sums[name]) for lag, name in zip((0, *lags), names, strict=True) if name in sums})


def _orthonormal(x: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of the columns of x, of rank columns at most."""
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, : min(rank, int((s > 1e-10 * s[0]).sum()))]
