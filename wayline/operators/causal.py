"""What single features do to a read-out: set one code to a value, and compare the policy and the value with those before.

The read-out is linear in the codes (features x outputs, the last of them the value), so setting a feature moves the logits
by its own row: all features of a batch of rows are done together, and only sums by feature leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import vectors as v

_SUMS = ["n", "kl", "value_change", "impact", "activation", "active"]


def kept(z: np.ndarray, k: int) -> np.ndarray:
    """Codes with all but each row's k largest set to zero, ties to the smaller feature."""
    rank = np.argsort(np.argsort(-z, axis=1, kind="stable"), axis=1, kind="stable")
    return np.where(rank < k, z, 0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def interventions(codes: DataFrame, head: np.ndarray, k: int, to: np.ndarray | None = None, group: str | None = None) -> DataFrame:
    """Means over the rows of codes (z, group) by feature, and by group if there is one:

    n rows; kl of the policy before from that after (1e-10 added to both); value_change, the mean size of it; impact, the
    mean change of an output's probability; mean_activation and activation_rate of the feature; effect and change, arrays
    by output of the mean change and of its mean size. to: the value each feature is set to, by default 0 (ablation).
    """
    features, outputs = head.shape[0], head.shape[1] - 1
    shared = codes.sparkSession.sparkContext.broadcast((head, np.zeros(features) if to is None else to))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, target = shared.value
        for b in batches:
            for lo in range(0, len(b), 128):
                part = b.iloc[lo : lo + 128]
                for g, own in part.groupby("g", dropna=False):
                    z = kept(np.stack(own["z"].to_numpy()).astype(float), k)
                    logits = z @ d
                    p = softmax(logits[:, :-1])[:, None]
                    moved = logits[:, None] + (target - z)[:, :, None] * d[None]
                    q = softmax(moved[..., :-1])
                    kl = (p * (np.log(p + 1e-10) - np.log(q + 1e-10))).sum(axis=2)
                    value = np.abs(np.tanh(logits[:, None, -1]) - np.tanh(moved[..., -1]))
                    sums = {"g": g, "feature": np.arange(features), "n": float(len(z)), "kl": kl.sum(axis=0), "value_change": value.sum(axis=0), "impact": np.abs(p - q).mean(axis=2).sum(axis=0), "activation": z.sum(axis=0), "active": (z > 0).sum(axis=0).astype(float)}
                    yield pd.DataFrame(sums | {"effect": list((p - q).sum(axis=0)), "change": list(np.abs(p - q).sum(axis=0))})

    rows = codes.select("z", (F.col(group) if group else F.lit(0)).cast("long").alias("g"))
    parts = rows.mapInPandas(run, f"g long, feature int, {', '.join(c + ' double' for c in _SUMS)}, effect array<double>, change array<double>")
    by_output = lambda c: [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(outputs)]
    t = parts.groupBy("g", "feature").agg(*(F.sum(c).alias(c) for c in _SUMS), *by_output("effect"), *by_output("change"))
    mean = lambda c: F.col(c) / F.col("n")
    array = lambda c: F.array(*(mean(f"{c}{i}") for i in range(outputs))).alias(c)
    names = [F.col("g").alias(group)] if group else []
    return t.select(*names, "feature", F.col("n").cast("long").alias("n"), mean("kl").alias("kl"), mean("value_change").alias("value_change"), mean("impact").alias("impact"), mean("activation").alias("mean_activation"), mean("active").alias("activation_rate"), array("effect"), array("change"))


def differential(codes: DataFrame, head: np.ndarray, k: int, concept: str) -> DataFrame:
    """(feature, n_present, n_absent, present, absent, differential): the mean impact of ablation where concept (0 or 1) is there, where it isn't, and their difference; 0 where there is no such row."""
    x = interventions(codes, head, k, group=concept)
    side = lambda c, s: F.coalesce(F.max(F.when(F.col(concept) == s, F.col(c))), F.lit(0))
    t = x.groupBy("feature").agg(side("n", 1).alias("n_present"), side("n", 0).alias("n_absent"), side("impact", 1).alias("present"), side("impact", 0).alias("absent"))
    return t.withColumn("differential", F.col("present") - F.col("absent"))


def screened(codes: DataFrame, head: np.ndarray, k: int, steer: np.ndarray, most: int, least: float = 0.01) -> DataFrame:
    """(feature, ablation, steering, sparsity, causal) of the most features that are active most often: effects of setting each to 0 and to its value in steer, how few outputs the former reaches, and whether one of the two is above least."""
    out = interventions(codes, head, k).orderBy(F.desc("activation_rate"), "feature").limit(most)
    moved = interventions(codes, head, k, steer).select("feature", F.col("kl").alias("steering"))
    x = out.join(moved, "feature")
    return x.select("feature", F.col("kl").alias("ablation"), "steering", v.effect_sparsity(F.col("effect")).alias("sparsity"), ((F.col("kl") > least) | (F.col("steering") > least)).alias("causal"))
