"""Moments, standardisation, data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, vec: str = "vec", *keep: str) -> DataFrame:
    """(keep..., j, v): a row per component; the only thing that grows is narrow rows in the same task."""
    return df.select(*keep, F.posexplode(vec).alias("j", "v"))


def feature_stats(df: DataFrame, vec: str = "vec", ddof: int = 1, eps: float = 0.0) -> DataFrame:
    """(j, n, mean, std) by component; partial aggregates merge as moments do. ddof 1: one row has std 0; ddof 0: std is sqrt(var + eps)."""
    g = exploded(df, vec).groupBy("j").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("vs"), F.var_pop("v").alias("vp"))
    std = F.sqrt(F.coalesce(F.when(F.col("n") > 1, F.col("vs")), F.lit(0.0))) if ddof else F.sqrt(F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("vp")) + eps)
    return g.select("j", "n", "mean", std.alias("std"))


def zscore(df: DataFrame, stats: DataFrame, vec: str = "vec", eps: float = 1e-8, inside: bool = False, *keep: str) -> DataFrame:
    """(keep..., j, z): (x - mean) / (std + eps), or with inside / sqrt(std^2 + eps). stats has a row per component; as one array, no larger than a row's vector, it meets each row."""
    scale = (lambda s: F.sqrt(s * s + eps)) if inside else (lambda s: s + eps)
    one = stats.agg(F.array_sort(F.collect_list(F.struct("j", "mean", "std"))).alias("s"))
    z = F.zip_with(vec, "s", lambda x, s: (x - s["mean"]) / scale(s["std"]))
    return df.crossJoin(F.broadcast(one)).select(*keep, F.posexplode(z).alias("j", "z"))


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check_name, passed, n_bad): every rule counted in one pass; a rule that is null counts as broken."""
    one = df.agg(*(F.sum(F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1)).alias(name) for name, rule in rules.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n_bad")) for n in rules))
    return one.select(F.explode(rows).alias("x")).select("x.check_name", (F.col("x.n_bad") == 0).alias("passed"), "x.n_bad")
