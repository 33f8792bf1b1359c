"""Ranks, running sums and quantiles over a whole table, without a task that gets all rows.

Rows are dealt over buckets of an order; each bucket is summed up on its own, and the sums of the buckets before it are
added. The number of buckets follows from the number of rows, which one job counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket, roughly.
BUCKET_ROWS = 500_000
#: Rows among which a quantile is taken at last.
QUANTILE_ROWS = 200_000


def _bucketed(df: DataFrame, col: str, groups: list[str], n: int) -> DataFrame:
    """df with _b, which ascends with col (a number or a date) in each group; cuts are approximate quantiles, held as groups x buckets numbers."""
    buckets = -(-n // BUCKET_ROWS)
    if buckets < 2:
        return df.withColumn("_b", F.lit(0))
    shares = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
    cuts = df.groupBy(*groups).agg(F.percentile_approx(col, shares).alias("_cuts")).collect()
    # a table of literals, as an approximate quantile needn't come out alike twice
    local = df.sparkSession.createDataFrame([tuple(r) for r in cuts], df.select(*groups, F.array(col).alias("_cuts")).schema)
    joined = df.join(F.broadcast(local), groups, "left") if groups else df.crossJoin(F.broadcast(local))
    return joined.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(col)))).drop("_cuts")


def running(df: DataFrame, col: str, value: Column, name: str, groups: list[str] | None = None, ties: list[str] | None = None, how: str = "sum") -> DataFrame:
    """df with name: the sum (or with how "max" the largest) of value over the rows before, in order of col, then ties, of the same group; null where none is."""
    groups = groups or []
    # rows of the largest group: cuts are by group, and each row is held against all of its group's
    n = df.groupBy(*groups).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] if groups else df.count()
    fold = F.sum if how == "sum" else F.max
    if n <= BUCKET_ROWS:  # one bucket, with nothing before it
        w = Window.partitionBy(*groups).orderBy(col, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_v", value).withColumn(name, fold("_v").over(w)).drop("_v")
    x = _bucketed(df.withColumn("_v", value), col, groups, n)
    own = fold("_v").over(Window.partitionBy(*groups, "_b").orderBy(col, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1))
    # groups x buckets rows
    sums = x.groupBy(*groups, "_b").agg(fold("_v").alias("_s"))
    before = fold("_s").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", before).drop("_s")
    both = F.coalesce(F.col("_own") + F.col("_before"), "_own", "_before") if how == "sum" else F.greatest("_own", "_before")
    return x.withColumn("_own", own).join(sums, [*groups, "_b"]).withColumn(name, both).drop("_v", "_b", "_own", "_before")


def hash_rank(df: DataFrame, key: str, seed: Column, name: str, groups: list[str]) -> DataFrame:
    """df with name: 0, 1, ... in an order of each group that keyed hashes of key fix. Rows of one key in a group come in any order."""
    n = df.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    x = df.withColumn("_h", F.xxhash64(F.col(key), seed)).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(buckets)))
    own = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", key)) - 1
    sums = x.groupBy(*groups, "_b").agg(F.count("*").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("_own", own).join(sums.withColumn("_before", before).drop("_s"), [*groups, "_b"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_h", "_b", "_own", "_before")


def quantile(df: DataFrame, col: str, share: float, name: str = "threshold") -> DataFrame:
    """(name): the exact quantile of col over all rows with linear interpolation; null without rows.

    A large table is narrowed down to QUANTILE_ROWS rows by histograms first: no buffer holds all values.
    """
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    n, lo, hi = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if n <= QUANTILE_ROWS or lo == hi:
        return x.agg(F.expr(f"percentile(x, {share})").alias(name)) if n <= QUANTILE_ROWS else df.sparkSession.createDataFrame([(lo,)], f"{name} double")
    at = share * (n - 1)
    first, below, inside, bins = int(at), 0, n, 4_096
    while inside > QUANTILE_ROWS and hi > lo:
        width = (hi - lo) / bins
        place = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
        counts = sorted(x.where(F.col("x").between(lo, hi)).groupBy(place.alias("k")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        for _, m, a, b in counts:
            if below + m > first:
                lo, hi, inside = a, b, m
                break
            below += m
    if inside <= QUANTILE_ROWS:
        values = sorted(r[0] for r in x.where(F.col("x").between(lo, hi)).collect())
        a = values[first - below]
        b = values[first - below + 1] if first - below + 1 < len(values) else x.where(F.col("x") > hi).agg(F.min("x")).first()[0]
    else:
        a, b = lo, lo if first - below + 1 < inside else x.where(F.col("x") > hi).agg(F.min("x")).first()[0]
    b = a if b is None else b
    return df.sparkSession.createDataFrame([(a + (b - a) * (at - first),)], f"{name} double")
