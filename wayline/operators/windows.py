"""Operators on moves in order: one window, hence one shuffle by game, each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wayline.functions import vectors as v
from wayline.operators import ranks


def game() -> WindowSpec:
    """A game's moves in order."""
    return Window.partitionBy("game_id").orderBy("move_number")


def divergence(df: DataFrame, w: int = 5, metric: str = "cosine") -> DataFrame:
    """df (game_id, move_number, vec) with divergence of the directions before and after each move; null nearer than w to an end, 0 where nothing moves."""
    x = df.withColumn("b", F.lag("vec", w).over(game())).withColumn("a", F.lead("vec", w).over(game()))
    x = x.withColumn("before", v.minus(F.col("vec"), F.col("b"))).withColumn("after", v.minus(F.col("a"), F.col("vec")))
    x = x.withColumn("nb", v.norm(F.col("before"))).withColumn("na", v.norm(F.col("after")))
    if metric == "cosine":
        apart = 1 - v.dot(F.col("before"), F.col("after")) / (F.col("nb") * F.col("na"))
    else:
        apart = F.sqrt(v.total(F.zip_with("before", "after", lambda p, q: (p / F.col("nb") - q / F.col("na")) * (p / F.col("nb") - q / F.col("na")))))
    out = F.when(F.col("b").isNull() | F.col("a").isNull(), None).when((F.col("nb") < 1e-8) | (F.col("na") < 1e-8), 0.0).otherwise(apart)
    return x.withColumn("divergence", out).drop("a", "b", "before", "after", "na", "nb")


def threshold(df: DataFrame, col: str, share: float) -> DataFrame:
    """(threshold): the exact percentile over all rows, with linear interpolation."""
    return ranks.quantile(df, col, share)


def bifurcations(df: DataFrame, share: float = 0.95, distance: int = 5, mode: str = "reference") -> DataFrame:
    """(idx, game_id, move_number, score) of divergences above the percentile, thinned greedily by falling score.

    mode "reference" walks over all games at once and takes a candidate only if it is distance or more behind the last one taken (signed, so
    none before it); "nms" takes, game by game, candidates distance or more from every one taken. "reference" needs a walk over all games: indices taken
    ascend, so only a candidate behind all that come before it by score can be taken, and the walk is over those few (of n in random order about ln n).
    """
    cut = threshold(df, "divergence", share)
    c = df.join(F.broadcast(cut), F.col("divergence") > F.col("threshold")).select("idx", "game_id", "move_number", F.col("divergence").alias("score"))
    item = F.struct((-F.col("score")).alias("neg"), "idx", "game_id", "move_number", "score")
    taken = "cast(array() as array<struct<neg:double,idx:bigint,game_id:bigint,move_number:int,score:double>>)"
    if mode == "reference":
        c = ranks.running(c.withColumn("neg", -F.col("score")), "neg", F.col("idx"), "top", ties=["idx"], how="max")
        c = c.where("top is null or idx > top").drop("neg", "top")
        g = c.agg(F.array_sort(F.collect_list(item)).alias("l"))
        fits = f"size(a) = 0 or x.idx - element_at(a, -1).idx >= {distance}"
    else:
        g = c.groupBy("game_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
        fits = f"forall(a, y -> abs(x.idx - y.idx) >= {distance})"
    kept = g.select(F.explode(F.expr(f"aggregate(l, {taken}, (a, x) -> case when {fits} then concat(a, array(x)) else a end)")).alias("x"))
    return kept.select("x.idx", "x.game_id", "x.move_number", "x.score")


def dwell_times(df: DataFrame) -> DataFrame:
    """(game_id, start, state, length) of runs of equal state; noise breaks runs and is dropped."""
    changed = F.coalesce((F.col("state") != F.lag("state").over(game())).cast("int"), F.lit(1))
    runs = df.withColumn("changed", changed).withColumn("run", F.sum("changed").over(game()))
    return runs.where("state >= 0").groupBy("game_id", "run", "state").agg(F.min("move_number").alias("start"), F.count("*").alias("length")).drop("run")


def context(col: str, before: int, after: int) -> Column:
    """The values of col from before rows back to after rows on, in one game."""
    return F.collect_list(col).over(game().rowsBetween(-before, after))


def even_subsample(df: DataFrame, m: int) -> DataFrame:
    """Of each game of more than m rows the floor(k (n - 1) / (m - 1))-th for k = 0 .. m - 1; shorter games whole."""
    n = F.count("*").over(Window.partitionBy("game_id"))
    x = df.withColumn("i", F.row_number().over(game()) - 1).withColumn("n", n)
    # the row i is picked if some k has floor(k (n - 1) / (m - 1)) = i; the smallest k with k (n - 1) >= i (m - 1) tells
    k = F.expr(f"(i * {m - 1} + n - 2) div greatest(n - 1, 1)")
    return x.where((F.col("n") <= m) | (k * (F.col("n") - 1) < (F.col("i") + 1) * (m - 1))).drop("i", "n")
