"""Transition counts and matrices of state trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lagged_pairs(traj: DataFrame, lag: int = 1, *carry: str) -> DataFrame:
    """(game_id, i, j) of states lag moves apart in one game; one shuffle by game."""
    w = Window.partitionBy("game_id").orderBy("move_number")
    ahead = F.lead("state", lag).over(w)
    return traj.select("game_id", *carry, F.col("state").alias("i"), ahead.alias("j")).where("j is not null")


def transition_counts(traj: DataFrame, lag: int = 1) -> DataFrame:
    """(i, j, n): transitions between states >= 0; noise on either end is left out."""
    return lagged_pairs(traj, lag).where("i >= 0 and j >= 0").groupBy("i", "j").agg(F.count("*").alias("n"))


def row_normalised(counts: DataFrame) -> DataFrame:
    """(i, j, p): shares of each row's total. The input is k x k."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i"))).select("i", "j", "p")
