"""The canonical views of the driver's tables: trajectories, vectors, outcomes, boards. Each has its SQL, so that queries and oracles begin alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators import ranks
from wayline.storage import shared_path as shared_path

#: Event types in alphabetical order are the states 0..4 (fixed values).
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traj_state(spark: SparkSession, sf_dir: str, noise: bool = False) -> DataFrame:
    """(game_id, move_number, state, x): a user's events in time; with noise, errors are state -1."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    move = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    state = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") - 1
    if noise:
        state = F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(state)
    return e.select(F.col("user_id").alias("game_id"), move.cast("int").alias("move_number"), state.cast("int").alias("state"), F.col("value").alias("x"))


def traj_state_sql(noise: bool = False) -> str:
    state = "list_position(['click','error','purchase','signup','view'], event_type) - 1"
    if noise:
        state = f"CASE WHEN event_type = 'error' THEN -1 ELSE {state} END"
    return f"SELECT user_id AS game_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS move_number, CAST({state} AS INTEGER) AS state, value AS x FROM events"


def traj_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, move_number, vec, label): embeddings in games of 100 rows."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 100").alias("game_id"), F.expr("cast(vec_id % 100 as int)").alias("move_number"), F.col("embedding").cast("array<double>").alias("vec"), "label", "vec_id")


TRAJ_VEC_SQL = "SELECT vec_id // 100 AS game_id, CAST(vec_id % 100 AS INTEGER) AS move_number, CAST(embedding AS DOUBLE[]) AS vec, label, vec_id FROM embeddings"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, filename, value): a game record per user, a move per event; no two stones are neighbours."""
    x = traj_state(spark, sf_dir).select("game_id", "move_number")
    p = F.pmod(F.col("move_number") * 2 + F.col("game_id"), F.lit(361))
    letter = lambda c: F.chr(97 + c)
    move = F.concat(F.when(F.col("move_number") % 2 == 0, ";B[").otherwise(";W["), letter(p % 19), letter(F.floor(p / 19)), F.lit("]"))
    moves = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("move_number", move.alias("m")))), lambda s: s["m"]), "")
    g = x.groupBy(F.col("game_id").alias("user_id")).agg(moves.alias("moves"))
    head = F.concat(F.lit("(;GM[1]SZ[19]KM[6.5]PB[u"), F.col("user_id").cast("string"), F.lit("]RE[B+R]DT[2024-01-"), F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0"), F.lit("]"))
    return g.select("user_id", F.concat(F.lit("game-"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("filename"), F.concat(head, "moves", F.lit(")")).alias("value"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, outcome, outcome_code): whether a user's purchases are above the median user's."""
    e = table(spark, sf_dir, "events")
    spent = e.groupBy(F.col("user_id").alias("game_id")).agg(F.sum(F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long")).otherwise(0)).alias("cents"))
    median = ranks.quantile(spent, "cents", 0.5, "mid")
    won = F.col("cents") > F.col("mid")
    return spent.crossJoin(F.broadcast(median)).select("game_id", won.cast("int").alias("outcome"), F.when(won, "B+").otherwise("W+").alias("outcome_code"))


OUTCOMES_SQL = """SELECT game_id, CAST(cents > mid AS INTEGER) AS outcome, CASE WHEN cents > mid THEN 'B+' ELSE 'W+' END AS outcome_code
    FROM (SELECT user_id AS game_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents FROM events GROUP BY 1),
         (SELECT quantile_cont(cents, 0.5) AS mid FROM (SELECT sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS cents FROM events GROUP BY user_id))"""
