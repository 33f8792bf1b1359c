"""Tables of positions, activations and results: reading with pruning, checked writing, and side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import ranks


def read_activations(spark: SparkSession, path: str, layer: str | None = None, max_chunks: int | None = None) -> DataFrame:
    """activations (layer, chunk, sample_id, vec); with a layer, and of the first max_chunks chunks, only their folders are read."""
    df = spark.read.parquet(path)
    df = df.where(F.col("layer") == layer) if layer else df
    return df.where(F.col("chunk") < max_chunks) if max_chunks is not None else df


def write_activations(df: DataFrame, path: str, rows_per_chunk: int = 50_000, max_samples: int | None = None) -> None:
    """Rows (layer, sample_id, vec) of samples below max_samples, in a folder per layer and chunk of rows_per_chunk samples."""
    some = df.where(F.col("sample_id") < max_samples) if max_samples is not None else df
    dealt = some.withColumn("chunk", F.expr(f"sample_id div {rows_per_chunk}"))
    dealt.repartition("layer", "chunk").write.partitionBy("layer", "chunk").mode("overwrite").parquet(path)


def write_metadata(positions: DataFrame, path: str) -> None:
    """A position table (position_id, game_id, move_number, ...) as parquet, and as JSON an index of its games: first and last position, and how many."""
    positions.write.mode("overwrite").parquet(f"{path}/positions")
    index = positions.groupBy("game_id").agg(F.min("position_id").alias("first"), F.max("position_id").alias("last"), F.count("*").alias("n"))
    index.write.mode("overwrite").json(f"{path}/games")


def read_metadata(spark: SparkSession, path: str, game_schema: str = "game_id long, first long, last long, n long") -> tuple[DataFrame, DataFrame]:
    """(positions, games) of what write_metadata has written."""
    return spark.read.parquet(f"{path}/positions"), spark.read.schema(game_schema).json(f"{path}/games")


def batches(df: DataFrame, order: str, rows: int) -> DataFrame:
    """df with batch: rows of successive ranks in order, rows of them in each. For use one by one, where("batch = k") reads one."""
    return ranks.running(df, order, F.lit(1), "_rank").withColumn("batch", F.expr(f"coalesce(_rank, 0) div {rows}")).drop("_rank")


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result table as parquet, json or csv."""
    w = df.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "csv": w.option("header", True).csv}[kind](path)


def read_results(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    r = spark.read.schema(schema)
    return {"parquet": r.parquet, "json": r.json, "csv": r.option("header", True).csv}[kind](path)


def validate_positions(df: DataFrame, cells: int = 361) -> None:
    """Raise ValueError if boards are missing, of another length, or hold other values than 0, 1, 2; one aggregate."""
    bad = df.agg(F.count_if(F.col("board").isNull() | (F.size("board") != cells)).alias("shape"), F.count_if(F.exists("board", lambda x: ~x.isin(0, 1, 2))).alias("value")).first()
    if bad["shape"] or bad["value"]:
        raise ValueError(f"{bad['shape']} boards of other shape, {bad['value']} with other values")


def with_stats(df: DataFrame, stats: DataFrame | None, key: str = "layer") -> DataFrame:
    """df with a side table's columns; without one, or where it has no row, null."""
    return df.join(stats, key, "left") if stats is not None else df
