"""Queries on sources and sinks: records, folders of them, positions, batches, activations, metadata, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import vectors as v
from wayline.functions.vectors import r6
from wayline.operators import boards
from wayline.plans import views
from wayline.plans.registry import query
from wayline.plans.views import TRAJ_VEC_SQL, table, traj_state_sql
from wayline.sources import chunks, records, tables, weights
from wayline.storage import shared_path

_P = "(move_number * 2 + game_id) % 361"
_NAME = "'game-' || lpad(CAST(game_id AS VARCHAR), 9, '0')"
_MOVES = f"SELECT game_id, move_number, {_NAME} AS filename, CAST({_P} % 19 AS INTEGER) AS c, CAST({_P} // 19 AS INTEGER) AS r, CAST(1 + move_number % 2 AS INTEGER) AS stone FROM ({traj_state_sql()})"


@query(f"""SELECT filename, 'B+R' AS result, CAST('2024-01-' || lpad(CAST(game_id % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS played, count(*) AS n_moves,
    string_agg(chr(97 + c) || chr(97 + r), ' ' ORDER BY move_number) AS moves FROM ({_MOVES}) GROUP BY filename, game_id HAVING count(*) >= 50""")
def record_text_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Moves, result and date by patterns alone; games of under 50 moves go."""
    x = records.text_moves(views.records(spark, sf))
    return x.select("filename", "result", F.to_date("date").alias("played"), F.size("moves").cast("long").alias("n_moves"), F.array_join("moves", " ").alias("moves"))


_USERS = "SELECT DISTINCT user_id AS u FROM events"


@query(f"""SELECT file, CAST(record AS BIGINT) AS record, value FROM (SELECT 'f' || CAST(u % 3 AS VARCHAR) AS file, row_number() OVER (PARTITION BY u % 3 ORDER BY u) AS record, u % 2 = 1 AS kept,
    '(;GM[1]PB[u' || CAST(u AS VARCHAR) || ']' || chr(10) || ';B[aa](;W[bb])' || chr(10) || ')' AS value FROM ({_USERS})) WHERE kept""")
def split_concatenated(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one file per third of the users, told apart by the depth of parentheses; games of another kind go."""
    u = table(spark, sf, "events").select(F.col("user_id").alias("u")).distinct()
    head = F.concat(F.when(F.col("u") % 2 == 1, "(;GM[1]PB[u").otherwise("(;GM[3]PB[u"), F.col("u").cast("string"), F.lit("]"))
    lines = u.select(F.concat(F.lit("f"), (F.col("u") % 3).cast("string")).alias("file"), "u", F.posexplode(F.array(head, F.lit(";B[aa](;W[bb])"), F.lit(")"))).alias("k", "value"))
    return records.split_records(lines.select("file", (F.col("u") * 3 + F.col("k")).alias("line"), "value")).select("file", "record", "value")


@query(f"SELECT filename, move_number, r AS next_row, c AS next_col, stone AS next_color, CAST(move_number AS INTEGER) AS stones FROM ({_MOVES}) WHERE move_number BETWEEN 5 AND 14")
def parse_record_range(spark: SparkSession, sf: str) -> DataFrame:
    """Positions before moves 5 to 14, boards played out from the records' text."""
    p = records.positions_of(views.records(spark, sf), first=5, last=15, boards_kept=1)
    return p.select("filename", "move_number", "next_row", "next_col", "next_color", F.size(F.filter("board", lambda x: x > 0)).alias("stones"))


def _with_broken(spark: SparkSession, sf: str) -> DataFrame:
    """The records, every tenth user's cut to nothing that is a record."""
    return views.records(spark, sf).withColumn("value", F.when(F.col("user_id") % 10 == 0, "broken").otherwise(F.col("value")))


@query(f"""WITH f AS (SELECT filename, game_id, count(*) AS n FROM ({_MOVES}) GROUP BY ALL ORDER BY filename LIMIT 20), k AS (SELECT DISTINCT filename, (k * (n - 1)) // 9 AS m FROM f, range(10) t(k) WHERE game_id % 10 <> 0)
    SELECT filename, CAST(m AS INTEGER) AS move_number FROM k""")
def record_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Files written and read back: the first 20 by name, those that can't be parsed left out, ten even positions of each (the limits are the operator's)."""
    path = shared_path(spark, "records")
    records.write_records(_with_broken(spark, sf), path)
    p = records.read_records(spark, path, max_games=20, positions_per_game=10, boards_kept=0).where("error is null")
    return p.select(F.regexp_extract("filename", r"([^/]+)\.sgf$", 1).alias("filename"), "move_number")


@query(f"SELECT count(DISTINCT game_id) FILTER (game_id % 10 <> 0) AS games, count(DISTINCT game_id) FILTER (game_id % 10 = 0) AS skipped, count(*) FILTER (game_id % 10 <> 0) AS positions FROM ({_MOVES})")
def position_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A position store made of records: written as parquet, counted from what was written."""
    path = shared_path(spark, "positions")
    records.positions_of(_with_broken(spark, sf), boards_kept=0).select("filename", "move_number", "error").write.parquet(path)
    return records.counters(spark.read.parquet(path))


@query(f"SELECT filename, move_number, CAST(move_number // 2 AS INTEGER) AS own, CAST(move_number - move_number // 2 AS INTEGER) AS other, CAST(CASE WHEN move_number % 2 = 0 THEN 361 ELSE 0 END AS INTEGER) AS black_to_move FROM ({_MOVES}) ORDER BY filename, move_number LIMIT 300")
def load_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The first 300 positions in order (the limit is the operator's), encoded in 18 planes of 361 points; the table is checked first, in one aggregate, which fails if shapes or values are wrong."""
    # which positions are the first is told without their boards, so that only the records that have them are encoded
    x = views.records(spark, sf)
    first = records.positions_of(x, boards_kept=0).where("error is null").orderBy("filename", "move_number").limit(300).select("filename", "move_number")
    first = spark.createDataFrame(first.collect(), first.schema)
    p = records.positions_of(x.join(F.broadcast(first.select("filename").distinct()), "filename", "left_semi")).where("error is null")
    tables.validate_positions(p)
    p = p.join(F.broadcast(first), ["filename", "move_number"], "left_semi")
    stack = [F.col("board"), *(F.get("history", F.lit(t)) for t in range(7))]
    planes = boards.planes([boards.points(b, 1) for b in stack], [boards.points(b, 2) for b in stack], F.col("next_color"))
    total = lambda k: F.size(F.get("planes", F.lit(k)))
    return p.select("filename", "move_number", planes.alias("planes")).select("filename", "move_number", total(0).alias("own"), total(8).alias("other"), total(16).alias("black_to_move"))


@query(f"SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 128 AS batch, vec_id, round(list_sum(vec), 4) + 0.0 AS total FROM ({TRAJ_VEC_SQL})")
def batch_load(spark: SparkSession, sf: str) -> DataFrame:
    """Successive batches of 128 rows of a folder of chunks, whose row numbers tell a row's batch without a pass over the data."""
    x = views.traj_vec(spark, sf).select(F.lit("all").alias("layer"), F.col("vec_id").alias("sample_id"), "vec")
    path = shared_path(spark, "batches")
    chunks.write_chunks(x, path, 100)
    b = chunks.batches(chunks.read_chunks(spark, path), 128)
    return b.select("batch", F.col("sample_id").alias("vec_id"), F.round(v.total(F.col("vec").cast("array<double>")), 4).alias("total"))


@query(f"SELECT sample_id, (k - 1) // 50 AS chunk, (k - 1) AS row, total FROM (SELECT vec_id AS sample_id, row_number() OVER (ORDER BY vec_id) AS k, round(list_sum(vec), 4) + 0.0 AS total FROM ({TRAJ_VEC_SQL}) WHERE label % 2 = 1) WHERE k <= 150")
def activation_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Activations of two layers written in chunks of 50 rows; the first three chunks of one layer read back (a prefix is the operator): no other file is opened."""
    path = shared_path(spark, "activations")
    x = views.traj_vec(spark, sf).select(F.when(F.col("label") % 2 == 1, "odd").otherwise("even").alias("layer"), F.col("vec_id").alias("sample_id"), "vec")
    chunks.write_chunks(x, path, 50)
    back = chunks.read_chunks(spark, path, ["odd"], rows=(0, 150))
    return back.select("sample_id", F.expr("row div 50").alias("chunk"), "row", (F.round(v.total(F.col("vec").cast("array<double>")), 4) + 0.0).alias("total"))


@query(f"SELECT p.event_id AS position_id, p.user_id AS game_id, g.first, g.last, g.n FROM events p JOIN (SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM events GROUP BY user_id) g USING (user_id)")
def metadata_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and their index of games through parquet and JSON."""
    path = shared_path(spark, "metadata")
    tables.write_metadata(table(spark, sf, "events").select(F.col("event_id").alias("position_id"), F.col("user_id").alias("game_id")), path)
    positions, games = tables.read_metadata(spark, path)
    return positions.join(games, "game_id").select("position_id", "game_id", "first", "last", "n")


_BLOCKS = f"SELECT vec_id, 'block' || CAST(label % 4 AS VARCHAR) AS layer, j, vec[j] AS a FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({TRAJ_VEC_SQL}))"


@query(f"""WITH x AS ({_BLOCKS}), s AS (SELECT layer, j, avg(a) AS m, stddev_pop(a) AS d FROM x WHERE layer <> 'block3' GROUP BY layer, j)
    SELECT vec_id, layer, CASE WHEN layer = 'block3' THEN NULL ELSE round(sum((a - m) / (d + 1e-8)), 4) + 0.0 END AS z_total, round(max(m), 6) + 0.0 AS most, round(min(d), 6) + 0.0 AS least_std FROM x LEFT JOIN s USING (layer, j) GROUP BY vec_id, layer""")
def stats_beside_data(spark: SparkSession, sf: str) -> DataFrame:
    """A stored side table of all components' moments by layer, arrays of a row each, beside the rows that it normalises; a layer without any gets null."""
    x = views.traj_vec(spark, sf).select("vec_id", F.concat(F.lit("block"), (F.col("label") % 4).cast("string")).alias("layer"), "vec")
    path = shared_path(spark, "stats")
    by = x.where("layer != 'block3'").select("layer", F.posexplode("vec").alias("j", "a")).groupBy("layer", "j").agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("d"))
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("j", c))), lambda s: s[c])
    by.groupBy("layer").agg(part("m").alias("mean"), part("d").alias("std")).write.parquet(path)
    y = tables.with_stats(x, spark.read.parquet(path))
    z = F.zip_with(F.zip_with("vec", "mean", lambda a, m: a - m), "std", lambda a, d: a / (d + 1e-8))
    return y.select("vec_id", "layer", (F.round(v.total(z), 4) + 0.0).alias("z_total"), r6(F.array_max("mean")).alias("most"), r6(F.array_min("std")).alias("least_std"))


_SIZES = weights.line_sizes(blocks=1, filters=2)


_NUMBERS = f"SELECT list(m ORDER BY label, j) AS m, count(*) AS k FROM (SELECT label, j, round(avg(vec[j]), 6) AS m FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({TRAJ_VEC_SQL})) GROUP BY label, j)"


@query(f"SELECT part, count(*) AS n, round(sum(m[1 + (l * 31 + i) % k]), 6) + 0.0 AS total FROM (VALUES {', '.join(f'({k}, {chr(39)}{name}{chr(39)}, {n})' for k, (name, n) in enumerate(_SIZES))}) t(l, part, size), range(300000) r(i), ({_NUMBERS}) WHERE i < size GROUP BY part")
def weights_file(spark: SparkSession, sf: str) -> DataFrame:
    """A network's weights through a compressed text file: a version line, then a line of numbers per tensor. The numbers are the labels' mean vectors, over and over."""
    path = shared_path(spark, "weights")
    means = views.traj_vec(spark, sf).select("label", F.posexplode("vec").alias("j", "x")).groupBy("label", "j").agg(F.round(F.avg("x"), 6).alias("m"))
    m = [r["m"] for r in means.orderBy("label", "j").collect()]
    weights.write(spark, path, [[m[(k * 31 + i) % len(m)] for i in range(n)] for k, (_, n) in enumerate(_SIZES)])
    parts = weights.read(spark, path, filters=2)
    rows = [(name, int(x.size), float(round(x.sum(), 6)) + 0.0) for name, x in parts.items()]
    return spark.createDataFrame(rows, "part string, n long, total double")
