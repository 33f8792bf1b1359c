"""Moments, checks, set operations, splits and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import vectors as v
from wayline.functions.vectors import r6
from wayline.operators import moments, ranks
from wayline.plans import views
from wayline.plans.registry import query
from wayline.plans.views import TRAJ_VEC_SQL, table, traj_state_sql

_LONG = f"SELECT game_id, move_number, j - 1 AS j, vec[j] AS v FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS j FROM ({TRAJ_VEC_SQL}))"


@query(f"SELECT CAST(j AS INTEGER) AS j, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(coalesce(stddev_samp(v), 0), 6) + 0.0 AS std FROM ({_LONG}) GROUP BY j")
def feature_stats_sample(spark: SparkSession, sf: str) -> DataFrame:
    return moments.feature_stats(views.traj_vec(spark, sf)).select("j", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(f"SELECT CAST(j AS INTEGER) AS j, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(sqrt(CASE WHEN count(*) < 2 THEN 0 ELSE var_pop(v) END + 1e-8), 6) + 0.0 AS std FROM ({_LONG}) GROUP BY j")
def feature_stats_pop(spark: SparkSession, sf: str) -> DataFrame:
    return moments.feature_stats(views.traj_vec(spark, sf), ddof=0, eps=1e-8).select("j", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


_S = f"SELECT j, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, var_pop(v) AS vp FROM ({_LONG}) GROUP BY j"


@query(f"SELECT game_id, move_number, CAST(j AS INTEGER) AS j, round((v - mean) / (sd + 1e-8), 6) + 0.0 AS z FROM ({_LONG}) JOIN ({_S}) USING (j)")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_vec(spark, sf)
    return moments.zscore(x, moments.feature_stats(x), "vec", 1e-8, False, "game_id", "move_number").withColumn("z", r6(F.col("z")))


@query(f"SELECT game_id, move_number, CAST(j AS INTEGER) AS j, round((v - mean) / sqrt(vp + 1e-8), 6) + 0.0 AS z FROM ({_LONG}) JOIN ({_S}) USING (j)")
def zscore_population(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_vec(spark, sf)
    return moments.zscore(x, moments.feature_stats(x, ddof=0), "vec", 1e-8, True, "game_id", "move_number").withColumn("z", r6(F.col("z")))


@query("SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS least, max(n) AS most, count(*) AS games FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def positions_per_game(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("games"))


@query(f"""WITH x AS (SELECT *, len(vec) AS d, move_number - lag(move_number) OVER (PARTITION BY game_id ORDER BY move_number) AS step FROM ({TRAJ_VEC_SQL})),
    c AS (SELECT 'width' AS check_name, count(*) FILTER (d IS DISTINCT FROM 64) AS n_bad FROM x UNION ALL
          SELECT 'finite', count(*) FILTER (NOT coalesce(len(list_filter(vec, lambda z: z IS NULL OR NOT isfinite(z))) = 0, false)) FROM x UNION ALL
          SELECT 'label_range', count(*) FILTER (NOT coalesce(label BETWEEN 0 AND 9, false)) FROM x UNION ALL
          SELECT 'sequential_moves', count(*) FILTER (coalesce(step, 1) <> 1) FROM x UNION ALL
          SELECT 'ids_from_zero', count(*) FILTER (NOT coalesce(vec_id >= 0, false)) FROM x UNION ALL
          SELECT 'not_empty', count(*) FILTER (NOT coalesce(len(list_filter(vec, lambda z: z <> 0)) > 0, false)) FROM x)
    SELECT check_name, n_bad = 0 AS passed, n_bad FROM c""")
def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("move_number") - F.lag("move_number").over(Window.partitionBy("game_id").orderBy("move_number"))
    x = views.traj_vec(spark, sf).withColumn("step", F.coalesce(step, F.lit(1)))
    return moments.checks(x, {
        "width": F.size("vec") == 64,
        "finite": F.forall("vec", lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))),
        "label_range": F.col("label").between(0, 9),
        "sequential_moves": F.col("step") == 1,
        "ids_from_zero": F.col("vec_id") >= 0,
        "not_empty": F.exists("vec", lambda z: z != 0),
    })


@query("""SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_games, count(*) FILTER (ts IS NULL OR user_id IS NULL OR event_type IS NULL) AS n_null,
    count(*) - count(DISTINCT event_id) AS n_repeated FROM events""")
def position_validation(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_games"), F.count_if(F.col("ts").isNull() | F.col("user_id").isNull() | F.col("event_type").isNull()).alias("n_null"), (F.count("*") - F.count_distinct("event_id")).alias("n_repeated"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 500")
def load_first_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is the operator: the first rows in id order."""
    return table(spark, sf, "events").select("event_id", "user_id", "event_type").orderBy("event_id").limit(500)


@query("SELECT event_id, CASE WHEN rn > n - n // 10 THEN 'val' ELSE 'train' END AS part FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events)")
def split_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last tenth in id order is for validation, by ranks in buckets of the order."""
    e = table(spark, sf, "events").select("event_id")
    n = e.count()
    ranked = ranks.running(e, "event_id", F.lit(1), "before")
    return ranked.select("event_id", F.when(F.coalesce("before", F.lit(0)) >= n - n // 10, "val").otherwise("train").alias("part"))


_BUCKET = "CAST('0x' || substr(md5(CAST({} AS VARCHAR) || '{}'), 1, 7) AS BIGINT) % 100"


def bucket(col: str, seed: str, n: int = 100):
    """0 .. n - 1 from an md5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.col(col).cast("string"), F.lit(seed))), 1, 7), 16, 10).cast("long") % n


@query(f"SELECT event_id, CASE WHEN {_BUCKET.format('event_id', 's1')} < 10 THEN 'val' ELSE 'train' END AS part FROM events")
def split_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.when(bucket("event_id", "s1") < 10, "val").otherwise("train").alias("part"))


@query(f"SELECT event_id, user_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS part FROM (SELECT event_id, user_id, {_BUCKET.format('user_id', 'g')} AS b FROM events)")
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of a game on one side, so that no game leaks."""
    b = bucket("user_id", "g")
    return table(spark, sf, "events").select("event_id", "user_id", F.when(b < 70, "train").when(b < 85, "val").otherwise("test").alias("part"))


@query(f"SELECT event_id, user_id FROM events WHERE {_BUCKET.format('user_id', 'o5')} < 20")
def game_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Whole games: the sample is by game."""
    return table(spark, sf, "events").where(bucket("user_id", "o5") < 20).select("event_id", "user_id")


@query("SELECT event_id, md5(CAST(event_id AS VARCHAR) || 'o4') AS k FROM events ORDER BY k, event_id LIMIT 200")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample is the operator: 200 rows of smallest keyed hash, by top-k per partition."""
    return table(spark, sf, "events").select("event_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit("o4"))).alias("k")).orderBy("k", "event_id").limit(200)


@query(f"SELECT game_id, move_number FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY md5(CAST(game_id AS VARCHAR) || '-' || CAST(move_number AS VARCHAR)), move_number) AS rk FROM ({traj_state_sql()}) WHERE move_number BETWEEN 10 AND 39) WHERE rk <= 5")
def random_moves(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_state(spark, sf).where("move_number between 10 and 39")
    key = F.md5(F.concat_ws("-", F.col("game_id").cast("string"), F.col("move_number").cast("string")))
    return x.withColumn("rk", F.row_number().over(Window.partitionBy("game_id").orderBy(key, "move_number"))).where("rk <= 5").select("game_id", "move_number")


@query("SELECT user_id, CAST(list(event_type ORDER BY ts, event_id)[1:10] AS VARCHAR[]) AS moves FROM events GROUP BY user_id")
def move_prefix(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.slice(rows, 1, 10), lambda x: x["event_type"]).alias("moves"))


# ---------------------------------------------------------------- set operations


@query(f"SELECT state, count(*) AS n, dense_rank() OVER (ORDER BY state) - 1 AS compact FROM ({traj_state_sql(True)}) WHERE state >= 0 GROUP BY state")
def compact_states(spark: SparkSession, sf: str) -> DataFrame:
    """The window is over the distinct states, not over rows."""
    n = views.traj_state(spark, sf, True).where("state >= 0").groupBy("state").agg(F.count("*").alias("n"))
    return n.select("state", "n", (F.dense_rank().over(Window.orderBy("state")) - 1).cast("long").alias("compact"))


_ENDS = f"SELECT state, CAST(sum(CAST(phase < 0.2 AS INTEGER)) AS BIGINT) AS source_count, CAST(sum(CAST(phase >= 0.8 AS INTEGER)) AS BIGINT) AS target_count FROM (SELECT state, move_number / count(*) OVER (PARTITION BY game_id) AS phase FROM ({traj_state_sql(True)})) WHERE state >= 0 GROUP BY state"


@query(f"SELECT state, source_count, target_count, CASE WHEN source_count > target_count THEN 'source' ELSE 'target' END AS side FROM ({_ENDS}) WHERE source_count > 0 OR target_count > 0")
def source_target_states(spark: SparkSession, sf: str) -> DataFrame:
    phase = F.col("move_number") / F.count("*").over(Window.partitionBy("game_id"))
    x = views.traj_state(spark, sf, True).withColumn("phase", phase).where("state >= 0")
    g = x.groupBy("state").agg(F.sum((F.col("phase") < 0.2).cast("int")).alias("source_count"), F.sum((F.col("phase") >= 0.8).cast("int")).alias("target_count"))
    return g.where("source_count > 0 or target_count > 0").withColumn("side", F.when(F.col("source_count") > F.col("target_count"), "source").otherwise("target"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT user_id AS id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def intersect_games(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.where("event_type = 'purchase'").select(F.col("user_id").alias("id")).intersect(e.where("event_type = 'error'").select("user_id"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT origin, count(*) AS n, CAST(sum(key) AS BIGINT) AS total FROM (SELECT 'customer' AS origin, c_custkey AS key FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY origin")
def union_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"))
    return c.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("key"))).groupBy("origin").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


# ---------------------------------------------------------------- scalar functions

_HIST = "SELECT user_id, list(coalesce(n, 0) ORDER BY t) AS h FROM (SELECT u.user_id, t.t, c.n FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(['click','error','purchase','signup','view']) AS t) t LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) c ON c.user_id = u.user_id AND c.event_type = t.t) GROUP BY user_id"


def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in views.EVENT_TYPES))
    return g.select("user_id", F.array(*(F.col(t).cast("double") for t in views.EVENT_TYPES)).alias("h"))


@query(f"""WITH h AS ({_HIST}), g AS (SELECT list(n / t ORDER BY event_type) AS q FROM (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS t FROM events GROUP BY event_type))
    SELECT user_id, round(list_sum(list_transform(range(1, 6), lambda i: (h[i] / list_sum(h) + 1e-10) * (ln(h[i] / list_sum(h) + 1e-10) - ln(q[i] + 1e-10)))), 6) + 0.0 AS kl FROM h, g""")
def kl_divergence(spark: SparkSession, sf: str) -> DataFrame:
    h = _histogram(spark, sf)
    p = h.select("user_id", F.transform("h", lambda x: x / v.total(F.col("h"))).alias("p"))
    e = table(spark, sf, "events")
    q = e.agg(F.array(*(F.count_if(F.col("event_type") == t) / F.count("*") for t in views.EVENT_TYPES)).alias("q"))
    return p.crossJoin(F.broadcast(q)).select("user_id", r6(v.kl_divergence(F.col("p"), F.col("q"))).alias("kl"))


@query(f"SELECT user_id, round(CASE WHEN list_sum(h) < 1e-10 THEN 0 ELSE 5 * list_sum(list_transform(h, lambda x: x * x)) / (list_sum(h) * list_sum(h) + 1e-10) END, 6) + 0.0 AS sparsity FROM ({_HIST})")
def effect_sparsity(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(spark, sf).select("user_id", r6(v.effect_sparsity(F.col("h"))).alias("sparsity"))


@query(f"SELECT user_id, round(-list_sum(list_transform(h, lambda x: (x + 1e-10) / (list_sum(h) + 5e-10) * ln((x + 1e-10) / (list_sum(h) + 5e-10)))), 6) + 0.0 AS entropy FROM ({_HIST})")
def membership_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(spark, sf).select("user_id", r6(v.membership_entropy(F.col("h"))).alias("entropy"))


@query("""SELECT event_id, round(greatest(value - 50, 0), 6) + 0.0 AS relu, round(1 / (1 + exp(-(value - 50) / 25)), 6) + 0.0 AS sigmoid, round(tanh((value - 50) / 25), 6) + 0.0 AS tanh FROM events""")
def activations(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("value") - 50
    return table(spark, sf, "events").select("event_id", r6(v.relu(x)).alias("relu"), r6(v.sigmoid(x / 25)).alias("sigmoid"), r6(F.tanh(x / 25)).alias("tanh"))


@query(f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.vec AS x, b.vec AS y FROM ({TRAJ_VEC_SQL}) a JOIN ({TRAJ_VEC_SQL}) b ON b.vec_id = a.vec_id + 1)
    SELECT a, b, round(1 - list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) + 0.0 AS cosine, round(list_distance(x, y), 6) + 0.0 AS euclid FROM p""")
def cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_vec(spark, sf).select("vec_id", "vec")
    p = x.alias("a").join(x.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return p.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), r6(v.cosine_distance(F.col("a.vec"), F.col("b.vec"))).alias("cosine"), r6(F.sqrt(v.squared_distance(F.col("a.vec"), F.col("b.vec")))).alias("euclid"))


@query("SELECT doc_id, 'k' || CAST(16 * (doc_id % 4 + 1) AS VARCHAR) || '_in_k' || CAST(32 * (doc_id % 4 + 1) AS VARCHAR) AS key, lang || '_k' || CAST(n_chars AS VARCHAR) AS method FROM documents")
def string_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4 + 1
    return table(spark, sf, "documents").select("doc_id", F.format_string("k%d_in_k%d", 16 * k, 32 * k).alias("key"), F.concat_ws("_k", "lang", F.col("n_chars").cast("string")).alias("method"))


@query("SELECT event_id, CAST(event_id // 361 AS BIGINT) AS board, CAST((event_id % 361) // 19 AS BIGINT) AS r, CAST(event_id % 19 AS BIGINT) AS c0, CAST((event_id % 361) % 19 AS BIGINT) AS c FROM events")
def index_coords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.expr("event_id div 361").alias("board"), F.expr("pmod(event_id, 361) div 19").alias("r"), F.expr("pmod(event_id, 19)").alias("c0"), F.expr("pmod(pmod(event_id, 361), 19)").alias("c"))


@query("SELECT event_type, CAST(props->>'$.k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]')) AS BIGINT) AS n_moves, coalesce(regexp_extract_all(text, '[A-Z][a-z]')[1:5], []) AS first_moves FROM documents WHERE len(regexp_extract_all(text, '[A-Z][a-z]')) >= 50")
def regex_moves(spark: SparkSession, sf: str) -> DataFrame:
    m = F.regexp_extract_all("text", F.lit("[A-Z][a-z]"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", m.alias("m")).where(F.size("m") >= 50).select("doc_id", F.size("m").cast("long").alias("n_moves"), F.slice("m", 1, 5).alias("first_moves"))


@query(f"SELECT vec_id, CAST(list_position(vec, list_max(vec)) - 1 AS INTEGER) AS argmax, round(list_max(vec), 6) + 0.0 AS top, round(list_sum(vec[1:8]), 6) + 0.0 AS head FROM ({TRAJ_VEC_SQL})")
def array_ops(spark: SparkSession, sf: str) -> DataFrame:
    return views.traj_vec(spark, sf).select("vec_id", (F.array_position("vec", F.array_max("vec")) - 1).cast("int").alias("argmax"), r6(F.array_max("vec")).alias("top"), r6(v.total(F.slice("vec", 1, 8))).alias("head"))


@query("""WITH b AS (SELECT n, floor(log10(n + 1) * 4) / 4 AS bin FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1))
    SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id").count()
    return n.select((F.floor(F.log10(F.col("count") + 1) * 4) / 4).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
