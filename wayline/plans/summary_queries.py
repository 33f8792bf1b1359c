"""Summaries over methods, controls, landmarks, cross-validation, and round trips through sinks."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import vectors as v
from wayline.functions.vectors import r6
from wayline.operators import codes, inference, kinetics, ranks, transitions
from wayline.plans import code_queries, views
from wayline.plans.code_queries import LEVELS
from wayline.plans.registry import query
from wayline.plans.stats_queries import bucket
from wayline.plans.views import TRAJ_VEC_SQL, table, traj_state_sql
from wayline.sources import records, tables

_ALLV = f"SELECT vec_id, label, j, vec[j + 1] AS v FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL}))"
_CUT = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, sum(CASE WHEN rk > {k} THEN v * v ELSE 0 END) AS most, sum(CASE WHEN j >= {k} THEN v * v ELSE 0 END) AS lead_k, count(*) AS n, var_pop(v) AS var FROM r" for k in LEVELS)


@query(f"""WITH r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, j) AS rk FROM ({_ALLV})), c AS (SELECT k, 1 - most / n / (var + 1e-8) AS s, 1 - lead_k / n / (var + 1e-8) AS p FROM ({_CUT}))
    SELECT round(avg(s - p), 6) AS mean_gain, round(max(s - p), 6) AS best_gain, arg_max(k, s) AS best_k, bool_and(s > p) AS wins_all, count(*) FILTER (s > p) AS wins FROM c""")
def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """R2 by k of keeping a vector's k largest components against its k leading ones: gains, the best k, and whether one wins throughout. One pass for all k, ranks in the row."""
    x = views.traj_vec(spark, sf).select("vec", F.transform(v.topk(F.transform("vec", lambda a: F.abs(a)), 64), lambda s: s["feature"]).alias("order"))
    square = lambda a: v.total(F.transform(a, lambda b: b * b))
    left = [(square("vec") - square(F.transform(F.slice("order", 1, k), lambda i: F.get("vec", i))), square(F.slice("vec", k + 1, 64))) for k in LEVELS]
    s = x.select("vec", *(c.alias(f"{n}{k}") for k, pair in zip(LEVELS, left, strict=True) for n, c in zip("sp", pair, strict=True)))
    moments = s.agg(F.sum(F.size("vec")).alias("n"), F.sum(v.total(F.col("vec"))).alias("t"), F.sum(square("vec")).alias("q"), *(F.sum(f"{n}{k}").alias(f"{n}{k}") for k in LEVELS for n in "sp"))
    var = F.col("q") / F.col("n") - F.pow(F.col("t") / F.col("n"), 2)
    r2 = lambda c: 1 - F.col(c) / F.col("n") / (var + 1e-8)
    c = moments.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), r2(f"s{k}").alias("s"), r2(f"p{k}").alias("p")) for k in LEVELS))).alias("c")).select("c.*").withColumn("d", F.col("s") - F.col("p"))
    return c.agg(F.round(F.avg("d"), 6).alias("mean_gain"), F.round(F.max("d"), 6).alias("best_gain"), F.max_by("k", "s").alias("best_k"), F.bool_and(F.col("d") > 0).alias("wins_all"), F.count_if(F.col("d") > 0).alias("wins"))


def _auc_sql(pos: str, keys: str, source: str) -> str:
    """AUC by keys of rows (keys, v) with the condition pos; 0.5 where a class is missing."""
    return f"""SELECT {keys}, CASE WHEN p = 0 OR p = n THEN 0.5 ELSE (sum(CASE WHEN pos THEN ar ELSE 0 END) - p * (p + 1) / 2) / (p * (n - p)) END AS auc FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY v) + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2 AS ar,
        count(*) OVER (PARTITION BY {keys}) AS n, sum(CAST(pos AS INTEGER)) OVER (PARTITION BY {keys}) AS p FROM (SELECT *, {pos} AS pos FROM ({source}))) GROUP BY {keys}, n, p"""


@query(f"WITH a AS ({_auc_sql('label < 5', 'j', _ALLV)}) SELECT 'm' || CAST(j % 4 AS VARCHAR) AS method, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) + 0.0 AS std, count(*) AS n, abs(avg(auc) - 0.5) <= 0.05 AS passed FROM a GROUP BY j % 4")
def control_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of the AUC by method (here a quarter of the components each), and whether the mean is near one half."""
    x = views.traj_vec(spark, sf).select((F.col("label") < 5).cast("int").alias("label"), F.posexplode("vec").alias("j", "score"))
    a = inference.auc(x, ["j"]).withColumn("method", F.concat(F.lit("m"), (F.col("j") % 4).cast("string")))
    return a.groupBy("method").agg(F.round(F.avg("auc"), 6).alias("mean"), r6(F.stddev_pop("auc")).alias("std"), F.count("*").alias("n"), (F.abs(F.avg("auc") - 0.5) <= 0.05).alias("passed"))


@query("""WITH u AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY user_id)
    SELECT a.user_id, CAST(len(list_intersect(a.t, b.t)) AS BIGINT) AS shared, len(list_intersect(a.t, b.t)) > 0 AS overlaps FROM u a JOIN u b ON b.user_id = a.user_id + 1""")
def array_overlap(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    x = u.alias("a").join(u.alias("b"), F.col("b.user_id") == F.col("a.user_id") + 1)
    return x.select("a.user_id", F.size(F.array_intersect("a.t", "b.t")).cast("long").alias("shared"), F.arrays_overlap("a.t", "b.t").alias("overlaps"))


_CONCEPT = {"low": "label < 5", "even": "label % 2 = 0", "absent": "label > 100"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS concept, 'b' || CAST(j // 16 AS VARCHAR) AS layer, round(max(auc), 6) + 0.0 AS auc FROM ({_auc_sql(e, 'j', _ALLV)}) GROUP BY j // 16 UNION ALL SELECT '{c}', 'b9', 0.5" for c, e in _CONCEPT.items()))
def auc_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The best AUC of a layer's components (16 each) by concept, as a matrix with 0.5 where nothing was measured (layer b9), read back as rows."""
    concepts = F.array(*(F.struct(F.lit(c).alias("concept"), F.expr(e).cast("int").alias("label")) for c, e in _CONCEPT.items()))
    x = views.traj_vec(spark, sf).select(concepts.alias("c"), F.posexplode("vec").alias("j", "score")).select(F.explode("c").alias("c"), "j", "score")
    a = inference.auc(x.select("c.concept", "c.label", "j", "score"), ["concept", "j"]).withColumn("layer", F.concat(F.lit("b"), F.expr("j div 16").cast("string")))
    layers = ["b0", "b1", "b2", "b3", "b9"]
    p = a.groupBy("concept").pivot("layer", layers).agg(F.max("auc")).fillna(0.5)
    return p.unpivot("concept", layers, "layer", "auc").withColumn("auc", r6(F.col("auc")))


@query(f"SELECT CAST(floor(x / 10) AS INTEGER) AS bin, count(*) AS n FROM ({traj_state_sql()}) GROUP BY bin")
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return views.traj_state(spark, sf).groupBy(F.floor(F.col("x") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || 'l'), vec_id) AS h, count(*) OVER () AS n FROM embeddings)
    SELECT 'uniform' AS strategy, vec_id FROM x WHERE h <= 40 UNION ALL SELECT DISTINCT 'temporal', vec_id FROM x JOIN range(40) t(k) ON x.i = CASE WHEN n <= 40 THEN k ELSE (k * (n - 1)) // 39 END""")
def landmark_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Forty landmarks (the number is the operator's): by hash, and evenly spaced in order."""
    x = table(spark, sf, "embeddings").select("vec_id")
    uniform = x.orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("l"))), "vec_id").limit(40)
    n = x.count()
    wanted = sorted({k * (n - 1) // 39 if n > 40 else k for k in range(min(40, n))})
    at = F.coalesce("before", F.lit(0))
    even = ranks.running(x, "vec_id", F.lit(1), "before").where(at.isin(wanted)).select("vec_id")
    return uniform.select(F.lit("uniform").alias("strategy"), "vec_id").unionByName(even.select(F.lit("temporal").alias("strategy"), "vec_id"))


@query()
def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """k-means centres' nearest rows, each once: the fixed few centres are broadcast."""
    x = views.traj_vec(spark, sf).select("vec_id", "vec", array_to_vector("vec").alias("features"))
    centres = KMeans(k=12, seed=3, maxIter=10).fit(x).clusterCenters()
    c = spark.createDataFrame([(i, [float(a) for a in m]) for i, m in enumerate(centres)], "c int, m array<double>")
    d = x.crossJoin(F.broadcast(c)).select("vec_id", "c", v.squared_distance(F.col("vec"), F.col("m")).alias("d2"))
    return d.groupBy("c").agg(F.min(F.struct("d2", "vec_id")).alias("b")).select("b.vec_id").distinct()


_FOLD = "CAST('0x' || substr(md5(CAST(game_id AS VARCHAR) || 'cv'), 1, 7) AS BIGINT) % 5"


@query(f"""WITH n AS (SELECT {_FOLD} AS fold, i, j, count(*) AS n FROM (SELECT game_id, state AS i, lead(state) OVER (PARTITION BY game_id ORDER BY move_number) AS j FROM ({traj_state_sql(True)})) WHERE j IS NOT NULL GROUP BY ALL)
    SELECT CAST(fold AS INTEGER) AS fold, round(sum(n * n / (r * c)) - 1, 6) + 0.0 AS vamp2 FROM (SELECT *, sum(n) OVER (PARTITION BY fold, i) AS r, sum(n) OVER (PARTITION BY fold, j) AS c FROM n) GROUP BY fold""")
def cross_validated_vamp(spark: SparkSession, sf: str) -> DataFrame:
    """VAMP-2 of states on held-out games, by fold; folds are whole games, so that lagged pairs stay whole."""
    x = views.traj_state(spark, sf, True).withColumn("fold", (bucket("game_id", "cv", 5)).cast("int"))
    n = transitions.lagged_pairs(x, 1, "fold").groupBy("fold", "i", "j").agg(F.count("*").alias("n"))
    r, c = n.groupBy("fold", "i").agg(F.sum("n").alias("r")), n.groupBy("fold", "j").agg(F.sum("n").alias("c"))
    y = n.join(r, ["fold", "i"]).join(c, ["fold", "j"])
    return y.groupBy("fold").agg(r6(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("r").cast("double") * F.col("c"))) - 1).alias("vamp2"))


@query()
def column_shuffle_control(spark: SparkSession, sf: str) -> DataFrame:
    """AUC after each row's components have been dealt anew in the row: no feature may keep its meaning."""
    dealt = F.transform(F.array_sort(F.transform("vec", lambda x, i: F.struct(F.xxhash64(F.col("vec_id"), i).alias("h"), x.alias("x")))), lambda s: s["x"])
    x = views.traj_vec(spark, sf).select((F.col("label") < 5).cast("int").alias("label"), F.posexplode(dealt).alias("feature", "score"))
    a = inference.auc(x, ["feature"])
    return a.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.count("*").alias("n"))


@query("SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || 'r'), event_id LIMIT 100")
def reservoir_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of 100 rows in one pass, by the smallest keyed hashes; the size is the operator's parameter."""
    return table(spark, sf, "events").select("event_id").orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("r"))), "event_id").limit(100)


_UP = " AND ".join(f"c_{a} <= c_{b}" for a, b in code_queries._NEXT)


@query(f"""WITH r AS MATERIALIZED ({code_queries._R}), n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT feature, {', '.join(f'count(*) FILTER (rk <= {k}) AS c_{k}' for k in LEVELS)} FROM r GROUP BY feature),
    u AS (SELECT {', '.join(f'count(*) FILTER (c_{k} > 0) AS used_{k}, round(max(c_{k}) / any_value(n), 6) AS top_{k}' for k in LEVELS)}, round(count(*) FILTER ({_UP} AND c_{LEVELS[-1]} > 0) / greatest(count(*) FILTER (c_{LEVELS[-1]} > 0), 1), 6) AS stable FROM m, n),
    x AS (SELECT vec_id, j, {code_queries._RAW} FROM r JOIN ({code_queries._WT}) USING (feature) WHERE rk <= {LEVELS[-1]} GROUP BY vec_id, j),
    e AS (SELECT {', '.join(f'1 - avg((v - x_{k} / 64) ** 2) / (var_pop(v) + 1e-8) AS r_{k}' for k in LEVELS)} FROM (SELECT vec_id, j, vec[j + 1] AS v FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL}))) y JOIN x USING (vec_id, j))
    SELECT u.*, {', '.join(f'round(r_{k}, 5) AS r2_{k}' for k in LEVELS)}, round(r_{LEVELS[-1]} - r_{LEVELS[0]}, 5) + 0.0 AS gap FROM u, e""")
def hierarchy_report(spark: SparkSession, sf: str) -> DataFrame:
    """By level: features used, how often the most frequent one is, R2 of the reconstruction; the share of features whose use only grows, and the gap of R2 between the last and the first level. One ranked pass for all levels of each."""
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    ranked = codes.ranked(code_queries.encoded(spark, sf))
    m = codes.membership(ranked, LEVELS).crossJoin(F.broadcast(n))
    last = F.col(f"c_{LEVELS[-1]}") > 0
    used = m.agg(*(c for k in LEVELS for c in (F.count_if(F.col(f"c_{k}") > 0).alias(f"used_{k}"), F.round(F.max(F.col(f"c_{k}") / F.col("n")), 6).alias(f"top_{k}"))), F.round(F.count_if(F.expr(_UP.lower()) & last) / F.greatest(F.count_if(last), F.lit(1)), 6).alias("stable"))
    x = codes.decode(codes.ranked(code_queries.encoded(spark, sf), k=LEVELS[-1]), code_queries.weight_table(spark), levels=LEVELS)
    e = views.traj_vec(spark, sf).select("vec_id", F.posexplode("vec").alias("j", "v")).join(x, ["vec_id", "j"])
    r2 = e.agg(*((1 - F.avg(F.pow(F.col("v") - F.col(f"x_{k}") / 64, 2)) / (F.var_pop("v") + 1e-8)).alias(f"r_{k}") for k in LEVELS))
    return used.crossJoin(F.broadcast(r2)).select(*used.columns, *(F.round(f"r_{k}", 5).alias(f"r2_{k}") for k in LEVELS), (F.round(F.col(f"r_{LEVELS[-1]}") - F.col(f"r_{LEVELS[0]}"), 5) + 0.0).alias("gap"))


@query(f"SELECT vec_id, label, round(list_sum(vec), 6) + 0.0 AS total FROM ({TRAJ_VEC_SQL})")
def result_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows through the parquet sink and back, in a folder of its own."""
    path = views.shared_path(spark, "results")
    tables.write_results(views.traj_vec(spark, sf).select("vec_id", "label", "vec"), path)
    back = tables.read_results(spark, path, "vec_id long, label int, vec array<double>")
    return back.select("vec_id", "label", r6(v.total(F.col("vec"))).alias("total"))


@query("SELECT 'game-' || CAST(user_id AS VARCHAR) AS filename, count(*) AS n_positions, 'B+R' AS result, count(*) FILTER (k = 2) AS passes FROM (SELECT DISTINCT user_id FROM events), range(3) r(k) GROUP BY user_id")
def parse_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records made of user ids, parsed to positions: two stones and a pass each."""
    # ids are few bytes, and records much work: a fixed number of parts isn't put together by bytes
    u = table(spark, sf, "events").select("user_id").distinct().repartition(4 * spark.sparkContext.defaultParallelism, "user_id")
    one = lambda x, m: F.chr(F.lit(97) + x % m)
    value = F.concat(F.lit("(;GM[1]SZ[19]KM[6.5]PB[a]RE[B+R];B["), one(F.col("user_id"), 19), one(F.col("user_id"), 7), F.lit("];W["), one(F.col("user_id") + 5, 19), F.lit("q];B[])"))
    p = records.positions_of(u.select(F.concat(F.lit("game-"), F.col("user_id").cast("string")).alias("filename"), value.alias("value")), boards_kept=0)
    return p.groupBy("filename").agg(F.count("*").alias("n_positions"), F.max("result").alias("result"), F.count_if(F.col("next_row").isNull()).alias("passes"))


@query()
def cluster_model_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Spectrum of a model of k-means states with its gap, and whether it counts as valid."""
    x = views.traj_vec(spark, sf).select("game_id", "move_number", array_to_vector("vec").alias("features"))
    y = KMeans(k=6, seed=2, maxIter=10).fit(x).transform(x).select("game_id", "move_number", F.col("prediction").alias("state"), vector_to_array("features").alias("vec"))
    _, c = kinetics.dense(transitions.transition_counts(y))
    lam = kinetics.eigenvalues(kinetics.row_normalise(c))
    gap, ok = kinetics.spectrum_check(np.array(lam))
    return spark.createDataFrame([(i, float(a), gap, ok) for i, a in enumerate(lam)], "rank int, eigenvalue double, gap double, valid boolean")
