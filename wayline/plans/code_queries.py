"""Queries on sparse codes, clusters and geometry of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import vectors as v
from wayline.functions.vectors import r6
from wayline.operators import causal, codes, neighbours, ranks
from wayline.plans import views
from wayline.plans.registry import query
from wayline.plans.views import TRAJ_VEC_SQL, table

FEATURES, INPUTS, LEVELS = 96, 64, (4, 8, 16, 32)
_W = "CAST(({f} * 31 + {j} * 17 + {f} * {j} * 7) % 101 - 50 AS DOUBLE) / 101"


def weights() -> np.ndarray:
    """Deterministic weights that any engine can state."""
    f, j = np.meshgrid(np.arange(FEATURES), np.arange(INPUTS), indexing="ij")
    return ((f * 31 + j * 17 + f * j * 7) % 101 - 50) / 101.0


def weight_table(spark: SparkSession) -> DataFrame:
    f, j = F.expr(f"id div {INPUTS}"), F.col("id") % INPUTS
    return spark.range(FEATURES * INPUTS).select(f.cast("int").alias("feature"), j.cast("int").alias("j"), (((f * 31 + j * 17 + f * j * 7) % 101 - 50) / 101.0).alias("w"))


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    return codes.encode(views.traj_vec(spark, sf), weights(), np.zeros(INPUTS))


_WT = f"SELECT CAST(f AS INTEGER) AS feature, CAST(j AS INTEGER) AS j, {_W.format(f='f', j='j')} AS w FROM range({FEATURES}) a(f), range({INPUTS}) b(j)"
_Z = f"SELECT vec_id, feature, greatest(sum(vec[j + 1] * w), 0) AS value FROM ({TRAJ_VEC_SQL}), ({_WT}) GROUP BY vec_id, feature"
_R = f"SELECT vec_id, feature, value, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, feature) AS rk FROM ({_Z})"


@query(f"SELECT vec_id, round(sum(value), 5) AS total, count(*) FILTER (value > 0) AS active FROM ({_Z}) GROUP BY vec_id")
def sae_encode(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf).select("vec_id", F.round(v.total(F.col("z")), 5).alias("total"), F.size(F.filter("z", lambda x: x > 0)).cast("long").alias("active"))


@query(f"SELECT vec_id, feature, CAST(rk AS INTEGER) AS rk, round(value, 6) + 0.0 AS value FROM ({_R}) WHERE rk <= 16")
def topk_per_row(spark: SparkSession, sf: str) -> DataFrame:
    return codes.ranked(encoded(spark, sf), k=16).select("vec_id", "feature", "rk", r6(F.col("value")).alias("value"))


@query(f"SELECT vec_id, j, round(sum(value * w), 5) + 0.0 AS x FROM ({_R}) JOIN ({_WT}) USING (feature) WHERE rk <= 16 GROUP BY vec_id, j")
def sae_decode(spark: SparkSession, sf: str) -> DataFrame:
    return codes.decode(codes.ranked(encoded(spark, sf), k=16), weight_table(spark)).select("vec_id", "j", (F.round("x", 5) + 0.0).alias("x"))


_SUMS = ", ".join(f"round(sum(CASE WHEN rk <= {k} THEN value * w ELSE 0 END), 5) + 0.0 AS x_{k}" for k in LEVELS)


@query(f"SELECT vec_id, j, {_SUMS} FROM ({_R}) JOIN ({_WT}) USING (feature) WHERE rk <= 32 GROUP BY vec_id, j")
def hierarchical_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    x = codes.decode(codes.ranked(encoded(spark, sf), k=32), weight_table(spark), levels=LEVELS)
    return x.select("vec_id", "j", *((F.round(f"x_{k}", 5) + 0.0).alias(f"x_{k}") for k in LEVELS))


#: Decoder rows of the data: each label's mean around the mean of all, by component.
_MEANS = f"SELECT feature, j, m - avg(m) OVER (PARTITION BY j) AS w FROM (SELECT label AS feature, CAST(j - 1 AS INTEGER) AS j, avg(vec[j]) AS m FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({TRAJ_VEC_SQL})) GROUP BY label, j)"


def mean_decoder(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, j, w), labels x components rows."""
    x = views.traj_vec(spark, sf).select(F.col("label").alias("feature"), F.posexplode("vec").alias("j", "x")).groupBy("feature", "j").agg(F.avg("x").alias("m"))
    return x.select("feature", "j", (F.col("m") - F.avg("m").over(Window.partitionBy("j"))).alias("w"))


@query(f"SELECT feature, j, round(w / sqrt(sum(w * w) OVER (PARTITION BY feature)), 6) + 0.0 AS w FROM ({_MEANS})")
def decoder_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """A decoder made of the labels' means, its rows scaled to length one."""
    return mean_decoder(spark, sf).select("feature", "j", r6(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("feature")))).alias("w"))


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), a AS (SELECT feature, count(*) FILTER (value > 0) AS live FROM ({_R}) WHERE rk <= 16 GROUP BY feature)
    SELECT CAST(f AS INTEGER) AS feature, coalesce(live, 0) AS live, round(coalesce(live, 0) / n, 6) + 0.0 AS rate, coalesce(live, 0) = 0 AS dead, coalesce(live, 0) / n > 0.001 AND coalesce(live, 0) / n < 0.05 AS interpretable
    FROM range({FEATURES}) d(f) LEFT JOIN a ON a.feature = f, n""")
def feature_liveness(spark: SparkSession, sf: str) -> DataFrame:
    domain = spark.range(FEATURES).select(F.col("id").cast("int").alias("feature"))
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    a = codes.liveness(codes.ranked(encoded(spark, sf), k=16), F.lit(1), domain).crossJoin(F.broadcast(n))
    rate = F.col("live") / F.col("n")
    return a.select("feature", "live", r6(rate).alias("rate"), (F.col("live") == 0).alias("dead"), ((rate > 0.001) & (rate < 0.05)).alias("interpretable"))


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), a AS (SELECT feature, count(*) FILTER (value > 0) AS live FROM ({_R}) WHERE rk <= 16 GROUP BY feature)
    SELECT round(CASE WHEN any_value(n) < 1000 THEN 0 ELSE avg(CAST(coalesce(live, 0) / n < 0.001 AS INTEGER)) END, 6) + 0.0 AS ratio FROM range({FEATURES}) d(f) LEFT JOIN a ON a.feature = f, n""")
def dead_latent_ratio(spark: SparkSession, sf: str) -> DataFrame:
    domain = spark.range(FEATURES).select(F.col("id").cast("int").alias("feature"))
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    a = codes.liveness(codes.ranked(encoded(spark, sf), k=16), F.lit(1), domain).crossJoin(F.broadcast(n))
    return a.agg(r6(F.when(F.max("n") < 1000, F.lit(0.0)).otherwise(F.avg((F.col("live") / F.col("n") < 0.001).cast("int")))).alias("ratio"))


_MEM = f"SELECT feature, " + ", ".join(f"count(*) FILTER (rk <= {k}) AS c_{k}" for k in LEVELS) + f" FROM ({_R}) GROUP BY feature"


@query(f"SELECT feature, " + ", ".join(f"round(c_{k} / (SELECT count(*) FROM embeddings), 6) + 0.0 AS f_{k}" for k in LEVELS) + f" FROM ({_MEM})")
def feature_importance_by_k(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    m = codes.membership(codes.ranked(encoded(spark, sf)), LEVELS).crossJoin(F.broadcast(n))
    return m.select("feature", *(r6(F.col(f"c_{k}") / F.col("n")).alias(f"f_{k}") for k in LEVELS))


@query(f"SELECT count(*) FILTER (c_4 <= c_8 AND c_8 <= c_16 AND c_16 <= c_32 AND c_32 > 0) AS stable, count(*) FILTER (c_32 > 0) AS active FROM ({_MEM})")
def feature_stability(spark: SparkSession, sf: str) -> DataFrame:
    m = codes.membership(codes.ranked(encoded(spark, sf)), LEVELS)
    up = (F.col("c_4") <= F.col("c_8")) & (F.col("c_8") <= F.col("c_16")) & (F.col("c_16") <= F.col("c_32"))
    return m.agg(F.count_if(up & (F.col("c_32") > 0)).alias("stable"), F.count_if(F.col("c_32") > 0).alias("active"))


_ABS = f"SELECT vec_id, j AS feature, row_number() OVER (PARTITION BY vec_id ORDER BY abs(vec[j + 1]) DESC, j) AS rk FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL}))"


_NEXT = tuple(zip(LEVELS[:-1], LEVELS[1:], strict=True))


@query(f"""WITH a AS ({_R}), b AS ({_ABS}), n AS ({" UNION ALL ".join(f"SELECT CAST({x} AS INTEGER) AS k_low, CAST({y} AS INTEGER) AS k_high, count(*) / {x}.0 / (SELECT count(*) FROM embeddings) AS s FROM a JOIN b ON a.vec_id = b.vec_id AND a.feature = b.feature WHERE a.rk <= {x} AND b.rk <= {y}" for x, y in _NEXT)})
    SELECT k_low, k_high, round(s, 6) + 0.0 AS nestedness FROM n""")
def nestedness(spark: SparkSession, sf: str) -> DataFrame:
    """Between adjacent levels the share of one ranking's first k_low in another's first k_high (codes against absolute components; within one ranking it is 1)."""
    first = lambda z, k: F.transform(F.slice(z, 1, k), lambda s: s["feature"])
    low = encoded(spark, sf).select("vec_id", v.topk(F.col("z"), LEVELS[-1]).alias("low"))
    high = views.traj_vec(spark, sf).select("vec_id", v.topk(F.transform("vec", lambda x: F.abs(x)), LEVELS[-1]).alias("high"))
    each = F.array(*(F.struct(F.lit(x).alias("k_low"), F.lit(y).alias("k_high"), (F.size(F.array_intersect(first("low", x), first("high", y))) / x).alias("s")) for x, y in _NEXT))
    return low.join(high, "vec_id").select(F.explode(each).alias("e")).groupBy("e.k_low", "e.k_high").agg(r6(F.avg("e.s")).alias("nestedness"))


_REC = f"SELECT vec_id, j, sum(value * w) / 64 AS x FROM ({_R}) JOIN ({_WT}) USING (feature) WHERE rk <= 16 GROUP BY vec_id, j"


@query(f"SELECT round(1 - avg((e.v - r.x) ** 2) / (var_pop(e.v) + 1e-8), 5) AS r2, round(1 - avg((e.v - r.x) ** 2) / var_samp(e.v), 5) AS r2_sample FROM (SELECT vec_id, j, vec[j + 1] AS v FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL}))) e JOIN ({_REC}) r ON r.vec_id = e.vec_id AND r.j = e.j")
def reconstruction_r2(spark: SparkSession, sf: str) -> DataFrame:
    rec = codes.decode(codes.ranked(encoded(spark, sf), k=16), weight_table(spark)).select("vec_id", "j", (F.col("x") / 64).alias("x"))
    e = views.traj_vec(spark, sf).select("vec_id", F.posexplode("vec").alias("j", "v")).join(rec, ["vec_id", "j"])
    mse = F.avg(F.pow(F.col("v") - F.col("x"), 2))
    return e.agg(F.round(1 - mse / (F.var_pop("v") + 1e-8), 5).alias("r2"), F.round(1 - mse / F.var_samp("v"), 5).alias("r2_sample"))


@query(f"SELECT feature, live FROM (SELECT feature, count(*) FILTER (value > 0) AS live FROM ({_R}) WHERE rk <= 16 GROUP BY feature) ORDER BY live DESC, feature LIMIT 20")
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is the operator: the 20 most frequent features."""
    n = codes.ranked(encoded(spark, sf), k=16).groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("live"))
    return n.orderBy(F.desc("live"), "feature").limit(20)


@query(f"SELECT feature, game_id, vec_id, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS r2 FROM (SELECT *, vec_id // 100 AS game_id, row_number() OVER (PARTITION BY feature, vec_id // 100 ORDER BY value DESC, vec_id) AS r1 FROM ({_R}) WHERE rk <= 8) WHERE r1 = 1) WHERE r2 <= 3")
def top_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The three strongest rows of a feature, from three games."""
    a = codes.ranked(encoded(spark, sf), k=8).withColumn("game_id", F.expr("vec_id div 100"))
    best = a.groupBy("feature", "game_id").agg(F.min(F.struct((-F.col("value")).alias("neg"), "vec_id")).alias("b")).select("feature", "game_id", "b.vec_id", (-F.col("b.neg")).alias("value"))
    return codes.first_per_group(best, "feature", [F.desc("value"), F.col("vec_id")], 3).select("feature", "game_id", "vec_id", r6(F.col("value")).alias("value"))


@query(f"""SELECT round(avg(CAST(abs(w) / nrm < 0.01 AS INTEGER)), 6) + 0.0 AS component_sparsity, (SELECT round(1 - count(*) / ({FEATURES}.0 * (SELECT count(*) FROM embeddings)), 6) + 0.0 FROM ({_R}) WHERE rk <= 16 AND value > 0) AS code_sparsity
    FROM (SELECT w, sqrt(sum(w * w) OVER (PARTITION BY feature)) AS nrm FROM ({_MEANS}))""")
def pca_sparsity(spark: SparkSession, sf: str) -> DataFrame:
    """The share of near-zero entries of dense components, the labels' means, beside the share of zeros among all rows' codes of at most 16 features."""
    w = mean_decoder(spark, sf).withColumn("nrm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("feature"))))
    dense = w.agg(r6(F.avg((F.abs("w") / F.col("nrm") < 0.01).cast("int"))).alias("component_sparsity"))
    rows = views.traj_vec(spark, sf).agg(F.count("*").alias("n"))
    sparse = codes.ranked(encoded(spark, sf), k=16).where("value > 0").agg(F.count("*").alias("some")).crossJoin(rows).select(r6(1 - F.col("some") / (F.lit(float(FEATURES)) * F.col("n"))).alias("code_sparsity"))
    return dense.crossJoin(sparse)


# ---------------------------------------------------------------- interventions

OUTPUTS = 8
_READ = "((j * 13 + p * 29 + j * p) % 37 - 18) / 37.0"


def head() -> np.ndarray:
    """Features x outputs, and the value in the last column: the decoder followed by a fixed read-out."""
    j, p = np.meshgrid(np.arange(INPUTS), np.arange(OUTPUTS + 1), indexing="ij")
    return weights() @ (((j * 13 + p * 29 + j * p) % 37 - 18) / 37.0) / 64


_H = f"SELECT feature, p, sum(w * {_READ}) / 64 AS d FROM ({_WT}), (SELECT CAST(p AS INTEGER) AS p FROM range({OUTPUTS + 1}) t(p)) GROUP BY feature, p"
_BASE = f"""a AS MATERIALIZED (SELECT vec_id, feature, value FROM ({_R}) WHERE rk <= 16), h AS MATERIALIZED ({_H}),
    l AS MATERIALIZED (SELECT vec_id, p, sum(value * d) AS l FROM a JOIN h USING (feature) GROUP BY vec_id, p),
    b AS MATERIALIZED (SELECT vec_id, p, l, CASE WHEN p < {OUTPUTS} THEN exp(l) / sum(exp(l)) FILTER (p < {OUTPUTS}) OVER (PARTITION BY vec_id) END AS q FROM l)"""


def _moved(rows: str) -> str:
    """By row and feature of rows (vec_id, feature, step): kl, value_change, impact, and changes by output."""
    return f"""m AS MATERIALIZED (SELECT vec_id, feature, p, q, b.l, b.l + step * d AS l2 FROM ({rows}) JOIN h USING (feature) JOIN b USING (vec_id, p)),
    s AS MATERIALIZED (SELECT *, CASE WHEN p < {OUTPUTS} THEN exp(l2) / sum(exp(l2)) FILTER (p < {OUTPUTS}) OVER (PARTITION BY vec_id, feature) END AS q2 FROM m),
    e AS MATERIALIZED (SELECT vec_id, feature, sum(q * (ln(q + 1e-10) - ln(q2 + 1e-10))) FILTER (p < {OUTPUTS}) AS kl, max(abs(tanh(l) - tanh(l2))) FILTER (p = {OUTPUTS}) AS dv, avg(abs(q - q2)) FILTER (p < {OUTPUTS}) AS impact FROM s GROUP BY ALL)"""


_ABLATED = "SELECT vec_id, feature, -value AS step FROM a WHERE value <> 0"
_ROWS = "(SELECT count(*) FROM embeddings)"
_SPARSE = f"""SELECT feature, CASE WHEN sum(abs(m)) < 1e-10 THEN 0 ELSE {OUTPUTS} * sum(m * m) / (sum(abs(m)) ** 2 + 1e-10) END AS sparsity FROM (SELECT feature, p, sum(q - q2) / {_ROWS} AS m FROM s WHERE p < {OUTPUTS} GROUP BY ALL) GROUP BY feature"""


@query(f"""WITH {_BASE}, {_moved(_ABLATED)} SELECT CAST(f AS INTEGER) AS feature, round(coalesce(sum(kl), 0) / {_ROWS}, 6) + 0.0 AS kl, round(coalesce(sum(dv), 0) / {_ROWS}, 6) + 0.0 AS value_change,
    round((SELECT coalesce(sum(value), 0) FROM a WHERE a.feature = f) / {_ROWS}, 6) + 0.0 AS mean_activation, round((SELECT count(*) FROM a WHERE a.feature = f AND value > 0) / {_ROWS}, 6) + 0.0 AS activation_rate,
    round(coalesce(max(sparsity), 0), 4) + 0.0 AS sparsity FROM range({FEATURES}) t(f) LEFT JOIN e ON e.feature = f LEFT JOIN ({_SPARSE}) x ON x.feature = f GROUP BY f""")
def ablation_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Each code set to zero: how far the policy moves, the value changes, and how few outputs it reaches."""
    x = causal.interventions(encoded(spark, sf), head(), 16)
    return x.select("feature", *(r6(F.col(c)).alias(c) for c in ("kl", "value_change", "mean_activation", "activation_rate")), (F.round(v.effect_sparsity(F.col("effect")), 4) + 0.0).alias("sparsity"))


@query(f"""WITH {_BASE}, {_moved("SELECT vec_id, feature, 2.0 - coalesce(value, 0) AS step FROM (SELECT vec_id FROM embeddings) JOIN range(6) t(f) ON true LEFT JOIN (SELECT vec_id AS v2, feature AS f2, value FROM a) x ON x.v2 = vec_id AND x.f2 = f".replace("SELECT vec_id, feature,", "SELECT vec_id, CAST(f AS INTEGER) AS feature,"))},
    c AS (SELECT feature, p, avg(abs(q - q2)) AS change FROM s WHERE p < {OUTPUTS} GROUP BY ALL)
    SELECT feature, round(avg(kl), 6) + 0.0 AS kl, round(avg(dv), 6) + 0.0 AS value_change, CAST((SELECT list(p ORDER BY change DESC, p) FROM c WHERE c.feature = e.feature)[1:3] AS INTEGER[]) AS top FROM e GROUP BY feature""")
def steering_effects(spark: SparkSession, sf: str) -> DataFrame:
    """The first six codes set to 2 in every row (these six are what is asked): how far policy and value move, and the three outputs that change most."""
    x = causal.interventions(encoded(spark, sf), head(), 16, np.full(FEATURES, 2.0)).where("feature < 6")
    order = F.array_sort(F.transform("change", lambda c, i: F.struct((-c).alias("c"), i.alias("i"))))
    return x.select("feature", r6(F.col("kl")).alias("kl"), r6(F.col("value_change")).alias("value_change"), F.slice(F.transform(order, lambda s: s["i"].cast("int")), 1, 3).alias("top"))


@query(f"""WITH {_BASE}, {_moved(_ABLATED)}, c AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS g FROM embeddings), n AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0 FROM c),
    i AS (SELECT feature, sum(impact) FILTER (g = 1) AS s1, sum(impact) FILTER (g = 0) AS s0 FROM e JOIN c USING (vec_id) GROUP BY feature)
    SELECT CAST(f AS INTEGER) AS feature, n1 AS n_present, n0 AS n_absent, round(coalesce(s1, 0) / n1, 6) + 0.0 AS present, round(coalesce(s0, 0) / n0, 6) + 0.0 AS absent, round(coalesce(s1, 0) / n1 - coalesce(s0, 0) / n0, 6) + 0.0 AS differential
    FROM range({FEATURES}) t(f) LEFT JOIN i ON i.feature = f, n""")
def differential_impact(spark: SparkSession, sf: str) -> DataFrame:
    """Impact of ablation in rows with a concept (label below 5) against rows without."""
    labels = views.traj_vec(spark, sf).select("vec_id", (F.col("label") < 5).cast("int").alias("concept"))
    x = causal.differential(encoded(spark, sf).join(labels, "vec_id"), head(), 16, "concept")
    return x.select("feature", "n_present", "n_absent", *(r6(F.col(c)).alias(c) for c in ("present", "absent", "differential")))


@query(f"""WITH {_BASE}, t AS MATERIALIZED (SELECT feature, count(*) AS n, quantile_disc(value, 0.95) AS up FROM a WHERE value > 0 GROUP BY feature ORDER BY n DESC, feature LIMIT 10),
    {_moved(_ABLATED)}, ab AS (SELECT feature, sum(kl) / {_ROWS} AS ablation FROM e GROUP BY feature), sp AS ({_SPARSE}),
    {_moved("SELECT r.vec_id, t.feature, t.up - coalesce(a.value, 0) AS step FROM (SELECT vec_id FROM embeddings) r JOIN t ON true LEFT JOIN a ON a.vec_id = r.vec_id AND a.feature = t.feature").replace("m AS", "m2 AS").replace("FROM m)", "FROM m2)").replace("s AS MAT", "s2 AS MAT").replace("FROM s GROUP", "FROM s2 GROUP").replace("e AS MAT", "e2 AS MAT")}, st AS (SELECT feature, avg(kl) AS steering FROM e2 GROUP BY feature)
    SELECT feature, round(ablation, 6) + 0.0 AS ablation, round(steering, 6) + 0.0 AS steering, round(sparsity, 4) + 0.0 AS sparsity, ablation > 0.001 OR steering > 0.001 AS causal FROM t JOIN ab USING (feature) JOIN st USING (feature) JOIN sp USING (feature)""")
def causal_screening(spark: SparkSession, sf: str) -> DataFrame:
    """The ten codes that are active most often (the ten are what is asked), set to 0 and to their 95 % quantile."""
    z = encoded(spark, sf)
    high = codes.ranked(z, k=16).where("value > 0").groupBy("feature").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("up"))
    steer = np.ones(FEATURES)
    for r in high.collect():
        steer[r["feature"]] = r["up"]
    x = causal.screened(z, head(), 16, steer, 10, 0.001)
    return x.select("feature", r6(F.col("ablation")).alias("ablation"), r6(F.col("steering")).alias("steering"), (F.round("sparsity", 4) + 0.0).alias("sparsity"), "causal")


_LOSS = ", ".join(f"avg((e.v - r.x_{k} / 64) ** 2) AS m_{k}" for k in LEVELS)
_RAW = ", ".join(f"sum(CASE WHEN rk <= {k} THEN value * w ELSE 0 END) AS x_{k}" for k in LEVELS)


@query(f"""WITH r AS (SELECT vec_id, j, {_RAW} FROM ({_R}) JOIN ({_WT}) USING (feature) WHERE rk <= 32 GROUP BY vec_id, j), e AS (SELECT vec_id, j, vec[j + 1] AS v FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL}))),
    m AS (SELECT {_LOSS} FROM e JOIN r ON r.vec_id = e.vec_id AND r.j = e.j)
    SELECT round((m_4 + m_8 + m_16 + m_32) / 4, 5) AS uniform_loss, round((m_4 / 4 + m_8 / 8 + m_16 / 16 + m_32 / 32) / (1 / 4.0 + 1 / 8.0 + 1 / 16.0 + 1 / 32.0), 5) AS weighted_loss FROM m""")
def nested_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Reconstruction losses of all levels, weighted alike and by 1/k."""
    x = codes.decode(codes.ranked(encoded(spark, sf), k=32), weight_table(spark), levels=LEVELS)
    e = views.traj_vec(spark, sf).select("vec_id", F.posexplode("vec").alias("j", "v")).join(x, ["vec_id", "j"])
    m = e.agg(*(F.avg(F.pow(F.col("v") - F.col(f"x_{k}") / 64, 2)).alias(f"m_{k}") for k in LEVELS))
    weight = sum(1 / k for k in LEVELS)
    return m.select(F.round(sum(F.col(f"m_{k}") for k in LEVELS) / 4, 5).alias("uniform_loss"), F.round(sum(F.col(f"m_{k}") / k for k in LEVELS) / weight, 5).alias("weighted_loss"))


# ---------------------------------------------------------------- clusters and geometry

_C = f"SELECT label AS c, j, avg(vec[j + 1]) AS m FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL})) GROUP BY label, j"
_D = f"SELECT e.vec_id, e.label, k.c, sum((e.x - k.m) ** 2) AS d2 FROM (SELECT vec_id, label, j, vec[j + 1] AS x FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL}))) e JOIN ({_C}) k ON k.j = e.j GROUP BY ALL"


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """(c, m): the mean vector of each label, as many rows as labels."""
    g = views.traj_vec(spark, sf).select(F.col("label").alias("c"), F.posexplode("vec").alias("j", "x")).groupBy("c", "j").agg(F.avg("x").alias("m"))
    return g.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("m"))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, own, nearest, d2): each row's squared distance from its own label's centroid, and its nearest centroid. The centroids, of a checked number, are one array that meets each row: no rows are made and none are shuffled."""
    k = codes.small(centroids(spark, sf))
    one = k.agg(F.collect_list(F.struct("c", "m")).alias("k"))
    x = views.traj_vec(spark, sf).select("vec_id", "label", "vec").crossJoin(F.broadcast(one))
    x = x.withColumn("d", F.transform("k", lambda s: F.struct(v.squared_distance(F.col("vec"), s["m"]).alias("d2"), s["c"].alias("c"))))
    own = F.filter("d", lambda s: s["c"] == F.col("label"))[0]["d2"]
    return x.select("vec_id", "label", own.alias("own"), F.array_min("d").alias("b")).select("vec_id", "label", "own", F.col("b.c").alias("nearest"), F.col("b.d2").alias("d2"))


@query(f"SELECT vec_id, arg_min(c, struct_pack(d := d2, c := c)) AS nearest, round(min(d2), 5) AS d2 FROM ({_D}) GROUP BY vec_id")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).select("vec_id", "nearest", F.round("d2", 5).alias("d2"))


@query(f"SELECT c, vec_id, CAST(rk AS INTEGER) AS rk FROM (SELECT c, vec_id, row_number() OVER (PARTITION BY c ORDER BY round(d2, 9), vec_id) AS rk FROM ({_D}) WHERE c = label) WHERE rk <= 5")
def cluster_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    own = _near(spark, sf).select(F.col("label").alias("c"), "vec_id", F.round("own", 9).alias("d"))
    return codes.first_per_group(own, "c", [F.col("d"), F.col("vec_id")], 5).select("c", "vec_id", "rk")


@query(f"SELECT label, count(*) AS n, round(sum(d2), 4) AS inertia FROM ({_D}) WHERE c = label GROUP BY label")
def kmeans_inertia(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("own"), 4).alias("inertia"))


_NEAR = f"SELECT * FROM (SELECT label AS a, arg_min(c, struct_pack(d := d2, c := c)) AS b FROM ({_D}) GROUP BY vec_id, label) WHERE a >= 0 AND b >= 0"


def _contingency(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).where("label >= 0 and nearest >= 0").groupBy(F.col("label").alias("a"), F.col("nearest").alias("b")).agg(F.count("*").alias("n"))


@query(f"SELECT a, b, count(*) AS n FROM ({_NEAR}) GROUP BY a, b")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return _contingency(spark, sf)


@query(f"""WITH n AS (SELECT a, b, count(*) AS n FROM ({_NEAR}) GROUP BY a, b), r AS (SELECT a, sum(n) AS x FROM n GROUP BY a), c AS (SELECT b, sum(n) AS y FROM n GROUP BY b), t AS (SELECT sum(n) AS t FROM n),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS i, (SELECT sum(x * (x - 1) / 2) FROM r) AS p, (SELECT sum(y * (y - 1) / 2) FROM c) AS q, (SELECT t * (t - 1) / 2 FROM t) AS m,
          (SELECT sum(n.n / t * ln(n.n * t / (r.x * c.y))) FROM n JOIN r USING (a) JOIN c USING (b), t) AS mi, (SELECT -sum(x / t * ln(x / t)) FROM r, t) AS ha, (SELECT -sum(y / t * ln(y / t)) FROM c, t) AS hb)
    SELECT round((i - p * q / m) / ((p + q) / 2 - p * q / m), 6) + 0.0 AS ari, round(mi / ((ha + hb) / 2), 6) + 0.0 AS nmi FROM s""")
def cluster_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information in closed form from the contingency table, in one aggregate over its few cells."""
    return agreement(_contingency(spark, sf))


def agreement(cells: DataFrame) -> DataFrame:
    """(ari, nmi) of cells (a, b, n). Sums over rows and columns of the table are sums over its cells."""
    over = lambda *k: F.sum("n").over(Window.partitionBy(*k)).cast("double")
    c = cells.select(F.col("n").cast("double").alias("n"), over("a").alias("x"), over("b").alias("y"), over().alias("t"))
    n, x, y, t = map(F.col, "nxyt")
    s = c.agg(F.sum(n * (n - 1) / 2).alias("i"), F.sum(n * (x - 1) / 2).alias("p"), F.sum(n * (y - 1) / 2).alias("q"), F.max(t * (t - 1) / 2).alias("m"), F.sum(n / t * F.ln(n * t / (x * y))).alias("mi"), (-F.sum(n / t * F.ln(x / t))).alias("ha"), (-F.sum(n / t * F.ln(y / t))).alias("hb"))
    e = F.col("p") * F.col("q") / F.col("m")
    return s.select(r6((F.col("i") - e) / ((F.col("p") + F.col("q")) / 2 - e)).alias("ari"), r6(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


_POINTS = f"SELECT vec_id, label, vec FROM ({TRAJ_VEC_SQL})"
_PD = f"SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_distance(a.vec, b.vec) AS d FROM ({_POINTS}) a JOIN ({_POINTS}) b ON a.vec_id <> b.vec_id"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """All rows."""
    return views.traj_vec(spark, sf).select("vec_id", "label", "vec")


def _over_all(spark: SparkSession, sf: str, fold: neighbours.Fold, schema: str, merge: neighbours.Merge | None = None) -> DataFrame:
    """fold of every pair of blocks, each once: for sums over all pairs of rows."""
    index = neighbours.build(_points(spark, sf))
    return neighbours.over_pairs(index, neighbours.near_pairs(index), fold, schema, merge=merge)


@query(f"SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS least, round(max(d), 6) AS most FROM ({_PD}) WHERE a < b")
def pairwise_distance_stats(spark: SparkSession, sf: str) -> DataFrame:
    def fold(x, y, d, same):
        v = d[np.triu_indices(len(d), 1)] if same else d.ravel()
        m = v.mean() if len(v) else 0.0
        return pd.DataFrame([(len(v), m, ((v - m) ** 2).sum(), v.min(), v.max())] if len(v) else [], columns=["n", "m", "m2", "least", "most"])

    p = _over_all(spark, sf, fold, "n long, m double, m2 double, least double, most double")
    t = p.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.min("least").alias("least"), F.max("most").alias("most"))
    std = F.sqrt(F.greatest(F.col("sq") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return t.select("n", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("n") > 0, std), 6).alias("std"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query(f"SELECT a, b, CAST(rk AS INTEGER) AS rk FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rk FROM ({_PD})) WHERE rk <= 10")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly, by the pivot index: pairs of blocks that are too far apart aren't looked at."""
    return neighbours.nearest(neighbours.build(_points(spark, sf)), 10)[0].select("a", "b", "rk")


_SIL = f"SELECT a, la, lb, sum(d) AS s, count(*) AS n FROM ({_PD}) GROUP BY a, la, lb"


@query(f"""WITH s AS ({_SIL}), i AS (SELECT a, max(s / n) FILTER (la = lb) AS own, min(s / n) FILTER (la <> lb) AS other FROM s GROUP BY a)
    SELECT round(avg(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 6) + 0.0 AS silhouette FROM i""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    def one_way(x, y, d, same):
        code, labels = pd.factorize(y["label"])
        each = (code[:, None] == np.arange(len(labels))).astype(float)
        n = np.tile(each.sum(axis=0), (len(x), 1)) - (each if same else 0)
        out = pd.DataFrame({"a": np.repeat(x["vec_id"].to_numpy(), len(labels)), "la": np.repeat(x["label"].to_numpy(), len(labels)), "lb": np.tile(np.asarray(labels), len(x)), "s": (d @ each).ravel(), "n": n.ravel()})
        return out[out["n"] > 0]

    def fold(x, y, d, same):
        return one_way(x, y, d, same) if same else pd.concat([one_way(x, y, d, same), one_way(y, x, d.T, same)])

    sums = _over_all(spark, sf, fold, "a long, la long, lb long, s double, n double", lambda t: t.groupby(["a", "la", "lb"], as_index=False, dropna=False).sum())
    s = sums.groupBy("a", "la", "lb").agg((F.sum("s") / F.sum("n")).alias("m"))
    i = s.groupBy("a").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("other"))
    return i.agg(r6(F.avg(F.coalesce((F.col("other") - F.col("own")) / F.greatest("own", "other"), F.lit(0.0)))).alias("silhouette"))


@query(f"""WITH k AS (SELECT a, b, CASE WHEN a = b THEN 1 ELSE exp(-d * d / 2) END AS w FROM (SELECT a, b, d FROM ({_PD}) UNION ALL SELECT vec_id, vec_id, 0 FROM ({_POINTS}))),
    g AS (SELECT a, sum(w) AS q FROM k GROUP BY a), m AS (SELECT k.a, k.b, w / sqrt(x.q * y.q) AS w FROM k JOIN g x ON x.a = k.a JOIN g y ON y.a = k.b)
    SELECT a, round(max(w / s), 6) AS top, round(sum((w / s) ** 2), 6) AS concentration FROM (SELECT *, sum(w) OVER (PARTITION BY a) AS s FROM m) GROUP BY a""")
def diffusion_operator(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian kernel, degrees to the power -1/2, rows normalised; by row, what can be compared. Two passes over the pairs; a row's weight with itself is 1."""

    def weights(d, same):
        w = np.exp(-d * d / 2)
        if same:
            np.fill_diagonal(w, 0)
        return w

    def degree(x, y, d, same):
        w = weights(d, same)
        sums = [(x, w.sum(axis=1))] + [(y, w.sum(axis=0))] * (not same)
        return pd.concat([pd.DataFrame({"a": r["vec_id"].to_numpy(), "w": s}) for r, s in sums])

    def row(x, y, d, same):
        w = weights(d, same) / np.sqrt(x["q"].to_numpy()[:, None] * y["q"].to_numpy())
        sides = [(x, w)] + [(y, w.T)] * (not same)
        return pd.concat([pd.DataFrame({"a": r["vec_id"].to_numpy(), "q": r["q"].to_numpy(), "mw": m.max(axis=1), "w2": (m * m).sum(axis=1), "s": m.sum(axis=1)}) for r, m in sides])

    index = neighbours.build(_points(spark, sf))
    pairs = neighbours.near_pairs(index)
    g = neighbours.over_pairs(index, pairs, degree, "a long, w double", merge=lambda t: t.groupby("a", as_index=False).sum()).groupBy("a").agg((F.sum("w") + 1).alias("q"))
    most = lambda t: t.groupby("a", as_index=False).agg({"q": "first", "mw": "max", "w2": "sum", "s": "sum"})
    m = neighbours.over_pairs(index, pairs, row, "a long, q double, mw double, w2 double, s double", index.rows.join(g.withColumnRenamed("a", "vec_id"), "vec_id"), most)
    own = 1 / F.col("q")
    t = m.groupBy("a", "q").agg(F.max("mw").alias("mw"), F.sum("w2").alias("w2"), F.sum("s").alias("s"))
    t = t.select("a", F.greatest("mw", own).alias("mw"), (F.col("w2") + own * own).alias("w2"), (F.col("s") + own).alias("s"))
    return t.select("a", F.round(F.col("mw") / F.col("s"), 6).alias("top"), F.round(F.col("w2") / (F.col("s") * F.col("s")), 6).alias("concentration"))


@query(f"""WITH x AS (SELECT label % 2 AS g, j, vec[j + 1] AS v FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL}))), s AS (SELECT g, j, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY g, j),
    p AS (SELECT a.j, a.m AS ma, b.m AS mb, a.sd AS sa, b.sd AS sb FROM s a JOIN s b ON a.j = b.j AND a.g = 0 AND b.g = 1)
    SELECT round(sum(ma * mb) / sqrt(sum(ma * ma) * sum(mb * mb)), 6) + 0.0 AS mean_cosine, round(corr(sa, sb), 6) + 0.0 AS std_corr, round(avg(sa), 6) AS std_a, round(avg(sb), 6) AS std_b FROM p""")
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_vec(spark, sf).select((F.col("label") % 2).alias("g"), F.posexplode("vec").alias("j", "v"))
    s = x.groupBy("j").pivot("g", [0, 1]).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return s.agg(r6(F.sum(F.col("0_m") * F.col("1_m")) / F.sqrt(F.sum(F.col("0_m") * F.col("0_m")) * F.sum(F.col("1_m") * F.col("1_m")))).alias("mean_cosine"), r6(F.corr("0_sd", "1_sd")).alias("std_corr"), F.round(F.avg("0_sd"), 6).alias("std_a"), F.round(F.avg("1_sd"), 6).alias("std_b"))


_AUC_X = f"SELECT j, label < 5 AS pos, vec[j + 1] AS s FROM (SELECT *, unnest(range(64)) AS j FROM ({TRAJ_VEC_SQL}))"


@query(f"""SELECT CAST(j AS INTEGER) AS feature, round((sum(CASE WHEN pos THEN ar ELSE 0 END) - p * (p + 1) / 2) / (p * (n - p)), 6) + 0.0 AS auc FROM (
    SELECT *, rank() OVER (PARTITION BY j ORDER BY s) + (count(*) OVER (PARTITION BY j, s) - 1) / 2 AS ar, count(*) OVER (PARTITION BY j) AS n, sum(CAST(pos AS INTEGER)) OVER (PARTITION BY j) AS p FROM ({_AUC_X})) GROUP BY j, n, p""")
def auc_by_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Mann-Whitney from average ranks; equal scores are counted up before they are ranked."""
    x = views.traj_vec(spark, sf).select((F.col("label") < 5).cast("long").alias("pos"), F.posexplode("vec").alias("feature", "s"))
    g = x.groupBy("feature", "s").agg(F.count("*").alias("m"), F.sum("pos").alias("p"))
    r = ranks.running(g, "s", F.col("m"), "before", ["feature"]).withColumn("ar", F.coalesce("before", F.lit(0)) + (F.col("m") + 1) / 2)
    t = r.groupBy("feature").agg(F.sum(F.col("ar") * F.col("p")).alias("sr"), F.sum("p").alias("p"), F.sum("m").alias("n"))
    auc = F.when((F.col("p") == 0) | (F.col("p") == F.col("n")), 0.5).otherwise((F.col("sr") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p").cast("double") * (F.col("n") - F.col("p"))))
    return t.select("feature", r6(auc).alias("auc"))
