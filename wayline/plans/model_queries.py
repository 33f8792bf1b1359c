"""Queries that end in small dense algebra, fits, permutations or topology. The big side is an aggregate; where SQL has no word for the rest, tests hold invariants."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import vectors as v
from wayline.functions.vectors import r6
from wayline import storage
from wayline.operators import density, geometry, gram, inference, kinetics, ranks, sketch, spectral, training, transitions
from wayline.plans import trajectories, views
from wayline.plans.registry import query
from wayline.plans.views import TRAJ_VEC_SQL, table


def _model(spark: SparkSession, sf: str, lag: int = 1) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(states, counts, P, stationary distribution)."""
    states, c = kinetics.dense(transitions.transition_counts(views.traj_state(spark, sf, True), lag))
    p = kinetics.row_normalise(c)
    return states, c, p, kinetics.stationary(p)


_COUNTS = trajectories.COUNTS_SQL
#: The matrix as a list of rows, states in order.
_MATRIX = f"""c AS ({_COUNTS}), s AS (SELECT i AS state FROM c UNION SELECT j FROM c), g AS (SELECT a.state AS i, b.state AS j, coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY a.state), 1e-10) AS p FROM s a CROSS JOIN s b LEFT JOIN c ON c.i = a.state AND c.j = b.state),
    m AS (SELECT list(r ORDER BY i) AS m, any_value(k) AS k FROM (SELECT i, list(p ORDER BY j) AS r, count(*) AS k FROM g GROUP BY i))"""
_POWER = f"""{_MATRIX}, it AS (SELECT 0 AS step, list_transform(range(k), lambda x: 1.0 / k) AS pi FROM m
    UNION ALL SELECT step + 1, list_transform(y, lambda x: x / list_sum(y)) FROM (SELECT step, list_transform(range(1, k + 1), lambda j: list_sum(list_transform(range(1, k + 1), lambda i: pi[i] * m.m[i][j]))) AS y FROM it, m) WHERE step < 400),
    pi AS (SELECT pi FROM it ORDER BY step DESC LIMIT 1), names AS (SELECT list(state ORDER BY state) AS names FROM s)"""


@query(f"WITH RECURSIVE {_POWER} SELECT CAST(names[i] AS INTEGER) AS state, round(pi[i], 6) AS pi FROM pi, names, m, range(1, 100) t(i) WHERE i <= k")
def stationary_distribution(spark: SparkSession, sf: str) -> DataFrame:
    states, _, _, pi = _model(spark, sf)
    return spark.createDataFrame([(int(s), round(float(x), 6)) for s, x in zip(states, pi, strict=True)], "state int, pi double")


@query()
def eigenvalues(spark: SparkSession, sf: str) -> DataFrame:
    lam = kinetics.eigenvalues(_model(spark, sf)[2])
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(lam)], "rank int, eigenvalue double")


@query()
def implied_timescales(spark: SparkSession, sf: str) -> DataFrame:
    """One pass of counts for all lags, then algebra on each."""
    counts = trajectories.counts_multi_lag(spark, sf).cache()
    out = []
    for lag in (1, 2, 5, 10):
        p = kinetics.row_normalise(kinetics.dense(counts.where(F.col("lag") == lag))[1])
        out += [(lag, i, float(t)) for i, t in enumerate(kinetics.timescales(p, lag))]
    counts.unpersist()
    return spark.createDataFrame(out, "lag int, rank int, timescale double")


_LAGGED = f"""l AS MATERIALIZED (SELECT lag, i, j, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT {k} AS lag, state AS i, lead(state, {k}) OVER (PARTITION BY game_id ORDER BY move_number) AS j FROM ({views.traj_state_sql(True)})" for k in (1, 2, 5, 10))}) WHERE i >= 0 AND j >= 0 GROUP BY ALL),
    s AS (SELECT DISTINCT i AS state FROM l), p AS MATERIALIZED (SELECT g.lag, g.i, g.j, coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY g.lag, g.i), 1e-10) AS p FROM (SELECT lag, a.state AS i, b.state AS j FROM (VALUES (1), (2), (5), (10)) t(lag), s a, s b) g LEFT JOIN l ON l.lag = g.lag AND l.i = g.i AND l.j = g.j)"""
_UP = " ".join(f", w{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM {'w' + str(k - 1) if k > 2 else '(SELECT i, j, p FROM p WHERE lag = 1)'} a JOIN (SELECT i, j, p FROM p WHERE lag = 1) b ON a.j = b.i GROUP BY ALL)" for k in range(2, 11))
_CK = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, sqrt(avg((w.p - q.p) ** 2)) AS e FROM {'w' + str(k) if k > 1 else '(SELECT i, j, p FROM p WHERE lag = 1)'} w JOIN p q ON q.lag = {k} AND q.i = w.i AND q.j = w.j" for k in (1, 2, 5, 10))


@query(f"WITH {_LAGGED}{_UP}, e AS ({_CK}) SELECT k, round(e, 9) + 0.0 AS rmse, e < 0.2 AS passed FROM e")
def chapman_kolmogorov(spark: SparkSession, sf: str) -> DataFrame:
    counts = trajectories.counts_multi_lag(spark, sf).cache()
    by = {lag: kinetics.row_normalise(kinetics.dense(counts.where(F.col("lag") == lag))[1]) for lag in (1, 2, 5, 10)}
    counts.unpersist()
    return spark.createDataFrame([(k, round(e, 9) + 0.0, ok) for k, e, ok in kinetics.chapman_kolmogorov(by, 1)], "k int, rmse double, passed boolean")


@query(f"""WITH RECURSIVE {_POWER}, t AS (SELECT 0 AS step, j, list_transform(range(k), lambda x: CAST(0 AS DOUBLE)) AS h FROM m, range(1, 100) r(j) WHERE j <= k
    UNION ALL SELECT step + 1, j, list_transform(range(1, k + 1), lambda i: CASE WHEN i = j THEN CAST(0 AS DOUBLE) ELSE 1 + list_sum(list_transform(range(1, k + 1), lambda q: m.m[i][q] * h[q])) END) FROM t, m WHERE step < 1500)
    SELECT CAST(names[i] AS INTEGER) AS i, CAST(names[j] AS INTEGER) AS j, round(h[i], 4) + 0.0 AS mfpt FROM t, m, names, range(1, 100) r(i) WHERE step = 1500 AND i <= k""")
def first_passage_times(spark: SparkSession, sf: str) -> DataFrame:
    states, _, p, pi = _model(spark, sf)
    m = kinetics.first_passage(p, pi)
    return spark.createDataFrame([(int(a), int(b), round(float(m[i, j]), 4) + 0.0) for i, a in enumerate(states) for j, b in enumerate(states)], "i int, j int, mfpt double")


@query()
def transition_paths(spark: SparkSession, sf: str) -> DataFrame:
    """From the first to the last state: committors, and flux into and out of each state."""
    states, _, p, pi = _model(spark, sf)
    t = kinetics.transition_paths(p, pi, [0], [len(states) - 1])
    rows = [(int(s), float(t["forward"][i]), float(t["backward"][i]), float(t["net"][:, i].sum()), float(t["net"][i].sum()), float(t["flux"]), float(t["rate"])) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "state int, forward double, backward double, flux_in double, flux_out double, flux double, rate double")


@query()
def reactive_pathways(spark: SparkSession, sf: str) -> DataFrame:
    states, _, p, pi = _model(spark, sf)
    t = kinetics.transition_paths(p, pi, [0], [len(states) - 1])
    out = [(k, [int(states[i]) for i in path], flux) for k, (path, flux) in enumerate(kinetics.pathways(t["net"], [0], [len(states) - 1]))]
    return spark.createDataFrame(out, "rank int, path array<int>, flux double")


@query()
def metastable_states(spark: SparkSession, sf: str) -> DataFrame:
    states, _, p, _ = _model(spark, sf)
    return spark.createDataFrame([(int(s), int(m)) for s, m in zip(states, kinetics.metastable(p, 2), strict=True)], "state int, macro int")


@query()
def soft_macrostates(spark: SparkSession, sf: str) -> DataFrame:
    """Memberships of states in two and in three macrostates."""
    states, _, p, _ = _model(spark, sf)
    out = [(k, int(s), j, float(m)) for k in (2, 3) if k <= len(states) for s, row in zip(states, kinetics.memberships(p, k), strict=True) for j, m in enumerate(row)]
    return spark.createDataFrame(out, "n_macro int, state int, macro int, membership double")


@query()
def macrostate_model(spark: SparkSession, sf: str) -> DataFrame:
    """Of two and of three macrostates: how crisp memberships are, and transition probabilities and first-passage times between macrostates."""
    states, _, p, pi = _model(spark, sf)
    out = []
    for k in (2, 3):
        if k <= len(states):
            m = kinetics.memberships(p, k)
            t, weight = kinetics.coarse(p, pi, m), m.T @ pi / (m.T @ pi).sum()
            times = kinetics.first_passage(t, weight)
            out += [(k, kinetics.membership_entropy(m), i, j, float(t[i, j]), float(times[i, j])) for i in range(k) for j in range(k)]
    return spark.createDataFrame(out, "n_macro int, entropy double, i int, j int, p double, mfpt double")


_MU = f"SELECT j, avg(vec[j]) AS m FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({TRAJ_VEC_SQL})) GROUP BY j"
_PAIR = f"SELECT game_id, move_number, vec, nxt FROM (SELECT *, lead(vec) OVER (PARTITION BY game_id ORDER BY move_number) AS nxt FROM ({TRAJ_VEC_SQL})) WHERE nxt IS NOT NULL"


@query(f"""WITH a AS (SELECT game_id, move_number, j, vec[j] - m AS x, nxt[j] - m AS y FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({_PAIR})) JOIN ({_MU}) USING (j)),
    c AS (SELECT a.j AS i, b.j, avg(a.x * b.y) AS c FROM a JOIN a b ON a.game_id = b.game_id AND a.move_number = b.move_number GROUP BY a.j, b.j)
    SELECT CAST(p.i - 1 AS INTEGER) AS i, CAST(p.j - 1 AS INTEGER) AS j, round((p.c + q.c) / 2, 6) + 0.0 AS c FROM c p JOIN c q ON p.i = q.j AND p.j = q.i""")
def lagged_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return gram.lagged_covariance(views.traj_vec(spark, sf)).select("i", "j", r6(F.col("c")).alias("c"))


@query()
def tica_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    s = sketch.spectrum(views.traj_vec(spark, sf), (1,))
    lam, _ = kinetics.tica(s.by_lag[0], s.by_lag[1], n=10)
    share = np.cumsum(lam**2) / (lam**2).sum()
    return spark.createDataFrame([(i, float(x), float(s)) for i, (x, s) in enumerate(zip(lam, share, strict=True))], "rank int, eigenvalue double, kinetic_share double")


@query()
def tica_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Rows on the two slowest components: a matrix product a batch."""
    x = views.traj_vec(spark, sf)
    s = sketch.spectrum(x, (1,))
    _, u = kinetics.tica(s.by_lag[0], s.by_lag[1], n=2)
    y = sketch.projected(x.select("vec_id", "vec"), np.zeros(len(s.mean)), s.basis @ u, "t")
    return y.select("vec_id", *(F.get("t", F.lit(k)).alias(f"t{k}") for k in range(2)))


@query()
def tica_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """How many components hold given shares of the kinetic variance."""
    s = sketch.spectrum(views.traj_vec(spark, sf), (1,))
    lam, _ = kinetics.tica(s.by_lag[0], s.by_lag[1])
    share = np.cumsum(lam**2) / (lam**2).sum()
    return spark.createDataFrame([(t, int(np.searchsorted(share, t) + 1)) for t in (0.5, 0.8, 0.95)], "share double, n int")


@query()
def tica_timescales(spark: SparkSession, sf: str) -> DataFrame:
    """The slowest five time scales by lag, all lags from one pass; infinite where an eigenvalue isn't between 0 and 1."""
    s, out = sketch.spectrum(views.traj_vec(spark, sf), (1, 2, 5)), []
    for lag in (1, 2, 5):
        lam, _ = kinetics.tica(s.by_lag[0], s.by_lag[lag], n=5)
        out += [(lag, i, float(-lag / np.log(a)) if 0 < a < 1 else float("inf")) for i, a in enumerate(lam)]
    return spark.createDataFrame(out, "lag int, rank int, timescale double")


@query(f"""WITH c AS (SELECT i, j, x FROM (SELECT CAST(j AS INTEGER) AS j, var_pop(vec[j]) AS x, row_number() OVER (ORDER BY var_pop(vec[j]) DESC, j) AS i FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({TRAJ_VEC_SQL})) GROUP BY j)),
    s AS (SELECT i, sum(x) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(x) OVER () AS share FROM c) SELECT CAST(i AS INTEGER) AS rank, round(share, 6) AS share, i = (SELECT min(i) FROM s WHERE share >= 0.95) AS reaches FROM s""")
def cumulative_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative share of sorted variances, and where it reaches 95 %; d rows."""
    from pyspark.sql import Window

    x = views.traj_vec(spark, sf).select(F.posexplode("vec").alias("j", "v")).groupBy("j").agg(F.var_pop("v").alias("x"))
    w = Window.orderBy(F.desc("x"), "j")
    s = x.select(F.row_number().over(w).alias("rank"), (F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("x").over(Window.partitionBy())).alias("share"))
    first = s.where("share >= 0.95").agg(F.min("rank").alias("first"))
    return s.crossJoin(F.broadcast(first)).select("rank", F.round("share", 6).alias("share"), (F.col("rank") == F.col("first")).alias("reaches"))


@query()
def elbow_point(spark: SparkSession, sf: str) -> DataFrame:
    """Where VAMP-2 of coarser and coarser states stops to grow."""
    x = views.traj_state(spark, sf, False)
    ks, scores = [], []
    for k in (2, 3, 4, 5):
        _, c = kinetics.dense(transitions.transition_counts(x.withColumn("state", F.col("state") % k)))
        r = c / c.sum()
        a, b = r.sum(axis=1), r.sum(axis=0)
        ks.append(k)
        scores.append(kinetics.vamp2(np.diag(a) - np.outer(a, a), r - np.outer(a, b), np.diag(b) - np.outer(b, b)))
    out = [(m, ks[kinetics.elbow(np.array(ks, float), np.array(scores), m)]) for m in ("distance", "gradient", "bend")]
    return spark.createDataFrame(out, "method string, k int")


@query()
def kmeans_states(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_vec(spark, sf).select("vec_id", array_to_vector("vec").alias("features"))
    model = KMeans(k=8, seed=1, maxIter=20).fit(x)
    return model.transform(x).select("vec_id", F.col("prediction").alias("state"))


@query()
def kmeans_vamp_search(spark: SparkSession, sf: str) -> DataFrame:
    """k-means for several k, each scored by VAMP-2 of its states' transitions."""
    x = views.traj_vec(spark, sf).select("game_id", "move_number", array_to_vector("vec").alias("features")).cache()
    out = []
    for i, k in enumerate((2, 4, 8, 16)):
        y = KMeans(k=k, seed=1 + i, maxIter=10).fit(x).transform(x).select("game_id", "move_number", F.col("prediction").alias("state"))
        n = transitions.lagged_pairs(y).groupBy("i", "j").agg(F.count("*").alias("n"))
        _, c = kinetics.dense(n)
        rc = c.sum(axis=1)[:, None] * c.sum(axis=0)[None]
        out.append((k, float((c[rc > 0] ** 2 / rc[rc > 0]).sum() - 1)))
    x.unpersist()
    return spark.createDataFrame(out, "k int, vamp2 double")


#: Rows that diffusion maps are fitted on at most; every row gets a result.
FIT_POINTS = 2_000


@query()
def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """All rows are fitted."""
    return density.density_clusters(views.traj_vec(spark, sf))


@query()
def spanning_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the least spanning tree of mutual reachability. Of trees with equal weights ids decide."""
    return density.spanning_tree(views.traj_vec(spark, sf), 5).select("lo", "hi", F.round("w", 6).alias("w"))


@query()
def density_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Four settings on ten principal components of all rows: clusters found and the share of noise. A tree serves all sizes of clusters, and neighbour lists both trees."""
    df = views.traj_vec(spark, sf)
    s = sketch.spectrum(df)
    comp = geometry.principal(s.by_lag[0], 10)[1] @ s.basis.T
    reduced = sketch.projected(df.select("vec_id", "vec"), s.mean, comp.T, "y").select("vec_id", F.col("y").alias("vec"))
    out = []
    with storage.scratch(spark):
        known = density.lists(reduced, 5)
        for least, sizes in ((2, (5,)), (5, (5, 10, 20))):
            with storage.scratch(spark):
                tree = density.spanning_tree(reduced, least, known)
                for size in sizes:
                    labels, n = density.condensed(tree, reduced.select("vec_id"), size)
                    out.append((size, least, n, labels.agg(F.avg((F.col("cluster") < 0).cast("int"))).first()[0]))
    return spark.createDataFrame(out, "min_size int, min_samples int, clusters int, noise double")


@query()
def pca_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """By number of components the share of variance, and R2 of the reconstruction around the mean of all numbers; from the covariance's leading part, the total variance and the means."""
    s = sketch.spectrum(views.traj_vec(spark, sf))
    w, _ = geometry.principal(s.by_lag[0], len(s.by_lag[0]))
    d = len(s.mean)
    around = (s.variance + ((s.mean - s.mean.mean()) ** 2).sum()) / d
    return spark.createDataFrame([(k, float(w[:k].sum() / s.variance), float(1 - (s.variance - w[:k].sum()) / d / (around + 1e-8))) for k in (4, 8, 16, 32)], "k int, share double, r2 double")


@query()
def component_sparsity(spark: SparkSession, sf: str) -> DataFrame:
    """The share of near-zero entries in each of ten fitted principal components."""
    s = sketch.spectrum(views.traj_vec(spark, sf))
    comp = geometry.principal(s.by_lag[0], 10)[1] @ s.basis.T
    share = (np.abs(comp) / np.linalg.norm(comp, axis=1, keepdims=True) < 0.01).mean(axis=1)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(share)], "component int, sparsity double")


@query()
def diffusion_map(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on FIT_POINTS landmarks at most; coordinates of every row by Nystroem's formula."""
    x = views.traj_vec(spark, sf)
    return geometry.extended(x, geometry.diffusion_fit(geometry.sample(x, "vec_id", "vec", FIT_POINTS)[1], 4))


@query()
def diffusion_graph_map(spark: SparkSession, sf: str) -> DataFrame:
    """All rows are fitted: a sparse kernel over the graph of nearest neighbours, and block Lanczos iteration as joins."""
    return spectral.diffusion_map(views.traj_vec(spark, sf), 4)[1]


def _landmarks(df: DataFrame, strategy: str, n: int) -> np.ndarray:
    """Vectors of n landmarks: by hash, evenly spaced in order, or the rows nearest to k-means centres (each once)."""
    if strategy == "uniform":
        return geometry.sample(df, "vec_id", "vec", n)[1]
    if strategy == "temporal":
        total = df.count()
        wanted = [k * (total - 1) // max(n - 1, 1) for k in range(min(n, total))]
        ranked = ranks.running(df.select("vec_id", "vec"), "vec_id", F.lit(1), "before").withColumn("at", F.coalesce("before", F.lit(0)))
        picked = ranked.join(F.broadcast(df.sparkSession.createDataFrame([(int(k),) for k in sorted(set(wanted))], "at long")), "at", "left_semi")
        return np.array([r["vec"] for r in picked.orderBy("vec_id").collect()], float)
    x = df.select("vec_id", "vec", array_to_vector("vec").alias("features"))
    centres = np.array(KMeans(k=min(n, 50), seed=3, maxIter=10).fit(x).clusterCenters())
    near = df.select("vec_id", "vec", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), v.squared_distance(F.col("vec"), F.array(*map(F.lit, map(float, m)))).alias("d2")) for i, m in enumerate(centres)))).alias("k"))
    best = near.groupBy("k.c").agg(F.min(F.struct("k.d2", "vec_id", "vec")).alias("b")).select("b.vec_id", "b.vec").dropDuplicates(["vec_id"])
    return np.array([r["vec"] for r in best.orderBy("vec_id").collect()], float)


@query()
def spectral_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The diffusion spectrum for several numbers of principal components and choices of landmarks: gap, first value, and whether it counts as valid."""
    df = views.traj_vec(spark, sf)
    cov = kinetics.dense(gram.lagged_covariance(df, 0), "c")[1]
    out = []
    for strategy in ("uniform", "temporal", "cluster"):
        x = _landmarks(df, strategy, 300)
        for k in (4, 8, 16):
            _, comp = geometry.principal(cov, k)
            lam, _ = geometry.diffusion_map((x - x.mean(axis=0)) @ comp.T, 6)
            gap, ok = kinetics.spectrum_check(lam[1:])
            out.append((strategy, k, len(x), gap, float(lam[1]), ok))
    return spark.createDataFrame(out, "strategy string, k int, landmarks int, gap double, first double, valid boolean")


#: Points of homology up to dimension 1 and of dimension 2, whose work grows with the third and the fourth power: samples are the operator's parameter.
HOMOLOGY_POINTS = {1: 100, 2: 32}


@query()
def persistence_diagram(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of dimensions 0 and 1 of 100 points, and of dimension 2 of 32: all of those points take part."""
    x = views.traj_vec(spark, sf)
    low = geometry.persistence(geometry.sample(x, "vec_id", "vec", HOMOLOGY_POINTS[1])[1], 1)
    high = geometry.persistence(geometry.sample(x, "vec_id", "vec", HOMOLOGY_POINTS[2])[1], 2)
    return spark.createDataFrame([*low, *(c for c in high if c[0] == 2)], "dimension int, birth double, death double")


@query()
def persistence_stats(spark: SparkSession, sf: str) -> DataFrame:
    """By dimension, zeros where it has no class."""
    p = persistence_diagram(spark, sf).withColumn("life", F.col("death") - F.col("birth"))
    g = p.groupBy("dimension").agg(F.count("*").alias("n"), F.avg("life").alias("mean"), F.max("life").alias("most"), F.sum("life").alias("total"), F.avg("birth").alias("birth"), F.avg("death").alias("mean_death"))
    return spark.range(3).select(F.col("id").cast("int").alias("dimension")).join(g, "dimension", "left").na.fill(0)


@query()
def persistence_significance(spark: SparkSession, sf: str) -> DataFrame:
    """Loops of 40 points that live over 0.01, against 20 tables with columns dealt anew, by half of the labels."""
    out = []
    for g in range(2):
        _, x = geometry.sample(views.traj_vec(spark, sf).where(F.col("label") % 2 == g), "vec_id", "vec", 40)
        out.append((g, *geometry.persistence_significance(x, 1, 20, 0.01, seed=g)))
    return spark.createDataFrame(out, "half int, observed int, null_mean double, p_value double")


@query()
def linear_probe(spark: SparkSession, sf: str) -> DataFrame:
    """A probe for each of three concepts, split by game; the score is the AUC on held-out games. Under 10 rows of a class: 0.5."""
    from wayline.plans.stats_queries import bucket

    x = views.traj_vec(spark, sf).withColumn("test", bucket("game_id", "probe") < 30).withColumn("features", array_to_vector("vec")).cache()
    out = None
    for k in (2, 3, 5):
        y = x.withColumn("label01", (F.col("label") % k == 0).cast("double"))
        train = y.where("not test")
        pos, n = train.agg(F.coalesce(F.sum("label01"), F.lit(0.0)), F.count("*")).first()
        if min(pos, n - pos) < 10:
            part = spark.createDataFrame([(k, 0.5)], "concept int, auc double")
        else:
            model = LogisticRegression(featuresCol="features", labelCol="label01", maxIter=30, regParam=0.01).fit(train)
            w = [float(a) for a in model.coefficients]
            scored = y.where("test").select(v.dot(F.col("vec"), F.array(*map(F.lit, w))).alias("score"), F.col("label01").cast("int").alias("label"), F.lit(k).alias("concept"))
            part = inference.auc(scored, ["concept"])
        out = part if out is None else out.unionByName(part)
    return out


@query()
def label_shuffle_control(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of every component against labels shuffled five times, and whether all are near one half."""
    x = views.traj_vec(spark, sf)
    runs = x.select("vec_id", (F.col("label") < 5).cast("int").alias("label")).crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "run")))
    dealt = inference.shuffled(runs, "vec_id", "label", ["run"], F.col("run"))
    one = dealt.groupBy("vec_id").agg(F.array(*(F.max(F.when(F.col("run") == k, F.col("label"))) for k in range(5))).alias("labels"))
    y = one.join(x.select("vec_id", "vec"), "vec_id").select("labels", F.posexplode("vec").alias("j", "score"))
    with storage.scratch(spark) as keep:
        a = inference.aucs(y, ["j"], 5)
        out = storage.stored(a.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), (F.abs(F.avg("auc") - 0.5) <= 0.05).alias("passed"), F.count("*").alias("n")), "control")
        keep.append(out)
    return out


@query()
def permutation_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user against outcome, 1,000 permutations of all users."""
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("game_id")).agg(F.count("*").cast("double").alias("score"))
    games = n.join(views.outcomes(spark, sf).select("game_id", F.col("outcome").cast("double").alias("outcome")), "game_id")
    return inference.permutation_pvalue(games)


@query()
def bootstrap_auc(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return inference.bootstrap_auc(d.select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label")), "doc_id", 100)


@query("""SELECT round((sum(CASE WHEN quality = 1 THEN ar ELSE 0 END) - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS ar, count(*) OVER () AS n, sum(quality) OVER () AS p FROM documents JOIN labels USING (doc_id)) GROUP BY n, p""")
def document_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Length as a score of quality."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return inference.auc(d.select(F.lit(1).alias("g"), F.col("n_chars").alias("score"), F.col("quality").alias("label")), ["g"]).select(F.round("auc", 6).alias("auc"))


@query()
def random_network_control(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of activations that are drawn from a normal distribution by hash, as of a network that has learnt nothing: all must be near one half."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("vec_id", "j", F.lit(k)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    x = views.traj_vec(spark, sf).select("vec_id", (F.col("label") < 5).cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    x = x.withColumn("score", F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * np.pi * u(2)))
    a = inference.auc(x, ["j"])
    return a.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), (F.abs(F.avg("auc") - 0.5) <= 0.05).alias("passed"), F.count("*").alias("n"))


#: Rows that models are trained on at most.
TRAIN_ROWS = 5_000


@query()
def train_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Nested codes trained on at most TRAIN_ROWS rows: held-out loss by epoch."""
    _, x = geometry.sample(views.traj_vec(spark, sf), "vec_id", "vec", TRAIN_ROWS)
    fit = training.train_codes(x, 96, (4, 8, 16, 32), epochs=10)
    return spark.createDataFrame([(i, float(a)) for i, a in enumerate(fit.losses)], "epoch int, loss double")


@query()
def trajectory_model(spark: SparkSession, sf: str) -> DataFrame:
    """A recurrent model of the next vector after four, trained on at most TRAIN_ROWS contexts: its error, the error of repeating the last vector, and how far drawn trajectories vary."""
    from wayline.operators import windows

    x = views.traj_vec(spark, sf).withColumn("ctx", windows.context("vec", 4, -1)).where(F.size("ctx") == 4)
    rows = x.select("ctx", "vec").orderBy(F.xxhash64("vec_id", F.lit(0)), "vec_id").limit(TRAIN_ROWS).collect()
    c, y = np.array([r["ctx"] for r in rows], float), np.array([r["vec"] for r in rows], float)
    p, losses = training.train_gru(c, y, epochs=8)
    drawn = training.sample_gru(p, c[:50], 5, noise=0.01)
    return spark.createDataFrame([(float(losses[-1]), float(((c[:, -1] - y) ** 2).mean()), float(drawn.std()))], "model_error double, last_error double, drawn_std double")


@query()
def network_forward(spark: SparkSession, sf: str) -> DataFrame:
    """A network with fixed weights over all boards: the best move, the value, and a tapped block's channel means."""
    from wayline.operators import network
    from wayline.plans.board_queries import encoded_boards
    from wayline.sources import weights

    text = "\n".join(["1", *(" ".join(str(((k * 31 + i * 17) % 101 - 50) / 1010 if not name.endswith("var") else 1.0) for i in range(n)) for k, (name, n) in enumerate(weights.line_sizes(2, 4)))])
    x = network.evaluate(encoded_boards(spark, sf), weights.parse(text, 4), 1, ["board_id"])
    return x.select("board_id", "best", F.round("value", 6).alias("value"), F.transform("pooled", lambda a: F.round(a, 6)).alias("pooled"))
