"""Queries on ordered moves: transitions, windows, divergence, dwell times, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import vectors as v
from wayline.functions.vectors import r6
from wayline.operators import intervals, kinetics, ranks, transitions, windows
from wayline.plans import views
from wayline.plans.board_queries import BOARDS_SQL, stones
from wayline.plans.registry import query
from wayline.plans.views import OUTCOMES_SQL, TRAJ_VEC_SQL, table, traj_state_sql
from wayline.sources import chunks
from wayline.storage import shared_path

TS, TN = traj_state_sql(), traj_state_sql(True)
_PAIRS = f"SELECT game_id, i, j FROM (SELECT game_id, state AS i, lead(state, 1) OVER (PARTITION BY game_id ORDER BY move_number) AS j FROM ({TN})) WHERE j IS NOT NULL"
COUNTS_SQL = f"SELECT i, j, count(*) AS n FROM ({_PAIRS}) WHERE i >= 0 AND j >= 0 GROUP BY i, j"


@query(COUNTS_SQL)
def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return transitions.transition_counts(views.traj_state(spark, sf, noise=True))


@query(f"SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 6) AS p FROM ({COUNTS_SQL})")
def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    p = transitions.row_normalised(transitions.transition_counts(views.traj_state(spark, sf, noise=True)))
    return p.select("i", "j", F.round("p", 6).alias("p"))


@query(f"SELECT g.i, g.j, coalesce(n, 0) AS n FROM (SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j FROM range(5) x(a), range(5) y(b)) g LEFT JOIN ({COUNTS_SQL}) c ON c.i = g.i AND c.j = g.j")
def transition_dense(spark: SparkSession, sf: str) -> DataFrame:
    counts = transitions.transition_counts(views.traj_state(spark, sf, noise=True))
    # every pair of 0 .. the largest state, from one row
    states = F.sequence(F.lit(0), F.greatest(F.max("i"), F.max("j")))
    grid = counts.agg(states.alias("s")).select(F.explode("s").alias("i"), "s").select("i", F.explode("s").alias("j"))
    return grid.join(counts, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH p AS (SELECT i, j, outcome_code AS o FROM ({_PAIRS}) JOIN ({OUTCOMES_SQL}) USING (game_id) WHERE i >= 0 AND j >= 0)
    SELECT coalesce(CASE o WHEN 'B+' THEN 'win' WHEN 'W+' THEN 'loss' END, 'all') AS stratum, i, j, count(*) AS n FROM p GROUP BY GROUPING SETS ((o, i, j), (i, j))""")
def transition_by_outcome(spark: SparkSession, sf: str) -> DataFrame:
    x = transitions.lagged_pairs(views.traj_state(spark, sf, noise=True)).where("i >= 0 and j >= 0")
    p = x.join(views.outcomes(spark, sf), "game_id").withColumn("o", F.when(F.col("outcome_code") == "B+", "win").otherwise("loss"))
    n = p.groupBy("o", "i", "j").agg(F.count("*").alias("n"))
    both = n.unionByName(n.groupBy("i", "j").agg(F.sum("n").alias("n")).withColumn("o", F.lit("all")))
    return both.select(F.col("o").alias("stratum"), "i", "j", "n")


@query("SELECT lag, i, j, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {k} AS lag, state AS i, lead(state, {k}) OVER (PARTITION BY game_id ORDER BY move_number) AS j FROM ({TN})" for k in (1, 2, 5, 10)) + ") WHERE i >= 0 AND j >= 0 GROUP BY lag, i, j")
def counts_multi_lag(spark: SparkSession, sf: str) -> DataFrame:
    """All lags in one pass: one window node, then one narrow explode."""
    x = views.traj_state(spark, sf, noise=True)
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), F.lead("state", k).over(windows.game()).alias("j")) for k in (1, 2, 5, 10)))
    e = x.select("game_id", "move_number", F.col("state").alias("i"), pairs.alias("p")).select("i", F.explode("p").alias("p")).select("p.lag", "i", "p.j")
    return e.where("i >= 0 and j >= 0").groupBy("lag", "i", "j").agg(F.count("*").alias("n"))


_RUNS = f"""SELECT game_id, state, min(move_number) AS start, count(*) AS length FROM (SELECT *, sum(changed) OVER (PARTITION BY game_id ORDER BY move_number ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY game_id ORDER BY move_number) THEN 0 ELSE 1 END AS changed FROM ({TN}))) WHERE state >= 0 GROUP BY game_id, run, state"""


@query(_RUNS)
def dwell_times(spark: SparkSession, sf: str) -> DataFrame:
    return windows.dwell_times(views.traj_state(spark, sf, noise=True)).select("game_id", "state", "start", "length")


@query(f"SELECT state, count(*) AS n_runs, round(avg(length), 6) AS mean, round(stddev_pop(length), 6) + 0.0 AS std FROM ({_RUNS}) GROUP BY state")
def dwell_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = windows.dwell_times(views.traj_state(spark, sf, noise=True))
    return d.groupBy("state").agg(F.count("*").alias("n_runs"), F.round(F.avg("length"), 6).alias("mean"), r6(F.stddev_pop("length")).alias("std"))


@query(f"SELECT game_id, move_number, round(move_number / greatest(count(*) OVER (PARTITION BY game_id), 1), 6) + 0.0 AS phase FROM ({TS})")
def game_phase(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("game_id"))
    return views.traj_state(spark, sf).select("game_id", "move_number", r6(F.col("move_number") / F.greatest(n, F.lit(1))).alias("phase"))


@query("SELECT count(*) AS n, CAST(coalesce(sum(CAST(d <> 1 AS INTEGER)), 0) AS BIGINT) AS jumps, CAST(coalesce(sum(CAST(d < 0 AS INTEGER)), 0) AS BIGINT) AS backwards FROM (SELECT turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM conversations) WHERE d IS NOT NULL")
def sequential_moves(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = table(spark, sf, "conversations").select(d.alias("d")).where("d is not null")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("d") != 1).alias("jumps"), F.count_if(F.col("d") < 0).alias("backwards"))


def _lists(sql: str) -> str:
    """Divergence of a vector table (keys, vec) in SQL, w = 5."""
    return f"""SELECT game_id, move_number, vec_id, CASE WHEN b IS NULL OR a IS NULL THEN NULL WHEN nb < 1e-8 OR na < 1e-8 THEN 0 ELSE 1 - list_dot_product(db, da) / (nb * na) END AS divergence
    FROM (SELECT *, sqrt(list_dot_product(db, db)) AS nb, sqrt(list_dot_product(da, da)) AS na FROM (
        SELECT *, list_transform(range(1, 65), lambda k: vec[k] - coalesce(b, vec)[k]) AS db, list_transform(range(1, 65), lambda k: coalesce(a, vec)[k] - vec[k]) AS da FROM (
            SELECT *, lag(vec, 5) OVER w AS b, lead(vec, 5) OVER w AS a FROM ({sql}) WINDOW w AS (PARTITION BY game_id ORDER BY move_number))))"""


DIV_SQL = _lists(TRAJ_VEC_SQL)


@query(f"SELECT game_id, move_number, round(divergence, 6) + 0.0 AS divergence FROM ({DIV_SQL})")
def trajectory_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return windows.divergence(views.traj_vec(spark, sf)).select("game_id", "move_number", r6(F.col("divergence")).alias("divergence"))


@query(f"SELECT round(quantile_cont(divergence, 0.95), 6) AS threshold FROM ({DIV_SQL}) WHERE divergence IS NOT NULL")
def divergence_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return windows.threshold(windows.divergence(views.traj_vec(spark, sf)), "divergence", 0.95).select(F.round("threshold", 6).alias("threshold"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return windows.divergence(views.traj_vec(spark, sf)).withColumn("idx", F.col("vec_id"))


_GREEDY = """WITH RECURSIVE d AS ({div}), c AS (SELECT vec_id AS idx, game_id, move_number, divergence AS score, row_number() OVER ({part} ORDER BY divergence DESC, vec_id) AS rk FROM d
        WHERE divergence > (SELECT quantile_cont(divergence, 0.95) FROM d WHERE divergence IS NOT NULL)),
    w AS (SELECT DISTINCT {g} AS g, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS taken, false AS ok, CAST(NULL AS BIGINT) AS idx FROM c
          UNION ALL SELECT w.g, c.rk, CASE WHEN {fits} THEN list_append(w.taken, c.idx) ELSE w.taken END, {fits}, c.idx FROM w JOIN c ON c.rk = w.rk + 1 AND {g2} = w.g)
    SELECT c.idx, c.game_id, c.move_number, round(c.score, 6) + 0.0 AS score FROM w JOIN c ON c.idx = w.idx WHERE w.ok"""


@query(_GREEDY.format(div=DIV_SQL, part="", g="0", g2="0", fits="(len(w.taken) = 0 OR c.idx - w.taken[len(w.taken)] >= 5)"))
def bifurcations(spark: SparkSession, sf: str) -> DataFrame:
    return windows.bifurcations(_scored(spark, sf)).withColumn("score", r6(F.col("score")))


@query(_GREEDY.format(div=DIV_SQL, part="PARTITION BY game_id", g="game_id", g2="c.game_id", fits="(len(list_filter(w.taken, lambda y: abs(y - c.idx) < 5)) = 0)"))
def bifurcations_nms(spark: SparkSession, sf: str) -> DataFrame:
    return windows.bifurcations(_scored(spark, sf), mode="nms").withColumn("score", r6(F.col("score")))


_CUT = f"SELECT d.*, (SELECT quantile_cont(divergence, 0.95) FROM ({DIV_SQL}) WHERE divergence IS NOT NULL) AS cut FROM ({DIV_SQL}) d"
_GAMES = f"SELECT game_id, count(*) AS moves, CAST(sum(CAST(divergence > cut AS INTEGER)) AS BIGINT) AS n_bif, avg(divergence) AS mean_div, max(divergence) AS max_div FROM ({_CUT}) GROUP BY game_id HAVING max(divergence) IS NOT NULL"


def _games(spark: SparkSession, sf: str) -> DataFrame:
    d = windows.divergence(views.traj_vec(spark, sf)).select("game_id", "divergence")
    x = d.crossJoin(F.broadcast(windows.threshold(d, "divergence", 0.95)))
    g = x.groupBy("game_id").agg(F.count("*").alias("moves"), F.count_if(F.col("divergence") > F.col("threshold")).alias("n_bif"), F.avg("divergence").alias("mean_div"), F.max("divergence").alias("max_div"))
    return g.where("max_div is not null")


@query(f"SELECT game_id, moves, n_bif, round(n_bif / moves, 6) + 0.0 AS rate, round(mean_div, 6) AS mean_div, round(max_div, 6) AS max_div FROM ({_GAMES})")
def game_divergence_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _games(spark, sf).select("game_id", "moves", "n_bif", r6(F.col("n_bif") / F.col("moves")).alias("rate"), F.round("mean_div", 6).alias("mean_div"), F.round("max_div", 6).alias("max_div"))


_BY_LABEL = f"SELECT game_id, CAST(avg(label) > 4.5 AS INTEGER) AS outcome FROM ({TRAJ_VEC_SQL}) GROUP BY game_id"


@query(f"""WITH g AS (SELECT game_id, n_bif, max_div FROM ({_GAMES})), z AS (SELECT game_id, ((n_bif - avg(n_bif) OVER ()) / (stddev_pop(n_bif) OVER () + 1e-8) + (max_div - avg(max_div) OVER ()) / (stddev_pop(max_div) OVER () + 1e-8)) / 2 AS score FROM g)
    SELECT round(corr(score, outcome), 6) + 0.0 AS corr, count(*) AS n FROM z JOIN ({_BY_LABEL}) USING (game_id)""")
def bifurcation_outcome_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Score of a game against its outcome (whether its labels' mean is above 4.5); the moments are one row, broadcast."""
    g = _games(spark, sf)
    m = g.agg(F.avg("n_bif").alias("ma"), F.stddev_pop("n_bif").alias("sa"), F.avg("max_div").alias("mb"), F.stddev_pop("max_div").alias("sb"))
    z = g.crossJoin(F.broadcast(m)).select("game_id", (((F.col("n_bif") - F.col("ma")) / (F.col("sa") + 1e-8) + (F.col("max_div") - F.col("mb")) / (F.col("sb") + 1e-8)) / 2).alias("score"))
    won = views.traj_vec(spark, sf).groupBy("game_id").agg((F.avg("label") > 4.5).cast("double").alias("outcome"))
    live = (F.stddev_pop("score") > 0) & (F.stddev_pop("outcome") > 0)
    return z.join(won, "game_id").agg(r6(F.when(live, F.corr("score", "outcome"))).alias("corr"), F.count("*").alias("n"))


@query(f"""SELECT game_id, move_number, list(x ORDER BY m) AS around FROM (SELECT a.game_id, a.move_number, b.x, b.move_number AS m FROM ({TS}) a JOIN ({TS}) b ON a.game_id = b.game_id AND abs(a.move_number - b.move_number) <= 10 WHERE a.state = 2) GROUP BY ALL""")
def event_context(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_state(spark, sf).withColumn("around", windows.context("x", 10, 10))
    return x.where("state = 2").select("game_id", "move_number", "around")


@query(f"SELECT game_id, move_number, ctx, state AS target FROM (SELECT *, list(state) OVER (PARTITION BY game_id ORDER BY move_number ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ctx FROM ({TS})) WHERE len(ctx) = 4")
def context_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ctx = windows.context("state", 4, -1)
    return views.traj_state(spark, sf).withColumn("ctx", ctx).where(F.size("ctx") == 4).select("game_id", "move_number", "ctx", F.col("state").alias("target"))


@query(f"""WITH x AS (SELECT game_id, move_number, row_number() OVER (PARTITION BY game_id ORDER BY move_number) - 1 AS i, count(*) OVER (PARTITION BY game_id) AS n FROM ({TS})),
    p AS (SELECT DISTINCT game_id, (k * (n - 1)) // 19 AS i FROM (SELECT DISTINCT game_id, n FROM x), range(20) r(k) WHERE n > 20)
    SELECT game_id, move_number FROM x WHERE n <= 20 UNION ALL SELECT x.game_id, x.move_number FROM x JOIN p ON p.game_id = x.game_id AND p.i = x.i""")
def even_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return windows.even_subsample(views.traj_state(spark, sf), 20).select("game_id", "move_number")


_BOARDS = f"SELECT board_id, list(CAST((r * 19 + c) * 3 + stone AS INTEGER) ORDER BY r, c) AS b FROM ({BOARDS_SQL}) GROUP BY board_id"


@query(f"SELECT board_id, " + ", ".join(f"lag(b, {t}) OVER (PARTITION BY board_id // 10 ORDER BY board_id) AS h{t}" for t in range(1, 8)) + f" FROM ({_BOARDS})")
def history_stack(spark: SparkSession, sf: str) -> DataFrame:
    """The seven boards before each in its game of ten, newest first; a board is its stones as point * 3 + colour."""
    b = stones(spark, sf).groupBy("board_id").agg(F.sort_array(F.collect_list(((F.col("r") * 19 + F.col("c")) * 3 + F.col("stone")).cast("int"))).alias("b"))
    w = Window.partitionBy(F.expr("board_id div 10")).orderBy("board_id")
    return b.select("board_id", *(F.lag("b", t).over(w).alias(f"h{t}") for t in range(1, 8)))


@query(f"SELECT game_id, move_number, label FROM (SELECT * FROM ({TRAJ_VEC_SQL}) WHERE game_id = 2) ORDER BY move_number")
def game_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """One game's rows in order: the key filter reaches the scan as a range of ids."""
    e = table(spark, sf, "embeddings").where("vec_id >= 200 and vec_id < 300")
    return e.select(F.expr("vec_id div 100").alias("game_id"), F.expr("cast(vec_id % 100 as int)").alias("move_number"), "label").orderBy("move_number")


_EPOCH = "CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || 'e1'), 1, 13) AS BIGINT)"


@query(f"""WITH x AS (SELECT vec_id, j, vec[j] AS v FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({TRAJ_VEC_SQL}))), s AS (SELECT j, avg(v) AS m, stddev_samp(v) AS d FROM x GROUP BY j),
    p AS (SELECT vec_id, row_number() OVER (ORDER BY {_EPOCH}, vec_id) - 1 AS place FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings) WHERE row >= 100 AND row < 300 AND row % 7 IN (0, 3))
    SELECT vec_id, place, CAST(j - 1 AS INTEGER) AS feature, round((v - m) / (d + 1e-8), 5) + 0.0 AS z FROM x JOIN s USING (j) JOIN p USING (vec_id)""")
def indexed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen rows of a folder of chunks, all features normalised by the whole table's moments, in the order of an epoch that a seed fixes. The range of rows reaches the files; ranks are of the chosen rows, by buckets."""
    path = shared_path(spark, "scan")
    chunks.write_chunks(views.traj_vec(spark, sf).select(F.lit("all").alias("layer"), F.col("vec_id").alias("sample_id"), "vec"), path, 100)
    x = chunks.read_chunks(spark, path)
    m = x.select(F.posexplode("vec").alias("feature", "v")).groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("d"))
    some = chunks.read_chunks(spark, path, rows=(100, 300)).where("row % 7 in (0, 3)").select(F.col("sample_id").alias("vec_id"), "vec")
    some = some.withColumn("h", F.conv(F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("e1"))), 1, 13), 16, 10).cast("long"))
    placed = ranks.running(some, "h", F.lit(1), "place", ties=["vec_id"]).withColumn("place", F.coalesce("place", F.lit(0)).cast("long"))
    y = placed.select("vec_id", "place", F.posexplode("vec").alias("feature", "v")).join(m, "feature")
    return y.select("vec_id", "place", "feature", (F.round((F.col("v") - F.col("m")) / (F.col("d") + 1e-8), 5) + 0.0).alias("z"))


@query(f"SELECT label, CAST(j - 1 AS INTEGER) AS j, count(*) AS n, round(avg(vec[j]), 6) + 0.0 AS mean FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({TRAJ_VEC_SQL})) GROUP BY label, j")
def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_vec(spark, sf).select("label", F.posexplode("vec").alias("j", "x"))
    return x.groupBy("label", "j").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"))


@query(f"SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({TN}) GROUP BY state")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = views.traj_state(spark, sf, True).groupBy("state").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("state", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


_DRIFT = f"""SELECT label AS state, CAST(j - 1 AS INTEGER) AS j, count(*) AS n, avg(d) AS drift, greatest(var_pop(d), 0) AS var FROM (
    SELECT label, j, nxt[j] - vec[j] AS d FROM (SELECT *, unnest(range(1, 65)) AS j FROM (SELECT *, lead(vec) OVER (PARTITION BY game_id ORDER BY move_number) AS nxt FROM ({TRAJ_VEC_SQL})) WHERE nxt IS NOT NULL AND label >= 0)) GROUP BY label, j"""


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    x = views.traj_vec(spark, sf).withColumn("nxt", F.lead("vec").over(windows.game())).where("nxt is not null and label >= 0")
    d = x.select(F.col("label").alias("state"), F.posexplode(v.minus(F.col("nxt"), F.col("vec"))).alias("j", "d"))
    return d.groupBy("state", "j").agg(F.count("*").alias("n"), F.avg("d").alias("drift"), F.greatest(F.var_pop("d"), F.lit(0.0)).alias("var"))


@query(f"SELECT state, j, n, round(drift, 6) + 0.0 AS drift FROM ({_DRIFT})")
def drift_field(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).select("state", "j", "n", r6(F.col("drift")).alias("drift"))


@query(f"SELECT state, max(n) AS n, round(sqrt(sum(drift * drift)), 6) + 0.0 AS magnitude, round(CASE WHEN max(n) > 1 THEN avg(var) ELSE 0 END, 6) + 0.0 AS diffusion, max(n) >= 10 AS covered FROM ({_DRIFT}) GROUP BY state")
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = _drift(spark, sf).groupBy("state").agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("drift") * F.col("drift"))).alias("m"), F.avg("var").alias("d"))
    return g.select("state", "n", r6(F.col("m")).alias("magnitude"), r6(F.when(F.col("n") > 1, F.col("d")).otherwise(0.0)).alias("diffusion"), (F.col("n") >= 10).alias("covered"))


_SOFT = "SELECT CAST(macro AS INTEGER) AS macro, d.*, CASE macro WHEN 0 THEN (state + 1) / (state + 3.0) ELSE 2 / (state + 3.0) END AS m FROM range(2) t(macro), ({}) d"


@query(f"SELECT macro, j, round(sum(m * n * drift) / sum(m * n), 6) + 0.0 AS drift, round(sum(m * n), 6) + 0.0 AS weight FROM ({_SOFT.format(_DRIFT)}) GROUP BY macro, j")
def macro_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Drift of two macrostates with soft memberships, each state's part weighted by its membership and its rows."""
    s = F.col("state")
    member = F.array(F.struct(F.lit(0).alias("macro"), ((s + 1) / (s + 3)).alias("m")), F.struct(F.lit(1).alias("macro"), (2 / (s + 3)).alias("m")))
    d = _drift(spark, sf).withColumn("x", F.explode(member)).withColumn("w", F.col("x.m") * F.col("n"))
    g = d.groupBy(F.col("x.macro").alias("macro"), "j").agg(F.sum(F.col("w") * F.col("drift")).alias("s"), F.sum("w").alias("w"))
    return g.select("macro", "j", r6(F.col("s") / F.col("w")).alias("drift"), r6(F.col("w")).alias("weight"))


_PI = f"SELECT label AS state, count(*) / sum(count(*)) OVER () AS pi FROM ({TRAJ_VEC_SQL}) WHERE label >= 0 GROUP BY label"


@query(f"SELECT state, j, round(drift * pi, 8) + 0.0 AS current, round(-0.5 * ln(pi + 1e-10), 6) + 0.0 AS potential FROM ({_DRIFT}) JOIN ({_PI}) USING (state)")
def probability_current(spark: SparkSession, sf: str) -> DataFrame:
    """Drift times occupation by component, and the potential at temperature 0.5."""
    n = views.traj_vec(spark, sf).where("label >= 0").groupBy(F.col("label").alias("state")).agg(F.count("*").alias("c"))
    pi = n.crossJoin(F.broadcast(n.agg(F.sum("c").alias("t")))).select("state", (F.col("c") / F.col("t")).alias("pi"))
    x = _drift(spark, sf).join(pi, "state")
    return x.select("state", "j", (F.round(F.col("drift") * F.col("pi"), 8) + 0.0).alias("current"), r6(-0.5 * F.ln(F.col("pi") + 1e-10)).alias("potential"))


_CONCEPTS = {"high_first": ("vec[1] > 0", "vec[0] > 0"), "early": ("move_number < 33", "move_number < 33"), "even": ("vec_id % 2 = 0", "vec_id % 2 = 0")}


@query("SELECT label, count(*) AS n, " + ", ".join(f"round(avg(CAST({q} AS INTEGER)), 6) + 0.0 AS {k}" for k, (q, _) in _CONCEPTS.items()) + f" FROM ({TRAJ_VEC_SQL}) GROUP BY label")
def cluster_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each concept holds in each cluster."""
    return views.traj_vec(spark, sf).groupBy("label").agg(F.count("*").alias("n"), *(r6(F.avg(F.expr(e).cast("int"))).alias(k) for k, (_, e) in _CONCEPTS.items()))


@query(f"""WITH p AS (SELECT j, vec[j] AS a, nxt[j] AS b FROM (SELECT *, unnest(range(1, 65)) AS j FROM (SELECT *, lead(vec) OVER (PARTITION BY game_id ORDER BY move_number) AS nxt FROM ({TRAJ_VEC_SQL})) WHERE nxt IS NOT NULL)),
    r AS (SELECT j, corr(a, b) AS lam FROM p GROUP BY j) SELECT CAST(j - 1 AS INTEGER) AS j, round(lam, 6) + 0.0 AS autocorrelation, round(CASE WHEN lam > 0 AND lam < 1 THEN -1 / ln(lam) END, 4) AS timescale FROM r""")
def timescale_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each component's time scale from its correlation with itself one move on; null where that isn't between 0 and 1 (an infinite one)."""
    x = views.traj_vec(spark, sf).withColumn("nxt", F.lead("vec").over(windows.game())).where("nxt is not null")
    p = x.select(F.posexplode(F.arrays_zip(F.col("vec").alias("a"), F.col("nxt").alias("b"))).alias("j", "p")).groupBy("j").agg(F.corr("p.a", "p.b").alias("lam"))
    return p.select("j", r6(F.col("lam")).alias("autocorrelation"), F.round(F.nullif(v.implied_timescale(F.col("lam"), 1), F.lit(float("inf"))), 4).alias("timescale"))


@query(f"""WITH x AS (SELECT CAST(j - 1 AS INTEGER) AS j, var_pop(vec[j]) AS lam FROM (SELECT *, unnest(range(1, 65)) AS j FROM ({TRAJ_VEC_SQL})) GROUP BY j), r AS (SELECT j, lam, lead(lam) OVER (ORDER BY lam DESC, j) AS nxt, CAST(row_number() OVER (ORDER BY lam DESC, j) AS INTEGER) AS rank FROM x),
    g AS (SELECT *, lam - nxt AS gap, row_number() OVER (ORDER BY lam - nxt DESC NULLS LAST, rank) AS o FROM r)
    SELECT rank, j, round(gap, 6) + 0.0 AS gap, round(CASE WHEN nxt > 0 THEN lam / nxt END, 6) AS ratio, o <= 5 AND gap IS NOT NULL AS suggested FROM g""")
def eigen_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps and ratios of the sorted variances of components, and the five largest gaps, which suggest where to cut; d rows."""
    x = views.traj_vec(spark, sf).select(F.posexplode("vec").alias("j", "v")).groupBy("j").agg(F.var_pop("v").alias("lam"))
    w = Window.orderBy(F.desc("lam"), "j")
    r = x.select("j", "lam", F.lead("lam").over(w).alias("nxt"), F.row_number().over(w).alias("rank")).withColumn("gap", F.col("lam") - F.col("nxt"))
    o = F.row_number().over(Window.orderBy(F.desc_nulls_last("gap"), "rank"))
    return r.select("rank", "j", r6(F.col("gap")).alias("gap"), F.round(F.when(F.col("nxt") > 0, F.col("lam") / F.col("nxt")), 6).alias("ratio"), ((o <= 5) & F.col("gap").isNotNull()).alias("suggested"))


@query(f"""WITH c AS (SELECT i, j, n FROM ({COUNTS_SQL})), s AS (SELECT i AS state FROM c UNION SELECT j FROM c), r AS (SELECT state, sum(n) AS t FROM s LEFT JOIN c ON c.i = s.state GROUP BY state)
    SELECT (SELECT count(*) FROM s) AS n_states, (SELECT count(*) FROM r WHERE t IS NULL) AS n_absorbing, (SELECT count(*) FROM s) = (SELECT count(*) FROM r) AS square, round((SELECT max(abs(p - 1)) FROM (SELECT sum(n / t) AS p FROM c JOIN r ON r.state = c.i GROUP BY c.i)), 9) + 0.0 AS deviation""")
def matrix_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of the transition matrix: its states, those that lead nowhere (their rows stay zero), and how far other rows are from adding up to 1."""
    found = kinetics.matrix_check(kinetics.row_normalise(kinetics.dense(transitions.transition_counts(views.traj_state(spark, sf, True)))[1]))
    return spark.createDataFrame([(found["n_states"], found["n_absorbing"], found["square"], round(found["deviation"], 9) + 0.0)], "n_states long, n_absorbing long, square boolean, deviation double")


@query(f"WITH s AS (SELECT state, avg(x) AS q FROM ({TS}) WHERE state <> 4 GROUP BY state) SELECT t.game_id, t.move_number, round(s.q, 6) + 0.0 AS q FROM ({TN}) t LEFT JOIN s ON s.state = t.state")
def state_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A value per state looked up for every move; states without one, noise too, get null."""
    q = views.traj_state(spark, sf).where("state <> 4").groupBy("state").agg(F.avg("x").alias("q"))
    return views.traj_state(spark, sf, True).join(q, "state", "left").select("game_id", "move_number", r6(F.col("q")).alias("q"))


@query(f"SELECT g.game_id, g.first_id, g.last_id, count(e.vec_id) AS n_inside FROM (SELECT game_id, min(vec_id) AS first_id, max(vec_id) AS last_id FROM ({TRAJ_VEC_SQL}) GROUP BY game_id) g LEFT JOIN (SELECT vec_id FROM embeddings WHERE label = 3) e ON e.vec_id >= g.first_id AND e.vec_id <= g.last_id GROUP BY ALL")
def interval_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Events inside of a game's index interval, by the interval join."""
    x = views.traj_vec(spark, sf)
    games = x.groupBy("game_id").agg(F.min("vec_id").alias("first_id"), (F.max("vec_id") + 1).alias("end_id"))
    inside = intervals.contained(x.where("label = 3").select("vec_id"), games, "vec_id", "first_id", "end_id", 100)
    n = inside.groupBy("game_id").agg(F.count("*").alias("n"))
    return games.join(n, "game_id", "left").select("game_id", "first_id", (F.col("end_id") - 1).alias("last_id"), F.coalesce("n", F.lit(0)).alias("n_inside"))


_DAYS = "SELECT user_id, day, day + 1 + user_id % 5 AS until FROM (SELECT user_id, min(CAST(floor(epoch(ts) / 86400) AS BIGINT)) AS day FROM events GROUP BY user_id)"


@query(f"SELECT i.user_id, count(*) AS n FROM ({_DAYS}) i JOIN (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events) e ON e.day >= i.day AND e.day < i.until GROUP BY i.user_id")
def events_in_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """All events in the first days of each user: intervals of one to five days that overlap."""
    e = table(spark, sf, "events").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("day"))
    days = e.groupBy("user_id").agg(F.min("day").alias("first")).withColumn("until", F.col("first") + 1 + F.col("user_id") % 5)
    by_day = e.groupBy("day").agg(F.count("*").alias("m"))
    return intervals.contained(by_day, days, "day", "first", "until", 4).groupBy("user_id").agg(F.sum("m").alias("n"))


# ---------------------------------------------------------------- kinetics on k x k tables

_P = f"SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p FROM ({COUNTS_SQL})"


@query(f"""WITH a AS (SELECT x.i, y.j, sum(x.p * y.p) AS p2 FROM ({_P}) x JOIN ({_P}) y ON x.j = y.i GROUP BY x.i, y.j),
    c2 AS (SELECT i, j, count(*) AS n FROM (SELECT state AS i, lead(state, 2) OVER (PARTITION BY game_id ORDER BY move_number) AS j FROM ({TN})) WHERE i >= 0 AND j >= 0 GROUP BY i, j),
    b AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p FROM c2), k AS (SELECT count(DISTINCT i) AS k FROM ({COUNTS_SQL}))
    SELECT round(sqrt(sum((coalesce(p2, 0) - coalesce(p, 0)) ** 2) / max(k * k)), 6) + 0.0 AS rmse FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j, k""")
def ck_rmse_k2(spark: SparkSession, sf: str) -> DataFrame:
    """Chapman-Kolmogorov at two steps: P squared against the matrix at lag 2."""
    x = views.traj_state(spark, sf, True)
    p1 = transitions.row_normalised(transitions.transition_counts(x))
    p2 = transitions.row_normalised(transitions.transition_counts(x, 2)).withColumnRenamed("p", "direct")
    sq = p1.alias("a").join(p1.alias("b"), F.col("a.j") == F.col("b.i")).groupBy(F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.p") * F.col("b.p")).alias("p2"))
    k = p1.agg(F.count_distinct("i").alias("k"))
    e = sq.join(p2, ["i", "j"], "full").select(F.pow(F.coalesce("p2", F.lit(0.0)) - F.coalesce("direct", F.lit(0.0)), 2).alias("e"))
    return e.crossJoin(F.broadcast(k)).agg(r6(F.sqrt(F.sum("e") / F.max(F.col("k") * F.col("k")))).alias("rmse"))


_ALL = f"SELECT i, j, count(*) AS n FROM ({_PAIRS}) GROUP BY i, j"


@query(f"SELECT i, j, round(n / sum(n) OVER () - (sum(n) OVER (PARTITION BY i) / sum(n) OVER ()) * (sum(n) OVER (PARTITION BY j) / sum(n) OVER ()), 6) + 0.0 AS c0t FROM ({_ALL})")
def vamp_covariances(spark: SparkSession, sf: str) -> DataFrame:
    """Indicator covariances from counts; noise is a state here. Windows run over k x k rows."""
    n = transitions.lagged_pairs(views.traj_state(spark, sf, True)).groupBy("i", "j").agg(F.count("*").alias("n"))
    r, c = n.groupBy("i").agg(F.sum("n").alias("r")), n.groupBy("j").agg(F.sum("n").alias("c"))
    t = n.agg(F.sum("n").alias("t"))
    x = n.join(r, "i").join(c, "j").crossJoin(F.broadcast(t))
    return x.select("i", "j", r6(F.col("n") / F.col("t") - F.col("r") / F.col("t") * (F.col("c") / F.col("t"))).alias("c0t"))


@query(f"SELECT round(sum(n * n / (r * c)) - 1, 6) + 0.0 AS vamp2 FROM (SELECT n, sum(n) OVER (PARTITION BY i) AS r, sum(n) OVER (PARTITION BY j) AS c FROM ({_ALL}))")
def vamp2_score(spark: SparkSession, sf: str) -> DataFrame:
    n = transitions.lagged_pairs(views.traj_state(spark, sf, True)).groupBy("i", "j").agg(F.count("*").alias("n"))
    r, c = n.groupBy("i").agg(F.sum("n").alias("r")), n.groupBy("j").agg(F.sum("n").alias("c"))
    x = n.join(r, "i").join(c, "j")
    return x.agg(r6(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("r").cast("double") * F.col("c"))) - 1).alias("vamp2"))


@query(f"""WITH p AS ({_P}), m AS (SELECT i AS state, CAST(i % 2 AS INTEGER) AS a FROM (SELECT DISTINCT i FROM p)), w AS (SELECT i, sum(n) / sum(sum(n)) OVER () AS pi FROM ({COUNTS_SQL}) GROUP BY i)
    SELECT x.a AS a, y.a AS b, round(sum(w.pi * p.p) / any_value(t.s), 6) + 0.0 AS p FROM p JOIN m x ON x.state = p.i JOIN m y ON y.state = p.j JOIN w ON w.i = p.i JOIN (SELECT m.a, sum(pi) AS s FROM w JOIN m ON m.state = w.i GROUP BY m.a) t ON t.a = x.a GROUP BY x.a, y.a""")
def coarse_transition(spark: SparkSession, sf: str) -> DataFrame:
    """Macrostates (here parity), weighted by occupation."""
    n = transitions.transition_counts(views.traj_state(spark, sf, True)).withColumn("a", (F.col("i") % 2).cast("int")).withColumn("b", (F.col("j") % 2).cast("int"))
    # occupation-weighted rows of P add up to counts
    g = n.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return g.join(g.groupBy("a").agg(F.sum("n").alias("t")), "a").select("a", "b", r6(F.col("n") / F.col("t")).alias("p"))


@query(f"SELECT state, round(-ln(n / sum(n) OVER () + 1e-10), 6) + 0.0 AS potential FROM (SELECT state, count(*) AS n FROM ({TN}) WHERE state >= 0 GROUP BY state)")
def potential_energy(spark: SparkSession, sf: str) -> DataFrame:
    n = views.traj_state(spark, sf, True).where("state >= 0").groupBy("state").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("state", r6(-F.ln(F.col("n") / F.col("t") + 1e-10)).alias("potential"))
