"""Decisions on cases where definitions differ: noise, absorbing states, games, seeds, p-values without the extra one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import gram, inference, kinetics, moments, transitions
from wayline.sources import records


def moves(spark, games):
    rows = [(g, m, s) for g, states in enumerate(games) for m, s in enumerate(states)]
    return spark.createDataFrame(rows, "game_id long, move_number int, state int")


def test_absorbing_states_stay_zero_rows(spark):
    states, c = kinetics.dense(transitions.transition_counts(moves(spark, [[0, 1, 0, 2], [1, 2]])))
    p = kinetics.row_normalise(c)
    assert states == [0, 1, 2] and p[2].sum() == 0 and kinetics.matrix_check(p)["n_absorbing"] == 1
    assert kinetics.stationary(p).sum() == pytest.approx(1)


def test_noise_has_no_value_to_look_up(spark):
    # a value per state: noise and unknown states get null, not that of the last state
    q = spark.createDataFrame([(0, 0.25), (1, 0.75)], "state int, q double")
    got = moves(spark, [[0, -1, 1, 7]]).join(q, "state", "left").orderBy("move_number").collect()
    assert [r.q for r in got] == [0.25, None, 0.75, None]


def test_whole_games_are_sampled(spark):
    from helpers import SF
    from wayline.plans import registry

    kept = {r.user_id: r.n for r in registry.QUERIES["game_sample"](spark, SF).groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    size = {r.user_id: r.n for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert kept and all(size[u] == n for u, n in kept.items())
    # so that transitions of a sample are transitions of the whole
    x = moves(spark, [[0, 1, 1], [1, 0, 1]])
    some = transitions.transition_counts(x.where("game_id = 1")).collect()
    assert {(r.i, r.j): r.n for r in some} == {(1, 0): 1, (0, 1): 1}


def test_lag_goes_across_any_partitions(spark):
    # pairs are by game and move, however rows are dealt, and a game shorter than the lag has none
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    rows = [(i // 20, i % 20, v.tolist()) for i, v in enumerate(x)] + [(9, 0, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "game_id long, move_number int, vec array<double>")
    want = None
    for n in (1, 7):
        got = {(r.i, r.j): r.c for r in gram.lagged_covariance(df.repartition(n), 4).collect()}
        assert want is None or got == pytest.approx(want)
        want = got
    every = np.array([r[2] for r in rows])
    mu = every.mean(axis=0)
    a = np.concatenate([x[g * 20 : g * 20 + 16] for g in range(3)]) - mu
    b = np.concatenate([x[g * 20 + 4 : g * 20 + 20] for g in range(3)]) - mu
    c = a.T @ b / len(a)
    assert want == pytest.approx({(i, j): ((c + c.T) / 2)[i, j] for i in range(3) for j in range(3)})


def test_p_values_with_and_without_one_more(spark):
    # score and outcome alike: no permutation of ten rows reaches that
    games = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)], "game_id long, score double, outcome double")
    got = [inference.permutation_pvalue(games, 50, plus_one=k).first() for k in (False, True)]
    assert [r.p_value for r in got] == pytest.approx([0, 1 / 51]) and got[0].observed == pytest.approx(1)
    down = games.withColumn("outcome", -F.col("outcome"))
    assert inference.permutation_pvalue(down, 50, two_sided=False).first().p_value == 1


def test_seeds_fix_results(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(80)], "id long, score double, label int")
    a, b = (tuple(inference.bootstrap_auc(df.repartition(n), "id", 20).first()) for n in (1, 5))
    assert a == pytest.approx(b)
    x = np.random.default_rng(0).normal(size=(40, 2))
    assert (kinetics.kmeans_rows(x, 3, seed=1) == kinetics.kmeans_rows(x, 3, seed=1)).all()


def test_lengths_of_games_and_of_what_is_encoded():
    text = "(;GM[1]SZ[19];B[aa];W[bb];B[cc];W[dd])"
    info, rows = records.parse_record(text, first=1, last=3)
    assert (info["n_moves"], info["n_encoded"], len(rows)) == (4, 2, 2)
    _, bare = records.parse_record(text, boards_kept=0)
    assert all(r["board"] is None and r["history"] is None for r in bare) and len(bare) == 4
    _, two = records.parse_record(text, boards_kept=2)
    assert [len(r["history"]) for r in two] == [0, 1, 1, 1]


def test_three_normalisations(spark):
    df = spark.createDataFrame([(1, [1.0, 4.0]), (2, [3.0, 4.0])], "id long, vec array<double>")
    by = lambda **k: [(r.mean, r.std) for r in moments.feature_stats(df, **k).orderBy("j").collect()]
    assert by() == [(2.0, pytest.approx(2**0.5)), (4.0, 0.0)]
    assert by(ddof=0, eps=1e-8) == [(2.0, pytest.approx((1 + 1e-8) ** 0.5)), (4.0, pytest.approx(1e-4))]
    z = lambda *a: [r.z for r in moments.zscore(df, moments.feature_stats(df), "vec", *a, "id").orderBy("id", "j").collect()]
    assert z(1e-8, False) == pytest.approx([-1 / (2**0.5 + 1e-8), 0, 1 / (2**0.5 + 1e-8), 0])
    assert z(1e-8, True) == pytest.approx([-1 / (2 + 1e-8) ** 0.5, 0, 1 / (2 + 1e-8) ** 0.5, 0])


def test_folds_are_whole_games(spark):
    from wayline.plans.stats_queries import bucket

    x = moves(spark, [[0, 1, 2]] * 40).withColumn("fold", bucket("game_id", "cv", 5))
    assert x.groupBy("game_id").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
