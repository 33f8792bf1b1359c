"""Replicates in one pass against the same replicates with a copy of the rows each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import inference


def hashes(df, key):
    rows = df.select(key, F.xxhash64(key)).collect()
    return {r[0]: np.array([r[1]]).view(np.uint64)[0] for r in rows}


@pytest.mark.parametrize("outcomes", [2, 5])
def test_permutations(spark, monkeypatch, outcomes):
    monkeypatch.setattr(inference, "STEP", 50)
    rng = np.random.default_rng(outcomes)
    n, runs = 900, 30
    score, outcome = np.round(rng.normal(size=n), 3), rng.integers(0, outcomes, n).astype(float) * 1.5 - 1
    games = spark.createDataFrame([(i, float(score[i]), float(outcome[i])) for i in range(n)] + [(n, None, 1.0)], "game_id long, score double, outcome double").repartition(3)
    sums, rows = inference.permuted_sums(games, runs)
    assert rows == n
    h = hashes(games.where("score is not null"), "game_id")
    mixed = inference._mixed(np.array([h[i] for i in range(n)]), np.arange(runs, dtype=np.uint64))
    dealt = np.sort(outcome)
    want = {r: float((score[np.argsort(mixed[:, r], kind="stable")] * dealt).sum()) for r in range(runs)}
    assert {r.run: r.s for r in sums.collect()} == pytest.approx(want)
    got = inference.permutation_pvalue(games, runs).first()
    null = np.array([np.corrcoef(score[np.argsort(mixed[:, r], kind="stable")], dealt)[0, 1] for r in range(runs)])
    assert got.p_value == (np.abs(null) >= abs(got.observed)).mean() and got.observed == pytest.approx(np.corrcoef(score, outcome)[0, 1])


def test_nothing_varies(spark):
    games = spark.createDataFrame([(i, 1.0, float(i)) for i in range(5)], "game_id long, score double, outcome double")
    assert tuple(inference.permutation_pvalue(games, 10).first()) == (None, None, 10)


def plain_auc(score, pos, w):
    u = sum(w[i] * w[j] * ((score[i] > score[j]) + (score[i] == score[j]) / 2) for i in np.flatnonzero(pos) for j in np.flatnonzero(~pos))
    both = w[pos].sum() * w[~pos].sum()
    return u / both if both else 0.5


def test_bootstrap(spark, monkeypatch):
    monkeypatch.setattr(inference, "STEP", 7)
    monkeypatch.setattr(inference.ranks, "BUCKET_ROWS", 30)
    rng = np.random.default_rng(1)
    n = 100
    score, pos = rng.integers(0, 12, n).astype(float), rng.random(n) < 0.4
    df = spark.createDataFrame([(i, float(score[i]), int(pos[i])) for i in range(n)], "id long, score double, label int").repartition(3)
    got = inference.bootstrap_aucs(df, "id", 12)
    h = hashes(df, "id")
    u = (inference._mixed(np.array([h[i] for i in range(n)]), np.arange(12, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
    w = np.searchsorted(inference.poisson_cuts(), u.ravel(), "right").reshape(u.shape).astype(float)
    assert got == pytest.approx([plain_auc(score, pos, w[:, r]) for r in range(12)])


def test_draws_have_no_cap():
    cuts = inference.poisson_cuts()
    assert len(cuts) > 15 and cuts[-1] == pytest.approx(1)
    u = np.random.default_rng(0).random(200_000)
    draws = np.searchsorted(cuts, u, "right")
    assert draws.mean() == pytest.approx(1, abs=0.02) and draws.var() == pytest.approx(1, abs=0.03)


def test_scores_are_ranked_once_for_all_shuffles(spark, monkeypatch):
    monkeypatch.setattr(inference.ranks, "BUCKET_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(j, float(rng.integers(0, 60)), [int(v) for v in rng.integers(0, 2, 3)]) for j in range(2) for _ in range(120)]
    df = spark.createDataFrame(rows, "j int, score double, labels array<int>")
    got = {(r.j, r.run): r.auc for r in inference.aucs(df, ["j"], 3).collect()}
    one = {(r.j, r.run): r.auc for r in inference.auc(df.select("j", "score", F.posexplode("labels").alias("run", "label")), ["j", "run"]).collect()}
    assert got == one and len(got) == 6
