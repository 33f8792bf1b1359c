"""Running sums, ranks and quantiles over many buckets, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import inference, ranks, windows


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 20)
    monkeypatch.setattr(ranks, "QUANTILE_ROWS", 15)


def rows(seed, n=400):
    r = random.Random(seed)
    return [(r.choice("ab"), float(r.choice([r.randint(0, 9), r.gauss(0, 5)])), i, r.randint(0, 1)) for i in range(n)]


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running(spark, small, how):
    data = rows(1)
    got = ranks.running(spark.createDataFrame(data, "g string, x double, i int, y int"), "x", F.col("i"), "before", ["g"], ["i"], how).collect()
    fold = sum if how == "sum" else max
    for r in got:
        less = [i for g, x, i, _ in data if g == r.g and (x, i) < (r.x, r.i)]
        assert r.before == (fold(less) if less else None)
    assert len(got) == len(data)


@pytest.mark.parametrize("share", [0, 0.05, 0.5, 0.95, 1])
def test_quantile(spark, small, share):
    for values in ([x for _, x, _, _ in rows(2)], [1.0] * 50, [0.0] * 100 + [1e9] * 3 + [0.5], [7.0]):
        df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
        assert ranks.quantile(df, "x", share).first()[0] == pytest.approx(np.quantile(values, share))
    assert ranks.quantile(spark.createDataFrame([], "x double"), "x", share).first()[0] is None


def test_auc_over_buckets(spark, small):
    data = rows(3)
    got = {r.g: r.auc for r in inference.auc(spark.createDataFrame(data, "g string, score double, i int, label int"), ["g"]).collect()}
    for g in "ab":
        pos, neg = ([x for h, x, _, y in data if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))


def test_hash_rank(spark, small):
    df = spark.range(300).crossJoin(spark.range(2).withColumnRenamed("id", "run"))
    got = ranks.hash_rank(df, "id", F.col("run"), "rk", ["run"]).collect()
    for run in range(2):
        assert sorted(r.rk for r in got if r.run == run) == list(range(300))
    assert [r.rk for r in sorted(got) if r.run == 0] != [r.rk for r in sorted(got) if r.run == 1]


@pytest.mark.parametrize("seed", range(3))
def test_walk_over_records_is_the_whole_walk(spark, small, seed):
    r = random.Random(seed)
    data = [(i, i // 50, i % 50, r.choice([r.random(), 0.5])) for i in range(300)]
    df = spark.createDataFrame(data, "idx long, game_id long, move_number int, divergence double")
    got = sorted(x.idx for x in windows.bifurcations(df, share=0.3).collect())
    cut, taken = np.quantile([d for *_, d in data], 0.3), []
    for i, _, _, d in sorted(data, key=lambda x: (-x[3], x[0])):
        if d > cut and (not taken or i - taken[-1] >= 5):
            taken.append(i)
    assert got == sorted(taken)
