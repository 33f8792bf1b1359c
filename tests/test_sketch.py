"""Spectra in a sketched basis against the full matrices."""

import numpy as np
import pytest

from wayline.operators import geometry, kinetics, sketch


def frame(spark, x, games):
    rows = [(int(i % games), int(i // games), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "game_id long, move_number int, vec array<double>").repartition(3)


def covariance(x, games, lag):
    y = x - x.mean(axis=0)
    pairs = [(y[g::games][: len(y[g::games]) - lag], y[g::games][lag:]) for g in range(games)]
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    c = a.T @ b / len(a)
    return (c + c.T) / 2


def slow(rng, n, games, d, k):
    """Rows of d columns that k slow processes move, and noise."""
    z = np.zeros((n // games, games, k))
    for t in range(1, n // games):
        z[t] = z[t - 1] * np.linspace(0.97, 0.5, k) + rng.normal(size=(games, k))
    mix = rng.normal(size=(k, d)) * np.linspace(3, 1, k)[:, None]
    return z.reshape(-1, k) @ mix + rng.normal(size=(n, d)) * 1e-5 + 50


@pytest.mark.parametrize("rank", [64, 32])
def test_lags_in_one_pass(spark, rank):
    x = slow(np.random.default_rng(0), 1200, 4, 64, 6)
    s = sketch.spectrum(frame(spark, x, 4), (1, 3), rank, 8)
    assert s.basis.shape[1] <= rank and (rank == 64) == (s.basis.shape[1] == 64)
    assert s.variance == pytest.approx(x.var(axis=0).sum()) and s.mean == pytest.approx(x.mean(axis=0))
    for lag in (1, 3):
        want, _ = kinetics.tica(covariance(x, 4, 0), covariance(x, 4, lag), 4)
        got, _ = kinetics.tica(s.by_lag[0], s.by_lag[lag], 4)
        assert got == pytest.approx(want, abs=1e-4)
    w, _ = geometry.principal(covariance(x, 4, 0), 5)
    assert geometry.principal(s.by_lag[0], 5)[0] == pytest.approx(w, rel=1e-6)


def test_4096_columns(spark):
    x = slow(np.random.default_rng(1), 240, 3, 4096, 5)
    s = sketch.spectrum(frame(spark, x, 3), (1,), directions=12)
    assert s.basis.shape[0] == 4096 and s.basis.shape[1] <= 37
    dual = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / len(x)
    assert geometry.principal(s.by_lag[0], 5)[0] == pytest.approx(dual[:5], rel=1e-4)
    y = (x - x.mean(axis=0)) @ s.basis
    assert s.by_lag[1] == pytest.approx(covariance(y, 3, 1), abs=1e-6 * dual[0])
