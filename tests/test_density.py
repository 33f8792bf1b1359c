"""Exact neighbours, spanning trees and density clusters of all rows, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from helpers import SF

from wayline import storage
from wayline.operators import density, geometry, neighbours
from wayline.plans import registry


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, vec array<double>").repartition(4)


def clustered(seed, n, centres, spread=0.1, copies=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 5)) * 3
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, 5)) * spread * rng.choice([1, 3], (n, 1))
    x[:copies] = x[0]
    return np.round(x, 3)


def plain_near(x, k):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j), r) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[: min(k, len(x) - 1)], 1)}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 45)
    monkeypatch.setattr(neighbours, "MOST_ROWS", 60)


def test_nearest_is_exact_and_prunes(spark, small):
    x = clustered(1, 400, 8, 0.02, copies=60)
    index = neighbours.build(frame(spark, x))
    assert sorted(r.vec_id for r in index.rows.collect()) == list(range(400)) and index.sizes.max() < 150
    got, share = neighbours.nearest(index, 7)
    assert {(r.a, r.b, r.rk) for r in got.collect()} == plain_near(x, 7)
    assert share < 0.4
    pairs = [(r.i, r.j) for r in neighbours.near_pairs(index).collect()]
    assert len(pairs) == len(set(pairs)) and all(i <= j for i, j in pairs)


def test_nearest_of_few_rows(spark):
    for x in (np.zeros((0, 2)), np.ones((1, 2)), np.array([[0.0, 0], [1, 0], [1, 0]])):
        assert {(r.a, r.b, r.rk) for r in neighbours.nearest(neighbours.build(frame(spark, x)), 5)[0].collect()} == plain_near(x, 5)


def prim_weights(x, min_samples):
    d = np.round(neighbours.distances(x, x), 9)
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    return geometry.spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None])))[:, 2]


@pytest.mark.parametrize("copies", [0, 50])
def test_spanning_tree(spark, small, monkeypatch, copies):
    x = clustered(2, 200, 5, 0.05, copies)
    for most in ((density.DRIVER_COMPONENTS, 0) if copies else (density.DRIVER_COMPONENTS,)):
        monkeypatch.setattr(density, "DRIVER_COMPONENTS", most)
        with storage.scratch(spark):
            edges = density.spanning_tree(frame(spark, x), 3).collect()
        assert len(edges) == 199
        assert np.allclose(sorted(e.w for e in edges), prim_weights(x, 3), atol=0)
        top = list(range(200))  # the edges span

        def root(i, top=top):
            while top[i] != i:
                i = top[i]
            return i

        for e in edges:
            top[root(e.lo)] = root(e.hi)
        assert len({root(i) for i in range(200)}) == 1


@pytest.mark.parametrize("chunk", [10**6, 37])
def test_same_labels_as_the_dense_fit(spark, monkeypatch, chunk):
    monkeypatch.setattr(density, "CHUNK_EDGES", chunk)
    x = clustered(3, 400, 6, 0.08, copies=40)
    with storage.scratch(spark):
        tree = density.spanning_tree(frame(spark, x), 4)
        for min_size in (5, 12, 60):
            got, n = density.condensed(tree, frame(spark, x).select("vec_id"), min_size)
            want = geometry.density_clusters(x, min_size, 4)
            assert {r.vec_id: r.cluster for r in got.collect()} == dict(enumerate(want.tolist()))
            assert n == want.max() + 1 and n > 1


def test_condensed_tree_whatever_the_order_of_ties():
    # three groups that meet at one height: each order of the merges gives the same labels
    rng = np.random.default_rng(0)
    inner = [(g * 10 + i, g * 10 + i + 1, 1.0) for g in range(3) for i in range(9)]
    seen = set()
    for _ in range(20):
        outer = [(3, 14, 2.0), (15, 27, 2.0), (30, 5, 2.0)]
        c = density.Condenser(4)
        for part in (inner, outer):
            for k in rng.permutation(len(part)):
                a, b, w = part[k]
                c.merge(a, 1, b, 1, w)
        node = [c.moved(i)[2] for i in range(31)]
        label, _ = c.finish()
        of = [int(label[c.cluster(x)]) for x in node]
        assert of[30] == -1 and len({*of[:10]}) == len({*of[10:20]}) == len({*of[20:30]}) == 1
        seen.add(len(set(of[:30])))
    assert seen == {3}


def test_noise_and_few_rows(spark):
    for x in (np.zeros((0, 2)), np.ones((1, 2)), np.arange(8.0)[:, None] ** 3):
        got = density.density_clusters(frame(spark, x), 5, 2).collect()
        assert {r.vec_id: r.cluster for r in got} == {i: -1 for i in range(len(x))}


def test_distances_are_held_by_tiles(spark, small, monkeypatch):
    # whatever the blocks' size, no array of distances is larger than a tile's, and each pair of rows comes once
    monkeypatch.setattr(neighbours, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbours, "MERGE_ROWS", 10)
    monkeypatch.setattr(neighbours, "SPAN_SHARE", 3)
    x = clustered(4, 300, 4, 0.05, copies=40)
    index = neighbours.build(frame(spark, x))
    assert index.sizes.max() > 16 and index.span > 1

    def fold(a, b, d, same):
        assert d.shape == (len(a), len(b)) and max(d.shape) <= 16
        i, j = np.triu_indices(len(a), 1) if same else (g.ravel() for g in np.mgrid[: len(a), : len(b)])
        p, q = a["vec_id"].to_numpy()[i], b["vec_id"].to_numpy()[j]
        return pd.DataFrame({"p": np.minimum(p, q), "q": np.maximum(p, q)})

    got = [tuple(r) for r in neighbours.over_pairs(index, neighbours.near_pairs(index), fold, "p long, q long").collect()]
    assert len(got) == 300 * 299 // 2 == len(set(got))
    assert {(r.a, r.b, r.rk) for r in neighbours.nearest(index, 7)[0].collect()} == plain_near(x, 7)
    with storage.scratch(spark):
        edges = density.spanning_tree(frame(spark, x), 3).collect()
    assert np.allclose(sorted(e.w for e in edges), prim_weights(x, 3), atol=0)


def even(seed, n, width=8):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("moved", [(1.0, 0.0), (1e-3, 500.0), (1e9, 0.0)])
def test_far_pairs_are_left_out_in_single_precision(moved):
    # rows in no clusters: once a tile has given limits, few distances are taken; whatever the scale and place of the rows, none is missed
    x = even(5, 1500) * moved[0] + moved[1]
    both = pd.DataFrame({"vec_id": np.arange(1500), "block": np.repeat([0, 1], 750), "vec": list(x)})
    calls = []

    def fold(a, b, d, same):
        calls.append(same)
        r = np.round(d, 9)
        if same:
            np.fill_diagonal(r, np.inf)
        p, q = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        return neighbours._nearest(p, q, r, 4) if same else pd.concat([neighbours._nearest(p, q, r, 4), neighbours._nearest(q, p, r.T, 4)])

    within = neighbours.Within(lambda rows, found: neighbours._limits(rows, found, 4), neighbours._both_ways)
    out = neighbours.folded(both, [(0, 0), (0, 1), (1, 1)], 150, 2_000, fold, neighbours.few(4), within)
    d = neighbours.distances(x, x)
    np.fill_diagonal(d, np.inf)
    got = np.array(out.groupby("a")["r"].apply(sorted).tolist())
    assert got == pytest.approx(np.sort(np.round(d, 9), axis=1)[:, :4], rel=1e-7, abs=2e-9)
    assert len(calls) < 55 / 2 or moved[1]


def test_told_components_join_without_looking_again(spark, small, monkeypatch):
    # one component takes nearly all rows: rounds follow neighbour lists, pairs of blocks are looked at for neighbours only
    x = np.concatenate([even(6, 300), even(7, 20) * 0.01 + 5])
    calls = []
    f = neighbours.over_pairs
    monkeypatch.setattr(neighbours, "over_pairs", lambda *a, **k: calls.append(1) or f(*a, **k))
    with storage.scratch(spark):
        edges = density.spanning_tree(frame(spark, x), 3).collect()
    assert len(calls) == 2 and np.allclose(sorted(e.w for e in edges), prim_weights(x, 3), atol=0)
    # as by blocks, where many rows ask
    monkeypatch.setattr(density, "ASKING_BYTES", 0)
    with storage.scratch(spark):
        assert {tuple(e) for e in density.spanning_tree(frame(spark, x), 3).collect()} == {tuple(e) for e in edges}
    assert len(calls) > 4


def test_a_sweep_looks_for_neighbours_once(spark, monkeypatch):
    calls = []
    f = neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda *a: calls.append(a[1]) or f(*a))
    assert len(registry.QUERIES["density_sweep"](spark, SF).collect()) == 4 and calls == [12]
    # longer lists give the same tree
    x = clustered(2, 200, 5, 0.05, 20)
    with storage.scratch(spark):
        edges = [{tuple(e) for e in density.spanning_tree(frame(spark, x), 2, known).collect()} for known in (None, density.lists(frame(spark, x), 5))]
    assert edges[0] == edges[1]


def test_clusters_of_even_rows_take_no_more_searches(spark, small, monkeypatch):
    x = np.concatenate([even(8, 200), even(9, 40) * 0.02 + 2])
    calls = []
    f = neighbours.over_pairs
    monkeypatch.setattr(neighbours, "over_pairs", lambda *a, **k: calls.append(1) or f(*a, **k))
    got = {r.vec_id: r.cluster for r in density.density_clusters(frame(spark, x), 10, 4).collect()}
    assert got == dict(enumerate(geometry.density_clusters(x, 10, 4).tolist())) and len(calls) == 2
