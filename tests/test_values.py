"""Values of the queries that SQL can't express, computed once more from the tables with numpy."""

import itertools

import duckdb
import numpy as np
import pytest
from helpers import SF

from wayline.functions import sizing
from wayline.operators import geometry, kinetics, network, training
from wayline.plans import registry
from wayline.sources import weights


@pytest.fixture(scope="module")
def vectors():
    rows = duckdb.execute(f"select vec_id, embedding, label from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])


@pytest.fixture(scope="module")
def matrix():
    """(states, P at a lag) of events, errors left out as noise, counted game by game."""
    rows = duckdb.execute(f"select user_id, event_type from '{SF}/events.parquet' order by user_id, ts, event_id").fetchall()
    names = ["click", "error", "purchase", "signup", "view"]
    games = [[-1 if t == "error" else names.index(t) for _, t in g] for _, g in itertools.groupby(rows, lambda r: r[0])]

    def at(lag):
        c = np.zeros((5, 5))
        for g in games:
            for i, j in zip(g, g[lag:]):
                if i >= 0 and j >= 0:
                    c[i, j] += 1
        keep = [s for s in range(5) if c[s].sum() + c[:, s].sum() > 0]
        c = c[np.ix_(keep, keep)]
        return keep, c / c.sum(axis=1, keepdims=True)

    return at


def run(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]


def test_spectra(spark, matrix):
    _, p = matrix(1)
    lam = np.sort(np.linalg.eigvals(p).real)[::-1]
    assert [r["eigenvalue"] for r in sorted(run(spark, "eigenvalues"), key=lambda r: r["rank"])] == pytest.approx(lam, abs=1e-6)
    got = {(r["lag"], r["rank"]): r["timescale"] for r in run(spark, "implied_timescales")}
    for lag in (1, 2, 5, 10):
        lam = np.sort(np.linalg.eigvals(matrix(lag)[1]).real)[::-1][1:]
        for i, x in enumerate(lam):
            want = -lag / np.log(x) if 0 < x < 1 else np.inf
            assert got[lag, i] == pytest.approx(want, rel=1e-6) or (np.isinf(want) and np.isinf(got[lag, i]))


def test_paths_between_the_outer_states(spark, matrix):
    states, p = matrix(1)
    n = len(p)
    pi = np.linalg.matrix_power(p, 4096)[0]
    # committor: the share of first visits to the last state before the first, by iteration
    q = np.linspace(0, 1, n)
    for _ in range(5000):
        q = p @ q
        q[0], q[-1] = 0, 1
    back = np.linspace(1, 0, n)
    reverse = pi[None] * p.T / pi[:, None]
    for _ in range(5000):
        back = reverse @ back
        back[0], back[-1] = 1, 0
    gross = pi[:, None] * back[:, None] * p * q[None]
    np.fill_diagonal(gross, 0)
    net = np.maximum(gross - gross.T, 0)
    flux = net[0].sum()
    for r in run(spark, "transition_paths"):
        i = states.index(r["state"])
        assert (r["forward"], r["backward"]) == pytest.approx((q[i], back[i]), abs=1e-6)
        assert (r["flux_in"], r["flux_out"], r["flux"], r["rate"]) == pytest.approx((net[:, i].sum(), net[i].sum(), flux, flux / (pi * back).sum()), abs=1e-6)
    paths = run(spark, "reactive_pathways")
    assert sum(r["flux"] for r in paths) >= 0.99 * flux and all(r["path"][0] == states[0] and r["path"][-1] == states[-1] for r in paths)
    assert all(a["flux"] >= b["flux"] - 1e-12 for a, b in itertools.pairwise(sorted(paths, key=lambda r: r["rank"])))


def test_macrostates(spark, matrix):
    states, p = matrix(1)
    pi = np.linalg.matrix_power(p, 4096)[0]
    soft = run(spark, "soft_macrostates")
    model = run(spark, "macrostate_model")
    for k in (2, 3):
        m = np.array([[next(r["membership"] for r in soft if (r["n_macro"], r["state"], r["macro"]) == (k, s, j)) for j in range(k)] for s in states])
        assert m.min() >= 0 and m.sum(axis=1) == pytest.approx(np.ones(len(m)))
        t = m.T @ (pi[:, None] * p) @ m
        t /= t.sum(axis=1, keepdims=True)
        entropy = np.mean([-sum(x * np.log(x) for x in (row + 1e-10) / (row + 1e-10).sum()) for row in m])
        for r in (r for r in model if r["n_macro"] == k):
            assert r["p"] == pytest.approx(t[r["i"], r["j"]], abs=1e-6) and r["entropy"] == pytest.approx(entropy, abs=1e-6)
            if r["i"] == r["j"]:
                assert r["mfpt"] == 0
        if k == 2:
            assert {(r["i"], r["j"]): r["mfpt"] for r in model if r["n_macro"] == 2}[0, 1] == pytest.approx(1 / t[0, 1], rel=1e-3)


def test_memberships_of_two_blocks():
    p = np.array([[0.89, 0.1, 0.01, 0], [0.1, 0.89, 0, 0.01], [0.01, 0, 0.89, 0.1], [0, 0.01, 0.1, 0.89]])
    m = kinetics.memberships(p, 2)
    assert m[0].argmax() == m[1].argmax() != m[2].argmax() == m[3].argmax() and m.max(axis=1).min() > 0.9
    for k in (1, 5):
        with pytest.raises(ValueError):
            kinetics.memberships(p, k)


def test_small_matrix_checks():
    got = kinetics.matrix_check(np.array([[0.5, 0.5, 0], [0, 0, 0], [0.2, 0.2, 0.2]]))
    assert (got["n_states"], got["n_absorbing"], got["square"]) == (3, 1, True) and got["deviation"] == pytest.approx(0.4)


def covariances(x, lag):
    mu, games = x.mean(axis=0), [x[i : i + 100] for i in range(0, len(x), 100)]
    a = np.concatenate([g[: len(g) - lag] for g in games]) - mu
    b = np.concatenate([g[lag:] for g in games]) - mu
    c = a.T @ b / len(a)
    return (c + c.T) / 2


def test_slow_components(spark, vectors):
    _, x, _ = vectors
    c0 = covariances(x, 0)
    low = np.linalg.inv(np.linalg.cholesky(c0 + 1e-6 * np.eye(len(c0))))
    spectra = {lag: np.sort(np.linalg.eigvalsh(low @ covariances(x, lag) @ low.T))[::-1] for lag in (1, 2, 5)}
    got = sorted(run(spark, "tica_spectrum"), key=lambda r: r["rank"])
    assert [r["eigenvalue"] for r in got] == pytest.approx(spectra[1][:10], abs=1e-4)
    for r in run(spark, "tica_timescales"):
        lam = spectra[r["lag"]][r["rank"]]
        assert r["timescale"] == pytest.approx(-r["lag"] / np.log(lam), rel=1e-2) if 0 < lam < 1 else np.isinf(r["timescale"])
    share = np.cumsum(spectra[1] ** 2) / (spectra[1] ** 2).sum()
    for r in run(spark, "tica_dimensions"):
        assert abs(r["n"] - (int((share < r["share"]).sum()) + 1)) <= 1
    t = np.array([[r["t0"], r["t1"]] for r in sorted(run(spark, "tica_projection"), key=lambda r: r["vec_id"])])
    y = t - t.mean(axis=0)
    assert y.T @ y / len(y) == pytest.approx(np.eye(2), abs=1e-3)


def test_principal_components(spark, vectors):
    _, x, _ = vectors
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    for r in run(spark, "pca_baseline"):
        back = centred @ vt[: r["k"]].T @ vt[: r["k"]] + x.mean(axis=0)
        assert r["share"] == pytest.approx((s[: r["k"]] ** 2).sum() / (s**2).sum(), abs=1e-6)
        assert r["r2"] == pytest.approx(1 - ((back - x) ** 2).mean() / (x.var() + 1e-8), abs=1e-6)
    for r in run(spark, "component_sparsity"):
        assert r["sparsity"] == pytest.approx((np.abs(vt[r["component"]]) < 0.01).mean(), abs=0.02)


def test_clusters_of_all_rows(spark, vectors):
    ids, x, _ = vectors
    got = {r["vec_id"]: r["cluster"] for r in run(spark, "density_clusters")}
    assert set(got) == set(ids.tolist())
    want = geometry.density_clusters(x)
    pairs = {(got[i], w) for i, w in zip(ids.tolist(), want.tolist())}
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})  # one label each, by another name
    for r in run(spark, "density_sweep"):
        assert 0 <= r["noise"] <= 1 and (r["clusters"] > 0 or r["noise"] == 1)


def test_assignment_beyond_the_sample(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    x = np.concatenate([c + rng.normal(size=(150, 2)) for c in centres] + [[[500.0, 500.0]]])
    truth = [*np.repeat(range(3), 150), -1]
    fit = geometry.density_fit(x[::3], 10, 5)
    assert len(fit.reach) == 3
    got = {r.vec_id: r.cluster for r in geometry.assigned(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>"), fit).collect()}
    names = {t: got[t * 150] for t in range(3)}
    assert sorted(names.values()) == [0, 1, 2] and got[450] == -1
    assert sum(got[i] == names.get(t, -1) for i, t in enumerate(truth)) >= 0.9 * len(x)
    assert geometry.density_clusters(x[:1]).tolist() == [-1]


def test_diffusion_coordinates_of_all_rows(spark, vectors):
    ids, x, _ = vectors
    got = np.array([[r["d1"], r["d2"], r["d3"]] for r in sorted(run(spark, "diffusion_map"), key=lambda r: r["vec_id"])])
    lam, y = geometry.diffusion_map(x, 4)
    assert got.shape == (len(ids), 3)
    for k in range(3):
        assert min(np.abs(got[:, k] - y[:, k + 1]).max(), np.abs(got[:, k] + y[:, k + 1]).max()) < 1e-6
    # a row-stochastic matrix by hand has these as its eigenvectors
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    k = np.exp(-d2 / np.median(d2))
    q = k.sum(axis=1)
    k /= np.sqrt(np.outer(q, q))
    p = k / k.sum(axis=1, keepdims=True)
    assert p @ y == pytest.approx(y * lam, abs=1e-9) and lam[0] == pytest.approx(1) and (np.abs(lam) <= 1 + 1e-9).all()
    fit = geometry.diffusion_fit(x[::2], 4)
    assert fit.extend(x[::2]) == pytest.approx(fit.phi * fit.lam, abs=1e-9) and np.isfinite(fit.extend(x)).all()


def test_homology_of_known_shapes():
    t = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    circle = geometry.persistence(np.stack([np.cos(t), np.sin(t)], axis=1), 2)
    loops = [d - b for k, b, d in circle if k == 1]
    assert max(loops) > 1 and len(loops) == 1
    octahedron = np.concatenate([np.eye(3), -np.eye(3)])
    assert [(k, round(b, 6), round(d, 6)) for k, b, d in geometry.persistence(octahedron, 2) if k == 2] == [(2, round(2**0.5, 6), 2.0)]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(14, 3))
    assert np.array(sorted(geometry.persistence(x, 2))) == pytest.approx(np.array(sorted(plain_persistence(x))))
    seen, null, p = geometry.persistence_significance(np.stack([np.cos(t), np.sin(t)], axis=1), 1, 10, 0.5)
    assert seen == 1 and p <= 0.3 and null < 1


def plain_persistence(x):
    """Classes by column reduction with sets over the whole complex, dimension by dimension mixed."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    simplices = [s for k in range(1, 5) for s in itertools.combinations(range(len(x)), k)]
    value = {s: max((d[a, b] for a, b in itertools.combinations(s, 2)), default=0.0) for s in simplices}
    order = sorted(simplices, key=lambda s: (value[s], len(s), s))
    place = {s: i for i, s in enumerate(order)}
    low, out = {}, []
    for s in order:
        column = {place[f] for f in itertools.combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            face = order[max(column)]
            if value[s] > value[face] + 1e-12:
                out.append((len(face) - 1, float(value[face]), float(value[s])))
    return out


def test_homology_queries(spark):
    rows = run(spark, "persistence_diagram")
    stats = {r["dimension"]: r for r in run(spark, "persistence_stats")}
    assert set(stats) == {0, 1, 2}
    for k, r in stats.items():
        life = [x["death"] - x["birth"] for x in rows if x["dimension"] == k]
        assert (r["n"], r["total"]) == (len(life), pytest.approx(sum(life))) and r["mean"] == pytest.approx(np.mean(life) if life else 0)
    assert all(0 <= r["p_value"] <= 1 for r in run(spark, "persistence_significance"))
    for r in run(spark, "spectral_validation"):
        assert r["valid"] == (r["gap"] >= 0.05 and r["first"] >= 0.8) and 0 < r["first"] < 1


def plain_auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)


def test_probe(spark, vectors):
    import hashlib

    ids, x, label = vectors
    test = np.array([int(hashlib.md5(f"{i // 100}probe".encode()).hexdigest()[:7], 16) % 100 < 30 for i in ids])
    for r in run(spark, "linear_probe"):
        y = (label % r["concept"] == 0).astype(float)
        if test.all() or not test.any() or min(y[~test].sum(), (1 - y[~test]).sum()) < 10:
            assert r["auc"] == 0.5
            continue
        s = x[~test].std(axis=0, ddof=1)
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(20_000):
            e = 1 / (1 + np.exp(-(x[~test] / s @ w + b))) - y[~test]
            w, b = w - 0.1 * ((x[~test] / s).T @ e / len(e) + 0.01 * w), b - 0.1 * e.mean()
        assert r["auc"] == pytest.approx(plain_auc(x[test] / s @ w, y[test]), abs=0.03)


def test_controls_and_tests(spark):
    for name in ("label_shuffle_control", "random_network_control", "column_shuffle_control"):
        r = run(spark, name)[0]
        assert abs(r["mean"] - 0.5) < 0.12 and 0 < r["std"] < 0.2
    rows = duckdb.execute(f"""select n, cast(cents > median(cents) over () as int) from (select user_id, count(*) as n, sum(case when event_type = 'purchase' then cast(round(value * 100) as bigint) else 0 end) as cents from '{SF}/events.parquet' group by 1)""").fetchall()
    n, y = np.array(rows, float).T
    seen = np.corrcoef(n, y)[0, 1]
    rng = np.random.default_rng(0)
    null = [np.corrcoef(n, rng.permutation(y))[0, 1] for _ in range(4000)]
    r = run(spark, "permutation_pvalue")[0]
    assert r["observed"] == pytest.approx(seen) and r["n"] == 1000 and r["p_value"] == pytest.approx(np.mean(np.abs(null) >= abs(seen)), abs=0.12)
    rows = duckdb.execute(f"select n_chars, quality from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id)").fetchall()
    score, y = np.array(rows, float).T
    boot = [plain_auc(score[k], y[k]) for k in (rng.integers(0, len(y), len(y)) for _ in range(300)) if 0 < y[k].sum() < len(y)]
    r = run(spark, "bootstrap_auc")[0]
    assert (r["low"], r["high"]) == pytest.approx(np.quantile(boot, [0.025, 0.975]), abs=0.05)


def test_kmeans(spark, vectors):
    ids, x, _ = vectors
    label = np.array([r["state"] for r in sorted(run(spark, "kmeans_states"), key=lambda r: r["vec_id"])])
    c = np.array([x[label == k].mean(axis=0) for k in np.unique(label)])
    near = np.unique(label)[((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)]
    assert len(c) == 8 and (near == label).mean() > 0.95
    picked = {r["vec_id"] for r in run(spark, "landmarks")}
    assert 1 < len(picked) <= 12 and picked <= set(ids.tolist())
    for r in run(spark, "kmeans_vamp_search"):
        assert 0 <= r["vamp2"] <= r["k"] - 1 + 1e-9
    lam = sorted((r["eigenvalue"] for r in run(spark, "cluster_model_spectrum")), reverse=True)
    assert lam[0] == pytest.approx(1) and all(r["gap"] == pytest.approx(lam[0] - lam[1]) for r in run(spark, "cluster_model_spectrum"))
    assert {r["method"] for r in run(spark, "elbow_point")} == {"distance", "gradient", "bend"}


def test_elbow_by_gradient():
    k, score = np.arange(5.0), np.array([0, 1.0, 1.5, 1.4, 1.45])
    # sizes of slopes count: 4, 2, -0.4 and 0.2 of the largest, so the last is the first below a tenth
    assert kinetics.elbow(k, score, "gradient") == 3
    assert kinetics.elbow(k, np.array([0, 1.0, 0.2, 0.1, 0.09]), "gradient") == 3
    # a straight line has no low gradient: the last but one
    assert kinetics.elbow(np.arange(2.0, 6.0), np.arange(4.0), "gradient") == 2


def test_metastable_is_by_sign(spark, matrix):
    states, p = matrix(1)
    got = {r["state"]: r["macro"] for r in run(spark, "metastable_states")}
    assert set(got) == set(states) and len(set(got.values())) == 2


def test_gradients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 5))
    p = {"encoder": rng.normal(size=(7, 5)), "decoder": rng.normal(size=(5, 7)), "bias": rng.normal(size=5)}
    checks = [(p, lambda: training.code_loss(p, x, (2, 4), True)[0], training.code_loss(p, x, (2, 4), True)[1])]
    g, ctx, y = training.gru_parameters(3, 4), rng.normal(size=(5, 3, 3)), rng.normal(size=(5, 3))
    checks.append((g, lambda: training.gru_loss(g, ctx, y)[0], training.gru_loss(g, ctx, y)[1]))
    for parameters, loss, grads in checks:
        for name, v in parameters.items():
            flat = v.reshape(-1)
            for i in range(0, len(flat), 3):
                old = flat[i]
                flat[i] = old + 1e-6
                up = loss()
                flat[i] = old - 1e-6
                assert grads[name].reshape(-1)[i] == pytest.approx((up - loss()) / 2e-6, abs=1e-5), (name, i)
                flat[i] = old


def test_training(spark):
    rng = np.random.default_rng(0)
    atoms = training.unit_columns(rng.normal(size=(16, 24)))
    z = np.where(rng.random((2000, 24)) < 0.1, rng.random((2000, 24)) + 0.5, 0)
    x = z @ atoms.T
    fit = training.train_codes(x, 24, (2, 4), epochs=25)
    assert fit.losses[-1] < 0.5 * x.var() and np.linalg.norm(fit.decoder, axis=0) == pytest.approx(np.ones(24))
    assert training.train_codes(x, 24, (2, 4), epochs=200, rate=0.0, patience=2).stopped == 3
    t = np.cumsum(np.tile([[0.1, 0.05]], (400, 1)), axis=0)
    x = np.sin(t)
    ctx = np.stack([x[i : i + 4] for i in range(390)])
    p, losses = training.train_gru(ctx, x[4:394], hidden=8, epochs=30)
    assert losses[-1] < 0.2 * losses[0] and training.sample_gru(p, ctx[:3], 6).shape == (3, 6, 2)
    losses = [r["loss"] for r in sorted(run(spark, "train_codes"), key=lambda r: r["epoch"])]
    assert losses[-1] < losses[0]
    r = run(spark, "trajectory_model")[0]
    assert r["model_error"] < r["last_error"] and r["drawn_std"] > 0


def test_network(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(2, 3, 5, 5)), rng.normal(size=(4, 3, 3, 3))
    want = np.zeros((2, 4, 5, 5))
    for n, o, i, j in itertools.product(range(2), range(4), range(5), range(5)):
        for c, a, b in itertools.product(range(3), range(3), range(3)):
            if 0 <= i + a - 1 < 5 and 0 <= j + b - 1 < 5:
                want[n, o, i, j] += x[n, c, i + a - 1, j + b - 1] * w[o, c, a, b]
    assert network.convolve(x, w) == pytest.approx(want)
    p = {name: rng.normal(size=n) for name, n in weights.line_sizes(1, 2)}
    text = "\n".join(["1", *(" ".join(map(str, np.abs(v) if k.endswith("var") else v)) for k, v in p.items())])
    p = weights.parse(text, 2)
    planes = rng.integers(0, 2, (3, 18, 19, 19)).astype(float)
    policy, value, seen = network.forward(planes, p, (0,))
    assert policy.shape == (3, 362) and (np.abs(value) <= 1).all() and seen[0].shape == (3, 2, 19, 19) and (seen[0] >= 0).all()
    # a block whose second convolution gives nothing passes its input on
    p["block0.2.weight"][:], p["block0.2.bias"][:], p["block0.2.mean"][:] = 0, 0, 0
    first = np.maximum(network.normalised(planes, p, "input"), 0)
    assert network.forward(planes, p, (0,))[2][0] == pytest.approx(first)
    s = network.shuffled(p)
    assert sorted(s["input.weight"].ravel()) == sorted(p["input.weight"].ravel())
    with pytest.raises(ValueError):
        weights.parse(text + "\n1 2", 2)
    got = run(spark, "network_forward")
    assert got and all(0 <= r["best"] < 362 and len(r["pooled"]) == 4 for r in got)


def test_sizes_of_batches_and_partitions():
    assert sizing.batch_rows(row_bytes=1_000, memory=64_000_000, share=0.5, least=10, most=10_000) == 10_000
    assert sizing.batch_rows(row_bytes=10_000_000, memory=64_000_000, share=0.5, least=1, most=10_000) == 3
    assert sizing.partitions(total_bytes=0, cores=8) == 8 and sizing.partitions(total_bytes=10**12, cores=100) == 7_500
