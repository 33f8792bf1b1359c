"""Hand-made cases and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import vectors as v
from wayline.operators import boards, geometry, gram, inference, kinetics, moments, neighbours, transitions, windows
from wayline.sources import records, tables


def traj(spark, games):
    rows = [(g, m, s) for g, states in enumerate(games) for m, s in enumerate(states)]
    return spark.createDataFrame(rows, "game_id long, move_number int, state int")


def counts(df):
    return {(r.i, r.j): r.n for r in df.collect()}


def test_transitions_stay_in_games(spark):
    assert counts(transitions.transition_counts(traj(spark, [[0, 0, 1], [1, 0]]))) == {(0, 0): 1, (0, 1): 1, (1, 0): 1}


def test_noise_breaks_transitions_and_runs(spark):
    t = traj(spark, [[0, -1, 0, 0]])
    assert counts(transitions.transition_counts(t)) == {(0, 0): 1}
    assert sorted(r.length for r in windows.dwell_times(t).collect()) == [1, 2]


def test_lag_over_length(spark):
    assert counts(transitions.transition_counts(traj(spark, [[0, 1]]), 2)) == {}


def vecs(spark, xs):
    return spark.createDataFrame([(0, i, [float(a) for a in x]) for i, x in enumerate(xs)], "game_id long, move_number int, vec array<double>")


@pytest.mark.parametrize("xs,want", [([[t, 0] for t in range(11)], 0.0), ([[abs(t - 5), 0] for t in range(11)], 2.0), ([[1, 1]] * 11, 0.0)])
def test_divergence(spark, xs, want):
    got = {r.move_number: r.divergence for r in windows.divergence(vecs(spark, xs)).collect()}
    assert got[5] == pytest.approx(want) and all(x is None for m, x in got.items() if m != 5)


@pytest.mark.parametrize("mode,want", [("reference", {10, 20, 30}), ("nms", {3, 10, 15, 20, 30})])
def test_greedy(spark, mode, want):
    rows = [(i, 0, i, s) for i, s in [(10, 5.0), (3, 4.0), (20, 3.0), (15, 2.0), (30, 1.0), (99, 0.0)]]
    df = spark.createDataFrame(rows, "idx long, game_id long, move_number int, divergence double")
    assert {r.idx for r in windows.bifurcations(df, share=0.1, distance=5, mode=mode).collect()} == want


def test_vector_functions(spark):
    row = spark.range(1).select(
        F.transform(v.topk(F.array(*map(F.lit, [1.0, 1.0, 0.0, 0.0])), 3), lambda s: s["feature"]).alias("top"),
        v.kl_divergence(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("kl"),
        v.effect_sparsity(F.array(*map(F.lit, [0.0, 3.0, 0.0, 0.0]))).alias("one"),
        v.effect_sparsity(F.array(*map(F.lit, [1.0, 1.0]))).alias("even"),
        v.effect_sparsity(F.array(F.lit(0.0), F.lit(0.0))).alias("none"),
        v.softmax(F.array(*map(F.lit, [1.0, 1.0]))).alias("soft"),
    ).first()
    assert row.top == [0, 1, 2] and row.kl == pytest.approx(0) and row.one == pytest.approx(4) and row.even == pytest.approx(1) and row.none == 0 and row.soft == [0.5, 0.5]


def test_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, (300, 4))
    df = vecs(spark, x.tolist())
    got = {r.j: r for r in moments.feature_stats(df).collect()}
    assert all(got[j].mean == pytest.approx(x[:, j].mean()) and got[j].std == pytest.approx(x[:, j].std(ddof=1)) for j in range(4))
    assert all(r.std == 0 for r in moments.feature_stats(vecs(spark, [[1.0, 2.0]])).collect())


def test_gram_is_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    got = kinetics.dense(gram.lagged_covariance(vecs(spark, x.tolist()), 2), "c")[1]
    y = x - x.mean(axis=0)
    c = y[:-2].T @ y[2:] / 48
    assert np.allclose(got, (c + c.T) / 2)


def test_auc(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (1, 1.0, 1), (2, 0.1, 0), (2, 0.9, 1), (3, 1.0, 1)], "g int, score double, label int")
    assert {r.g: r.auc for r in inference.auc(df, ["g"]).collect()} == {1: 0.5, 2: 1.0, 3: 0.5}


def test_shuffle_keeps_values(spark):
    df = spark.range(40).select(F.lit(0).alias("run"), F.col("id").alias("key"), (F.col("id") % 7).alias("value"))
    got = inference.shuffled(df, "key", "value", ["run"], F.lit(3))
    assert sorted(r.value for r in got.collect()) == sorted(i % 7 for i in range(40))


def chain():
    c = np.random.default_rng(4).integers(1, 30, (6, 6)).astype(float)
    p = kinetics.row_normalise(c)
    return p, kinetics.stationary(p, 10_000, 1e-14)


def test_kinetics():
    p, pi = chain()
    assert np.allclose(pi @ p, pi, atol=1e-8)
    m = kinetics.first_passage(p, pi)
    for j in range(6):
        for i in range(6):
            if i != j:
                assert m[i, j] == pytest.approx(1 + sum(p[i, k] * m[k, j] for k in range(6) if k != j), rel=1e-6)
    t = kinetics.transition_paths(p, pi, [0], [5])
    inner = range(1, 5)
    assert all(t["net"][:, i].sum() == pytest.approx(t["net"][i].sum(), abs=1e-9) for i in inner)
    assert sum(f for _, f in kinetics.pathways(t["net"], [0], [5], 1.0)) == pytest.approx(t["flux"], rel=1e-6)
    assert kinetics.chapman_kolmogorov({1: p, 2: p @ p}, 1)[0][1] == 0
    lam, u = kinetics.tica(np.eye(3) * 2, np.diag([1.0, 0.5, 0.2]))
    assert np.allclose(u.T @ (np.eye(3) * 2 + 1e-6 * np.eye(3)) @ u, np.eye(3)) and lam[0] > lam[1] > lam[2]
    assert kinetics.spectrum_check(np.array([0.95, 0.85, 0.7, 0.5, 0.3])) == (pytest.approx(0.1), True) and not kinetics.spectrum_check(np.array([0.5, 0.4]))[1]


def test_metastable_blocks():
    p = np.full((4, 4), 0.01)
    p[:2, :2] += 0.48
    p[2:, 2:] += 0.48
    label = kinetics.metastable(kinetics.row_normalise(p), 2)
    assert label[0] == label[1] != label[2] == label[3]


def board(**stones):
    b = np.zeros((1, 19, 19), np.int64)
    for (r, c), s in {p: (1 if k == "black" else 2) for k, ps in stones.items() for p in ps}.items():
        b[0, r, c] = s
    return b


def test_atari():
    x = boards.label_boards(board(black=[(5, 5)], white=[(4, 5), (6, 5), (5, 4)]))
    assert x["liberties"][0, 5, 5] == 1 and x["is_atari"][0, 5, 5]


def test_cutting_point():
    assert boards.label_boards(board(black=[(3, 4), (4, 3), (4, 5), (5, 4)]))["black_cutting"][0, 4, 4]


def test_territory():
    x = boards.label_boards(board(black=[(0, 2), (1, 2), (2, 0), (2, 1), (2, 2)]))["black_territory"][0]
    assert x[0, 0] and x[0, 1] and x[1, 0] and x[1, 1] and x[10, 10]


def test_eyes():
    x = boards.label_boards(board(black=[(0, 1), (1, 0), (1, 1)]))
    assert x["black_eye"][0, 0, 0]
    x = boards.label_boards(board(black=[(0, 1), (1, 0)], white=[(1, 1)]))
    assert not x["black_eye"][0, 0, 0]


def test_record():
    info, rows = records.parse_record("(;GM[1]SZ[19]KM[6.5]PB[a]RE[B+R];B[dd];W[cd];B[](;W[dc];B[aa])(;W[qq]))")
    assert info["n_moves"] == 5 and info["komi"] == 6.5 and info["white"] == "Unknown" and rows[2]["next_row"] is None
    assert rows[1]["board"][3 * 19 + 3] == 1 and len(rows[3]["history"]) == 3
    info, rows = records.parse_record("(;GM[1];B[dd];W[dd];B[aa])")
    assert info["n_moves"] == 1
    with pytest.raises(ValueError):
        records.parse_record("(;SZ[9];B[aa])")


def test_capture():
    b = board(black=[(0, 1)], white=[(0, 0)])[0]
    new = boards.play(b, 1, 0, 1)
    assert new[0, 0] == 0 and boards.play(new, 0, 0, 2) is None


def test_split_and_read(spark, tmp_path):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["(;GM[1]", "RE[W+R];B[aa])", "junk", "(;GM[2])", "(;GM[1];B[bb])"])], "file string, line int, value string")
    got = sorted(r.value for r in records.split_records(lines).collect())
    assert got == ["(;GM[1]\nRE[W+R];B[aa])", "(;GM[1];B[bb])"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.sgf").write_text("(;GM[1];B[aa];W[bb])")
    (tmp_path / "b.sgf").write_text("(;SZ[9];B[aa])")
    rows = records.read_records(spark, str(tmp_path)).collect()
    assert sum(r.error is None for r in rows) == 2 and sum(r.error is not None for r in rows) == 1


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("b5", 1, [1.0]), ("b20", 2, [2.0])], "layer string, sample_id long, vec array<double>")
    tables.write_activations(df, str(tmp_path / "a"))
    assert [r.sample_id for r in tables.read_activations(spark, str(tmp_path / "a"), "b5").collect()] == [1]
    for kind in ("parquet", "json", "csv"):
        tables.write_results(df.select("layer", "sample_id"), str(tmp_path / kind), kind)
        assert sorted(tuple(r) for r in tables.read_results(spark, str(tmp_path / kind), "layer string, sample_id long", kind).collect()) == [("b20", 2), ("b5", 1)]
    with pytest.raises(ValueError):
        tables.validate_positions(spark.createDataFrame([([0, 1],)], "board array<int>"))


def test_density_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2))])
    label = geometry.density_clusters(x)
    assert len(set(label[:40]) - {-1}) == 1 and len(set(label[40:]) - {-1}) == 1 and label[0] != label[-1]


def test_persistence_of_circle():
    t = np.linspace(0, 2 * np.pi, 30, endpoint=False)
    loops = [d - b for k, b, d in geometry.persistence(np.stack([np.cos(t), np.sin(t)], axis=1)) if k == 1]
    assert max(loops) > 1 and sum(x > 0.5 for x in loops) == 1


def test_streams_equal_batches(spark, tmp_path):
    import os
    import shutil

    from helpers import SF
    from wayline.streaming import jobs

    folder = tmp_path / "in"
    folder.mkdir()
    if os.path.isfile(f"{SF}/events.parquet"):
        shutil.copy(f"{SF}/events.parquet", folder / "events.parquet")
    s = jobs.events_stream(spark, str(folder))
    b = spark.read.parquet(str(folder)).withColumn("at", F.col("ts").cast("timestamp"))
    got = jobs.collected(jobs.tumbling(s), "tumbled", str(tmp_path / "c1"), "complete")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, jobs.tumbling(b).collect()), key=str)
    got = jobs.collected(jobs.running_moments(s), "moments", str(tmp_path / "c2"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.running_moments(b).collect()))
    # sessions are final once the watermark has passed them
    late = jobs.written(jobs.sessions(s, late="1 hour"), f"file://{tmp_path}/c3")
    end = b.agg(F.max("at")).first()[0]
    final = jobs.sessions(b.where(F.col("at") < end))
    got, want = set(map(tuple, late.collect())), set(map(tuple, jobs.sessions(b).collect()))
    assert got <= want and len(got) > 0.8 * len(want) and final.count() > 0


def test_late_rows_are_left_out(spark, tmp_path):
    """Batch by batch: a row behind the watermark is left out."""
    from datetime import datetime

    from wayline.streaming import jobs

    at = lambda h, m=0: datetime(2024, 1, 1 + h // 24, h % 24, m)
    files = [[(1, 1, at(1), "view"), (2, 2, at(1), "click")], [(3, 1, at(30), "click"), (4, 1, at(31), "error")], [(6, 2, at(32), "view")], [(5, 1, at(2), "signup"), (7, 1, at(32), "view")]]
    folder = tmp_path / "events"
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(i, t, u, e, 1.0, "") for i, u, t, e in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/{k}")
    stream = lambda: spark.readStream.schema(jobs.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder)).withColumn("at", F.col("ts").cast("timestamp"))
    got = jobs.written(jobs.tumbling(stream(), late="1 hour"), f"file://{tmp_path}/tumbled")
    rows = {(r.start.day, r.event_type): r.n for r in got.collect()}
    assert rows == {(1, "view"): 1, (1, "click"): 1}  # the signup of the first day came when that day was closed


@pytest.fixture
def many_points(spark, tmp_path):
    """A folder whose embeddings have more rows than the SQL samples, and the rows."""
    rng = np.random.default_rng(7)
    label = rng.integers(0, 3, 900)
    x = (rng.normal(size=(900, 64)) + label[:, None]).astype(np.float32)
    x[3] = x[800]
    spark.createDataFrame([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path), x.astype(float), label


def test_pairs_of_all_rows(spark, many_points, monkeypatch):
    from wayline.plans import code_queries

    sf, x, label = many_points
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 100)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    half = d[np.triu_indices(900, 1)]
    got = code_queries.pairwise_distance_stats(spark, sf).first()
    assert got.n == 900 * 899 // 2 and (got["mean"], got["std"], got.least, got.most) == pytest.approx((half.mean(), half.std(), half.min(), half.max()), abs=1e-6)
    near = {(r.a, r.rk): r.b for r in code_queries.knn_graph(spark, sf).collect()}
    r = np.round(d, 9)
    np.fill_diagonal(r, np.inf)
    want = np.argsort(r, axis=1, kind="stable")[:, :10]
    assert near == {(a, k + 1): want[a, k] for a in range(900) for k in range(10)}
    same = label[:, None] == label[None]
    np.fill_diagonal(same, False)
    own = (d * same).sum(axis=1) / same.sum(axis=1)
    other = np.min([np.where(label == k, np.inf, d[:, label == k].mean(axis=1)) for k in range(3)], axis=0)
    assert code_queries.silhouette(spark, sf).first().silhouette == pytest.approx(((other - own) / np.maximum(own, other)).mean(), abs=1e-6)
    w = np.exp(-d * d / 2)
    w = w / np.sqrt(np.outer(w.sum(axis=1), w.sum(axis=1)))
    w = w / w.sum(axis=1, keepdims=True)
    got = {r.a: (r.top, r.concentration) for r in code_queries.diffusion_operator(spark, sf).collect()}
    assert len(got) == 900 and all(got[a] == pytest.approx((w[a].max(), (w[a] ** 2).sum()), abs=2e-6) for a in range(900))
