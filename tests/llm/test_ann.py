import numpy as np
import pytest

from wayline.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    monkeypatch.setattr(ann, "TURN_ROWS", 7)
    monkeypatch.setattr(ann.common, "HOT_ROWS", 20)
    x = np.random.default_rng(0).normal(size=(3000, 32)).astype(np.float32)
    df = table(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    y, hit = x.astype(float), 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(len(y)), -s))[:10]
        hit += len({v for v, _ in found.values()} & set(top.tolist()))
        assert all(score == pytest.approx(s[v], abs=1e-12) for v, score in found.values())
    assert len(got) == 30 and hit / 300 >= 0.9


def test_edges(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.5, 0.0]), (0, [0.25, 0.0]), (None, [9.0, 9.0]), (8, [float("inf"), 0.0])]
    df = table(spark, rows)
    monkeypatch.setattr(ann, "LIST_SAMPLE", 100)  # one list: all is found
    got = [(r.rank, r.vec_id, r.score) for r in sorted(ann.nearest(df, df.where("vec_id = 1"), k=20).collect(), key=lambda r: r.rank)]
    assert got == [(1, 6, 2.0), (2, 0, 1.0), (3, 7, 1.0), (4, 7, 0.5), (5, 0, 0.25)]
    # an id with two vectors is two rows and two queries
    got = sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 0"), k=2).collect())
    assert got == [(1, 6, 0.5), (1, 6, 2.0), (2, 0, 0.25), (2, 1, 1.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ann.nearest(table(spark, [(0, [1.0]), (1, [1.0, 2.0])]), df)


def test_large_group_of_copies(spark, request):
    # rows reach a list from several partitions, not in the order of ids
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    # 3,000 of 4,000 rows are one vector, which many others are near to; ids in no order
    r = np.random.default_rng(1)
    hot = r.normal(size=16).astype(np.float32)
    x = np.where(np.arange(4000)[:, None] % 4 > 0, hot, hot + r.normal(size=(4000, 16)).astype(np.float32) / 4).astype(np.float32)
    ids = r.permutation(4000)
    df = table(spark, [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)])
    got = {}
    # what is held here is the choice among copies, so lists are probed for nearly all neighbours
    for row in ann.nearest(df, df.where("vec_id % 50 = 0"), k=20, recall=0.999).collect():
        got.setdefault(row.query_id, {})[row.rank] = row.vec_id
    y, at, hit = x.astype(float), np.argsort(ids), 0
    for q, found in got.items():
        s = (y * y[at[q]]).sum(axis=1)
        s[at[q]] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]].tolist()
        hit += len(set(found.values()) & set(want))
    assert len(got) == 80 and hit / 1600 >= 0.99, hit / 1600
    # copies alone: the smallest ids in order, but its own
    same = table(spark, [(int(i), [1.0, 2.0]) for i in ids])
    got = [r.vec_id for r in sorted(ann.nearest(same, same.where("vec_id = 3"), k=20).collect(), key=lambda r: r.rank)]
    assert got == [0, 1, 2, *range(4, 21)]


def recall_of(rows, x, k):
    """Of found (query, id) rows, the share of the k nearest by brute force; ids are row numbers."""
    found, hit = {}, 0
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, ids in found.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hit += len(ids & set(np.lexsort((np.arange(len(x)), -s))[:k].tolist()))
    return len(found), hit / len(found) / k


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    from wayline.llm import queries

    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in table] == list(range(len(table)))
    n, share = recall_of(queries.op8_ann_ivfpq(spark, f"/root/testdata/{sf}").collect(), np.array([r.embedding for r in table]), min(20, len(table) - 1))
    assert n == -(-len(table) // 20) and share >= 0.9


def test_clustered_vectors_need_few_lists():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 32))[r.integers(0, 200, 10_000)] * 3 + r.normal(size=(10_000, 32)) / 2
    quantiser = ann.Quantiser(x, 100)
    assert quantiser.probes_for(x, 20, 0.96) <= 15
