"""Queries that do their whole job, on tables made for one case."""

import numpy as np
import pandas as pd

from wayline import storage
from wayline.operators import spectral
from wayline.plans import registry
from wayline.sources import records


def test_except_ids_takes_all_orders(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 2, 3)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (2, "5-LOW"), (2, None)], "o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.id for r in registry.QUERIES["except_ids"](spark, str(tmp_path)).collect()] == [3]
    assert "WHERE" not in registry.ORACLES["except_ids"]


def test_a_step_of_lanczos_moves_no_basis(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in ([0, 0, 0], [4, 0, 0])])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, vec array<double>")
    monkeypatch.setattr(spectral, "BLOCK", 4)
    wrote = []
    with storage.scratch(spark):
        edges = spectral.kernel(df, 6)
        for name in ("stored", "bucketed"):
            f = getattr(storage, name)

            def kept(t, *a, f=f):
                wrote.append(f(t, *a))
                return wrote[-1]

            monkeypatch.setattr(storage, name, kept)
        found = spectral.leading(edges, 3)
        # tables of one key and as many parts are joined where they lie
        first = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            parts = spectral._parts(spark, 80)
            a, b = (storage.bucketed(spark.range(80).selectExpr("id as i", f"array({k}D) as x"), "x", "i", parts) for k in (1, 2))
            both = spectral._joined([a, b], "q")
            assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.i, r.q) for r in both.collect()) == [(i, [1.0, 2.0]) for i in range(80)]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", first)
    assert found.steps > 1 and not any({"q", "y"} <= set(t.columns) for t in wrote)


def test_many_records_make_one_table():
    class Source:
        select = lambda self, *a: self
        mapInPandas = lambda self, f, schema: f  # noqa: E731, N815

    run = records.positions_of(Source(), boards_kept=0)
    texts = pd.DataFrame({"filename": [f"g{k}" for k in range(300)], "value": ["(;SZ[19];B[aa];W[bb];B[])"] * 299 + ["none"]})
    tables = list(run(iter([texts, texts])))
    assert len(tables) == 1 and len(tables[0]) == 2 * (3 * 299 + 1) and tables[0]["error"].notna().sum() == 2
    # with boards, a table stays small
    assert max(map(len, records.positions_of(Source())(iter([texts])))) < 64
