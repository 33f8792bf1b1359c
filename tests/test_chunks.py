"""Chunked arrays: round trip, and that what isn't wanted isn't read."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.shipping import ship
from wayline.sources import chunks


@pytest.fixture
def folder(spark, tmp_path):
    ship(spark)
    rng = np.random.default_rng(0)
    rows = [("a" if i % 3 else "b", 1000 - i, [float(v) for v in rng.normal(size=6).astype(np.float32)]) for i in range(230)]
    df = spark.createDataFrame(rows, "layer string, sample_id long, vec array<double>").repartition(4)
    path = f"file://{tmp_path}/chunks"
    chunks.write_chunks(df, path, 20)
    return path, sorted(rows)


def listed(path):
    with open(f"{path.removeprefix('file://')}/manifest.json") as f:
        return json.load(f)["chunks"]


def test_round_trip(spark, folder):
    path, rows = folder
    got = [tuple(r) for r in chunks.read_chunks(spark, path).orderBy("layer", "row").collect()]
    assert [(g[0], g[3], g[4]) for g in got] == rows
    for layer in "ab":
        own = [g for g in got if g[0] == layer]
        assert [g[2] for g in own] == list(range(len(own))) and [g[1] for g in own] == sorted(g[1] for g in own)
    made = listed(path)
    assert sum(c["rows"] for c in made) == 230 and all(c["rows"] <= 20 for c in made)


def test_unwanted_chunks_are_not_opened(spark, folder):
    path, rows = folder
    own = [r for r in rows if r[0] == "a"]
    for c in listed(path):
        if c["layer"] == "b" or c["first"] >= 60 or c["first"] + c["rows"] <= 25:
            for end in "xk":
                os.remove(f"{path.removeprefix('file://')}/{c['file']}.{end}.npy")
    some = chunks.read_chunks(spark, path, ["a"], rows=(25, 60)).where("sample_id % 2 = 0")
    assert [(r.layer, r.sample_id, r.vec) for r in some.orderBy("row").collect()] == [r for r in own[25:60] if r[1] % 2 == 0]
    first = next(c for c in listed(path) if c["layer"] == "a" and c["first"] >= 25 and c["first"] + c["rows"] <= 60)
    assert chunks.read_chunks(spark, path, ["a"], chunks=(first["chunk"], first["chunk"] + 1)).count() == first["rows"]
    assert chunks.read_chunks(spark, path, ["nothing"]).count() == 0
    # two reads in one plan keep their own wants
    both = chunks.read_chunks(spark, path, ["a"], rows=(30, 40)).unionByName(chunks.read_chunks(spark, path, ["a"], rows=(50, 53)))
    assert sorted(r.row for r in both.collect()) == [*range(30, 40), *range(50, 53)]
    with pytest.raises(Exception):
        chunks.read_chunks(spark, path, ["b"]).collect()


def test_batches(spark, folder):
    path, rows = folder
    own = [r[1] for r in rows if r[0] == "a"]
    b = chunks.batches(chunks.read_chunks(spark, path).where("layer = 'a'"), 32)
    got = {r.batch: (r.n, r.lo, r.hi) for r in b.groupBy("batch").agg(F.count("*").alias("n"), F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi")).collect()}
    assert got == {k: (len(own[32 * k : 32 * k + 32]), own[32 * k], own[32 * k : 32 * k + 32][-1]) for k in range(-(-len(own) // 32))}


def test_edges(spark, tmp_path):
    ship(spark)
    empty = spark.createDataFrame([], "layer string, sample_id long, vec array<float>")
    chunks.write_chunks(empty, f"file://{tmp_path}/none")
    assert chunks.read_chunks(spark, f"file://{tmp_path}/none").count() == 0
    uneven = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [1.0, 2.0, 3.0])], empty.schema).coalesce(1)
    with pytest.raises(Exception, match="one length"):
        chunks.write_chunks(uneven, f"file://{tmp_path}/uneven")
    assert not os.path.exists(f"{tmp_path}/uneven/manifest.json")
