import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayline.llm import sharding


def brute_shard(key, weights):
    """The shard of a key's text, by the rule."""
    def score(s):
        draw = int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16)
        return -math.log((draw + 0.5) / 16**13) / weights[s]

    return min((score(s), s) for s in range(len(weights)) if weights[s] > 0)[1]


def test_shards_of_the_rule(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(500)] + [(None, "n"), (7, None), (7, "again")], "doc_id long, text string")
    weights = [1.0, 2.5, 0.0, 0.5]
    got = sharding.assigned(df, weights, ["doc_id"], grown=3.0).collect()
    assert len(got) == 503
    for r in got:
        key = "-" if r.doc_id is None else f"{len(str(r.doc_id))}={r.doc_id}"
        assert (r.shard, r.grown_shard) == (brute_shard(key, weights), brute_shard(key, [*weights, 3.0]))


def test_growth_moves_only_into_the_new_shard(spark):
    df = spark.range(40_000).withColumnRenamed("id", "doc_id")
    rows = sharding.assigned(df, [1, 1, 2, 4], ["doc_id"]).collect()
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert all(abs(sizes[s] - 40_000 * w / 8) < 500 for s, w in enumerate([1, 1, 2, 4]))
    assert abs(sum(r.grown_shard == 4 for r in rows) - 40_000 / 9) < 500
    # a larger weight takes records only to its shard
    more = {r.doc_id: r.shard for r in sharding.assigned(df, [1, 1, 3, 4], ["doc_id"], None).collect()}
    assert all(more[r.doc_id] in (r.shard, 2) for r in rows) and any(more[r.doc_id] != r.shard for r in rows)


def slots_without_gaps(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    return all(sorted(x) == list(range(len(x))) for x in by.values())


def test_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    # a third of the rows has one key, another third none; names that the operator uses itself are kept
    df = spark.range(9_000).select(F.expr("case when id < 3000 then 5 when id < 6000 then null else id end").alias("doc_id"), F.col("id").alias("row"), F.lit(1).alias("slot"), F.lit("s").alias("s"), F.lit(2).alias("shard"))
    out = sharding.slotted(sharding.assigned(df, 3, ["doc_id"]), ["doc_id"])
    assert out.columns == ["doc_id", "row", "s", "shard", "grown_shard", "slot"]
    rows = out.collect()
    assert sorted(r.row for r in rows) == list(range(9_000)) and slots_without_gaps(rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    empty = sharding.slotted(sharding.assigned(df.limit(0), 3, ["doc_id"]), ["doc_id"])
    assert empty.count() == 0 and empty.columns == out.columns


def test_weights_are_checked(spark):
    for bad in (0, [], [0.0], [1, -1], [math.nan], [math.inf]):
        with pytest.raises(ValueError):
            sharding.assigned(spark.range(1), bad, ["id"])


def test_keys_of_several_columns_stay_apart(spark):
    df = spark.createDataFrame([("a,1=b", "c"), ("a", "b"), (None, "-"), ("-", None)], "x string, y string")
    keys = [r[0] for r in df.select(sharding.key_text(F.col("x"), F.col("y"))).collect()]
    assert len(set(keys)) == 4


def test_write_shards(spark, tmp_path):
    df = sharding.assigned(spark.range(1_000).withColumn("text", F.lit("t")), 4, ["id"])
    sharding.write_shards(df, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(r.id, r.shard) for r in back.collect()} == {(r.id, r.shard) for r in df.collect()}


def test_query(spark, tmp_path):
    from wayline.llm import queries

    long = "é" * 300_000
    spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (None, long), (1, "ab")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = queries.op12_sharding(spark, f"file://{tmp_path}").collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in ("ab", None, "", long, "ab"))
    assert {r.law for r in rows} == {"key"} and slots_without_gaps(rows)
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
