"""Streams of several batches: order within the watermark, late rows, state that goes, and batches that are run again."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from wayline.plans import registry
from wayline.streaming import jobs

START = datetime(2024, 1, 1)


def files(spark, folder, batches):
    """Parquet files of (event_id, user_id, at in minutes, type), one a batch, in order."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(i, START + timedelta(minutes=m), u, e, float(i), "") for i, u, m, e in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/{k:03}")


def stream(spark, folder):
    return spark.readStream.schema(jobs.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder)).withColumn("at", F.col("ts").cast("timestamp"))


def plain(rows, until):
    out = []
    for u in {r[1] for r in rows}:
        own = [r[3] for r in sorted((r for r in rows if r[1] == u and r[2] <= until), key=lambda r: (r[2], r[0]))]
        out += [(u, a, b) for a, b in zip(own, own[1:], strict=False)]
    return sorted(out)


def test_rows_out_of_order_give_the_batch(spark, tmp_path):
    jobs.rocksdb(spark)
    r = random.Random(1)
    rows = [(i, r.randint(1, 5), 20 * i + r.randint(0, 9), r.choice("abc")) for i in range(60)]
    # each row is at most 55 minutes behind one that came before
    came = sorted(rows, key=lambda x: x[2] + r.randint(0, 50))
    files(spark, tmp_path / "in", [came[k : k + 12] for k in range(0, 60, 12)])
    got = jobs.written(jobs.stream_transitions(stream(spark, tmp_path / "in"), "1 hour"), f"file://{tmp_path}/out").collect()
    assert not any(x.late for x in got)
    until = max(x[2] for x in rows) - 60
    assert sorted((x.user_id, x.i, x.j) for x in got) == plain(rows, until)


def test_late_rows_are_told_and_state_goes(spark, tmp_path):
    jobs.rocksdb(spark)
    day = 24 * 60
    batches = [[(1, 1, 0, "a"), (2, 1, 10, "b"), (3, 2, 5, "a")], [(4, 3, day, "c")], [(5, 1, 20, "late"), (6, 3, day + 5, "a")], [(7, 1, 5 * day, "c"), (8, 4, 9 * day, "x")], [(9, 4, 9 * day + 1, "y"), (10, 4, 9 * day + 600, "z")]]
    files(spark, tmp_path / "in", batches)
    q = jobs.stream_transitions(stream(spark, tmp_path / "in"), "1 hour", keep_ms=2 * day * 60_000).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(x)[:3] for x in spark.table("told").collect() if not x.late)
    # the last event of user 1 was forgotten before the one on day 5
    assert got == [(1, "a", "b"), (3, "c", "a"), (4, "x", "y")]
    told = sum(x.late for x in spark.table("told").collect())
    dropped = sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)
    assert told + dropped == 1


def test_moments_of_batches_run_again(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, 1, i, "ab"[int(rng.integers(2))]) for i in range(90)]
    files(spark, tmp_path / "in", [rows[k : k + 30] for k in range(0, 90, 30)])
    path = f"file://{tmp_path}/out"

    def check():
        got = {x.event_type: x for x in jobs.merged_moments(stream(spark, tmp_path / "in"), path).collect()}
        for e in "ab":
            v = np.array([float(r[0]) for r in rows if r[3] == e])
            assert (got[e].n, got[e]["mean"], got[e].m2) == (len(v), pytest.approx(v.mean()), pytest.approx(((v - v.mean()) ** 2).sum()))

    check()
    # the last batch's commit is lost: it is run again, and changes nothing
    import os

    commits = sorted(f for f in os.listdir(f"{tmp_path}/out/state/commits") if f.isdigit())
    os.remove(f"{tmp_path}/out/state/commits/{commits[-1]}")
    crc = f"{tmp_path}/out/state/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    check()
    files(spark, tmp_path / "more", [[]])
    assert jobs.merged_moments(stream(spark, tmp_path / "more"), f"file://{tmp_path}/none").count() == 0


def test_users_share_a_state(spark, tmp_path):
    jobs.rocksdb(spark)
    rows = [(i, i % 500, i // 50, "abc"[i * i % 7 % 3]) for i in range(6000)]
    files(spark, tmp_path / "in", [rows[:3000], rows[3000:]])
    t = jobs.stream_transitions(stream(spark, tmp_path / "in"), "10 minutes", groups=8)
    q = t.writeStream.format("memory").queryName("shared").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((x.user_id, x.i, x.j) for x in spark.table("shared").collect()) == plain(rows, 119 - 10)
    # a list of rows, and timers by key and by time, for each group
    assert 0 < max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= 3 * 8


def test_transitions_of_odd_events_are_those_of_the_sql(spark, duck, tmp_path):
    at = lambda us: START + timedelta(microseconds=us)
    hour = 3_600_000_000
    # two events of one millisecond that come by time, not by number; events of nobody; an event without a type; ids that no double holds
    rows = [(2, at(100), 1, "a"), (1, at(900), 1, "b"), (3, at(5000), 1, "a"), (4, at(0), None, "x"), (5, at(1), None, "y"), (6, at(0), 2, "a"), (7, at(1), 2, None), (8, at(2), 2, "c"), (12, at(3), 2, None)]
    rows += [(2**62 + 1, at(7), 2**62, "a"), (2**62, at(7), 2**62, "b"), (9, at(8), 2**62 + 1, "z"), (10, at(2 * hour), 1, "c"), (11, None, 1, "a")]
    df = spark.createDataFrame([(i, t, u, e, 0.0, "") for i, t, u, e in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/in")
    next((tmp_path / "in").glob("*.parquet")).rename(tmp_path / "events.parquet")
    own = duck.cursor()
    own.execute("CREATE SCHEMA odd")
    own.execute("SET schema = 'odd'")
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    try:
        same_rows(registry.QUERIES["stream_transition_counts"](spark, str(tmp_path)), own.execute(registry.ORACLES["stream_transition_counts"]))
    finally:
        own.execute("DROP SCHEMA odd CASCADE")
