"""Structured Streaming forms: windows over event time, running moments, transitions with keyed state. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayline import storage

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """The event files of a folder as a bounded stream; at is the event time."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by window and type."""
    x = df.withWatermark("at", late) if late else df
    w = F.window("at", size, slide) if slide else F.window("at", size)
    g = x.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def sessions(df: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """(user_id, start, n) of runs of events with less than gap between them."""
    x = df.withWatermark("at", late) if late else df
    g = x.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def running_moments(df: DataFrame) -> DataFrame:
    """(event_type, n, mean, var): partial and final moments merge, over any number of batches."""
    return df.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def stream_transitions(df: DataFrame, late: str = "1 hour", keep_ms: int = 400 * 24 * 3_600_000, groups: int = 2048) -> DataFrame:
    """(user_id, i, j, late) of a stream (user_id, at, event_id, event_type): successive event types of each user, in the order of event time, and a row with late = 1 for each event that came behind the watermark, which takes part in nothing.

    The watermark is late behind the latest event. Events wait in the state until it passes them, woken by an event-time timer
    at the earliest of them, so events that are out of order within late give the transitions of the ordered table, across
    batches as well. Events keep_ms or more apart make no transition, and a user whose last event is keep_ms behind the
    watermark is forgotten: the state holds what waits, and one event of each user that is not forgotten.

    Users lie in groups by a hash, and a group has one state and one timer: its rows go into the state as arrays and are ordered
    at once, since a call to the state costs far more than a row. A task holds the rows of one group, and a batch reads and
    writes all that the groups it wakes hold, so groups should grow with the users of the stream and with its largest batch;
    its checkpoint fixes their number. Needs the RocksDB state store (rocksdb). The processor is a class of this call, so that
    workers get it whole, without the package.
    """
    kinds = {"user_id": "long", "us": "long", "event_id": "long", "event_type": "string"}

    class Ordered(StatefulProcessor):
        """Keeps the waiting events of a group of users, and the last one passed on of each."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", ", ".join(f"{c} array<{t}>" for c, t in kinds.items()))

        def wake(self, ms: int, mark: int) -> None:
            # a timer that has just expired goes by itself
            due = [int(t) for t in self.handle.listTimers() if int(t) > mark]
            if not due or ms < min(due):
                for t in due:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(ms)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
            mark, first = timerValues.getCurrentWatermarkInMs(), None
            for x in rows:
                behind = x["us"] // 1000 <= mark
                fresh = x[~behind]
                if len(fresh):
                    self.held.appendValue(tuple(fresh[c].tolist() for c in kinds))
                    ms = int(fresh["us"].min()) // 1000
                    first = ms if first is None else min(first, ms)
                if behind.any():
                    yield pd.DataFrame({"user_id": None if key[0] < 0 else x["user_id"][behind], "i": None, "j": None, "late": 1}, index=x.index[behind])
            if first is not None:
                self.wake(first, mark)

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N803
            mark = timerValues.getCurrentWatermarkInMs()
            held = [pd.DataFrame(dict(zip(kinds, r, strict=True))) for r in self.held.get()] if self.held.exists() else []
            if not held:
                return
            x = pd.concat(held).sort_values(list(kinds), ignore_index=True)
            ms = x["us"] // 1000
            ready = ms <= mark
            # a user's first row is the last one passed on, if there is one; the others are new
            before = (x["user_id"] == x["user_id"].shift()) & ready
            last = ready & ~before.shift(-1, fill_value=False) & (ms + keep_ms > mark)
            stays = x[last | ~ready]
            if len(stays):
                self.held.put([tuple(stays[c].iloc[k : k + 10_000].tolist() for c in kinds) for k in range(0, len(stays), 10_000)])
                self.wake(int((ms + last * keep_ms)[stays.index].min()), mark)
            else:
                self.held.clear()
            pair = before & (ms - ms.shift(fill_value=0) < keep_ms)
            if pair.any():
                yield pd.DataFrame({"user_id": None if key[0] < 0 else x["user_id"], "i": x["event_type"].shift(), "j": x["event_type"], "late": 0})[pair]

        def close(self) -> None:
            pass

    # a null user has a group of its own, as arrays of numbers hold no null
    group = F.when(F.col("user_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int"))
    us, last = F.coalesce(F.unix_micros("at"), F.lit(-(2**63))), F.coalesce("event_id", F.lit(2**63 - 1))
    x = df.withWatermark("at", late).select(group.alias("group"), "at", F.coalesce("user_id", F.lit(0)).alias("user_id"), us.alias("us"), last.alias("event_id"), "event_type")
    return x.groupBy("group").transformWithStateInPandas(Ordered(), "user_id long, i string, j string, late int", "Append", "EventTime")


def rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state of any kind needs, for the session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged_moments(stream: DataFrame, path: str, key: str = "event_type", value: str = "value") -> DataFrame:
    """Run a stream over what there is into a table of running moments below path, and read it: (key, n, mean, m2), m2 the sum of squared deviations.

    Each batch writes a version of the table under its number, from the latest version before and the batch's own moments. A
    batch that is run again writes the same version from the same ones, so nothing counts twice. Versions but the last
    two go.
    """
    spark = stream.sparkSession

    def versions() -> list[int]:
        jvm = spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(base)] if fs.exists(base) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{n}/_SUCCESS")))

    def merge(batch: DataFrame, number: int) -> None:
        x = moments_of(batch, key, value)
        before = [v for v in versions() if v < number]
        if before:
            x = spark.read.schema(x.schema).parquet(f"{path}/versions/{before[-1]}").unionByName(x)
        merged(x, key).write.mode("overwrite").parquet(f"{path}/versions/{number}")
        for v in before[:-1]:
            storage.remove(spark, f"{path}/versions/{v}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = versions()
    if not done:
        return moments_of(spark.createDataFrame([], stream.schema), key, value)
    return spark.read.parquet(f"{path}/versions/{done[-1]}")


def moments_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, m2) of value; nulls don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(value).alias("n"), F.avg(value).cast("double").alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merged(parts: DataFrame, key: str) -> DataFrame:
    """One row of moments a key, of several: deviations of the parts' means from the common one are added."""
    t = parts.groupBy(key).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("within"), F.collect_list(F.struct("n", "mean")).alias("parts"))
    between = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return t.select(key, "n", "mean", (F.col("within") + between).alias("m2"))


def written(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what there is into parquet files below path, with its checkpoint beside them, and read them."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def collected(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, and its result as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
