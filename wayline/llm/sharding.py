"""Shards by weighted rendezvous hashing of stable record keys.

Every shard draws a number from a record's key and its own name, and the record goes to the shard of the best draw, weighted.
A shard's draws don't depend on the other shards: one more shard takes records only into itself, one less gives its records
to the others, and a change of one weight moves records only to or from that shard. All of it is DataFrame functions.

assigned is a map without a shuffle. slotted numbers each shard's records: order buckets are numbered apart and added up, so
no task has a whole shard, and copies of one record are dealt over parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm import common

#: Records of one order bucket of a shard, roughly, and buckets of a shard at least.
BUCKET_ROWS, LEAST_BUCKETS = 10_000, 32
#: Hexadecimal digits of a digest that make a draw.
DIGITS = 13


def key_text(*columns: Column) -> Column:
    """One string for the values of columns (cast to strings), different for different values; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws(",", *parts)


def digits(text: Column) -> Column:
    """The number in the first DIGITS hexadecimal digits of text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _best(key: Column, weights: list[float]) -> Column:
    """The shard with the least -ln(u) / weight, u in (0, 1) from the MD5 of key:shard; ties to the smaller shard. Shards of weight 0 take nothing."""
    scores = []
    for shard, w in enumerate(weights):
        if w > 0:
            draw = digits(F.concat(key, F.lit(f":{shard}"))).cast("double")
            scores.append(F.struct((-F.ln((draw + 0.5) / float(16**DIGITS)) / float(w)).alias("score"), F.lit(shard).alias("shard")))
    return scores[0]["shard"] if len(scores) == 1 else F.least(*scores)["shard"]


def checked(weights: int | list[float]) -> list[float]:
    """Weights as a list; a number is that many equal shards. ValueError if there is no shard, or a weight is negative or not finite, or all are 0."""
    out = [1.0] * weights if isinstance(weights, int) else [float(w) for w in weights]
    if not out or any(w < 0 or not math.isfinite(w) for w in out) or not any(out):
        raise ValueError(f"weights {weights}")
    return out


def assigned(df: DataFrame, weights: int | list[float], key: list[str], grown: float | None = 1.0) -> DataFrame:
    """df with shard, and grown_shard: where the record would be with one more shard of weight grown (null if grown is None).

    weights: of the shards 0, 1, ..., or their number. The columns key and the weights alone decide; a null in them is a
    value as any other. Rows that repeat a key share a shard. Columns of df with the new names are replaced; others, and an
    empty table, are kept as they are.
    """
    weights = checked(weights)
    rest = [c for c in df.columns if c not in ("shard", "grown_shard")]
    k = key_text(*(df[c] for c in key))
    more = _best(k, [*weights, *checked([grown])]) if grown is not None else F.lit(None).cast("int")
    return df.select(*(df[c] for c in rest), _best(k, weights).alias("shard"), more.alias("grown_shard"))


def slotted(df: DataFrame, key: list[str]) -> DataFrame:
    """df, which has shard, with slot: 0, 1, ... without gaps in each shard, in order of the digests of the columns key.

    df is written to the shared folder once, so that numbers hold if a task runs again. Rows alike in key come in any order.
    A bucket with more than one part in HOT_SHARE of all rows (copies of a key) is dealt over parts by the stored rows' places;
    the broadcast list of such buckets has HOT_SHARE rows at most. An empty table gives no rows.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != "slot"]
    row = F.struct(*(df[c] for c in rest)).alias("row")
    at = common.stored(df.select(row, df["shard"].alias("s"), digits(key_text(*(df[c] for c in key))).alias("h"), F.monotonically_increasing_id().alias("at")), "shards")
    n, shards = at.agg(F.count("*"), F.count_distinct("s")).first()
    buckets = max(LEAST_BUCKETS, -(-n // (max(shards, 1) * BUCKET_ROWS)))
    # buckets are ranges of the hash
    keyed = at.withColumn("b", F.floor(F.col("h") / float(16**DIGITS) * buckets).cast("long"))
    limit = max(4 * BUCKET_ROWS, n // common.HOT_SHARE)
    hot = keyed.groupBy("s", "b").count().where(F.col("count") > limit).select("s", "b", F.ceil(F.col("count") / BUCKET_ROWS).alias("parts"))
    hot = common.stored(hot, "hot")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("at"), F.col("parts")))
    keyed = keyed.join(F.broadcast(hot), ["s", "b"], "left").withColumn("p", part.cast("long")).drop("parts")
    sizes = keyed.groupBy("s", "b", "p").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("s").orderBy("b", "p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("s", "b", "p", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("s", "b", "p").orderBy("h", "at")) - 1
    out = keyed.withColumn("own", own).join(sizes, ["s", "b", "p"])
    return out.select("row.*", (F.col("before") + F.col("own")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """df, which has shard, as Parquet in a folder per shard. Rows of a shard are dealt over several files by the size that Spark's settings give."""
    df.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
