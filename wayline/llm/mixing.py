"""Interleaving of sources to target weights, by Pfair scheduling.

Each source is a task that gets one slot (a block of its documents) at a time. With weights w of sum W, block j of a source
is released at slot floor(j * W / w) and due by slot ceil((j + 1) * W / w); among released blocks the earliest deadline goes
first (ties: by name), which on one machine meets all deadlines. Up to any slot, each source is then less than one block
away from its target. Weights are exact rationals (a float is one) and aren't rounded to a period, so this holds however
long the mixture is. Slots are dealt on the driver up to the first one for which a source has no full block.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm import common

#: Slots of the schedule that are broadcast at most; a longer one is joined by shuffle.
BROADCAST_SLOTS = 1_000_000
#: Rows of one order bucket, roughly: what one task ranks at once.
BUCKET_ROWS = 20_000
#: Sources whose table is broadcast at most; a longer one is joined by shuffle, with hot sources dealt out.
BROADCAST_SOURCES = 100_000


def exact_weights(targets: dict) -> dict:
    """Integer weights in exactly the targets' proportions (of any sum), by name."""
    positive = {s: Fraction(w) for s, w in targets.items() if w and w > 0}
    scale = math.lcm(*(w.denominator for w in positive.values()))
    return {s: int(positive[s] * scale) for s in sorted(positive, key=str)}


def pfair_slots(weights: list[int]) -> Iterator[int]:
    """The source (its place in weights) of each slot, without end."""
    total = sum(weights)
    turn = [0] * len(weights)
    future = [(0, i) for i in range(len(weights))]
    ready: list[tuple[int, int]] = []
    slot = 0
    while weights:
        while future and future[0][0] <= slot:
            _, i = heapq.heappop(future)
            heapq.heappush(ready, (-(-(turn[i] + 1) * total // weights[i]), i))
        due, i = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block missed its deadline")
        yield i
        turn[i] += 1
        heapq.heappush(future, (turn[i] * total // weights[i], i))
        slot += 1


def max_deviation(order: list, weights: dict) -> Fraction:
    """The largest distance, in blocks, between what a source has got and its target, over all prefixes."""
    period, got, worst = sum(weights.values()), dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(order, 1):
        got[s] += 1
        worst = max(worst, *(abs(Fraction(w * t, period) - got[x]) for x, w in weights.items()))
    return worst


def _ranked(df: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """df (src, row, ...) with rank: its place from 0 in its source's order of keyed hashes of whole rows.

    No task gets a whole source: order buckets are ranked apart and added up. A bucket is much larger than BUCKET_ROWS only
    if many rows are alike; those are dealt over parts by their numbers at, which are stored, so that each part is small again.
    """
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    plain = [f"row.`{f.name}`" for f in df.schema["row"].dataType if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "interval"))]
    keyed = df.withColumn("h", F.xxhash64(*map(F.col, plain), F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 16), F.lit(buckets)))
    counts = keyed.groupBy("src", "bucket").count()
    # HOT_SHARE rows at most
    large = counts.where(F.col("count") > max(2 * BUCKET_ROWS, n_rows // common.HOT_SHARE)).select("src", "bucket", F.expr(f"ceil(count / {BUCKET_ROWS})").alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("at"), F.col("parts")))
    keyed = keyed.join(F.broadcast(large), ["src", "bucket"], "left").withColumn("part", part).drop("parts")
    sizes = keyed.groupBy("src", "bucket", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("src").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("src", "bucket", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("src", "bucket", "part").orderBy("h", F.col("id").asc_nulls_first(), "at")) - 1
    return keyed.withColumn("own", own).join(sizes, ["src", "bucket", "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("h", "bucket", "part", "own", "before")


def mix_sources(df: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = 64, seed: int = 7) -> DataFrame:
    """df with mix_block (slot of the row's block), mix_row (its place in it), mix_position (slot * block_rows + place) and mix_exact.

    Ordering by mix_position gives the mixture. Within a source, order is by a keyed hash of the whole row. No row is dropped:
    mix_exact marks slots before the first source runs out of full blocks, up to where every source is less than one
    block off its target; later blocks follow in the order of the slots at which the weights release them, without those
    of sources that are used up, so their slots have gaps. All sources take part, however many. weights: target by source, default the square
    root of each source's row count; sources without a weight (or of weight 0) come last, after all others, with
    mix_exact false. A null source and an empty one are one, named "". Rows that repeat an id, or a null id, are rows of their
    own; rows alike in all columns come in any order. Columns of df that have the new names are replaced. An empty table
    gives no rows. df is written to the shared folder once. The driver holds a row per source and 16 bytes per
    exact slot: with very many rows, block_rows should be so large that rows / block_rows fits it.
    """
    new = ["mix_block", "mix_row", "mix_position", "mix_exact"]
    names = [c for c in df.columns if c not in new]
    packed = df.select(F.struct(*[df[c] for c in names]).alias("row"), F.coalesce(df[source_col].cast("string"), F.lit("")).alias("src"), df[id_col].alias("id"), F.monotonically_increasing_id().alias("at"))
    packed = common.stored(packed, "mixed")
    sizes = {r["src"]: r["count"] for r in packed.groupBy("src").count().collect()}
    n_rows = sum(sizes.values())
    chosen = exact_weights(weights if weights is not None else {s: n**0.5 for s, n in sizes.items()})
    total, full = sum(chosen.values()), [sizes.get(s, 0) // block_rows for s in chosen]
    order, turns, dealt = array("q"), array("q"), [0] * len(chosen)
    for i in pfair_slots(list(chosen.values())):
        if dealt[i] == full[i]:
            break
        order.append(i)
        turns.append(dealt[i])
        dealt[i] += 1
    horizon = len(order)
    # later blocks: source i has every len(chosen)-th slot from its place on; the distance of its blocks is bounded, so that positions stay 64-bit
    bound = 2**61 // (block_rows * max(1, len(chosen)))
    steps = [float(min(Fraction(total, w), Fraction(bound, n + 1))) for w, n in zip(chosen.values(), full, strict=True)]
    last = horizon + max((int(x * (n + 1)) + 1 for x, n in zip(steps, full, strict=True)), default=0) * len(chosen)
    spark = df.sparkSession
    per = spark.createDataFrame(pa.table({"src": pa.array(list(map(str, chosen)), pa.string()), "i": pa.array(range(len(chosen)), pa.int64()), "step": pa.array(steps, pa.float64()), "size": pa.array([sizes.get(s, 0) for s in chosen], pa.int64())}))
    schedule = spark.createDataFrame(pa.table({"i": pa.array(order, pa.int64()), "block": pa.array(turns, pa.int64()), "slot": pa.array(range(horizon), pa.int64())}))
    # all sources without weight are ranked as one
    tasks = packed.join(F.broadcast(per.drop("size")), "src", "left") if len(chosen) <= BROADCAST_SOURCES else common.join_groups(packed, per, ["src"], n_rows, "at", "left")
    tasks = tasks.withColumn("src", F.when(F.col("i").isNotNull(), F.col("src")).otherwise("\u0000"))
    ranked = _ranked(tasks, n_rows, seed).withColumn("block", F.floor(F.col("rank") / block_rows)).withColumn("place", F.col("rank") % block_rows)
    placed = ranked.join(F.broadcast(schedule) if horizon <= BROADCAST_SLOTS else schedule, ["i", "block"], "left")
    later = F.lit(horizon) + F.floor(F.col("block") * F.col("step")) * len(chosen) + F.col("i")
    at = F.when(F.col("slot").isNotNull(), F.col("slot")).when(F.col("i").isNotNull(), later).otherwise(F.col("block") + last)
    placed = placed.withColumn("spot", at.cast("long"))
    return placed.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("spot").alias("mix_block"), F.col("place").cast("int").alias("mix_row"), (F.col("spot") * block_rows + F.col("place")).cast("long").alias("mix_position"), (F.col("spot") < horizon).alias("mix_exact"))
