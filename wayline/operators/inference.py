"""Probes, controls, permutation tests and resampling, with hashes in place of random streams so that results repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline import storage
from wayline.operators import ranks


def auc(df: DataFrame, group: list[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """(group..., auc): Mann-Whitney with average ranks, weights allowed; 0.5 where a class is missing. Equal scores are added up first."""
    w = F.col(weight) if weight else F.lit(1.0)
    g = df.groupBy(*group, score).agg(F.sum(w).alias("m"), F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("p"))
    g = ranks.running(g, score, F.col("m") - F.col("p"), "below", group)
    won = g.withColumn("won", F.col("p") * (F.coalesce("below", F.lit(0.0)) + (F.col("m") - F.col("p")) / 2))
    t = won.groupBy(*group).agg(F.sum("won").alias("u"), F.sum("p").alias("pos"), F.sum(F.col("m") - F.col("p")).alias("neg"))
    return t.select(*group, F.when((F.col("pos") == 0) | (F.col("neg") == 0), 0.5).otherwise(F.col("u") / (F.col("pos") * F.col("neg"))).alias("auc"))


def aucs(df: DataFrame, group: list[str], runs: int, score: str = "score", labels: str = "labels") -> DataFrame:
    """(group..., run, auc) of df (group..., score, labels): as auc, for each of the runs labels in an array. Scores are ranked once, as ranks don't depend on labels."""
    g = df.groupBy(*group, score).agg(F.count("*").alias("m"), *(F.count_if(F.get(labels, F.lit(k)) == 1).alias(f"p{k}") for k in range(runs)))
    g = ranks.running(storage.stored(g, "scores"), score, F.col("m"), "below", group)
    rank = F.coalesce("below", F.lit(0)) + (F.col("m") + 1) / 2
    t = g.groupBy(*group).agg(F.sum("m").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(runs)), *(F.sum(rank * F.col(f"p{k}")).alias(f"r{k}") for k in range(runs)))
    each = t.select(*group, "n", F.posexplode(F.array(*(F.struct(F.col(f"p{k}").cast("double").alias("p"), F.col(f"r{k}").alias("r")) for k in range(runs)))).alias("run", "s"))
    pos, neg = F.col("s.p"), F.col("n") - F.col("s.p")
    return each.select(*group, "run", F.when((pos == 0) | (neg == 0), 0.5).otherwise((F.col("s.r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def shuffled(df: DataFrame, key: str, value: str, groups: list[str], seed: Column) -> DataFrame:
    """df (groups..., key, value) with value dealt anew in each group by keyed hashes: ranks of two orders are joined."""
    a = ranks.hash_rank(df, key, seed, "rk", groups)
    b = ranks.hash_rank(df, key, F.lit(-1), "rk", groups).select(*groups, "rk", F.col(value).alias("dealt"))
    return a.join(b, [*groups, "rk"]).drop("rk", value).withColumnRenamed("dealt", value)


def _mixed(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(keys, seeds) of hashes: splitmix64 of each key moved on by each seed."""
    x = keys[:, None] + (seeds[None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Rows that meet all replicates at once, and ranges of hashes of one replicate at most.
STEP, MOST_BINS = 256, 512


def permuted_sums(games: DataFrame, n: int) -> tuple[DataFrame, int]:
    """((run, s), rows): for each run the sum of score times outcome, outcomes dealt anew: in order of a run's hashes of game_id, rows take the outcomes in rising order.

    No row is copied. One pass counts and sums each run's hashes by range; that tells the range in which each outcome begins. A
    second takes only the rows in those ranges, which are ranked. Runs times distinct outcomes are broadcast.
    """
    spark = games.sparkSession
    x = games.select(F.xxhash64("game_id").alias("h"), "game_id", F.col("score").cast("double").alias("score"), F.col("outcome").cast("double").alias("outcome")).where("score is not null and outcome is not null")
    values = sorted(tuple(r) for r in x.groupBy("outcome").count().collect())
    rows = sum(c for _, c in values)
    bins = max(1, min(MOST_BINS, rows // 256))

    def places(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(b["h"].to_numpy().astype(np.int64).view(np.uint64), np.arange(n, dtype=np.uint64))
        return h, ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(n * bins, np.int64), np.zeros(n * bins)
        for b in batches:
            for lo in range(0, len(b), STEP):
                part = b.iloc[lo : lo + STEP]
                at = (np.arange(n) * bins + places(part)[1]).ravel()
                count += np.bincount(at, minlength=n * bins)
                total += np.bincount(at, np.repeat(part["score"].to_numpy(), n), n * bins)
        some = np.flatnonzero(count)
        yield pd.DataFrame({"run": (some // bins).astype(np.int32), "bin": (some % bins).astype(np.int32), "c": count[some], "t": total[some]})

    sums = x.select("h", "score").mapInPandas(tally, "run int, bin int, c long, t double").groupBy("run", "bin").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    before = Window.partitionBy("run").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"c0": F.coalesce(F.sum("c").over(before), F.lit(0)), "t0": F.coalesce(F.sum("t").over(before), F.lit(0.0))})
    # an outcome takes the rows from its first place on: what it has more than the one before counts for all of those
    firsts, at, last = [], 0, 0.0
    for v, c in values:
        firsts.append((at, v - last))
        at, last = at + c, v
    cuts = spark.createDataFrame(firsts, "first long, more double")
    all_ = sums.groupBy("run").agg(F.sum("t").alias("all"))
    asked = sums.crossJoin(F.broadcast(cuts)).where("first >= c0 and first < c0 + c").select("run", "bin", (F.col("first") - F.col("c0")).alias("k"), "t0", "more")
    asked = storage.stored(asked, "asked")
    pairs = [tuple(r) for r in asked.select("run", "bin").distinct().collect()]
    shared = spark.sparkContext.broadcast(np.array(pairs, np.int64).reshape(-1, 2))

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.zeros(n * bins, bool)
        wanted[shared.value[:, 0] * bins + shared.value[:, 1]] = True
        for b in batches:
            for lo in range(0, len(b), STEP):
                part = b.iloc[lo : lo + STEP]
                h, place = places(part)
                i, run = np.nonzero(wanted[np.arange(n) * bins + place])
                yield pd.DataFrame({"run": run.astype(np.int32), "bin": place[i, run].astype(np.int32), "o": h[i, run].view(np.int64) ^ np.int64(-(2**63)), "game_id": part["game_id"].to_numpy()[i], "score": part["score"].to_numpy()[i]})

    kind = x.schema["game_id"].dataType.simpleString()
    near = x.select("h", "game_id", "score").mapInPandas(picked, f"run int, bin int, o long, game_id {kind}, score double")
    order = Window.partitionBy("run", "bin").orderBy("o", "game_id")
    near = near.withColumn("place", F.row_number().over(order) - 1)
    inside = near.join(asked, ["run", "bin"]).groupBy("run", "bin", "k", "t0", "more").agg(F.sum(F.when(F.col("place") < F.col("k"), F.col("score")).otherwise(0.0)).alias("t1"))
    s = inside.join(all_, "run").groupBy("run").agg(F.sum(F.col("more") * (F.col("all") - F.col("t0") - F.col("t1"))).alias("s"))
    return s, rows


def permutation_pvalue(games: DataFrame, n: int = 1_000, two_sided: bool = True, plus_one: bool = False) -> DataFrame:
    """(observed, p_value, n) of the correlation of score and outcome in games (game_id, score, outcome): outcomes are dealt anew n times, by permuted_sums. Both null where one of the two doesn't vary."""
    spark = games.sparkSession
    schema = "observed double, p_value double, n long"
    one = games.where("score is not null and outcome is not null").agg(F.covar_pop("score", "outcome"), F.avg("score"), F.avg("outcome"), F.stddev_pop("score"), F.stddev_pop("outcome")).first()
    together, mean_x, mean_y, dev_x, dev_y = one
    if not dev_x or not dev_y:
        return spark.createDataFrame([(None, None, n)], schema)
    observed = together / (dev_x * dev_y)
    sums, rows = permuted_sums(games, n)
    r = (np.array([x[0] for x in sums.select("s").collect()]) / rows - mean_x * mean_y) / (dev_x * dev_y)
    beyond = int((np.abs(r) >= abs(observed) if two_sided else r >= observed).sum())
    extra = 1 if plus_one else 0
    return spark.createDataFrame([(observed, (beyond + extra) / (n + extra), n)], schema)


def poisson_cuts() -> np.ndarray:
    """Cumulative Poisson(1) probabilities, up to where the next is no more: a uniform number's place among them is a draw."""
    cuts, p, k = [], np.exp(-1.0), 0
    while not cuts or cuts[-1] + p > cuts[-1]:
        cuts.append((cuts[-1] if cuts else 0.0) + p)
        k += 1
        p /= k
    return np.array(cuts)


def bootstrap_aucs(df: DataFrame, key: str, n: int) -> np.ndarray:
    """The AUC of df (key, score, label) in n replicates, in which a row counts as often as a Poisson(1) draw by the hash of its key says. 0.5 where a class is missing.

    A row is read once and meets all replicates in its task. Rows are dealt over ranges of scores; of each, n sums come back.
    """
    x = df.select(F.xxhash64(key).alias("h"), F.col("score").cast("double").alias("score"), (F.col("label") == 1).alias("pos")).where("score is not null and pos is not null")
    x = ranks._bucketed(x, "score", [], x.count()).withColumnRenamed("_b", "b")
    rows = x.repartition("b").sortWithinPartitions("b", "score")
    cuts = poisson_cuts()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def fresh() -> list:
            return [np.zeros(n) for _ in range(5)] + [None]

        def close(s: list) -> None:
            """The rows of one score, tied with each other, go to those below."""
            u, below, pos, p, q, _ = s
            u += p * (below + q / 2)
            pos += p
            below += q
            p[:], q[:] = 0, 0

        def out() -> pd.DataFrame:
            close(state)
            return pd.DataFrame({"b": [now], "u": [state[0]], "neg": [state[1]], "pos": [state[2]]})

        for batch in batches:
            for lo in range(0, len(batch), STEP):
                part = batch.iloc[lo : lo + STEP]
                u = (_mixed(part["h"].to_numpy().view(np.uint64), np.arange(n, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
                w = np.searchsorted(cuts, u.ravel(), "right").reshape(u.shape).astype(float)
                b, score, positive = part["b"].to_numpy(), part["score"].to_numpy(), part["pos"].to_numpy(dtype=bool)
                first = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (score[1:] != score[:-1])))
                p, q = np.add.reduceat(w * positive[:, None], first), np.add.reduceat(w * ~positive[:, None], first)
                for i, at in enumerate(first):
                    if b[at] != now:
                        if now is not None:
                            yield out()
                        now, state = b[at], fresh()
                    if state[5] != score[at]:
                        close(state)
                        state[5] = score[at]
                    state[3] += p[i]
                    state[4] += q[i]
        if now is not None:
            yield out()

    parts = sorted((r["b"], r["u"], r["neg"], r["pos"]) for r in rows.mapInPandas(run, "b int, u array<double>, neg array<double>, pos array<double>").collect())
    u, below, pos = np.zeros(n), np.zeros(n), np.zeros(n)
    for _, own, q, p in parts:
        u += np.array(own) + np.array(p) * below
        below += np.array(q)
        pos += np.array(p)
    both = pos * below
    return np.where(both > 0, u / np.maximum(both, 1e-300), 0.5)


def bootstrap_auc(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """(low, high, n): 2.5 and 97.5 percentiles of the AUC over n replicates of df (key, score, label)."""
    low, high = np.quantile(bootstrap_aucs(df, key, n), [0.025, 0.975])
    return df.sparkSession.createDataFrame([(float(low), float(high), n)], "low double, high double, n long")
