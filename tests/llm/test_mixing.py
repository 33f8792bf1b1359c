import math
import random
from collections import Counter
from fractions import Fraction
from itertools import islice

import pytest
from pyspark.sql import functions as F

from wayline.llm import mixing


def test_pfair_deviation():
    random.seed(0)
    for _ in range(300):
        w = {str(i): random.randint(1, 60) for i in range(random.randint(1, 9))}
        names = sorted(w)
        order = [names[i] for i in islice(mixing.pfair_slots([w[s] for s in names]), sum(w.values()))]
        assert Counter(order) == Counter(w) and mixing.max_deviation(order, w) < 1


def test_order(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), F.lit(1).alias("mix_row"))
    out = mixing.mix_sources(df, {"s1": 3, "s2": 1, "": 2}, block_rows=10).collect()
    assert len(out) == 3000 and len({r.mix_position for r in out}) == 3000
    exact = sorted((r for r in out if r.mix_exact), key=lambda r: r.mix_position)
    assert [r.mix_position for r in exact] == list(range(len(exact))) and exact
    got, want = Counter(), {"s1": 0.5, "s2": 1 / 6, "": 1 / 3}
    for n, r in enumerate(exact, 1):
        got[r.source or ""] += 1
        assert all(abs(got[s] - w * n) < 2 * 10 for s, w in want.items())
    for t in range(10, len(exact), 10):
        c = Counter(r.source or "" for r in exact[:t])
        assert all(abs(c[s] - w * t) < 10 for s, w in want.items())
    assert all(not r.mix_exact for r in out if (r.source or "") not in want)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def deviation(rows, target, block_rows):
    """The largest distance in blocks from the target, over all prefixes of whole blocks of the exact part."""
    at = {r.mix_block: r.source for r in rows if r.mix_exact}
    assert sorted(at) == list(range(len(at)))
    total, got, worst = sum(target.values()), Counter(), 0
    for t in range(len(at)):
        got[at[t]] += 1
        worst = max(worst, *(abs(w * (t + 1) / total - got[s]) for s, w in target.items()))
    return len(at), worst


def test_long_mixture_keeps_exact_targets(spark):
    # 0.0004 and 0.0011 aren't whole parts of 1,000
    target = {"a": 0.9985, "b": 0.0004, "c": 0.0011}
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("case when id < 40 then 'b' when id < 120 then 'c' else 'a' end").alias("source"))
    rows = mixing.mix_sources(df, target, block_rows=1).collect()
    n, worst = deviation(rows, target, 1)
    assert n > 20_000 and worst < 1
    assert len({r.mix_position for r in rows}) == 30_000


@pytest.mark.parametrize("most", [100_000, 10])
def test_many_sources(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    # 1,500 sources of 4 rows: all of them have a share
    df = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 1500).cast("string")).alias("source"))
    rows = mixing.mix_sources(df, block_rows=2).collect()
    n, worst = deviation(rows, {f"s{i}": 1 for i in range(1500)}, 2)
    assert n == 3_000 and worst < 1 and all(r.mix_exact for r in rows)
    # with explicit weights too, small sources included, and tiny weights keep positions distinct
    rows = mixing.mix_sources(df, {f"s{i}": 1e-30 if i == 7 else i + 1 for i in range(1500)}, block_rows=2).collect()
    assert len({r.mix_position for r in rows}) == 6_000 and min(r.mix_position for r in rows) >= 0


def brute_slots(weights, blocks):
    """Slots dealt one by one among all released blocks, the earliest deadline first, to the first source without a block."""
    total, done, out = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0), []
    while True:
        t = len(out)
        released = [(math.ceil((done[s] + 1) * total / Fraction(w)), s) for s, w in sorted(weights.items()) if math.floor(done[s] * total / Fraction(w)) <= t]
        s = min(released)[1]
        if done[s] == blocks[s]:
            return out
        out.append(s)
        done[s] += 1


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(spark, seed):
    r = random.Random(seed)
    weights = {f"s{i}": r.choice([0.1, 0.25, 1, 3, 1 / 3, 7.5]) for i in range(r.randint(1, 6))}
    sizes = {s: r.randint(0, 400) for s in [*weights, "other"]}
    rows = [(i, s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=7).collect()
    want = brute_slots(weights, {s: sizes[s] // 7 for s in weights})
    exact = sorted((x for x in got if x.mix_exact), key=lambda x: x.mix_position)
    assert [x.source for x in exact] == [s for s in want for _ in range(7)]
    assert [x.mix_position for x in exact] == list(range(7 * len(want)))
    assert sorted((x.doc_id, x.source) for x in got) == sorted(rows) and len({x.mix_position for x in got}) == len(rows)
    # later blocks: in the order of their release, those of unweighted sources last
    later = [x for x in got if not x.mix_exact]
    assert all(x.mix_position > y.mix_position for x in later for y in exact[-1:])
    if sizes["other"] and len(later) > sizes["other"]:
        assert min(x.mix_position for x in later if x.source == "other") > max(x.mix_position for x in later if x.source != "other")


def test_rows_alike(spark, monkeypatch):
    # null ids, repeated ids and equal rows: the buckets stay small, positions distinct
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(None, "a", f"t{i}") for i in range(300)] + [(1, "a", "same")] * 500 + [(2, None, None)] * 200
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"h": F.lit(1), "part": F.lit("p"), "m": F.create_map(F.lit("k"), F.lit(1))}).repartition(3)
    out = mixing.mix_sources(df, block_rows=10).collect()
    assert len({r.mix_position for r in out}) == 1000 and Counter(r.text for r in out) == Counter(t for _, _, t in rows)
    assert all(n == 10 for n in Counter(r.mix_block for r in out).values())
