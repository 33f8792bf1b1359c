import random
import re
from collections import Counter

import numpy as np
import pytest

from wayline.llm import common, divergence

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "lang string, source string, text string"


def brute(rows, least, top):
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))) for a, b, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)

        def shares(words, kept=kept):
            c = Counter(w for w in words if w in kept)
            n = sum(c.values())
            return c, {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        _, q = shares([w for d in own for w in d[2]])
        by = {s: shares([w for d in own if d[1] == s for w in d[2]]) for s in {d[1] for d in own}}
        for s, (c, p) in by.items():
            for part, items in (("pair", [(-sum(abs(p[t] - by[o][1][t]) for t in kept), o.encode()) for o in by if o != s]), ("term", sorted((q[t] - p[t], t.encode()) for t in kept if c[t] and p[t] > q[t])[:top])):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(items), 1)}
    return out


def corpus(seed, sources):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(80)]
    rows = []
    for _ in range(400):
        s = r.choice(sources)
        few = vocabulary if r.random() < 0.2 else vocabulary[hash_of(s) % 60 :][: r.randint(3, 20)]
        words = [r.choice(few) for _ in range(r.choice([0, 1, 10, 200]))]
        rows.append((r.choice(["x", "y", None]), s, r.choice([" ", "1", "\x7f", "-"]).join(w.upper() if r.random() < 0.3 else w for w in words)))
    return rows


def hash_of(s):
    return sum((s or "").encode()) * 31


@pytest.mark.parametrize("seed, n", [(1, 30), (2, 4)])
def test_brute_force(spark, monkeypatch, seed, n):
    # small tiles and steps, so that several blocks, chunks and batches meet
    for name, value in (("TILE_GROUPS", 8), ("TILE_TERMS", 5), ("HELD_ROWS", 300), ("KEEP_ROWS", 50)):
        monkeypatch.setattr(divergence, name, value)
    sources = [f"s{i}" for i in range(n)] + [None, "é"]
    rows = corpus(seed, sources) + [("z", "only", "a b"), ("z", "other", None), ("z", "other", ""), (None, None, None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA + ", term long").repartition(3)
    got = [tuple(r) for r in divergence.divergence(df, least_docs=7, top=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 7, 5)
    if n == 30:
        parts = divergence.term_counts(df)
        assert parts.where("term is null or n < docs").count() == 0


def test_light_and_heavy_only(spark, monkeypatch):
    sources = [f"s{i}" for i in range(12)]
    rows = corpus(5, sources)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 3, 50)
    for most, share in ((64, 1), (0, 4)):
        monkeypatch.setattr(divergence, "LIGHT_MAX", most)
        monkeypatch.setattr(divergence, "HEAVY_SHARE", share)
        assert {tuple(r) for r in divergence.divergence(df, least_docs=3).collect()} == want


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.divergence(empty).count() == 0
    # no term is kept: pairs are at distance 0, ties by the name's bytes
    df = spark.createDataFrame([("l", "b", "t"), ("l", "a", None), ("l", "Z", ""), ("m", None, "t")], SCHEMA)
    assert sorted(tuple(r) for r in divergence.divergence(df).collect()) == sorted(("l", s, "pair", o, 0, k) for s in "Zab" for k, o in enumerate((x for x in "Zab" if x != s), 1))
    # one very long text, one very long word, rows that repeat
    rows = [("l", "a", "big " * 200_000 + "x" * 300_000)] * 30 + [("l", "b", "big")]
    got = {tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 30, 50)


def test_share_is_exact(spark):
    cases = [(0, 6), (7, 12), (10**14, 8 * 10**15), (8 * 10**15 - 5, 8 * 10**15), (123_456_789, 987_654_321_987)]
    df = spark.createDataFrame(cases, "c long, t long")
    got = [r[0] for r in df.select(divergence.share(df["c"], df["t"])).collect()]
    assert got == [1 + 10**9 * (c + 5) // t for c, t in cases]


def test_block_counts_by_bytes():
    import pyarrow as pa

    (block,) = common.blocks(pa.array(["Aa aA b", None, "É é é"]))
    g, term, n, rows = divergence.block_counts(block, np.array([0, 1, 0]))
    assert sorted(zip(g.tolist(), term.to_pylist(), n.tolist(), rows.tolist(), strict=True)) == [(0, "aa", 2, 1), (0, "b", 1, 1), (0, "É", 1, 1), (0, "é", 2, 1)]
