import math
import random
import re

import numpy as np
import pyarrow as pa
from helpers import SF
from pyspark.sql import functions as F

from wayline.llm import quality


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    votes = []
    for accuracy in (0.95, 0.9, 0.85, 0.9):
        right = rng.random(len(truth)) < accuracy
        vote = np.where(right == truth, 1, -1)
        votes.append(np.where(rng.random(len(truth)) < 0.2, 0, vote))
    rows, counts = np.unique(np.stack(votes, axis=1), axis=0, return_counts=True)
    prior, table, good = quality.fit_labellers(rows, counts.astype(float))
    assert abs(prior - 0.8) < 0.05
    assert abs(table[1, 0, 2] - 0.95) < 0.03 and abs(table[0, 0, 0] - 0.95) < 0.05


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.quality_scores(d).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.97 * len(good)
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)


def test_edges(docs):
    assert quality.quality_scores(docs([])).count() == 0
    got = {r.doc_id: r for r in quality.quality_scores(docs([(1, None), (2, ""), (3, "A clean and short text of some words stands here. It ends."), (3, "x"), (None, "y")])).collect()}
    assert not got[1].keep and not got[2].keep
    kept = quality.keep_good(docs([(1, None), (3, "A clean and short text of some words stands here. It ends.")]))
    assert kept.columns == ["doc_id", "text"] and kept.count() <= 1


def plain_votes(text):
    """The labellers once more, word by word."""
    data = (text or "").encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", data) if x]
    if not w:
        return [-1] * len(quality.LABELLERS)
    if len(w) < quality.LEAST_WORDS:
        return [0] * len(quality.LABELLERS)
    low, n = [x.lower() for x in w], len(w)
    plain = lambda b: b in b"0123456789" or chr(b).isascii() and chr(b).isalpha() or b > 127
    share = lambda flags: sum(flags) / n
    signs = share(len(x) > 2 and x[-1] == x[-2] and not plain(x[-1]) and x[-1:] not in b".," for x in w)
    up, lo = (sum(a <= b <= z for b in data) for a, z in ((65, 90), (97, 122)))
    again = share(a == b for a, b in zip(low[1:], low[:-1]))
    letters = sum(plain(b) and not 48 <= b <= 57 for b in data)
    bodies = sum(b not in b" \t\n\x0b\x0c\r" and not 48 <= b <= 57 for b in data)
    pairs = len(set(zip(low, [*low[1:], None]))) / n
    stops = share(x[-1:] in (b".", b"!", b"?") for x in w)
    bare = share(len(x) == 1 and not plain(x[0]) for x in w)
    distinct, letters, upper = len(set(low)) / min(n, 400), letters / max(bodies, 1), up / max(up + lo, 1)
    pick = lambda bad, good: -1 if bad else int(good)
    return [pick(signs > 0.25, signs < 0.05), pick(upper > 0.5, upper < 0.2), pick(again > 0.2, again < 0.05), pick(n >= 40 and distinct < 0.2, distinct > 0.35), pick(pairs < 0.4, pairs > 0.7), pick(bare > 0.1, bare < 0.03), pick(n >= 40 and (stops < 0.005 or stops > 0.6), 0.03 < stops < 0.4), pick(letters < 0.88, letters > 0.93)]


def plain_em(rows):
    """The posteriors of rows of votes, row by row, with dictionaries."""
    good = [0.2 if -1 in r else 0.8 for r in rows]
    for _ in range(200):
        before, n = good, len(rows)
        prior = min(max(sum(good) / n, 1e-3), 1 - 1e-3)
        table = {}
        for c, q in ((1, good), (0, [1 - g for g in good])):
            for j in range(len(rows[0])):
                mass = {v: sum(x for x, r in zip(q, rows) if r[j] == v) / n + 1e-6 for v in (-1, 1)}
                table[c, j] = {-1: mass[-1] / sum(mass.values()), 0: 1.0, 1: mass[1] / sum(mass.values())}
        odds = [math.prod(table[1, j][v] for j, v in enumerate(r)) * prior for r in rows], [math.prod(table[0, j][v] for j, v in enumerate(r)) * (1 - prior) for r in rows]
        good = [a / (a + b) for a, b in zip(*odds)]
        if max(abs(a - b) for a, b in zip(good, before)) < 1e-9:
            break
    return good


def test_brute_force(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    model = quality.fit_quality(d)
    got = {r.doc_id: r for r in quality.quality_scores(d, model=model).collect()}
    want = {i: plain_votes(t) for i, t in texts.items()}
    assert {i: list(r.votes) for i, r in got.items()} == want
    posterior = dict(zip(want, plain_em(list(want.values()))))
    assert all(abs(got[i].posterior - p) < 1e-6 for i, p in posterior.items())
    # the score: the weights of a text's words and word shapes, one by one
    w = model.weights
    for i in sorted(got)[:40]:
        block = next(quality.common.blocks(pa.array([texts[i] or ""])))
        _, columns, values = quality.features(block)
        z = w[-1] + sum(w[c] * v for c, v in zip(columns.tolist(), values.tolist()))
        assert got[i].n_words == 0 or abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9
        assert got[i].keep == (got[i].score >= 0.5)


def test_sources_not_fitted_to(spark):
    # the model and the accuracies come from some sources and languages, the documents judged from others
    sf = SF.replace("sf0.001", "sf0.1")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.xxhash64("source") % 3 == 0
    model = quality.fit_quality(d.where(seen))
    got = quality.quality_scores(d.where(~seen), model=model).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(bad) > 100 and sum(r.keep for r in good) >= 0.98 * len(good) and sum(not r.keep for r in bad) >= 0.95 * len(bad)


def test_repeated_ids_and_long_texts(docs, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    monkeypatch.setattr(quality, "SAMPLE_CELLS", 2_000)
    r = random.Random(1)
    clean = [" ".join(r.choice(["apple", "river", "stone", "cloud", "walks", "sings", "green", "under", "over", "house"]) + ("." if k % 9 == 8 else "") for k in range(60)) for _ in range(60)]
    junk = ["|| ## || ## 12 || ## " * 10 for _ in range(20)]
    rows = [(1, t) for t in clean] + [(1, t) for t in junk] + [(2, "## " * 200_000), (3, "word, other words. " * 100_000)]
    got = quality.quality_scores(docs(rows).withColumns({"score": F.lit("old"), "row": F.lit(1), "_key": F.lit(2)}), carry=True).collect()
    assert len(got) == len(rows) and all(x.row.score == "old" for x in got)
    kept = {x.row.text for x in got if x.keep}
    assert not kept & set(junk) and sum(t in kept for t in clean) > 50
    out = quality.keep_good(docs(rows).withColumns({"score": F.lit("old"), "row": F.lit(1), "_key": F.lit(2)}))
    assert out.columns == ["doc_id", "text", "score", "row", "_key"] and out.count() == sum(x.keep for x in got)
    alike = quality.quality_scores(docs([(1, clean[0])] * 500 + [(2, junk[0])]).withColumnRenamed("doc_id", "score"), id_col="score")
    assert alike.columns == ["score", "n_words", "votes", "posterior", "keep"] and alike.count() == 501
