"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of
vote patterns of all documents (at most 3**labellers rows) estimates each labeller's accuracy and coverage with no
labelled row, and gives each pattern a posterior probability of good. A linear model on hashed words and word shapes is
then fitted to the posteriors on a bounded sample of rows, and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm import common

LABELLERS = ["symbol_tails", "capitals", "echoes", "few_words", "few_pairs", "bare_signs", "sentences", "letters"]
#: Shorter texts say too little: labellers don't vote on them.
LEAST_WORDS = 8
#: Distinct rows that the linear model is fitted on at most, those with the smallest keyed hashes, and the number of their
#: non-zero features at most (with six bytes each): what the driver holds of the corpus.
SAMPLE, SAMPLE_CELLS = 4_000, 4_000_000
DIMS = 1 << 14
STEPS = 300

_LETTERS = common.byte_class({*range(65, 91), *range(97, 123), *range(128, 256)})
_DIGITS = common.byte_class(set(range(48, 58)))
_UPPER = common.byte_class(set(range(65, 91)))
_LOWER = common.byte_class(set(range(97, 123)))


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def measures(block: common.Block) -> dict[str, np.ndarray]:
    """Per row: counts and shares that the labellers look at."""
    data, bounds = block.data, block.bounds
    starts, ends, first = common.words(block, common.NONSPACE)
    n = np.diff(first)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[first])
    chars = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[bounds])
    last, second = data[ends - 1], data[np.maximum(ends - 2, 0)]
    signs = ~common.ALNUM[last] & (last != 46) & (last != 44) & (last == second) & (ends - starts > 2)
    h = common.word_hashes(block, starts, ends)
    again = np.append(False, h[1:] == h[:-1]) if len(h) else np.zeros(0, bool)
    row = np.repeat(np.arange(len(block)), n)

    def fresh(x: np.ndarray) -> np.ndarray:
        """Flags, sorted by row, of the first of equal values in a row."""
        order = np.lexsort((x, row))
        return np.append(True, (x[order][1:] != x[order][:-1]) | (row[order][1:] != row[order][:-1])) if len(x) else np.zeros(0, bool)

    pair = h * np.uint64(3) + np.append(h[1:], np.uint64(0)) if len(h) else h
    return {
        "words": n,
        "signs": _share(per(signs), n),
        "upper": _share(chars(_UPPER), chars(_UPPER) + chars(_LOWER)),
        "again": _share(per(again), n),
        "distinct": _share(per(fresh(h)), np.minimum(n, 400)),
        "pairs": _share(per(fresh(pair)), n),
        "bare": _share(per((ends - starts == 1) & ~common.ALNUM[last]), n),
        "stops": _share(per((last == 46) | (last == 33) | (last == 63)), n),
        "letters": _share(chars(_LETTERS), chars(common.NONSPACE) - chars(_DIGITS)),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, labellers) of 1 good, -1 bad, 0 no vote."""
    pick = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    long = m["words"] >= 40
    out = [
        pick(m["signs"] > 0.25, m["signs"] < 0.05),
        pick(m["upper"] > 0.5, m["upper"] < 0.2),
        pick(m["again"] > 0.2, m["again"] < 0.05),
        pick(long & (m["distinct"] < 0.2), m["distinct"] > 0.35),
        pick(m["pairs"] < 0.4, m["pairs"] > 0.7),
        pick(m["bare"] > 0.1, m["bare"] < 0.03),
        pick(long & ((m["stops"] < 0.005) | (m["stops"] > 0.6)), (m["stops"] > 0.03) & (m["stops"] < 0.4)),
        pick(m["letters"] < 0.88, m["letters"] > 0.93),
    ]
    v = np.stack(out, axis=1).astype(np.int8)
    v[m["words"] < LEAST_WORDS] = 0
    v[m["words"] == 0] = -1
    return v


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for two classes and labellers independent within a class: (share of good, P(vote | class, it votes) as (2, labellers, 3), posterior of good per pattern)."""
    k = patterns.shape[1]
    weight = counts / max(counts.sum(), 1)
    good = np.where((patterns < 0).any(axis=1), 0.2, 0.8)  # a start on the right side: any bad vote speaks against
    prior, table = 0.8, np.ones((2, k, 3))
    for _ in range(rounds):
        before = good
        prior = float(np.clip((weight * good).sum(), 1e-3, 1 - 1e-3))
        for c, q in ((1, good), (0, 1 - good)):
            for v in (-1, 1):
                table[c, :, v + 1] = (weight[:, None] * q[:, None] * (patterns == v)).sum(axis=0) + 1e-6
            table[c] /= table[c, :, :1] + table[c, :, 2:]
            table[c, :, 1] = 1  # no vote says nothing
        logs = [np.log(p) + sum(np.log(table[c, j, patterns[:, j] + 1]) for j in range(k)) for c, p in ((0, 1 - prior), (1, prior))]
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    return prior, table, good


def features(block: common.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bag of words, word shapes and the length's order: (row, column, share of the row's words), summed by the caller's dot product."""
    starts, ends, first = common.words(block, common.NONSPACE)
    n = np.diff(first)
    row = np.repeat(np.arange(len(block)), n)
    h = common.word_hashes(block, starts, ends)
    data = block.data
    kind = np.zeros(256, np.uint64)
    kind[_LOWER], kind[_UPPER], kind[common.byte_class(set(range(48, 58)))], kind[common.byte_class(set(range(128, 256)))] = 1, 2, 3, 1
    signs = ~common.ALNUM
    kind[signs] = 4 + np.arange(256, dtype=np.uint64)[signs]
    shape = kind[data[starts]] * np.uint64(1_000_003) + kind[data[np.maximum(ends - 2, 0)]] * np.uint64(1009) + kind[data[ends - 1]] if len(h) else h
    again = (np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.zeros(0, bool)).astype(np.uint64)
    columns = [common.mix64(h) % np.uint64(DIMS // 2), np.uint64(DIMS // 2) + common.mix64(shape * np.uint64(2) + again + np.uint64(77)) % np.uint64(DIMS // 2)]
    value = 1 / np.maximum(n, 1)[row]
    length = common.mix64(np.minimum(np.log2(n + 1), 6).astype(np.uint64) + np.uint64(9_000_000)) % np.uint64(DIMS // 2)
    return np.concatenate([row, row, np.arange(len(block))]), np.concatenate([*columns, length]).astype(np.int64), np.concatenate([0.2 * value, value, np.full(len(block), 0.5)])


def _train(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logistic regression on soft targets, both classes of equal weight, by Adagrad over the whole sample; the last weight is the bias."""
    n = len(target)
    w, squares = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-8)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    weight = target / (2 * share) + (1 - target) / (2 * (1 - share))
    for _ in range(STEPS):
        z = np.bincount(rows, values * w[columns], minlength=n) + w[-1]
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / n
        grad = np.bincount(columns, values * slope[rows], minlength=DIMS + 1) + 1e-6 * w
        grad[-1] = slope.sum()
        squares += grad**2
        w -= 0.5 * grad / np.sqrt(squares)
    return w


@dataclass
class Model:
    """What is learnt of a corpus: the posterior of good by vote pattern, and the linear model (None where only one class is there)."""

    posterior: dict[str, float]
    weights: np.ndarray | None


def _pattern(votes_of_row: np.ndarray) -> str:
    return "".join("-0+"[x + 1] for x in votes_of_row)


def fit_quality(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Fit to df: EM to the vote patterns of all rows, the linear model to SAMPLE distinct rows (by id and text)."""
    spark = df.sparkSession
    common.ship(spark)
    # the sample is fixed by hashes of the rows, whatever the partitions are
    source = df.select(F.xxhash64(df[id_col], df[text_col], F.lit(11)).alias("order"), df[text_col].alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in common.blocks(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(int(block.rows[0]), len(block)), pa.array([_pattern(r) for r in votes(measures(block))], pa.string())], names=["order", "pattern"])

    voted = common.stored(source.mapInArrow(vote, "order long, pattern string"), "votes")
    seen = sorted((r["pattern"], r["count"]) for r in voted.groupBy("pattern").count().collect())
    patterns = np.array([["-0+".index(c) - 1 for c in p] for p, _ in seen], np.int64).reshape(len(seen), len(LABELLERS))
    counts = np.array([c for _, c in seen], np.float64)
    _, _, good = fit_labellers(patterns, counts)
    posterior = {p: float(g) for (p, _), g in zip(seen, good, strict=True)}

    # hashes spread evenly, so about 2 * SAMPLE rows lie below this
    top = int(min(2**63 - 1, -(2**63) + 2**64 * min(1.0, 2 * SAMPLE / max(counts.sum(), 1))))
    chosen = [r["order"] for r in voted.where(F.col("order") <= top).select("order").distinct().orderBy("order").limit(SAMPLE).collect()]
    if len(chosen) < SAMPLE and top < 2**63 - 1:  # many rows are alike
        chosen = [r["order"] for r in voted.select("order").distinct().orderBy("order").limit(SAMPLE).collect()]
    if not chosen:
        return Model(posterior, None)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in common.blocks(batch.column(1)):
                row, column, value = features(block)
                cell, back = np.unique(row * DIMS + column, return_inverse=True)
                total = np.bincount(back, value, minlength=len(cell)).astype(np.float32)
                cuts = np.searchsorted(cell // DIMS, np.arange(len(block) + 1))
                c = pa.array([(cell % DIMS)[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                v = pa.array([total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                target = [posterior[_pattern(r)] for r in votes(measures(block))]
                yield pa.record_batch([batch.column(0).slice(int(block.rows[0]), len(block)), pa.array(np.diff(cuts)), c, v, pa.array(target)], names=["order", "cells", "c", "v", "target"])

    sampled = source.where(F.col("order") <= chosen[-1]).mapInArrow(extract, "order long, cells long, c binary, v binary, target double")
    sampled = common.stored(sampled.dropDuplicates(["order"]), "sample")
    sizes = sorted((r["order"], r["cells"]) for r in sampled.select("order", "cells").collect())
    last = [o for (o, _), n in zip(sizes, np.cumsum([n for _, n in sizes]), strict=True) if n <= SAMPLE_CELLS]
    if not last:
        return Model(posterior, None)
    rows, columns, values, targets = [], [], [], []
    for r in sorted(sampled.where(F.col("order") <= last[-1]).collect(), key=lambda r: r["order"]):
        columns.append(np.frombuffer(r["c"], np.uint16))
        values.append(np.frombuffer(r["v"], np.float32))
        rows.append(np.full(len(columns[-1]), len(targets), np.uint16))
        targets.append(r["target"])
    if not min(targets) < 0.5 <= max(targets):
        return Model(posterior, None)
    return Model(posterior, _train(np.concatenate(rows), np.concatenate(columns), np.concatenate(values), np.array(targets)))


def quality_scores(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5, carry: bool = False, model: Model | None = None) -> DataFrame:
    """One row per row of df: id_col, n_words, votes (by LABELLERS: 1, 0, -1), posterior and score of good, keep.

    keep: the linear score is threshold or more. Where all patterns of the sample agree that only one class is there (as in
    tiny or empty tables) the posterior decides alone. Null and empty texts get all bad votes. Repeated ids and rows are
    scored row by row. With carry the result has the column row, a struct of all columns of df; else other columns aren't
    read, and an id column named like a result column takes its place. model: of fit_quality; None: fitted to df itself.
    A pattern that the model hasn't seen has the posterior of the nearest one seen, in votes that differ, the first of them.
    The sample's size is SAMPLE; counts of patterns are of all rows.
    """
    common.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    model = model or fit_quality(df, text_col, id_col)
    posterior, weights = model.posterior, model.weights

    def of(pattern: str) -> float:
        if pattern not in posterior and posterior:
            near = min(sorted(posterior), key=lambda p: sum(a != b for a, b in zip(p, pattern, strict=True)))
            return posterior[near]
        return posterior.get(pattern, 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in common.blocks(batch.column(1)):
                m = measures(block)
                v = votes(m)
                p = np.array([of(_pattern(r)) for r in v])
                s = p
                if weights is not None:
                    row, column, value = features(block)
                    z = np.bincount(row, value * weights[column], minlength=len(block)) + weights[-1]
                    s = np.where(m["words"] > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel().astype(np.int32)))
                own = [c.slice(int(block.rows[0]), len(block)) for c in (batch.column(0), *batch.columns[2:])]
                yield pa.record_batch([own[0], pa.array(m["words"]), flat, pa.array(p), pa.array(s), pa.array(s >= threshold), *own[1:]], names=["_id", *made, *["row"] * carry])

    made = ["n_words", "votes", "posterior", "score", "keep"]
    schema = f"_id {kind}, n_words long, votes array<int>, posterior double, score double, keep boolean"
    if not carry:
        return common.named(df.select(df[id_col], df[text_col]).mapInArrow(score, schema), id_col, made)
    whole = F.struct(*[df[c] for c in df.columns]).alias("row")
    packed = df.select(df[id_col].alias("id"), df[text_col].alias("text"), whole)
    return common.named(packed.mapInArrow(score, T._parse_datatype_string(schema).add("row", packed.schema["row"].dataType)), id_col, [*made, "row"])


def keep_good(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """df without the rows that quality_scores rejects; no shuffle, and no join by id."""
    scored = quality_scores(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].alias("_key"), df[text_col].alias("_text")), "_text", "_key", threshold, carry=True)
    return scored.where("keep").select("row.row.*")
