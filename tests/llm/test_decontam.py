import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayline.llm import decontam

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, width=10):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            x = words(text)
            for a in range(max(1, len(x) - width + 1) if x else 0):
                g = x[a : a + width]
                for s in range(len(w) - len(g) + 1):
                    if w[s : s + len(g)] == g:
                        hit.update(range(s, s + len(g)))
                        names.add(str(name))
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


ITEMS = [(10, "One two three four five six seven eight nine ten eleven twelve"), (9, "ab cd"), (11, None), (12, "..."), (13, "AB CD"), (2, "é ü one")]
DOCS = [(1, "x one TWO three, four five six seven eight nine ten eleven y ab"), (1, "cd ab cd ab cd"), (2, None), (3, ""), (4, "É ü one é ü ONE"), (None, "ab-cd"), (5, "ab\ncd " * 30_000), (6, "two three")]


@pytest.mark.parametrize("limit", [32_000_000, 60])
def test_brute_force(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BENCHMARK_BYTES", limit)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    small = [d for d in DOCS if len(d[1] or "") < 1000]
    got = decontam.contamination(docs(small), items).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(small, ITEMS)
    long = decontam.contamination(docs([DOCS[6]]), items).first()
    assert long.n_hit == 60_000 and list(long["items"]) == ["13", "9"]


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs([]), none).count() == 0
    assert [r.n_hit for r in decontam.contamination(docs([(1, "a b")]), none).collect()] == [0]


def test_proximity(docs):
    index = decontam.build_index(docs([(1, "red big green house"), (2, "green a a a a a a red"), (3, "red"), (4, "green")]))
    assert sorted((r.doc_id, r.position) for r in decontam.proximity_matches(index, ["red", "green"], 3).collect()) in ([(1, 0)], [(1, 2)])


@pytest.mark.parametrize("limit", [32_000_000, 60])
def test_repeated_items_count_once(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BENCHMARK_BYTES", limit)
    items = [(7, "ab cd"), (7, "ef gh"), (7, "ab cd"), (None, "cd ef"), (None, "gh ij"), (8, "zz")]
    found = decontam.contamination(docs([(1, "ab cd ef gh ij"), (2, "zz"), (3, "ab")]), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_hit, r.n_items, list(r["items"])) for r in found.collect()}
    assert got == {1: (5, 2, ["7", "null"]), 2: (1, 1, ["8"]), 3: (0, 0, [])}


def test_words_of_regular_build(spark, docs):
    # words over two letters and their complements agree in every polynomial hash modulo 2**64
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (64, 1024, 4096):
        items = spark.createDataFrame([(1, a[:n])], "item_id long, text string")
        assert {r.doc_id: r.n_hit for r in decontam.contamination(docs([(1, a[:n]), (2, b[:n])]), items).collect()} == {1: 1, 2: 0}


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam.common, "span_hashes", lambda data, starts, ends, lanes=1: (ends - starts).astype(np.uint64) % np.uint64(2))
    block = next(decontam.common.blocks(pa.array(["ab cd ab ef a b cd"])))
    starts, ends, _ = decontam.common.words(block, decontam.common.ALNUM)
    order, new = decontam._terms(block.data, starts, ends, decontam.common.word_hashes(block, starts, ends))
    assert order.tolist() == [0, 2, 1, 6, 3, 4, 5] and new.tolist() == [0, 2, 4, 5, 6]


def test_clashing_names(spark, docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    df = docs([(1, "x a b")]).withColumnsRenamed({"doc_id": "n_words"}).withColumn("n_hit", F.lit(5))
    out = decontam.contamination(df, items, id_col="n_words")
    assert out.columns == ["n_words", "n_hit", "n_items", "items", "contaminated"] and tuple(out.first())[:2] == (1, 2)
