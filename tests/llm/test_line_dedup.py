import random
import re

import pytest
from pyspark.sql import functions as F

from wayline.llm import line_dedup


def lines(t):
    if not t:
        return []
    out = t.split("\n")
    return out[:-1] if t.endswith("\n") else out


def brute(rows, least):
    """{id: (text left, lines removed)} for distinct ids, by maximal runs: every pair of places, as far as they agree without overlap."""
    all_lines = {i: lines(t) for i, t in rows}
    places = [(i, a) for i in sorted(all_lines) for a in range(len(all_lines[i]))]
    words = {i: [len([w for w in re.split(r"[\x20\x09-\x0D]+", y) if w]) for y in x] for i, x in all_lines.items()}
    gone = {}
    for at, (i, a) in enumerate(places):
        x = all_lines[i]
        for j, b in places[:at]:
            y, n = all_lines[j], 0
            while a + n < len(x) and b + n < (a if i == j else len(y)) and x[a + n] == y[b + n]:
                n += 1
            if n and sum(words[i][a : a + n]) >= least:
                gone.setdefault(i, set()).update(range(a, a + n))
    out = {}
    for i, t in rows:
        left = [y for j, y in enumerate(all_lines[i]) if j not in gone.get(i, set())]
        out[i] = (t if not gone.get(i) else "\n".join(left) + ("\n" if left and t.endswith("\n") else ""), len(gone.get(i, set())))
    return out


@pytest.mark.parametrize("least", [1, 3, 7])
def test_brute_force(docs, least):
    r = random.Random(least)
    pool = ["", "a", "b c", "d e f", "g", "h i j k"][: 3 + least % 4]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14))) + r.choice(["", "\n"])) for i in range(40)]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(docs(rows), min_words=least).collect()}
    assert got == brute(rows, least)


def test_edges(docs):
    rows = [(1, "x y\nz"), (1, "x y\nz"), (2, None), (3, ""), (4, "x y\nz"), (None, "x y"), (5, "q\n" * 30_000)]
    df = docs(rows).withColumn("n_lines", F.lit("old")).withColumn("id", F.lit(7)).withColumn("gone", F.lit(8))
    got = line_dedup.dedup_lines(df, min_words=2).collect()
    assert len(got) == 7 and all(r.id == 7 and r.gone == 8 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    # the null id sorts first, so its "x y" is the first copy
    assert by[None] == [("x y", 1, 0)] and by[1] == [("z", 2, 1)] * 2 and by[2] == [(None, 0, 0)] and by[3] == [("", 0, 0)]
    assert by[5][0][1] == 30_000 and by[5][0][0] == "q\nq\n"
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_runs_that_end_short_of_the_depth(docs):
    # the last lines begin no run of 50 words, and end one that begins far before them
    text = " ".join(f"w{i}" for i in range(50)) + "\n" + "\n".join(f"v{i}" for i in range(20))
    rows = [(1, text), (2, text), (3, "x\n" + text)]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == brute(rows, 50) and got[2] == ("", 21) and got[3] == ("x", 21)


def test_lines_of_regular_build(docs):
    # a word over two letters and its complement agree in every polynomial hash modulo 2**64
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b, w = a.translate(str.maketrans("ab", "ba")), " ".join(f"w{i}" for i in range(50))
    for n in (64, 1024, 4096):
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs([(1, f"{a[:n]}\n{w}"), (2, f"{b[:n]}\n{w}")])).collect()}
        assert got == {1: (f"{a[:n]}\n{w}", 0), 2: (b[:n], 1)}


def test_many_blank_lines(docs):
    w = " ".join(f"w{i}" for i in range(50))
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs([(1, "\n" * 20_000 + w), (2, "\n" * 20_000 + w), (3, "x\n\n" + w)])).collect()}
    assert got == {1: ("\n" * 20_000 + w, 0), 2: ("", 20_001), 3: ("x", 2)}


def test_hot_lines(docs, monkeypatch):
    monkeypatch.setattr(line_dedup.common, "HOT_ROWS", 3)
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["a b", "c", "d"]) for _ in range(r.randint(1, 9)))) for i in range(60)]
    assert {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(docs(rows), min_words=4).collect()} == brute(rows, 4)
