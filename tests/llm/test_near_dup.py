import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import near_dup

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    top = {i: i for i, _ in rows if i is not None}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = root(i), root(j)
                top[max(i, j)] = min(i, j)
    return {i: root(i) for i in top}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 120))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(base[min(r.randint(0, 24), r.randint(0, 24))])
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_brute_force(spark, docs, monkeypatch, k):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 900)  # several blocks
    monkeypatch.setattr(near_dup.common, "HOT_ROWS", 4)  # and hot keys
    rows = corpus(k) + [(500, None), (501, ""), (502, "  \n"), (503, "one"), (504, "ONE"), (None, "one"), (505, "a b"), (505, "a b"), (506, "x y z w v u t " * 9000), (507, "x y z w v u t " * 9000)]
    want = brute(rows, k, 80)
    got = near_dup.near_duplicates(docs(rows).withColumn("n", F.lit(1)).withColumn("component_id", F.lit("c")), k=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    assert near_dup.near_duplicates(docs([])).count() == 0


def test_one_id_two_texts(docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs([(1, a), (2, a), (2, b), (3, b)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_estimate():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
            n = int(1000 * 2 * share / (1 + share))
            a, b = pool[:1000], np.concatenate([pool[:n], pool[1000 : 2000 - n]])
            _, bits = near_dup.signatures(near_dup.minima([np.unique(a), np.unique(b)]))
            apart = bits[0] ^ bits[1]
            agree = near_dup.PERMUTATIONS - int(np.bitwise_count((apart | (apart >> 1)) & 0x5555555555555555).sum())
            errors.append(near_dup.estimate(agree) - n / (2000 - n))
        assert abs(np.mean(errors)) < 0.03


def test_words_of_regular_build(docs):
    # words over two letters and their complements agree in every polynomial hash modulo 2**64
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(2 * i + j, " ".join([x[:n], "q", "r", x[:n]])) for i, n in enumerate((64, 1024, 4096)) for j, x in enumerate((a, b))]
    assert all(r.component_id == r.doc_id for r in near_dup.near_duplicates(docs(rows), k=4).collect())


def test_percent_is_checked(docs):
    for percent in (59, 101):
        with pytest.raises(ValueError):
            near_dup.near_duplicates(docs([(1, "a")]), percent=percent)


@pytest.mark.parametrize("k", [4, 5])
def test_blocks_of_few_words(spark, docs, k):
    # each row alone in its partition, of 0 to k words
    rows = [(n, " ".join("abcdefg"[:n])) for n in range(k + 1)] + [(20, "a"), (21, "A b"), (22, None)]
    df = docs(rows).repartition(len(rows), "doc_id")
    want = brute(rows, k, 80)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, k=k).collect()} == want
    for one in ([(1, "a b")], [(1, "a"), (2, "b")], [(1, "a b c")], [(1, None)]):
        got = near_dup.near_duplicates(docs(one), k=k).collect()
        assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == [i for i, _ in one]


def test_words_that_met_in_an_unkeyed_hash(docs):
    rows = [(1, "a33m-4jwa-easkbb is here today now"), (2, "7cwjhor_gx-3_-0_ is here today now")]
    assert all(r.kept for r in near_dup.near_duplicates(docs(rows), k=4).collect())


def test_exact_sets_by_bytes():
    import pyarrow as pa

    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "A", "b", "É", "é", "cc"]) for _ in range(r.randint(0, 9))) for _ in range(80)] + [None, "a b c d", "a b c d e"]
    for k in (1, 4, 5):
        sets = near_dup.exact_sets(pa.array(texts), k)
        plain = [shingles(t, k) for t in texts]
        assert [len(s) for s in sets] == [len(s) for s in plain]
        for a in range(len(texts)):
            for b in range(a):
                assert len(np.intersect1d(sets[a], sets[b])) == len(plain[a] & plain[b])


def test_colliding_words_link_nothing(docs, monkeypatch):
    # all words of one length share a hash, of equal sets only the digests of whole texts tell them apart: links still go by bytes
    real = near_dup.common.keyed_hashes
    monkeypatch.setattr(near_dup.common, "keyed_hashes", lambda words, key: np.array([len(w.as_py()) for w in words], np.uint64) if len(words) > 3 else real(words, key))
    texts = [" ".join(f"{c}{i:03}" for i in range(40)) + " " + "long" * n for n, c in enumerate("abc")]
    got = near_dup.near_duplicates(docs(list(enumerate(texts))), k=4).collect()
    assert all(r.kept for r in got)


def test_key_differs_by_call():
    import pyarrow as pa

    words = pa.array(["a", "b"], pa.large_string())
    a, b = near_dup.common.keyed_hashes(words, b"1" * 16), near_dup.common.keyed_hashes(words, b"2" * 16)
    assert len({*a.tolist(), *b.tolist()}) == 4 and near_dup.common.keyed_hashes(words, b"1" * 16).tolist() == a.tolist()


def test_id_named_like_a_result_column(docs):
    df = docs([(1, "a b c d e f"), (2, "a b c d e f")]).withColumnRenamed("doc_id", "kept")
    out = near_dup.near_duplicates(df, id_col="kept")
    assert out.columns == ["kept", "n_shingles", "component_id"] and sorted(r.kept for r in out.collect()) == [1, 2]


def test_long_texts(docs):
    base = [f"w{i}" for i in range(150_000)]
    other = [*base[:140_000], *(f"v{i}" for i in range(10_000))]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[::-1])), (4, "w1 w2")]
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
