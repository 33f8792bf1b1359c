import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayline.llm import token_counts as tc

TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "s", "'re", "'ll", "'v", "ve", "é", "ß", "中", "😀", "1", "23", "½", "!", "...", "<|endoftext|>", "<|end", " ", "\x1c", "\x85", "A", "'S", "_", "\r\n", "ing", "\x00", "'d"]


def count(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_every_prefix(text):
    d = tc.counter().deltas_of([text])[0]
    assert [tc.prefix_count(d, i) for i in range(len(text) + 1)] == [count(text[:i]) for i in range(len(text) + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert tc.prefix_count(tc.counter().deltas_of([text])[0], len(text)) == count(text)


def test_budget():
    text = "The quick brown fox jumps over the lazy dog. " * 5
    d = tc.counter().deltas_of([text])[0]
    for budget in (0, 1, 7, 20, 1000):
        n = tc.longest_within(d, budget)
        assert count(text[:n]) <= budget and all(count(text[:m]) > budget for m in range(n + 1, len(text) + 1))


def test_rows(docs):
    long = "word " * 60_000
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x"), (4, long)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tc.prefix_token_counts(docs(rows)).collect())
    assert got == sorted((i or 0, len((t or "").encode()), count(t or "")) for i, t in rows)
    assert tc.prefix_token_counts(docs([])).count() == 0


def test_texts_of_regular_build():
    # words over two letters and their complements agree in every polynomial hash modulo 2**64
    for pair in ("ab", "in", "a\u00e9"):
        for n in (64, 1024, 4096):
            a = pair[0]
            while len(a) < n:
                a += a.translate(str.maketrans(pair, pair[::-1]))
            texts = [a, a.translate(str.maketrans(pair, pair[::-1]))]
            assert [tc.prefix_count(d, n) for d in tc.counter().deltas_of(texts)] == [count(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    counter = tc.PrefixCounter(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tc.common, "span_hashes", lambda data, starts, ends, lanes=1: (ends - starts).astype("uint64") % 3)
    texts = ["the cat sat", "internationalisation zzzq", "  \n x<|endoftext|>'re"]
    for _ in range(2):
        assert [tc.prefix_count(d, len(t)) for d, t in zip(counter.deltas_of(texts), texts)] == [count(t) for t in texts]


def test_clashing_names(docs):
    df = docs([(1, "a b")]).withColumnsRenamed({"doc_id": "n_tokens"}).withColumn("n_bytes", F.lit("x"))
    out = tc.prefix_token_counts(df, id_col="n_tokens")
    assert out.columns == ["n_tokens", "n_bytes", "n_chars", "prefix_deltas"] and tuple(out.first())[:3] == (1, 3, 3)
