import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from wayline.llm import chat

PARTS = ["<", "|", "\\", "im_start|>", "<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "[", "\n", "a", "%0A", "%", "<<SYS>>", "<s>", "s>", "<</SYS>>"]
texts = st.lists(st.sampled_from(PARTS), max_size=9).map("".join)


@settings(max_examples=500, deadline=None)
@given(texts)
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), texts), max_size=5))
def test_spans(turns):
    safe = [(chat.escape_role(r), chat.escape(t)) for r, t in turns]
    out = chat.render_incrementally(safe, chat.marked_turns)
    assert not out.rewrites and chat.parse_marked(out.text) == turns
    assert [out.text[a:b] for _, _, a, b in out.spans] == [t for _, t in safe]


def test_rewriting_template():
    def template(turns):  # only the last two turns are shown
        return "".join(f"[{r}]{t}" for r, t in turns[-2:])

    out = chat.render_incrementally([("user", "one"), ("assistant", "two"), ("user", "three")], template)
    assert out.rewrites == [2] and out.text[slice(*out.spans[2][2:])] == "three"


def test_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "assistant", "n"), (1, 1, "assistant", "b"), (3, 0, "assistant", "x" * 300_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[2].loss_chars == 0 and got[None].loss_chars == 1 and got[3].loss_chars == 300_000
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_ids_as_they_are(spark):
    # a null id beside others in one batch, and neighbours that are one number as floats
    ids = [None, 2**53 + 1, 2**53 + 2, -7]
    rows = [(i, t, "assistant", f"{i}{t}") for i in ids for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("n_turns", F.lit("x")).coalesce(1)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got == {i: (2, len(f"{i}0{i}1")) for i in ids}
    named = spark.createDataFrame([("", 0, "user", "a"), ("a ", 0, "user", "a"), ("a", 0, "user", "a")], "conv_id string, turn long, role string, text string").coalesce(1)
    assert {r.conv_id for r in chat.format_conversations(named).collect()} == {"", "a ", "a"}
