"""The pipeline against a plain version that calls brute-force forms of its deterministic stages."""

import math
import os
from collections import Counter

import pyarrow as pa
from helpers import SF, TABLES, same_rows
from pyspark.sql import functions as F
from test_decontam import brute as hits
from test_line_dedup import brute as line_brute
from test_mixing import brute_slots
from test_near_dup import brute as near_brute
from test_quality import plain_em, plain_votes

import corpus_pipeline
from wayline.llm import quality, queries


def plain_keep(docs, model):
    """Ids that the first stage keeps, with plain votes and sums of weights."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    votes = {i: plain_votes(t) for i, t in texts.items()}
    posterior = dict(zip(votes, plain_em(list(votes.values()))))
    kept = set()
    for i, t in texts.items():
        score = posterior[i]
        if model.weights is not None:
            _, columns, values = quality.features(next(quality.common.blocks(pa.array([t or ""]))))
            z = model.weights[-1] + sum(model.weights[c] * v for c, v in zip(columns.tolist(), values.tolist()))
            score = 1 / (1 + math.exp(-z)) if (t or "").split() else 0.0
        if score >= 0.5:
            kept.add(i)
    return kept


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = plain_keep(docs, quality.fit_quality(docs))
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    left = line_brute(rows, 50)
    rows = [(i, left[i][0]) for i, _ in rows if left[i][1] == 0 or left[i][0].strip()]
    top = near_brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if top[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, n, _ in hits(rows, items) if n == 0}
    want = {i: t for i, t in rows if i in clean}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert len({r.mix_position for r in out}) == len(out) == len(want)
    sizes = Counter(r.source for r in out)
    slots = brute_slots({s: n**0.5 for s, n in sizes.items()}, {s: n // 64 for s, n in sizes.items()})
    exact = sorted((r for r in out if r.mix_exact), key=lambda r: r.mix_position)
    assert [r.source for r in exact] == [s for s in slots for _ in range(64)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_oracles(spark, duck):
    assert set(TABLES) and os.path.exists(SF)
    for name in ("op4_chat_formatting", "op5_warc_revisits", "op6_decontamination", "op9_minhash_near_dup"):
        same_rows(queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLES[name]))


def test_edges_of_every_stage(spark, tmp_path):
    clean = "The river runs past the old mill and on to the sea. In spring it carries ice, and in summer children swim there every day."
    rows = [(1, clean, "en", "a", 9), (1, clean, "en", "a", 9), (2, None, None, None, None), (3, "", "", "", 0), (None, clean + " Nobody knows.", "en", None, 1), (None, None, None, None, None), (4, "\n\n", "en", "b", 2), (5, "x", "en", "b", 1), (6, (clean + "\n") * 3_000, "en", "b", 5), (7, "a benchmark item of just a few words here stands " + clean, None, "c", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "a benchmark item of just a few words here stands"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.createDataFrame(rows, schema).withColumns({c: F.lit("old") for c in ("score", "row", "id", "th", "cuts", "kept", "mix_row", "n_lines")})
    for df in (full, full.limit(0)):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.common.stored(stage(spark, docs, str(tmp_path)), "edge")
            got = docs.collect()
            assert docs.columns[:5] == corpus_pipeline.DOCUMENT and len(got) <= len(rows)
        assert (len(got) > 0) == (df is full) and len({r.mix_position for r in got}) == len(got)
        assert 7 not in {r.doc_id for r in got} and all((r.text or "").strip() for r in got)


def test_stages_decide_by_row(spark, tmp_path):
    a, b = ("a benchmark item of more than ten words stands here in full, and then some", "the river runs past the old mill and on to the sea in spring and in summer too")
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "1 " + a), (None, b), (5, "2 " + a), (5, b + " too"), (6, "clean as well")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == {(i, t) for i, t in rows if a not in t}
    # near copies share ids with others, or have none: one row of each group stays
    rows = [(None, b), (None, b), (None, a), (7, a), (7, b + " x"), (7, "alone in the world"), (3, "alone at sea"), (3, "alone at sea"), (3, b + " y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    kept = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert kept == sorted([("3", b + " y"), ("7", a), ("7", "alone in the world"), ("3", "alone at sea")])


def test_scratch_leaves_others_alone(spark):
    from threading import Thread

    common = corpus_pipeline.common
    with common.scratch(spark):
        inner = common.stored(spark.range(3), "inner")
        made = []
        t = Thread(target=lambda: made.append(common.stored(spark.range(5), "other")))
        t.start()
        t.join()
        with common.scratch(spark) as keep:
            kept, gone = common.stored(spark.range(7), "kept"), common.stored(spark.range(8), "gone")
            keep.append(kept)
        assert gone._stored_at not in common._STORED and kept.count() == 7 and inner.count() == 3
    assert made[0].count() == 5 and not {kept._stored_at, inner._stored_at} & set(common._STORED)


def test_a_stage_deletes_what_the_one_before_left(spark):
    common = corpus_pipeline.common
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    left = tuple(p for p in corpus_pipeline._LEFT.get() if p in common._STORED)
    assert left
    kept = common.stored(first, "kept")
    # docs that are read from what was left keep it; others don't
    corpus_pipeline.mix(spark, first, SF)
    assert set(left) <= set(common._STORED)
    corpus_pipeline._LEFT.set(left)
    out = corpus_pipeline.mix(spark, kept, SF)
    assert not set(left) & set(common._STORED) and out.count() == kept.count()
