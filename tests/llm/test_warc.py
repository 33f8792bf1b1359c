import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from wayline.llm import common, warc

PAGES = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, None, "same"), (4, "u", None), (2, "u", ""), (7, "u\r\nX: y", "é\r\n\r\nbody"), (None, "u", "same"), (8, "u", "z" * 200_000)]
    folder = common.work_path(spark, "test-warc")
    got = {r.page_id: r for r in warc.deduplicate_pages(spark.createDataFrame(rows, PAGES), folder).collect()}
    assert len(got) == len(rows)
    first = {"same": 3, "": 2}
    for i, _, html in rows:
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), digest(html))
        o = first.get(html or "", i)
        assert (r.record_type, r.refers_to) == (("response", None) if o == i else ("revisit", o))
    files = {r.file for r in got.values()}
    data = b"".join(gzip.open(f"{folder.removeprefix('file://')}/{f}").read() for f in files)
    assert data.count(b"WARC/1.1\r\n") == len(rows) and data.count(b"same") == 1


def test_least_bytes_and_empty(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")]
    got = {r.page_id: r.record_type for r in warc.deduplicate_pages(spark.createDataFrame(rows, PAGES), least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.deduplicate_pages(spark.createDataFrame([], PAGES)).count() == 0


def headers_of(folder, files):
    out = []
    for f in files:
        for _, raw in warc.members(open(f"{folder.removeprefix('file://')}/{f}", "rb")):
            out.append(warc.parse_record(raw))
    return out


def test_revisits_resolve_by_standard_fields(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(30)]
    folder = common.work_path(spark, "test-warc")
    got = warc.deduplicate_pages(spark.createDataFrame(rows, PAGES).repartition(4), folder).collect()
    records = headers_of(folder, {r.file for r in got})
    by_id = {h["WARC-Record-ID"]: (h, body) for h, body in records}
    assert len(by_id) == 30
    revisits = [h for h, _ in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 19
    for h in revisits:
        original, body = by_id[h["WARC-Refers-To"]]
        assert (original["WARC-Target-URI"], original["WARC-Date"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"])
        assert original["WARC-Type"] == "response" and body.endswith(b"same") and original["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]


@pytest.mark.parametrize("kind, ids", [("string", ["", "a b ", "a b", None, "\u00e9%0A", "x\ny"]), ("long", [2**53 + 1, 2**53 + 2, None, 3, 4, 5]), ("int", [None, 1, 2, 3, 4, 5])])
def test_ids_as_they_are(spark, kind, ids):
    df = spark.createDataFrame([(i, None, "same") for i in ids], f"page_id {kind}, url string, html string").coalesce(1)
    got = warc.deduplicate_pages(df.withColumns({"file": F.lit("f"), "digest": F.lit(1), "size": F.lit(2)})).collect()
    least = min(i for i in ids if i is not None)
    assert {r.page_id for r in got} == set(ids) and [r.page_id for r in got if r.record_type == "response"] == [least]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {least}
    none = warc.deduplicate_pages(spark.createDataFrame([(None, "u", "same")] * 3, f"page_id {kind}, url string, html string").coalesce(1)).collect()
    assert sorted(r.record_type for r in none) == ["response", "revisit", "revisit"] and all(r.refers_to is None and r.payload_bytes == 4 for r in none)


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    got = warc.deduplicate_pages(spark.createDataFrame([(i, "u", "same") for i in range(40)], PAGES)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == [(i, "revisit" if i else "response", 0 if i else None, 4) for i in range(40)]
