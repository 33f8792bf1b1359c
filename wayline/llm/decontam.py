"""Benchmark decontamination with a positional inverted index of the training tokens.

The index is partitioned by documents: each stored row holds the dictionary and the postings of one block of documents,
term by term, as ascending word positions. It doesn't depend on the benchmark and can serve several. A search looks the
benchmark's terms up in the block's dictionary, by hash and then by their bytes, and takes each benchmark window from its
rarest term in the block: that term's postings, moved back by the term's offset, are the candidates, and are intersected
with the other terms' moved lists in order of rarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import common

#: Benchmark bytes that one search takes, about 1,200,000 windows and 200 MB on the driver; a larger benchmark is searched in several rounds.
BENCHMARK_BYTES = 8_000_000

_INDEX = "ids array<{kind}>, bounds binary, terms binary, firsts binary, words binary, postings binary, block string"


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in order of their hashes (and of their bytes, where different words share one), and where in it each distinct word begins."""
    order, size = np.argsort(h, kind="stable"), ends - starts

    def fresh() -> tuple[np.ndarray, np.ndarray]:
        """Where the word before has another hash, and where it has other bytes."""
        a, b = order[1:], order[:-1]
        hashed = h[a] != h[b]
        new, alike = hashed.copy(), np.flatnonzero(~hashed)
        new[alike] = ~common.equal_spans(data, starts[a[alike]], size[a[alike]], data, starts[b[alike]], size[b[alike]])
        return hashed, new

    hashed, new = fresh()
    if (hashed != new).any():
        spot = np.flatnonzero(np.isin(h[order], h[order[1:][hashed != new]]))
        order[spot] = sorted(order[spot].tolist(), key=lambda j: (h[j], data[starts[j] : ends[j]].tobytes(), j))
        _, new = fresh()
    return order, np.flatnonzero(np.append(True, new)) if len(order) else order


def build_index(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The stored index of df's texts: a row per block of documents with

    block (its name); ids; bounds (int32, each document's first word and the end); terms (uint64, ascending hashes of
    distinct words); firsts (int32, each term's first posting and the end); words (zlib of the terms' lengths as int32 and
    their bytes); postings (zlib of int32 differences of word positions, term after term).
    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased. Null and empty texts have no words but are listed.
    """
    common.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in common.blocks(batch.column(1)):
                number += 1
                starts, ends, first = common.words(block, common.ALNUM)
                h, low = common.word_hashes(block, starts, ends), common.LOWER[block.data]
                order, new = _terms(low, starts, ends, h)
                gaps = np.diff(order.astype(np.int32), prepend=np.int32(0))
                lead = order[new]
                lengths = (ends - starts)[lead]
                letters = low[_gather(starts[lead], ends[lead])]
                parts = [first.astype(np.int32).tobytes(), h[lead].tobytes(), np.append(new, len(h)).astype(np.int32).tobytes(), zlib.compress(lengths.astype(np.int32).tobytes() + letters.tobytes(), 1), zlib.compress(gaps.tobytes(), 1)]
                ids = batch.column(0).slice(int(block.rows[0]), len(block))
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.record_batch([lists, *(pa.array([x], pa.binary()) for x in parts), pa.array([f"{part}-{number}"])], names=["ids", "bounds", "terms", "firsts", "words", "postings", "block"])

    return common.stored(df.select(df[id_col], df[text_col]).mapInArrow(run, _INDEX.format(kind=kind)), "index")


class Vocabulary:
    """Distinct words to look up in dictionaries: hashes, ascending, and bytes."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64)
        h = common.span_hashes(data, starts, ends)
        order = np.argsort(h, kind="stable")
        self.data, self.starts, self.sizes, self.hashes = data, starts[order], (ends - starts)[order], h[order]
        #: of each word, its place here
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))


class Dictionary:
    """The opened index of one block."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        bounds, self.terms, firsts = (np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in ((1, np.int32), (2, np.uint64), (3, np.int32)))
        self.bounds, self.firsts = bounds.astype(np.int64), firsts.astype(np.int64)
        words = np.frombuffer(zlib.decompress(batch.column(4)[i].as_py()), np.uint8)
        self.sizes = words[: 4 * len(self.terms)].view(np.int32).astype(np.int64)
        self.letters = words[4 * len(self.terms) :]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.postings = np.cumsum(np.frombuffer(zlib.decompress(batch.column(5)[i].as_py()), np.int32), dtype=np.int64)
        self.ids, self.block = batch.column(0)[i].values, batch.column(6)[i].as_py()

    def lists(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's posting list begins and ends; equal places for words that aren't there."""
        at = np.searchsorted(self.terms, v.hashes)
        found = np.full(len(at), -1, np.int64)
        todo = np.flatnonzero(at < len(self.terms))
        while len(todo):  # a second step only where different words share a hash
            todo = todo[self.terms[at[todo]] == v.hashes[todo]]
            same = common.equal_spans(self.letters, self.starts[at[todo]], self.sizes[at[todo]], v.data, v.starts[todo], v.sizes[todo])
            found[todo[same]] = at[todo[same]]
            at[todo] += 1
            todo = todo[~same]
            todo = todo[at[todo] < len(self.terms)]
        known = found >= 0
        return np.where(known, self.firsts[found], 0), np.where(known, self.firsts[found + 1], 0)


class Windows:
    """The distinct word windows of some benchmark items, and the items of each: arrays of numbers, no object per window."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.names = [i for i, _ in items]
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        block = next(common.blocks(texts, 2**62), common.Block(np.zeros(0, int), np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        starts, ends, first = common.words(block, common.ALNUM)
        code, distinct = common.word_codes(block, starts, ends)
        self.vocabulary = Vocabulary([w.as_py().encode() for w in distinct])
        code = self.vocabulary.rank[code]
        counts = np.diff(first)
        n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
        owner = np.repeat(np.arange(len(counts)), n)
        start = first[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(counts[owner], width)
        # one number for equal windows: pairs of numbers are numbered, word after word (0 is no word)
        number = np.zeros(len(owner), np.int64)
        for j in range(width):
            at = np.minimum(start + j, max(len(code) - 1, 0))
            word = np.where(j < size, code[at] + 1, 0)
            number = pa.array(number * (len(distinct) + 1) + word).dictionary_encode().indices.to_numpy().astype(np.int64)
        _, lead = np.unique(number, return_index=True)
        self.size = size[lead]
        self.terms = np.full((len(lead), width), -1, np.int32)
        for j in range(width):
            inside = np.flatnonzero(j < self.size)
            self.terms[inside, j] = code[start[lead[inside]] + j]
        pairs = np.unique(number * max(len(counts), 1) + owner)
        self.owner_first = np.searchsorted(pairs, np.arange(len(lead) + 1) * max(len(counts), 1))
        self.owners = pairs % max(len(counts), 1)


def _gather(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Indices lo[0]..hi[0]-1, lo[1]..hi[1]-1, and so on."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def phrase_hits(w: Windows, d: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in one block."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(w.size) or not len(d.postings):
        return none
    lo, hi = d.lists(w.vocabulary)
    often = np.append(hi - lo, np.iinfo(np.int64).max)  # the last for the padding of short windows
    counts = often[w.terms]
    alive = np.flatnonzero(counts.min(axis=1) > 0)
    if not len(alive):
        return none
    order = np.argsort(counts[alive], axis=1, kind="stable")
    seed = w.terms[alive, order[:, 0]]
    window = np.repeat(alive, hi[seed] - lo[seed])
    place = np.repeat(np.arange(len(alive)), hi[seed] - lo[seed])
    start = d.postings[_gather(lo[seed], hi[seed])] - order[place, 0]
    doc = np.searchsorted(d.bounds, start, "right") - 1
    ok = (start >= 0) & (start + w.size[window] <= d.bounds[np.minimum(doc + 1, len(d.bounds) - 1)])
    window, place, start = window[ok], place[ok], start[ok]
    # the lists of all terms as one ascending list of (term, position): a look-up in it is one in the term's list
    end = int(d.bounds[-1])
    joined = np.repeat(np.arange(len(lo)), hi - lo) * end + d.postings[_gather(lo, hi)]
    for step in range(1, w.terms.shape[1]):
        if not len(window):
            break
        offset = order[place, step]
        inside = offset < w.size[window]
        wanted = w.terms[window, np.minimum(offset, w.size[window] - 1)].astype(np.int64) * end + start + offset
        at = np.minimum(np.searchsorted(joined, wanted), len(joined) - 1)
        same = ~inside | (joined[at] == wanted)
        window, place, start = window[same], place[same], start[same]
    return window, start


def proximity_hits(words: Vocabulary, slop: int, d: Dictionary) -> np.ndarray:
    """Positions of the rarest of the words in one block that have all others, in any order, at most slop words away in the same document."""
    lo, hi = d.lists(words)
    order = np.argsort(hi - lo, kind="stable")
    at = d.postings[lo[order[0]] : hi[order[0]]]
    for j in order[1:]:
        other = d.postings[lo[j] : hi[j]]
        if not len(other):
            return other[:0]
        doc = np.searchsorted(d.bounds, at, "right") - 1
        near = np.searchsorted(other, np.maximum(at - slop, d.bounds[doc]))
        at = at[(near < len(other)) & (other[np.minimum(near, len(other) - 1)] <= np.minimum(at + slop, d.bounds[doc + 1] - 1))]
    return at


def proximity_matches(index: DataFrame, words: list[str], slop: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, position) of the rarest of words wherever all are within slop words of it. No words, no matches."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    block = next(common.blocks(pa.array([" ".join(words)])))
    low = common.LOWER[block.data].tobytes()
    wanted = Vocabulary(sorted({low[a:b] for a, b in zip(*(x.tolist() for x in common.words(block, common.ALNUM)[:2]), strict=True)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = Dictionary(batch, i)
                at = proximity_hits(wanted, slop, d) if len(wanted.sizes) else np.zeros(0, np.int64)
                doc = np.searchsorted(d.bounds, at, "right") - 1
                yield pa.record_batch([d.ids.take(pa.array(doc)), pa.array(at - d.bounds[doc])], names=["_id", "position"])

    return common.named(index.mapInArrow(run, f"_id {kind}, position long"), id_col, ["position"])


def _search(index: DataFrame, windows: Windows, spans: bool) -> DataFrame:
    """Per document: id, n_words, row (its place in its block), block, items, and the hit words: their count, or with spans merged [start, end) pairs."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        names = np.array(w.names, object)
        for batch in batches:
            for i in range(batch.num_rows):
                d = Dictionary(batch, i)
                bounds = d.bounds
                window, start = phrase_hits(w, d)
                n = len(bounds) - 1
                edge = np.zeros(int(bounds[-1]) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + w.size[window], -1)
                hit = np.cumsum(edge)[:-1] > 0
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])
                doc = np.searchsorted(bounds, start, "right") - 1
                n_own = w.owner_first[window + 1] - w.owner_first[window]
                pairs = np.unique(np.repeat(doc, n_own) * (len(names) + 1) + w.owners[_gather(w.owner_first[window], w.owner_first[window + 1])])
                items = [[] for _ in range(n)]
                for at, item in zip((pairs // (len(names) + 1)).tolist(), names[pairs % (len(names) + 1)].tolist(), strict=True):
                    items[at].append(item)
                places = [[] for _ in range(n)]
                if spans:
                    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                    cuts = np.unique(np.concatenate([np.flatnonzero(step), bounds])).astype(np.int64)
                    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        if hit[s]:
                            at = int(np.searchsorted(bounds, s, "right")) - 1
                            places[at] += [s - int(bounds[at]), e - int(bounds[at])]
                yield pa.record_batch([d.ids, pa.array([d.block] * n, pa.string()), pa.array(np.arange(n), pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int64()))], names=["id", "block", "row", "n_words", "n_hit", "items", "places"])

    return index.mapInArrow(run, f"id {kind}, block string, row long, n_words long, n_hit long, items array<string>, places array<bigint>")


def contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", width: int = 10, spans: bool = False) -> DataFrame:
    """One row per row of df: id_col, n_words, n_hit, n_items, items (sorted as strings), contaminated (n_hit > 0), and with spans also places.

    A window is width consecutive words of an item, or a whole item of fewer words (of none: no window). A document's
    words inside any occurrence of a window are hit; items are those with an occurring window. Null and empty texts have
    no words. Repeated ids and rows are handled row by row; a null item id counts as the string null; items that repeat
    count once by id. Other columns aren't read; an id column named like a result column takes its place. places: starts and ends of hit word runs, flat.
    """
    common.ship(df.sparkSession)
    index = build_index(df, text_col, id_col)
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    rounds = int(-(-total // BENCHMARK_BYTES)) or 1
    if rounds == 1:
        found = _search(index, Windows([tuple(r) for r in items.collect()], width), spans)
    else:
        parts = None
        for r in range(rounds):
            some = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(rounds)) == r)
            part = _search(index, Windows([tuple(x) for x in some.collect()], width), True)
            part = common.stored(part if not r else part.where("n_hit > 0"), "found")
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("block", "row").agg(F.any_value("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list(F.expr("transform(sequence(0, greatest(size(places) div 2 - 1, 0)), i -> struct(get(places, 2 * i) as s, get(places, 2 * i + 1) as e))"))).alias("p"))
        merged = merged.withColumn("p", F.array_sort(F.expr("filter(p, x -> x.s is not null)")))
        merged = merged.withColumn("p", F.expr("aggregate(p, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) -> case when size(a) > 0 and a[size(a) - 1].e >= x.s then concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].s as s, greatest(a[size(a) - 1].e, x.e) as e))) else concat(a, array(x)) end)"))
        found = merged.withColumn("n_hit", F.expr("aggregate(p, 0L, (a, x) -> a + x.e - x.s)")).withColumn("places", F.expr("flatten(transform(p, x -> array(x.s, x.e)))"))
    found = found.withColumn("items", F.array_distinct("items"))
    out = found.select(F.col("id").alias("_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"), (F.col("n_hit") > 0).alias("contaminated"), "places")
    return common.named(out, id_col, ["n_words", "n_hit", "n_items", "items", "contaminated", *["places"] * spans])
