"""How far the sources of a language are apart in the terms they use, in exact whole numbers.

Terms are counted per task and then by (language, source, term). A term's share in a group is smoothed, so a term that a group
lacks has the group's base share, and the distance of two groups is a sum over all kept terms. It is made of two parts, added
exactly. Heavy terms, which many groups have, fill dense tiles: numpy matrices of terms x groups, base shares where a term is
absent, for each pair of blocks of groups. Light terms have at most LIGHT_MAX postings. All terms count at first as if both
groups lacked them; a tile adds what its terms change, each light posting is corrected against the other group's base share (a running sum over the group's sorted shares),
and each pair of postings of one light term is corrected once more. No group's terms meet another's as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm import common

#: Words of [^\x00-\x40\x5B-\x60\x7B-\x7F]+: letters and all bytes beyond ASCII.
LETTERS = common.byte_class({*range(65, 91), *range(97, 123), *range(128, 256)})
#: Documents of a language that a kept term is in at least; terms reported of a group at most.
LEAST_DOCS, TOP_TERMS = 30, 50
#: A term is heavy if more than this many groups have it, or more than one in HEAVY_SHARE of its language's groups.
LIGHT_MAX, HEAVY_SHARE = 64, 4
#: Groups on a side of a dense tile, terms of one step, and postings of one tile's task, roughly.
TILE_GROUPS, TILE_TERMS, TILE_ROWS = 256, 512, 500_000
#: Rows of counts that a task holds before it adds them up, and before it gives them away.
HELD_ROWS, KEEP_ROWS = 400_000, 100_000
#: Tasks that the pairs of one language are dealt over.
PAIR_SALTS = 32


def block_counts(block: common.Block, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, rows that have it) of a block, whose rows are of the groups given. Terms are compared by their bytes."""
    starts, ends, first = common.words(block, LETTERS)
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = common.LOWER[block.data[LETTERS[block.data]]]
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    terms = len(coded.dictionary)
    row = np.repeat(np.arange(len(block)), np.diff(first))
    in_row, n = np.unique(row * terms + coded.indices.to_numpy(), return_counts=True)
    key, at = np.unique(group[in_row // terms] * terms + in_row % terms, return_inverse=True)
    return key // terms, coded.dictionary.cast(pa.string()).take(pa.array(key % terms)), np.bincount(at, n).astype(np.int64), np.bincount(at)


def _added(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    t = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and rows that have it. Nulls are ''. A task adds up what it reads before it is shuffled."""
    common.ship(df.sparkSession)
    empty = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    docs = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            langs, sources = (batch.column(j).dictionary_encode() for j in (0, 1))
            many = max(len(sources.dictionary), 1)
            pair, group = np.unique(langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy(), return_inverse=True)
            for block in common.blocks(batch.column(2)):
                g, term, n, rows = block_counts(block, group[block.rows])
                held.append(pa.table({"lang": langs.dictionary.take(pa.array(pair[g] // many)), "source": sources.dictionary.take(pa.array(pair[g] % many)), "term": term, "n": n, "docs": rows}))
                if sum(t.num_rows for t in held) > HELD_ROWS:
                    held = [_added(held)]
                    if held[0].num_rows > KEEP_ROWS:
                        yield from held[0].combine_chunks().to_batches(10_000)
                        held = []
        if held:
            yield from _added(held).combine_chunks().to_batches(10_000)

    parts = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(1000000000 * (count + 5) / total) in 64 bits, three digits at a time, for count + 5 <= total < 9 * 10**15 (beyond, an overflow stops the job)."""
    out, rest = F.lit(1).cast("long"), (count + 5).cast("long")
    for unit in (1_000_000, 1_000, 1):
        out = out + F.call_function("div", rest * 1000, total) * unit
        rest = rest * 1000 % total
    return out


def _heavy(terms: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """(lang, lo, hi, v): parts of the sum of |p - q| - |difference of bases| over terms (lang, term, sid, p) by pairs of groups (lang, sid, base, ...), lo < hi.

    A term that neither of two blocks has adds nothing to their pairs.
    A task has one pair of blocks of TILE_GROUPS groups and one part of the terms, of about TILE_ROWS postings.
    """
    chunks = max(16, -(-n_rows // TILE_ROWS))
    blocks = groups.groupBy("lang").agg(F.expr(f"cast(ceil(count(*) / {TILE_GROUPS}.0) as int)").alias("blocks"))
    own = F.expr(f"sid div {TILE_GROUPS}").cast("int")
    per = lambda x: x.join(blocks, "lang").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    every = groups.select("lang", "sid", "base").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    base = per(every).select("lang", "chunk", "own", "other", F.lit(None).cast("string").alias("term"), "sid", F.col("base").alias("p"))
    some = per(terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))).select("lang", "chunk", "own", "other", "term", "sid", "p")
    dealt = some.unionByName(base).select("lang", "chunk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "term", "sid", "p")

    def run(t: pa.Table) -> pa.Table:
        lang, i, j = (t[c][0].as_py() for c in ("lang", "i", "j"))
        sid, p = t["sid"].to_numpy(), t["p"].to_numpy()
        head = t["term"].is_null().to_numpy()
        ids = np.sort(sid[head])
        bases = np.empty(len(ids), np.int64)
        bases[np.searchsorted(ids, sid[head])] = p[head]
        code = t["term"].combine_chunks().dictionary_encode().indices.filter(pa.array(~head)).to_numpy()
        at, p = np.searchsorted(ids, sid[~head]), p[~head]
        order = np.argsort(code, kind="stable")
        code, at, p = code[order], at[order], p[order]
        n_terms = int(code[-1]) + 1 if len(code) else 0
        left, right = np.flatnonzero(ids // TILE_GROUPS == i), np.flatnonzero(ids // TILE_GROUPS == j)
        total = np.zeros((len(left), len(right)), np.int64)
        for lo in range(0, n_terms, TILE_TERMS):
            a, b = np.searchsorted(code, [lo, lo + TILE_TERMS])
            tile = np.tile(bases, (min(TILE_TERMS, n_terms - lo), 1))
            tile[code[a:b] - lo, at[a:b]] = p[a:b]
            other = tile[:, right]
            for x, k in enumerate(left):
                total[x] += np.abs(tile[:, k, None] - other).sum(axis=0)
        total -= n_terms * np.abs(bases[left][:, None] - bases[right][None])
        x, y = np.nonzero(ids[left][:, None] < ids[right][None]) if n_terms else (np.zeros(0, int), np.zeros(0, int))
        return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "lo": ids[left][x], "hi": ids[right][y], "v": total[x, y]})

    return dealt.groupBy("lang", "i", "j", "chunk").applyInArrow(run, "lang string, lo long, hi long, v long")


def _light(terms: DataFrame) -> DataFrame:
    """(lang, lo, hi, v): for each pair of postings of one term, what is to be added to |p - base of the other| + |q - base of the other| - |difference of bases| for |p - q|."""
    keys = ["lang", "term"]
    rows = terms.select(*keys, "sid", "p", "base").repartition(*keys).sortWithinPartitions(*keys, "sid")

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        new = np.ones(t.num_rows, bool)
        for k in range(2):
            c = t.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] = c[1:] != c[:-1] if not k else new[1:] | (c[1:] != c[:-1])
        group = np.cumsum(new)
        langs = t["lang"].combine_chunks().dictionary_encode()
        lang, sid, p, base = langs.indices.to_numpy().astype(np.int64), t["sid"].to_numpy(), t["p"].to_numpy(), t["base"].to_numpy()
        found = []
        for step in range(1, LIGHT_MAX):
            a = np.flatnonzero(group[step:] == group[:-step])
            if not len(a):
                break
            b = a + step
            v = np.abs(p[a] - p[b]) - np.abs(p[a] - base[b]) - np.abs(p[b] - base[a]) + np.abs(base[a] - base[b])
            found.append(np.stack([lang[a], sid[a], sid[b], v]))
        if found:
            all_ = np.concatenate(found, axis=1)
            key, at = np.unique(all_[:3], axis=1, return_inverse=True)
            v = np.zeros(key.shape[1], np.int64)
            np.add.at(v, at.ravel(), all_[3])
            yield pa.record_batch([langs.dictionary.take(pa.array(key[0])), pa.array(key[1]), pa.array(key[2]), pa.array(v)], names=["lang", "lo", "hi", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) > KEEP_ROWS:
                t = pa.Table.from_batches(held)
                # the last term may go on in the next batch
                last = [t.column(k)[t.num_rows - 1].as_py() for k in range(2)]
                cut = t.num_rows - 1
                while cut and [t.column(k)[cut - 1].as_py() for k in range(2)] == last:
                    cut -= 1
                yield from pairs(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "lang string, lo long, hi long, v long")


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) that occurs; nulls of the three columns are ''.

    Terms are [^\x00-\x40\x5B-\x60\x7B-\x7F]+ with A-Z lower-cased. A language keeps its V terms that are in least_docs of
    its rows or more. p of a kept term in a group or a language is 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N the number
    of kept terms' occurrences there. part "pair": item is another source of the language, value the sum of |p - its p| over
    kept terms, 0 without any. part "term": item is a term that the group has with p above the language's, value by how
    much, at most top of them. rank is from 1 by group and part, by falling value, then item by its bytes.

    Texts without terms and empty texts make groups all the same. Rows that repeat count each time. Other columns aren't read.
    An empty table gives no rows. The pairs of a language are as many as its sources squared: that is the result's size.
    """
    counts = common.stored(term_counts(df, text_col, lang_col, source_col), "counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"), F.count("*").alias("m")).where(F.col("docs") >= least_docs).drop("docs")
    of_lang = common.stored(of_lang, "terms")
    kept = common.stored(counts.drop("docs").join(of_lang, ["lang", "term"]), "kept")
    common.drop(counts)
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    empty = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    groups = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("size")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    by_lang = Window.partitionBy("lang")
    base = F.when(F.col("v") > 0, share(F.lit(0), F.greatest(F.col("n") + 5 * F.col("v"), F.lit(1)))).otherwise(0)
    groups = groups.select("*", base.alias("base"), (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("sid"), F.count("*").over(by_lang).alias("groups"))
    groups = common.stored(groups, "groups")

    total = kept.count()
    per = groups.select("lang", "source", "size", F.struct("n", "v", "lang_n", "base", "sid", "groups").alias("g")).where("size > 0")
    own = common.join_groups(kept, per, ["lang", "source"], total, "term")
    p, q = share(F.col("n"), F.col("g.n") + 5 * F.col("g.v")), share(F.col("in_lang"), F.col("g.lang_n") + 5 * F.col("g.v"))
    heavy = (F.col("m") > LIGHT_MAX) | (F.col("m") * HEAVY_SHARE > F.col("g.groups"))
    own = common.stored(own.select("lang", "source", "term", p.alias("p"), q.alias("q"), "g.sid", "g.base", heavy.alias("heavy")), "shares")
    common.drop(kept)

    term_rows = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    term_rows = term_rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)

    light = own.where("not heavy")
    dense = own.where("heavy").select("lang", "term", "sid", "p")
    sums = light.groupBy("lang", "sid").agg(F.count("*").alias("m"), F.sum("p").alias("s"))
    side = groups.select("lang", "sid", "base", "v").join(sums, ["lang", "sid"], "left").na.fill(0)
    # each ordered pair of groups of a language: the result has a row for it, too
    salt = F.pmod(F.xxhash64("sid"), F.lit(PAIR_SALTS)).cast("int")
    x = side.withColumn("salt", salt)
    y = side.select("lang", F.col("sid").alias("other"), F.col("base").alias("other_base"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))).alias("salt"))
    pairs = x.join(y, ["lang", "salt"]).where("sid != other").drop("salt")
    # where a group's shares lie below another's base share: running sums over its distinct light shares
    points = light.groupBy("lang", "sid", "p").agg(F.count("*").alias("c"))
    none = F.lit(None).cast("long")
    asked = pairs.select("lang", "sid", F.col("other_base").alias("p"), F.lit(0).cast("long").alias("c"), "other", "base", "m", "s", "v")
    line = asked.unionByName(points.select("lang", "sid", "p", "c", *(none.alias(c) for c in ("other", "base", "m", "s", "v"))))
    so_far = Window.partitionBy("lang", "sid").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("below", F.sum("c").over(so_far)).withColumn("sum_below", F.sum(F.col("c") * F.col("p")).over(so_far)).where("other is not null")
    apart = F.abs(F.col("base") - F.col("p"))
    alone = F.col("s") - F.col("m") * F.col("p") + 2 * (F.col("below") * F.col("p") - F.col("sum_below")) - F.col("m") * apart + F.when(F.col("sid") < F.col("other"), F.col("v") * apart).otherwise(0)
    alone = line.select("lang", F.least("sid", "other").alias("lo"), F.greatest("sid", "other").alias("hi"), alone.alias("v"))

    both = alone.unionByName(_light(light)).unionByName(_heavy(dense, groups, total)).groupBy("lang", "lo", "hi").agg(F.sum("v").alias("value"))
    both = both.select("lang", "value", F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))).alias("k"))
    name = lambda a, c: groups.select("lang", F.col("sid").alias(a), F.col("source").alias(c))
    pair_rows = both.select("lang", "k.a", "k.b", "value").join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pair_rows = pair_rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(first))
    return term_rows.unionByName(pair_rows)
