"""The registered queries of the training-data operators, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import ann, chat, decontam, divergence, line_dedup, mixing, near_dup, pii, quality, repair, sharding, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]
#: A key for tests and these queries; users of replace_pii give their own.
PII_KEY = "surrogates-v1"
CONTEXT_TOKENS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_chars", "n_tokens", (F.col("n_tokens") > CONTEXT_TOKENS).alias("over_limit"), F.md5("prefix_deltas").alias("prefixes_md5"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities", "entity_kinds")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_row", "mix_position", "mix_exact")


def op8_ann_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20).select(F.col("query_id"), "rank", "vec_id", "score")


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


#: The registered query's shards.
SHARDS = 16


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    out = sharding.slotted(sharding.assigned(docs, SHARDS, ["doc_id"]), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair.audits(repair.damaged(rows))
    every = rows.select("conv_id").distinct().withColumnRenamed("conv_id", "original")
    out = every.join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in repair.NUMBERS]
    return out.select(F.col("original").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_token_counts, op2_quality_classifier, op3_pii_surrogates, op4_chat_formatting, op5_warc_revisits, op6_decontamination, op7_source_mixing, op8_ann_ivfpq, op9_minhash_near_dup, op10_line_dedup, op11_source_divergence, op12_sharding, op13_conversation_repair)
}

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = r"length(regexp_replace({}, '(<\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[\\*)(INST\]|/INST\])', '\1\3\\\2\4', 'g'))"
_TEXT = "coalesce(text, '')"
_ROLE = "replace(replace(coalesce(role, ''), '%', '%25'), chr(10), '%0A')"

def _key_sql(*columns: str) -> str:
    return "concat_ws(',', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || '=' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


def _digits_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {sharding.DIGITS}) AS BIGINT)"


def _shard_sql(n: int) -> str:
    return f"list_min(list_transform(range({n}), lambda s: struct_pack(score := -ln((CAST({_digits_sql("k || ':' || CAST(s AS VARCHAR)")} AS DOUBLE) + 0.5) / {16**sharding.DIGITS}.0) / 1.0, shard := CAST(s AS INTEGER)))).shard"


#: CRC-32 by its rule: a table of 256 remainders, then a fold over the bytes.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"

def _share_sql(count: str, total: str) -> str:
    return f"1 + (1000000000 * CAST({count} + 5 AS HUGEINT)) // ({total})"


def _crc_sql(x: str, n: str) -> str:
    """CRC-32 of the n bytes that x holds in hexadecimal digits; t is _CRC_TABLE."""
    return f"xor(4294967295, list_reduce(list_transform(range({n}), lambda i: CAST('0x' || substr({x}, 2 * i + 1, 2) AS BIGINT)), lambda r, b: xor(t[1 + CAST(xor(r, b) & 255 AS INTEGER)], r >> 8), CAST(4294967295 AS BIGINT)))"


def _edit_sql(state: str, edit: str, cost: str, line: str = "''") -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', t := {state}.t || {line})"


def _least_sql(*ways: str) -> str:
    """The first by cost, then audit; null ways are none."""
    return f"list_min([{', '.join(ways)}])"


def _inserted_sql(rows: str) -> str:
    """rows (conv_id, i, s0..s3) with insertions: each state holds the best cost, audit and repaired text of the ways to it."""
    line = lambda role: f"chr(10) || '{role}:'"
    user = _least_sql("s2", *(_edit_sql(s, "I", "3", line("user")) for s in ("s0", "s1", "s3")))
    return f"SELECT conv_id, i, s0, s1, s2, {_least_sql('s3', _edit_sql('s2', 'I', '3', line('assistant')))} AS s3 FROM (SELECT conv_id, i, s0, s1, {user} AS s2, s3 FROM ({rows}))"


def _consumed_sql() -> str:
    """The states after row i + 1."""
    kept = lambda s, initial: f"CASE WHEN initial = '{initial}' AND NOT must THEN {_edit_sql(s, 'K', 'extra', 'line')} END"
    rerole = lambda s, role: f"CASE WHEN NOT must THEN {_edit_sql(s, 'R', '3 + extra', f"chr(10) || '{role}:' || text")} END"
    gone = lambda s: _edit_sql(s, "D", "4")
    to = [
        [gone("s0")],
        [gone("s1"), kept("s0", "s")],
        [gone("s2"), *(f(s, *x) for s in ("s0", "s1", "s3") for f, x in ((kept, ("u",)), (rerole, ("user",))))],
        [gone("s3"), kept("s2", "a"), rerole("s2", "assistant")],
    ]
    states = ", ".join(f"{_least_sql(*w)} AS s{k}" for k, w in enumerate(to))
    return f"SELECT conv_id, i + 1 AS i, {states} FROM (SELECT b.conv_id, b.i, s0, s1, s2, s3, initial, must, extra, line, text FROM b JOIN s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1)"


_NO_WAY = "struct_pack(c := 1000000000, a := '', t := '')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op13_conversation_repair": f"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
        f AS (SELECT *, {_crc_sql('x', 'length(x) // 2')} % 20 AS f FROM k, (SELECT {_CRC_TABLE} AS t)),
        d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
              FROM (SELECT *, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE f <> 0)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, {_BLANKS}) AS z, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS role_before
              FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
        s AS MATERIALIZED (SELECT *, left(role, 1) AS initial, z = '' OR seen > 1 AS must, CASE WHEN right(z, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS extra, chr(10) || role || ':' || text AS line FROM o),
        b AS ({_inserted_sql(f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, struct_pack(c := 0, a := '', t := '') AS s0, {_NO_WAY} AS s1, {_NO_WAY} AS s2, {_NO_WAY} AS s3 FROM k")}
              UNION ALL {_inserted_sql(_consumed_sql())}),
        e AS (SELECT conv_id, {_least_sql('s0', 's3')} AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS latest FROM b) WHERE latest = 1),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (z = '') AS blank, count(*) FILTER (z <> '' AND seen > 1) AS duplicate,
                 count(*) FILTER (NOT must AND extra > 0) AS truncated, count(*) FILTER (role_before IS NOT NULL AND left(role_before, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(e.e.c AS BIGINT) AS cost, e.e.a AS audit, sha256(substr(e.e.t, 2)) AS repaired_sha256
        FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op11_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT k, lang, source, unnest(w) AS t FROM d),
        kept AS (SELECT lang, t, count(*) AS ln FROM o GROUP BY lang, t HAVING count(DISTINCT k) >= 30),
        v AS (SELECT lang, count(*) AS v, sum(ln) AS n FROM kept GROUP BY lang),
        c AS (SELECT o.lang, source, t, count(*) AS c FROM o JOIN kept USING (lang, t) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
        p AS MATERIALIZED (SELECT g.lang, g.source, kept.t, coalesce(c.c, 0) AS c, CAST({_share_sql('coalesce(c.c, 0)', 'coalesce(n.n, 0) + 5 * v.v')} AS BIGINT) AS p,
                 CAST({_share_sql('kept.ln', 'v.n + 5 * v.v')} AS BIGINT) AS q
              FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t
                 LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
        f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', t, p - q FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
    "op12_sharding": f"""
        WITH d AS (SELECT doc_id, CAST(strlen({_TEXT}) + 1 AS BIGINT) AS size, hex(encode({_TEXT})) AS x, {_key_sql('doc_id')} AS k FROM documents),
        c AS (SELECT *, {_crc_sql('x', 'size - 1')} AS text_crc32
              FROM d, (SELECT {_CRC_TABLE} AS t)),
        s AS (SELECT *, {_shard_sql(SHARDS)} AS shard, {_shard_sql(SHARDS + 1)} AS grown_shard, {_digits_sql(_key_sql('doc_id', 'text_crc32', 'size'))} AS h FROM c)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, grown_shard FROM s""",
    "op4_chat_formatting": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, {_TEXT} AS t, {_ESCAPED.format(_TEXT)} AS tn, {_ESCAPED.format(_ROLE)} AS rn
            FROM (SELECT conv_id, turn, role, text FROM conversations
                  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) x
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
               CAST(sum(12 + rn + 1 + tn + 11) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op5_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, CAST(unhex(sha1(h)) AS BIT)::VARCHAR AS bits, h FROM p),
        e AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest,
                  min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM e""",
    "op6_decontamination": rf"""
        WITH iw AS (SELECT item_id, regexp_extract_all({_LOW.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, w[i:i + 9] AS g, len(w[i:i + 9]) AS n
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
        dw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        spots AS (SELECT k, s, w[s:s + n - 1] AS g, n
                  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win))),
        hits AS (SELECT k, s, spots.n, item_id FROM spots JOIN win ON spots.g = win.g),
        hit_words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hits) GROUP BY k),
        items AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS l FROM hits GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit_words USING (k) LEFT JOIN items USING (k)""",
    "op9_minhash_near_dup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
        g AS (SELECT doc_id, unnest(s) AS x FROM s),
        c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT u, v FROM c JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
        e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        r AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.d)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
        FROM s JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = s.doc_id""",
}
