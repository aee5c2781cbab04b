"""The thin queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.llm import ann, bpe, chat, decontam, exact_substrings, fuzzy_passages, html, minhash, secrets, toxicity
from rowloom.llm.common import table


def bpe_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), *bpe_files(), digests=True)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.dedup(table(spark, sf_dir, "documents"), digests=True)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ask = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", ask), (-7, 1, "assistant", ask)], "conv_id long, turn long, role string, text string")
    messages = own.unionByName(more).withColumn("parts", chat.text_part(F.col("text")))
    return chat.digests(chat.format_conversations(messages))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chained_passages": op1_chained_passages,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_hnsw_neighbours": op6_hnsw_neighbours,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_html_text": op8_html_text,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op10_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
       FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
       FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS i) WHERE len(ws) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL["op3_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, unnest(generate_series(0, length(h) // 2 - 50)) AS p, h FROM d WHERE length(h) >= 100),
g AS MATERIALIZED (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM w),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
hit AS (SELECT g.r, g.p FROM g JOIN m USING (s) WHERE g.doc_id > m.first),
run AS (SELECT r, p, coalesce(p > lag(p) OVER o + 50, true)::INT AS new FROM hit WINDOW o AS (PARTITION BY r ORDER BY p)),
span AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM run) GROUP BY r, k),
ends AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM span),
cutd AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM ends JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cutd USING (r)
"""

_CONTROL = ["<|turn|>", "<|body|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPED = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in ["\\", *_CONTROL])
_ESCAPED_ROLE = _ESCAPED.replace("(t", "(r").replace("t, ", "r, ")
ORACLE_SQL["op4_chat_format"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(t) + length(r) + {_ESCAPED} + {_ESCAPED_ROLE} + 23 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL["op7_minhash_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * pairs.c >= 75 * (p.c + q.c - pairs.c)),
reach AS (SELECT a AS doc_id, b AS r FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a),
comp AS (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(comp.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(comp.m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
