"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontamination, html, lm, neardup, packing, paragraphs, quality, sharding, spelling, urls, warc
from .common import table

SHARDS = 40


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(quality.PREFIX + c).alias(c) for c in names], "base_failed", F.col("rejected_by").isNull().alias("kept"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 16).cast("long")
    out = sharding.two_pass_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", size, SHARDS, seed=4)
    text = F.coalesce("record.text", F.lit(""))
    return out.select(F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    page = lambda c: F.expr(f"try_cast({c} as bigint)")
    return out.select(page("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.train_and_score(docs, held_out=F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(own)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_html_extraction, op3_quality_rules, op4_sharding, op5_url_filters, op6_substring_dedup, op7_warc, op8_lm_scoring, op9_benchmark_decontamination, op10_minhash_near_dedup, op11_chat_formatting, op12_spelling_variants, op13_cross_tokenizer_alignment)}

_OP3 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT *, len(w) AS n,
         list_transform(range(1, greatest(len(w) - 4, 0) + 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) AS g,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM w),
p AS (SELECT doc_id, unnest(g) AS s, unnest(range(1, len(g) + 1)) AS i FROM g),
c AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM p) WHERE k > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words FROM c GROUP BY doc_id),
f AS (
  SELECT g.doc_id, t, w, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS capitals,
         len(string_split(t, chr(10))) AS n_lines
  FROM g LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * letters < 3 * word_chars OR 10 * capitals > 5 * letters
            OR 10 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) > 3 * n_words
            OR 4 * len(list_filter(w, lambda x: x = '|')) > n_words) AS kept
FROM v
"""

_OP5 = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(verdict, rh, rp)),
best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
         FROM h JOIN rules ON ends_with('.' || host, '.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule,
       coalesce(best.verdict, CASE WHEN starts_with(path, '/') AND (contains(host, 'spam') OR contains(host, 'casino') OR contains(host, 'pills')
            OR regexp_matches(path, '(?s)^/.*/porn') OR regexp_matches(path, '(?s)^/.*viagra') OR regexp_matches(path, '(?s)^/.*\.exe$')) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best USING (page_id)
"""

_OP7 = """
WITH h AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, p, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM h),
d AS (SELECT page_id, strlen(p) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5*i+1] AS INT)
        + 8 * CAST(bits[5*i+2] AS INT) + 4 * CAST(bits[5*i+3] AS INT) + 2 * CAST(bits[5*i+4] AS INT) + CAST(bits[5*i+5] AS INT)]), '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM m
"""

_OP11 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM t),
b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS before,
             regexp_replace(text, '([<\[]\\*)(/?s>|/?INST\]|/?ROLE\]|SEP\])', '\1\\\2', 'g') AS escaped,
             regexp_replace(role, '([<\[]\\*)(/?s>|/?INST\]|/?ROLE\]|SEP\])', '\1\\\2', 'g') AS named FROM n),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss,
             sum(length(escaped) + CASE WHEN before = role THEN length('[SEP]')
                 ELSE length('<s></s>') + CASE role WHEN 'user' THEN length('[INST]') WHEN 'assistant' THEN length('[/INST]') ELSE length('[ROLE][/ROLE]') + length(named) END END) AS formatted_chars
      FROM b GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

ORACLES = {"op3_quality_rules": _OP3, "op5_url_filters": _OP5, "op7_warc": _OP7, "op11_chat_formatting": _OP11}
