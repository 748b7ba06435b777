"""Queries over conversations: turns, bindings, signals, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import turns as T
from .registry import query, t

_TURNS = """
n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_no FROM conversations),
g AS (SELECT conv_id, CAST(turn_no AS BIGINT) AS turn_no, arg_min(text, turn) AS question,
             arg_max(text, turn) FILTER (role = 'assistant' AND trim(coalesce(text, '')) <> '') AS answer,
             min(turn) AS first_order, max(turn) AS last_order, count(*) AS n_messages
      FROM n WHERE turn_no > 0 GROUP BY 1, 2),
turns AS (SELECT *, lag(question) OVER w AS previous_question, lead(first_order) OVER w AS next_order
          FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no) QUALIFY trim(coalesce(question, '')) <> '')
"""


def _turns(spark, d):
    return T.slice_turns(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(f"WITH {_TURNS} SELECT * FROM turns")
def turns(spark, d):
    return _turns(spark, d)


@query(f"WITH {_TURNS} SELECT n_messages, count(*) AS n FROM turns GROUP BY 1")
def turn_length_facet(spark, d):
    return _turns(spark, d).groupBy("n_messages").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS)
          OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), turn) AS anchor FROM conversations""")
def anchor_messages(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.anchor_of("conv_id", "turn", "role", "assistant", "turn").alias("anchor"))


@query("""WITH u AS (SELECT conv_id, turn, substr(coalesce(text, ''), 1, 400) AS x FROM conversations),
b AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM u)
SELECT conv_id, turn, CASE WHEN used >= 1000 THEN substr(x, 1, 200) ELSE x END AS compact FROM b""")
def compact_text(spark, d):
    return T.compact_messages(t(spark, d, "conversations"), ["conv_id"], "turn", "text", 1000, 400).select("conv_id", "turn", "compact")


@query("SELECT role, count(*) AS messages, count(*) FILTER (trim(coalesce(text, '')) <> '') AS with_text FROM conversations GROUP BY 1")
def role_profile(spark, d):
    return T.role_profile(t(spark, d, "conversations"), "role", {"with_text": "text"})


_RUNS = """
runs AS (SELECT event_id AS run_id, user_id AS conv_id, ts, props FROM events WHERE event_type <> 'view'),
spans AS (SELECT event_id AS turn_id, user_id AS conv_id, CASE WHEN event_id % 3 = 0 THEN event_id + 1 END AS run_id, props, ts AS low,
                 lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS high FROM events WHERE event_type = 'view')
"""


@query(f"""WITH {_RUNS},
u AS (SELECT turn_id, r.run_id, 1 AS tier FROM spans s JOIN runs r ON s.run_id = r.run_id
      UNION SELECT turn_id, r.run_id, 2 FROM spans s JOIN runs r USING (conv_id, props)
      UNION SELECT turn_id, r.run_id, 3 FROM spans s JOIN runs r ON s.conv_id = r.conv_id AND r.ts >= low AND (high IS NULL OR r.ts < high))
SELECT turn_id, run_id, tier FROM u QUALIFY tier = min(tier) OVER (PARTITION BY turn_id)""")
def usage_binding(spark, d):
    from pyspark.sql import Window

    e = t(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = e.where("event_type = 'view'").select(F.col("event_id").alias("turn_id"), F.col("user_id").alias("conversation_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1).alias("run_id"), F.col("props").alias("question"), F.col("ts").alias("start"), F.lead("ts").over(w).alias("next_start"))
    runs = e.where("event_type <> 'view'").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("conversation_id"), F.col("props").alias("question"), F.col("ts").alias("start"))
    return T.bind_usage(spans, runs)


@query("""SELECT DISTINCT a.event_id AS error_id, b.event_id AS purchase_id FROM events a JOIN events b
          ON a.event_type = 'error' AND b.event_type = 'purchase' AND (a.user_id = b.user_id AND a.props = b.props OR a.event_id = b.event_id - 1)""")
def feedback_binding(spark, d):
    e = t(spark, d, "events")
    key = F.concat_ws("|", "user_id", "props")
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), key.alias("k1"), F.col("event_id").alias("k2"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), key.alias("j1"), (F.col("event_id") - 1).alias("j2"))
    return T.bind_any(a, b, [("k1", "j1"), ("k2", "j2")], "error_id", "purchase_id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_opinion(spark, d):
    return T.latest_per_key(t(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, user_id, props FROM events QUALIFY count(*) OVER (PARTITION BY user_id, props) = 1")
def unambiguous_events(spark, d):
    return T.unique_only(t(spark, d, "events"), ["user_id", "props"]).select("event_id", "user_id", "props")


@query("""WITH m AS (SELECT user_id, event_type AS tool, props, regexp_matches(props, '[13579]}') AS bad FROM events WHERE event_type <> 'view')
SELECT user_id, count(*) FILTER (NOT bad) AS tool_ok, count(*) FILTER (bad) AS tool_fail, CASE WHEN bool_or(bad) THEN 'degraded' ELSE 'clean' END AS level FROM m GROUP BY 1""")
def turn_signals(spark, d):
    e = t(spark, d, "events").where("event_type <> 'view'").withColumn("result", F.when(F.col("props").rlike("[13579]}"), F.concat(F.lit("Timeout: "), "props")).otherwise("ok"))
    return T.turn_signals(e.withColumn("tool", F.when(F.col("event_type") == "error", "err").otherwise(F.col("event_type"))), ["user_id"], "tool", "result", "result").select("user_id", "tool_ok", "tool_fail", "level")


@query("""WITH e AS (SELECT user_id * 8 + event_id % 8 AS turn, event_id, event_type AS k, floor(value)::BIGINT AS v FROM events),
m AS (SELECT turn, count(*) AS n, count(*) FILTER (event_id % 3 > 0 AND v % 5 > 0) AS ok, count(*) FILTER (event_id % 3 > 0 AND v % 5 = 0) AS bad, count(*) FILTER (event_id % 3 > 0 AND k = 'click') AS clicks,
 list(k || ': it timed out' ORDER BY event_id) FILTER (event_id % 3 > 0 AND v % 5 = 0) AS errors FROM e WHERE k IN ('click', 'view') GROUP BY 1),
r AS (SELECT turn, count(*) AS n, nullif(sum(v)::BIGINT, 0) AS ms, bool_or(v % 7 = 0) AS failed, bool_or(v % 11 = 3) AS aborted, bool_or(v % 11 = 5) AS late, bool_or(v % 11 = 7) AS auth,
 string_agg(DISTINCT CASE WHEN v % 7 = 0 THEN 'failed' ELSE 'done' END, ',' ORDER BY CASE WHEN v % 7 = 0 THEN 'failed' ELSE 'done' END) AS statuses, arg_min(CASE v % 11 WHEN 3 THEN 'user canceled' WHEN 5 THEN 'TIMEOUT' ELSE '请先登录' END, event_id) FILTER (v % 11 IN (3, 5, 7)) AS error FROM e WHERE k IN ('purchase', 'error') GROUP BY 1),
c AS (SELECT turn, (2 * sum(v))::BIGINT AS input, sum(v)::BIGINT AS output, (3 * sum(v))::BIGINT AS total, coalesce((3 * sum(v) FILTER (k = 'signup'))::BIGINT, 0) AS unknown, count(*) FILTER (v % 13 = 1) AS stopped FROM e GROUP BY 1)
SELECT c_custkey AS turn, coalesce(m.ok, 0) AS tool_ok, coalesce(m.bad, 0) AS tool_fail, coalesce(clicks, 0) AS clicks, array_to_string(coalesce(errors[1:8], []), ';') AS tool_errors, ms AS duration_ms, statuses AS run_status, error AS run_error, coalesce(input, 0) AS input_tokens, coalesce(output, 0) AS output_tokens,
 coalesce(total, 0) AS total_tokens, coalesce(unknown, 0) AS unknown_tokens, coalesce(stopped, 0) AS stopped, array_to_string(list_filter([CASE WHEN failed THEN 'usage_run_failed' END, CASE WHEN aborted THEN 'aborted' END, CASE WHEN late THEN 'timeout' END, CASE WHEN m.bad > 0 THEN 'tool_error' END, CASE WHEN auth THEN 'auth_required' END], lambda x: x IS NOT NULL), ',') AS kinds,
 CASE WHEN m.n IS NULL AND r.n IS NULL THEN 'unobserved' WHEN failed OR aborted THEN 'hard_fail' WHEN late OR auth OR m.bad > 0 THEN 'degraded' ELSE 'clean' END AS level
FROM customer LEFT JOIN m ON m.turn = c_custkey LEFT JOIN r ON r.turn = c_custkey LEFT JOIN c ON c.turn = c_custkey""")
def turn_report(spark, d):
    """What events say of customers' turns: as messages, as runs, as calls."""
    e = t(spark, d, "events").selectExpr("user_id * 8 + event_id % 8 as turn", "event_id as ord", "event_type as k", "cast(floor(value) as bigint) as v")
    msgs = e.where("k in ('click', 'view')").selectExpr("turn", "ord", "if(ord % 3 > 0, concat(' ', k), '') as tool", "if(v % 5 = 0, 'it timed out', null) as result", "if(ord % 3 > 0, 'fine', 'error') as content")
    runs = e.where("k in ('purchase', 'error')").selectExpr("turn", "ord", "if(v % 7 = 0, 'failed', 'done') as status", "case v % 11 when 3 then 'user canceled' when 5 then 'TIMEOUT' when 7 then '请先登录' else '' end as error", "v as duration_ms")
    calls = e.selectExpr("turn", "ord", "if(k = 'signup', null, k) as purpose", "if(v % 13 = 1, 'stopped', 'ok') as status", "2 * v as input_tokens", "v as output_tokens", "3 * v as total_tokens")
    r = T.turn_report(t(spark, d, "customer").selectExpr("c_custkey as turn"), msgs, runs, calls, "turn")
    count = lambda m, k: F.coalesce(F.col(m)[k], F.lit(0).cast("long"))
    joined = lambda c, by: F.array_join(c, by).alias(c)
    return r.select("turn", "tool_ok", "tool_fail", count("tool_counts", "click").alias("clicks"), joined("tool_errors", ";"), "duration_ms", "run_status", "run_error", "input_tokens", "output_tokens", "total_tokens", count("tokens_by_purpose", "unknown").alias("unknown_tokens"), F.size("failed_call_purposes").cast("long").alias("stopped"), joined("kinds", ","), "level")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 300) THEN 'hard_fail' WHEN bool_or(event_type = 'error' AND value > 200) THEN 'degraded' ELSE 'clean' END AS level
          FROM events GROUP BY 1""")
def run_levels(spark, d):
    e = t(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    status = F.when(F.col("bad") & (F.col("value") > 300), "failed").otherwise("done")
    error = F.when(F.col("bad") & (F.col("value") > 200), "the call timed out")
    return e.groupBy("user_id").agg(F.collect_set(status).alias("s"), F.collect_set(error).alias("x")).select("user_id", T.run_level(F.col("s"), F.col("x")).alias("level"))


_STRATUM = "CASE WHEN event_type = 'error' AND value > 100 THEN 'neg_feedback' WHEN event_type = 'error' THEN 'software_fail' WHEN event_type = 'purchase' THEN 'pos_feedback' ELSE 'ordinary' END"


@query(f"""WITH c AS (SELECT event_id, {_STRATUM} AS stratum, list_position(['neg_feedback','software_fail','correction','pos_feedback','degraded','ordinary'], {_STRATUM}) AS s FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY event_id) AS r FROM c)
SELECT event_id, stratum FROM r ORDER BY r, s LIMIT 50""")
def stratified_cases(spark, d):
    e = t(spark, d, "events").select("event_id", F.expr(_STRATUM).alias("stratum"))
    return T.stratified_sample(e, "event_id", "stratum", "event_id", 50).select("event_id", "stratum")


@query("""SELECT event_id, props FROM events WHERE props NOT IN (SELECT props FROM events WHERE event_type = 'purchase' AND value > 100)
          QUALIFY row_number() OVER (PARTITION BY props ORDER BY event_id) = 1 ORDER BY event_id LIMIT 20""")
def claim_wave(spark, d):
    e = t(spark, d, "events")
    return T.claim_wave(e, e.where("event_type = 'purchase' and value > 100").select("props").distinct(), "props", "event_id", 20).select("event_id", "props")


@query("""WITH b AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS r FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, l_partkey) AS rn FROM b)
SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY rn) FILTER (rn <= 3), ',') AS paths, greatest(count(*) - 3, 0) AS omitted FROM k GROUP BY 1""")
def top_attachments(spark, d):
    out = T.top_attachments(t(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber", 3)
    return out.select("l_orderkey", F.array_join(F.col("paths").cast("array<string>"), ",").alias("paths"), "omitted")


@query("SELECT md5(text) AS digest, count(*) AS copies, count(*) - 1 AS extra FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    return T.duplicate_content(t(spark, d, "documents").select(F.md5("text").alias("digest")), "digest")


@query("""WITH a AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')),
r AS (SELECT o_custkey AS c_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM orders)
SELECT c_custkey, o_orderkey, 0 AS ordinal, 'user' AS role, o_orderpriority AS content FROM a JOIN r USING (c_custkey)
UNION ALL SELECT c_custkey, o_orderkey, 1, 'assistant', o_orderstatus FROM a JOIN r USING (c_custkey)""")
def usage_only_cases(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return T.usage_only_cases(t(spark, d, "customer").select("c_custkey"), o.where("o_orderstatus = 'F'").select("c_custkey"), o, "c_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")


@query("""SELECT conv_id, turn, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) || chr(10) || substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 2000) || chr(10) || '{}') AS fingerprint FROM conversations""")
def turn_fingerprints(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", C.turn_fingerprint(F.col("text"), F.col("text"), F.lit("{}")).alias("fingerprint"))


@query("""SELECT conv_id, turn, CAST(ceil(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 3.0 + (strlen(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / 2.0) AS BIGINT) AS tokens FROM conversations""")
def token_estimates(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", C.estimate_tokens(F.col("text")).alias("tokens"))


@query("""SELECT 'c' || substr(sha256(c_custkey::VARCHAR || '|' || c_name), 1, 24) AS id, c_custkey FROM customer""")
def content_ids(spark, d):
    return t(spark, d, "customer").select(C.content_id("c", F.col("c_custkey"), F.col("c_name")).alias("id"), "c_custkey")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'unverified' END AS label FROM events""")
def label_statuses(spark, d):
    vote, outcome = F.when(F.col("event_type") == "error", "down").when(F.col("event_type") == "purchase", "up"), F.when(F.col("event_type") == "error", "success")
    return t(spark, d, "events").select("event_id", C.label_status(vote, outcome).alias("label"))


@query("""WITH w AS (SELECT c_custkey, sha256(c_name) AS h FROM customer)
SELECT c_custkey, round(('0x' || substr(h, 1, 8))::BIGINT / 4294967295.0::DOUBLE * 2000 - 1000, 6) AS x FROM w""")
def hash_positions(spark, d):
    return t(spark, d, "customer").select("c_custkey", C.hash_position(F.col("c_name"))[0].alias("x"))


@query()
def normalised_texts(spark, d):
    """NFKC has no SQL twin in the oracle; tests compare it with unicodedata."""
    return t(spark, d, "conversations").select("conv_id", "turn", C.nfkc(F.col("text")).alias("nfkc"))


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]{2,}'))), ' ') AS terms FROM conversations""")
def query_terms(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(C.query_terms(F.col("text"))), " ").alias("terms"))


@query("""WITH r AS (SELECT 1 AS rank, doc_id AS id, source AS name, n_chars AS place FROM documents WHERE contains(lower(source), '7')
UNION ALL SELECT 2, conv_id, text, turn FROM conversations WHERE contains(lower(text), 'ing the') UNION ALL SELECT 3, page_id, url, length(html) FROM pages WHERE contains(lower(url), '77'))
SELECT rank, id, place FROM r ORDER BY rank, place DESC, id LIMIT 100""")
def global_search(spark, d):
    docs = t(spark, d, "documents").where(F.lower("source").contains("7")).select(F.lit(1).alias("rank"), F.col("doc_id").alias("id"), F.col("n_chars").cast("long").alias("place"))
    conv = t(spark, d, "conversations").where(F.lower("text").contains("ing the")).select(F.lit(2).alias("rank"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("place"))
    page = t(spark, d, "pages").where(F.lower("url").contains("77")).select(F.lit(3).alias("rank"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("place"))
    return docs.unionByName(conv).unionByName(page).orderBy("rank", F.desc("place"), "id").limit(100)


# stored: all messages but every fifth turn, some of them deleted; the sync brings the conversations of even number as they
# are in the table, but for assistants' turns beyond the sixth, and the first turn twice
@query("""WITH i AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 2 = 0 AND NOT (role = 'assistant' AND turn > 6)),
c AS (SELECT conv_id, turn, role, 'old ' || coalesce(text, '') AS text, turn % 4 = 3 AS is_deleted FROM conversations WHERE turn % 5 <> 4)
SELECT coalesce(i.conv_id, c.conv_id) AS conv_id, coalesce(i.turn, c.turn) AS turn, coalesce(i.role, c.role) AS role, md5(CASE WHEN i.conv_id IS NULL THEN c.text ELSE coalesce(i.text, '') END) AS digest,
 CASE WHEN i.conv_id IS NOT NULL THEN FALSE WHEN c.conv_id IN (SELECT conv_id FROM i) THEN TRUE ELSE c.is_deleted END AS is_deleted
FROM c FULL JOIN i ON c.conv_id = i.conv_id AND c.turn = i.turn""")
def synced_messages(spark, d):
    m = t(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    stored = m.where("turn % 5 <> 4").withColumn("text", F.concat(F.lit("old "), "text")).withColumn("at", F.lit(0)).withColumn("is_deleted", F.expr("turn % 4 = 3"))
    new = m.where("conv_id % 2 = 0 and not (role = 'assistant' and turn > 6)").withColumn("at", F.lit(2))
    new = new.unionByName(new.where("turn = 0").withColumn("text", F.lit("earlier")).withColumn("at", F.lit(1)))
    out = T.sync_messages(stored, new, ["conv_id", "turn"], "at", ["role", "text", "at"])
    return out.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "is_deleted")
