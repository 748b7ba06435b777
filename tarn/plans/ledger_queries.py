"""Queries over usage calls, charges and grants, which events and orders stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from .registry import query, t

# one call per event: the payload uses one of three gateways' names
_PAYLOAD = """CASE event_id % 3 WHEN 0 THEN '{"prompt_tokens": ' || CAST(p AS VARCHAR) || ', "completion_tokens": ' || CAST(o AS VARCHAR) || ', "prompt_tokens_details": {"cached_tokens": ' || CAST(c AS VARCHAR) || '}}'
 WHEN 1 THEN '{"input_tokens": ' || CAST(p AS VARCHAR) || ', "output_tokens": ' || CAST(o AS VARCHAR) || ', "cache_read_tokens": ' || CAST(c AS VARCHAR) || ', "total_tokens": 5}'
 ELSE '{"input": ' || CAST(p AS VARCHAR) || ', "output": -3, "cache_write": ' || CAST(c AS VARCHAR) || '}' END"""


def _events(spark, d):
    e = t(spark, d, "events")
    return e.withColumn("p", F.round(F.col("value") * 700).cast("long")).withColumn("o", (F.col("event_id") % 900).cast("long")).withColumn("c", (F.col("event_id") % 50 * 1000).cast("long"))


def _calls(spark, d):
    e = _events(spark, d).withColumn("payload", F.expr(_PAYLOAD.replace("VARCHAR", "STRING")))
    return e.select("event_id", "user_id", "event_type", "ts", *[v.alias(k) for k, v in L.normalize_usage("payload").items()])


_CALLS = """
e AS (SELECT *, CAST(round(value * 700) AS BIGINT) AS p, CAST(event_id % 900 AS BIGINT) AS o, CAST(event_id % 50 * 1000 AS BIGINT) AS c FROM events),
calls AS (SELECT event_id, user_id, event_type, ts, p AS input_tokens, CASE WHEN event_id % 3 = 2 THEN 0 ELSE o END AS output_tokens,
  CASE WHEN event_id % 3 = 2 THEN 0 ELSE c END AS cache_read_tokens, CASE WHEN event_id % 3 = 2 THEN c ELSE 0 END AS cache_write_tokens, CAST(0 AS BIGINT) AS reasoning_tokens,
  CASE event_id % 3 WHEN 0 THEN p + o WHEN 1 THEN 5 ELSE p END AS total_tokens FROM e)
"""
_PRICED = _CALLS + """,
s AS (SELECT *, least(cache_read_tokens, input_tokens) AS cached_input FROM calls),
s2 AS (SELECT *, least(cache_write_tokens, input_tokens - cached_input) AS cache_write FROM s),
s3 AS (SELECT *, greatest(input_tokens - cached_input - cache_write, 0) AS uncached_input FROM s2),
priced AS (SELECT *, uncached_input * 1667 + cached_input * 208 + cache_write * 2083 + output_tokens * 5000 AS micro_credits FROM s3),
charges AS (SELECT *, (micro_credits + 999999) // 1000000 AS credits FROM priced)
"""


def _charges(spark, d):
    return L.priced(_calls(spark, d))


@query(f"WITH {_CALLS} SELECT * FROM calls")
def usage_counters(spark, d):
    return _calls(spark, d)


@query(f"WITH {_PRICED} SELECT event_id, cached_input, cache_write, uncached_input, micro_credits, credits FROM charges")
def priced_calls(spark, d):
    return _charges(spark, d).select("event_id", "cached_input", "cache_write", "uncached_input", "micro_credits", "credits")


@query(f"WITH {_CALLS} SELECT user_id, event_type, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM calls GROUP BY 1, 2")
def usage_breakdown(spark, d):
    return L.usage_totals(_calls(spark, d), ["user_id", "event_type"], ["input_tokens", "total_tokens"])


@query(f"""WITH {_CALLS}, b AS (SELECT *, CASE WHEN input_tokens < 20000 THEN '0k-20k' WHEN input_tokens < 40000 THEN '20k-40k' WHEN input_tokens < 60000 THEN '40k-60k' WHEN input_tokens < 100000 THEN '60k-100k'
  WHEN input_tokens < 150000 THEN '100k-150k' WHEN input_tokens < 250000 THEN '150k-250k' ELSE '>250k' END AS bucket FROM calls),
g AS (SELECT event_type, bucket, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cached_tokens FROM b GROUP BY 1, 2)
SELECT *, CASE WHEN input_tokens > 0 THEN round(100.0::DOUBLE * cached_tokens / input_tokens, 4) ELSE 0.0::DOUBLE END AS cached_percent, input_tokens // calls AS average_input FROM g""")
def cache_hits(spark, d):
    return L.cache_report(_calls(spark, d).withColumn("bucket", L.input_bucket(F.col("input_tokens"))), ["event_type", "bucket"])


@query(f"""WITH {_PRICED}, r AS (SELECT event_type, credits, row_number() OVER (PARTITION BY event_type ORDER BY credits) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM charges)
SELECT event_type, max(credits) FILTER (i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS p50, max(credits) FILTER (i = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)) AS p90, max(credits) FILTER (i = CAST(round_even((n - 1) * 0.99, 0) AS BIGINT)) AS p99 FROM r GROUP BY 1""")
def credit_percentiles(spark, d):
    return L.nearest_rank(_charges(spark, d), ["event_type"], "credits", [0.5, 0.9, 0.99])


_GRANTS = """
ch AS (SELECT user_id AS org, event_id AS charge_id, ts AS moment, credits FROM charges),
gr AS (SELECT o_custkey % 150 AS org, o_orderkey AS grant_id, o_orderdate AS ends, CAST(o_totalprice / 100 AS BIGINT) AS credits FROM orders)
"""


def _ledger(spark, d):
    c = _charges(spark, d).select(F.col("user_id").alias("org"), F.col("event_id").alias("charge_id"), F.col("ts").alias("at"), "credits")
    o = t(spark, d, "orders")
    return c, o.select((F.col("o_custkey") % 150).alias("org"), F.col("o_orderkey").alias("grant_id"), F.col("o_orderdate").alias("ends"), F.rint(F.col("o_totalprice") / 100).cast("long").alias("credits"))


_INTERVALS = f"""{_PRICED}, {_GRANTS},
c AS (SELECT *, sum(credits) OVER (PARTITION BY org ORDER BY moment, charge_id) AS hi, sum(credits) OVER (PARTITION BY org ORDER BY moment, charge_id) - credits AS lo FROM ch WHERE credits > 0),
g AS (SELECT org, grant_id, sum(credits) OVER (PARTITION BY org ORDER BY ends NULLS LAST, grant_id) AS t, sum(credits) OVER (PARTITION BY org ORDER BY ends NULLS LAST, grant_id) - credits AS f FROM gr WHERE credits > 0)"""


@query(f"WITH {_INTERVALS} SELECT c.org, charge_id, grant_id, CAST(least(hi, t) - greatest(lo, f) AS BIGINT) AS credits FROM c JOIN g ON c.org = g.org AND lo < t AND f < hi")
def grant_allocations(spark, d):
    return L.draw_down(*_ledger(spark, d))[0]


@query(f"WITH {_INTERVALS}, a AS (SELECT org, max(t) AS al FROM g GROUP BY 1), u AS (SELECT c.org, charge_id, CAST(greatest(hi - greatest(lo, coalesce(al, 0)), 0) AS BIGINT) AS unbacked FROM c LEFT JOIN a ON c.org = a.org) SELECT * FROM u WHERE unbacked > 0")
def unbacked_charges(spark, d):
    return L.draw_down(*_ledger(spark, d))[1]


@query()
def grant_allocations_in_order(spark, d):
    """Grants that start and end mid-stream; sequential per organisation, compared with plain Python in tests."""
    c, g = _ledger(spark, d)
    starts = F.timestamp_seconds(F.lit(1704067200) + F.col("grant_id") % 20 * 86400)
    return L.draw_down_in_order(c, g.withColumn("starts", starts).withColumn("ends", F.col("starts") + F.expr("interval 9 days")))


@query(f"""WITH {_PRICED}, {_GRANTS},
pd AS (SELECT org, CAST(moment AS DATE) AS day, sum(credits) AS credits, count(*) AS calls FROM ch WHERE moment < TIMESTAMP '2024-01-25' AND moment >= TIMESTAMP '2024-01-25' - INTERVAL 14 DAY GROUP BY 1, 2),
p AS (SELECT org, CAST(sum(credits) AS BIGINT) AS credits, CAST(sum(calls) AS BIGINT) AS calls, count(*) AS active_days FROM pd GROUP BY 1),
b AS (SELECT org, CAST(sum(greatest(credits - grant_id % 1000, 0)) AS BIGINT) AS balance FROM gr WHERE ends > TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT p.org, p.credits, calls, active_days, coalesce(balance, 0) AS balance, round(p.credits / greatest(1, least(14, active_days)), 6) AS daily_burn,
 CASE WHEN coalesce(balance, 0) >= 10 AND p.credits > 0 THEN round(coalesce(balance, 0) / (p.credits / greatest(1, least(14, active_days))), 6) END AS runway_days
FROM p LEFT JOIN b ON p.org = b.org""")
def org_usage(spark, d):
    c, g = _ledger(spark, d)
    g = g.withColumn("used", F.col("grant_id") % 1000).where("ends > timestamp '1998-01-01'").withColumn("ends", F.lit(None).cast("timestamp"))
    return L.org_usage(c, g, F.expr("timestamp '2024-01-25'"), 14)


@query(f"WITH {_PRICED} SELECT user_id, CAST(sum(credits) AS BIGINT) AS credits FROM charges GROUP BY 1 ORDER BY credits DESC, user_id LIMIT 10")
def top_consumers(spark, d):
    return _charges(spark, d).groupBy("user_id").agg(F.sum("credits").alias("credits")).orderBy(F.desc("credits"), "user_id").limit(10)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unbilled_calls(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.unbilled_calls(t(spark, d, "orders"), lines, "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"""WITH {_PRICED}, {_GRANTS}, q AS (SELECT org, greatest(credits - grant_id % 3000, 0) AS l, credits, ends, CASE grant_id % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'team' ELSE 'other' END AS tier FROM gr WHERE ends > TIMESTAMP '1998-01-01')
SELECT org, CAST(sum(l) AS BIGINT) AS remaining, CAST(sum(credits) AS BIGINT) AS total, min(ends) FILTER (l > 0) AS next_end, CASE WHEN bool_or(tier = 'team') THEN 'team' WHEN bool_or(tier = 'pro') THEN 'pro' ELSE 'free' END AS tier FROM q GROUP BY 1""")
def quota_summary(spark, d):
    g = _ledger(spark, d)[1].withColumn("used", F.col("grant_id") % 3000).withColumn("tier", F.when(F.col("grant_id") % 3 == 0, "pro").when(F.col("grant_id") % 3 == 1, "team").otherwise("other"))
    return L.quota_summary(g, F.expr("timestamp '1998-01-01'"), ["team", "pro"])


@query(f"""WITH {_PRICED}, p AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(credits) AS BIGINT) AS credits, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS flagged, count(*) AS calls FROM charges GROUP BY 1, 2)
SELECT *, CASE WHEN calls = 1 THEN 'single_turn' WHEN flagged = 1 THEN 'takeoff' ELSE 'analysis' END AS scenario FROM p""")
def run_scenarios(spark, d):
    return L.run_scenarios(_charges(spark, d).withColumn("day", F.to_date("ts")), ["user_id", "day"], "credits", F.col("event_type") == "error")


@query(f"""WITH {_PRICED}, m AS (SELECT event_type, credits, event_id, row_number() OVER (PARTITION BY event_type ORDER BY credits) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM charges),
p AS (SELECT event_type, max(credits) FILTER (i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS p50 FROM m GROUP BY 1)
SELECT event_type, event_id, credits, p50 FROM charges JOIN p USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY abs(credits - p50), event_id) = 1""")
def typical_runs(spark, d):
    return L.nearest_to_median(_charges(spark, d).select("event_type", "event_id", "credits"), ["event_type"], "credits", "event_id")


@query(f"""WITH {_PRICED}, v AS (SELECT micro_credits, CASE WHEN event_id % 100 = 0 THEN credits + 1 ELSE credits END AS c, credits, event_id % 7 = 0 AS stale FROM charges)
SELECT count(*) AS charges, count(*) FILTER (stale) AS stale, count(*) FILTER (c <> credits) AS mismatched, CAST(sum(c) AS BIGINT) AS credits, count(*) FILTER (stale) = 0 AND count(*) FILTER (c <> credits) = 0 AS ready FROM v""")
def ledger_integrity(spark, d):
    c = _charges(spark, d).withColumn("credits", F.col("credits") + (F.col("event_id") % 100 == 0).cast("long")).withColumn("pricing_version", F.when(F.col("event_id") % 7 == 0, "v0").otherwise("v1"))
    return L.ledger_integrity(c, "v1")


@query()
def budget_pick(spark, d):
    """Greedy while it fits, sequential per request; compared with plain Python in tests."""
    e = _events(spark, d).select("user_id", "event_type", F.col("value").alias("score"), F.col("o").alias("tokens"), "event_id")
    return L.budget_pick(e, "user_id", "event_type", "score", "tokens", "event_id", 2000)


@query(f"""WITH {_PRICED}, v AS (SELECT 'purpose' AS scope, event_type AS key, credits FROM charges UNION ALL SELECT 'run', '', CAST(sum(credits) AS BIGINT) FROM charges GROUP BY user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY credits) - 1 AS i, count(*) OVER (PARTITION BY scope, key) AS m FROM v)
SELECT scope, key, count(*) AS n, round(avg(credits), 4) AS mean, max(credits) AS max, max(credits) FILTER (i = CAST(round_even((m - 1) * 0.5, 0) AS BIGINT)) AS p50,
 max(credits) FILTER (i = CAST(round_even((m - 1) * 0.9, 0) AS BIGINT)) AS p90, max(credits) FILTER (i = CAST(round_even((m - 1) * 0.99, 0) AS BIGINT)) AS p99 FROM r GROUP BY 1, 2""")
def credit_report(spark, d):
    return L.credit_report(_charges(spark, d), "user_id", "event_type")


@query(f"""WITH {_PRICED}, w AS (SELECT CAST(sum(credits) AS BIGINT) AS credits, CAST(sum(micro_credits) AS BIGINT) AS micro FROM charges),
m AS (SELECT credits, credits * 0.008::DOUBLE AS revenue, micro / 1000000.0::DOUBLE * 0.008::DOUBLE / (10.0::DOUBLE / 9) AS cost FROM w)
SELECT credits, round(revenue, 6) AS revenue, round(cost, 6) AS provider_cost, round((revenue - cost) / revenue * 100, 4) AS margin FROM m""")
def window_economics(spark, d):
    return L.window_economics(_charges(spark, d))


@query(f"""WITH {_CALLS}, g AS (SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-15 12:00:00' THEN 'before' ELSE 'after' END AS period, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(cache_read_tokens) AS BIGINT) AS cached_tokens FROM calls GROUP BY 1, 2)
SELECT *, CASE WHEN input_tokens > 0 THEN round(100.0::DOUBLE * cached_tokens / input_tokens, 4) ELSE 0.0::DOUBLE END AS cached_percent, input_tokens // calls AS average_input FROM g""")
def cache_hits_by_period(spark, d):
    period = L.period_of(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return L.cache_report(_calls(spark, d).withColumn("period", period), ["event_type", "period"])
