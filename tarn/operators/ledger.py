"""Model usage and credit ledger: prices, grants, burn, percentiles. Money is whole micro-credits (longs)."""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_counter
from .graph import checkpointed

MICRO = 1_000_000
#: Provider prices per million tokens (uncached, cached, written, output), credit price, markup.
PRICES = {"flagship": (12.0, 1.5, 15.0, 36.0)}
CREDIT_PRICE, MARKUP = 0.008, 10 / 9
INPUT_EDGES = [20_000, 40_000, 60_000, 100_000, 150_000, 250_000]
RUNWAY_FLOOR = 10


def rate(price: float, markup: float = MARKUP) -> int:
    """Micro-credits of one token, rounded once; at least 1 for a price above 0."""
    return max(1, round(price * markup / CREDIT_PRICE)) if price > 0 else 0


def normalize_usage(payload: str) -> dict[str, Column]:
    """Token counters of a usage payload (JSON text), whatever names the gateway used; a total of 0 is in plus out."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(payload, f"$.{p}") for p in paths])
    out = {
        "input_tokens": safe_counter(get("prompt_tokens", "input_tokens", "input")),
        "output_tokens": safe_counter(get("completion_tokens", "output_tokens", "output")),
        "cache_read_tokens": safe_counter(get("prompt_tokens_details.cached_tokens", "cache_read_tokens", "cache_read")),
        "cache_write_tokens": safe_counter(get("prompt_tokens_details.cache_write_tokens", "cache_write_tokens", "cache_write")),
        "reasoning_tokens": safe_counter(get("completion_tokens_details.reasoning_tokens", "reasoning_tokens")),
    }
    total = safe_counter(get("total_tokens", "total"))
    return out | {"total_tokens": F.when(total == 0, out["input_tokens"] + out["output_tokens"]).otherwise(total)}


def priced(calls: DataFrame, model: str | None = None, prices: dict[str, tuple] | None = None, markup: float = MARKUP) -> DataFrame:
    """``calls`` (input_tokens, output_tokens, cache_read_tokens, cache_write_tokens) with the billable parts,
    micro_credits and credits. Cached tokens are part of the input, written ones of the rest; an unknown model costs
    as much as the first one of ``prices``."""
    prices = PRICES if prices is None else prices
    rates = {m: tuple(rate(p, markup) for p in ps) for m, ps in prices.items()}
    first = next(iter(rates.values()))
    pick = lambda i: F.coalesce(F.create_map(*[F.lit(x) for m, r in rates.items() for x in (m, r[i])])[F.col(model)], F.lit(first[i])) if model else F.lit(first[i])
    prompt, cached = safe_counter(F.col("input_tokens")), F.least(safe_counter(F.col("cache_read_tokens")), safe_counter(F.col("input_tokens")))
    written = F.least(safe_counter(F.col("cache_write_tokens")), prompt - cached)
    out = calls.withColumn("cached_input", cached).withColumn("cache_write", written)
    out = out.withColumn("uncached_input", F.greatest(prompt - cached - written, F.lit(0))).withColumn("output", safe_counter(F.col("output_tokens")))
    micro = F.col("uncached_input") * pick(0) + F.col("cached_input") * pick(1) + F.col("cache_write") * pick(2) + F.col("output") * pick(3)
    return out.withColumn("micro_credits", micro).withColumn("credits", whole_credits(F.col("micro_credits")))


def whole_credits(micro: Column) -> Column:
    """Ceiling in exact integer arithmetic."""
    return F.floor((micro + (MICRO - 1) - F.pmod(micro + (MICRO - 1), F.lit(MICRO))) / MICRO).cast("long")


def nearest_rank(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per group the value at index round((n - 1) * share), half to even, of the ascending order. Equal values are
    counted before they are ordered, so a large group is as many rows as it has values."""
    df = checkpointed(df.select(*groups, value))  # what makes the value is computed, and compiled, apart from its counts
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    key = groups or ["_all"]
    counts = counts if groups else counts.withColumn("_all", F.lit(1))
    w = Window.partitionBy(*key)
    ranked = counts.withColumn("_to", F.sum("_n").over(w.orderBy(value))).withColumn("_total", F.sum("_n").over(w))
    at = lambda q: F.bround((F.col("_total") - 1) * F.lit(q), 0)
    hit = lambda q: F.max(F.when((F.col("_to") > at(q)) & (F.col("_to") - F.col("_n") <= at(q)), F.col(value))).alias(f"p{round(q * 100)}")
    return ranked.groupBy(*key).agg(*[hit(q) for q in shares]).drop("_all")


def draw_down(charges: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allocations, unbacked): charges (org, charge_id, at, credits), in the order of (at, charge_id), consume grants
    (org, grant_id, ends, credits), those that end first. Both sides become intervals of the organisation's cumulative
    credits; an allocation is an overlap (one sort of an organisation, no product of charges and grants). All grants are valid for all charges (else: :func:`draw_down_in_order`)."""
    # priced once, in a step of their own: inlined into the sums below, prices are too much code to compile
    charges = checkpointed(charges.select("org", "charge_id", "at", "credits"))
    c = charges.where("credits > 0").withColumn("hi", F.sum("credits").over(Window.partitionBy("org").orderBy("at", "charge_id"))).withColumn("lo", F.col("hi") - F.col("credits"))
    g = grants.where("credits > 0").withColumn("to", F.sum("credits").over(Window.partitionBy("org").orderBy(F.col("ends").asc_nulls_last(), "grant_id"))).withColumn("from", F.col("to") - F.col("credits"))
    # every end of an interval ends one stretch, which lies in the next charge and the next grant at or after it
    ends = c.select("org", F.col("hi").alias("v"), "charge_id", F.lit(None).cast(g.schema["grant_id"].dataType).alias("grant_id"))
    ends = ends.unionByName(g.select("org", F.col("to").alias("v"), F.lit(None).cast(c.schema["charge_id"].dataType).alias("charge_id"), "grant_id"))
    ends = ends.groupBy("org", "v").agg(F.max("charge_id").alias("charge_id"), F.max("grant_id").alias("grant_id"))
    down = Window.partitionBy("org").orderBy(F.desc("v"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda x: F.last(x, ignorenulls=True).over(upto).alias(x)
    size = F.col("v") - F.coalesce(F.lead("v").over(down), F.lit(0))
    allocations = ends.select("org", last("charge_id"), last("grant_id"), size.alias("credits")).where("charge_id is not null and grant_id is not null")
    backed = g.groupBy("org").agg(F.max("to").alias("all"))
    unbacked = c.join(backed, "org", "left").select("org", "charge_id", F.greatest(F.col("hi") - F.greatest("lo", F.coalesce("all", F.lit(0))), F.lit(0)).alias("unbacked"))
    return allocations, unbacked.where("unbacked > 0")


def draw_down_in_order(charges: DataFrame, grants: DataFrame) -> DataFrame:
    """The same with grants that start and end while charges run: (org, charge_id, grant_id or null, credits). The
    order inside an organisation is sequential, so each is one group; grants also have ``starts``. A charge looks only at
    grants that are live, the one that ends first on top of a heap."""

    def run(c: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        # grants wait by their start, then lie in a heap by their end; spent and ended ones leave it for good
        g = g.sort_values(["ends", "grant_id"], na_position="last")
        ends, ids, left = g["ends"].tolist(), g["grant_id"].tolist(), g["credits"].tolist()
        waiting = sorted(((s, i) for i, s in enumerate(g["starts"].tolist()) if not pd.isna(s) and left[i] > 0), reverse=True)
        live, rows = [], []
        c = c.sort_values(["at", "charge_id"])
        for org, charge, at, need in zip(c["org"].tolist(), c["charge_id"].tolist(), c["at"].tolist(), c["credits"].tolist(), strict=True):
            if not pd.isna(at):
                while waiting and waiting[-1][0] <= at:
                    heappush(live, waiting.pop()[1])
                while need > 0 and live:
                    i = live[0]
                    if left[i] <= 0 or not (pd.isna(ends[i]) or at < ends[i]):
                        heappop(live)
                        continue
                    part = min(need, left[i])
                    rows.append((org, charge, ids[i], part))
                    left[i] -= part
                    need -= part
            if need > 0:
                rows.append((org, charge, None, need))
        return pd.DataFrame(rows, columns=["org", "charge_id", "grant_id", "credits"]).astype({"grant_id": "Int64"})

    # organisations without grants need no group
    charges = checkpointed(charges.select("org", "charge_id", "at", "credits"))
    orgs = grants.select(F.col("org").alias("_org")).distinct()
    granted = F.col("org").eqNullSafe(F.col("_org"))
    out = charges.join(orgs, granted, "left_semi").groupBy("org").cogroup(grants.groupBy("org")).applyInPandas(run, "org long, charge_id long, grant_id long, credits long")
    none = charges.join(orgs, granted, "left_anti").where("credits > 0")
    return out.unionByName(none.select("org", "charge_id", F.lit(None).cast("long").alias("grant_id"), "credits"))


def org_usage(charges: DataFrame, grants: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Per organisation in the window: credits, calls, active_days, daily_burn, balance, runway_days (null under the
    floor of a balance or without burn). charges: org, at, credits; grants: org, credits, used, ends."""
    per_day = charges.where((F.col("at") < as_of) & (F.col("at") >= as_of - F.expr(f"interval {days} days"))).groupBy("org", F.to_date("at").alias("day")).agg(F.sum("credits").alias("credits"), F.count("*").alias("calls"))
    per = per_day.groupBy("org").agg(F.sum("credits").alias("credits"), F.sum("calls").alias("calls"), F.count("*").alias("active_days"))
    balance = grants.where(F.col("ends").isNull() | (F.col("ends") > as_of)).groupBy("org").agg(F.sum(F.greatest(F.col("credits") - F.col("used"), F.lit(0))).alias("balance"))
    burn = F.col("credits") / F.greatest(F.lit(1), F.least(F.lit(days), F.col("active_days")))
    out = per.join(balance, "org", "left").withColumn("balance", F.coalesce("balance", F.lit(0))).withColumn("daily_burn", F.round(burn, 6))
    return out.withColumn("runway_days", F.when((F.col("balance") >= RUNWAY_FLOOR) & (burn > 0), F.round(F.col("balance") / burn, 6)))


def usage_totals(calls: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def input_bucket(tokens: Column) -> Column:
    out, low = None, 0
    for edge in INPUT_EDGES:
        label = F.lit(f"{low // 1000}k-{edge // 1000}k")
        out = F.when(tokens < edge, label) if out is None else out.when(tokens < edge, label)
        low = edge
    return out.otherwise(f">{INPUT_EDGES[-1] // 1000}k")


def cache_report(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, input and cached tokens, whole percent cached, average input."""
    out = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("cache_read_tokens").alias("cached_tokens"))
    share = F.when(F.col("input_tokens") > 0, F.round(100.0 * F.col("cached_tokens") / F.col("input_tokens"), 4)).otherwise(0.0)
    return out.withColumn("cached_percent", share).withColumn("average_input", F.expr("input_tokens div calls"))


def period_of(at: Column, cutoff: Column) -> Column:
    """before or after (from the cutoff on); null without a time."""
    return F.when(at < cutoff, "before").when(at >= cutoff, "after")


def unbilled_calls(calls: DataFrame, charges: DataFrame, key: str) -> DataFrame:
    """Finished calls without a charge."""
    return calls.join(charges.select(key).distinct(), key, "left_anti")


def quota_summary(grants: DataFrame, as_of: Column, tiers: list[str]) -> DataFrame:
    """Per organisation: remaining, total, the soonest end of a grant that still holds credits, the best tier."""
    live = grants.where(F.col("ends").isNull() | (F.col("ends") > as_of))
    left = F.greatest(F.col("credits") - F.col("used"), F.lit(0))
    rank = F.array_position(F.array(*[F.lit(x) for x in tiers]), F.col("tier"))
    out = live.groupBy("org").agg(F.sum(left).alias("remaining"), F.sum("credits").alias("total"), F.min(F.when(left > 0, F.col("ends"))).alias("next_end"), F.min(F.struct(F.when(rank > 0, rank).otherwise(len(tiers) + 1).alias("r"), "tier")).alias("b"))
    return out.withColumn("tier", F.when(F.col("b.r") <= len(tiers), F.col("b.tier")).otherwise("free")).drop("b")


def run_scenarios(calls: DataFrame, runs: list[str], value: str, flag: Column) -> DataFrame:
    """Per run: credits, calls, whether any call has the flag, and the scenario: of one call, with the flag, or else."""
    per = calls.groupBy(*runs).agg(F.sum(value).alias("credits"), F.max(flag.cast("int")).alias("flagged"), F.count("*").alias("calls"))
    kind = F.when(F.col("calls") == 1, "single_turn").when(F.col("flagged") == 1, "takeoff").otherwise("analysis")
    return per.withColumn("scenario", kind)


def nearest_to_median(runs: DataFrame, groups: list[str], value: str, ident: str) -> DataFrame:
    """Per group the row nearest to the nearest-rank median; ties: the smaller id."""
    middle = nearest_rank(runs, groups, value, [0.5])
    return runs.join(middle, groups).withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(F.abs(F.col(value) - F.col("p50")), ident))).where("_rn = 1").drop("_rn")


def ledger_integrity(charges: DataFrame, current: str) -> DataFrame:
    """One row: charges, stale pricing versions, charges whose repricing differs, totals, ready."""
    again = whole_credits(F.col("micro_credits"))
    out = charges.agg(F.count("*").alias("charges"), F.count_if(F.col("pricing_version") != current).alias("stale"), F.count_if(again != F.col("credits")).alias("mismatched"), F.coalesce(F.sum("credits"), F.lit(0)).alias("credits"))
    return out.withColumn("ready", (F.col("stale") == 0) & (F.col("mismatched") == 0))


def budget_pick(rows: DataFrame, request: str, group: str, score: str, tokens: str, ident: str, budget: int) -> DataFrame:
    """Per request: all rows if they fit the budget; else the best row of each group, then the others by score, each
    while it still fits (one that does not is passed over). Ties: the smaller id. Sequential inside a request."""
    total = F.sum(tokens).over(Window.partitionBy(request))
    first = F.row_number().over(Window.partitionBy(request, group).orderBy(F.desc(score), ident)) == 1
    marked = rows.select(request, group, score, tokens, ident, total.alias("_total"), first.alias("_first"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["_first", score, ident], ascending=[False, False, True])
        left, keep = budget, []
        for size in f[tokens]:
            fits = size <= left
            keep.append(fits)
            left -= size if fits else 0
        return f[keep][[request, ident]]

    kinds = dict(rows.dtypes)
    schema = f"`{request}` {kinds[request]}, `{ident}` {kinds[ident]}"
    small = marked.where(F.col("_total") <= budget).select(request, ident)
    return small.unionByName(marked.where(F.col("_total") > budget).groupBy(request).applyInPandas(run, schema))


def credit_report(charges: DataFrame, run: str, purpose: str) -> DataFrame:
    """scope ("run" or "purpose"), key (the purpose; empty for runs), n, mean, p50, p90, p99, max: credits of whole runs,
    and of single calls by purpose (null: empty). charges: as :func:`priced` returns them."""
    calls = charges.select(F.lit("purpose").alias("scope"), F.coalesce(F.col(purpose).cast("string"), F.lit("")).alias("key"), "credits")
    runs = charges.groupBy(run).agg(F.sum("credits").alias("credits")).select(F.lit("run").alias("scope"), F.lit("").alias("key"), "credits")
    rows = calls.unionByName(runs)
    sums = rows.groupBy("scope", "key").agg(F.count("credits").alias("n"), F.round(F.avg("credits"), 4).alias("mean"), F.max("credits").alias("max"))
    return sums.join(nearest_rank(rows, ["scope", "key"], "credits", [0.5, 0.9, 0.99]), ["scope", "key"])


def window_economics(charges: DataFrame, markup: float = MARKUP) -> DataFrame:
    """One row: credits burned, their retail value (revenue), what the provider took, and the margin in per cent of the
    revenue (null without any)."""
    sums = charges.agg(F.coalesce(F.sum("credits"), F.lit(0)).alias("credits"), F.coalesce(F.sum("micro_credits"), F.lit(0)).alias("micro"))
    out = sums.withColumn("revenue", F.col("credits") * F.lit(CREDIT_PRICE)).withColumn("provider_cost", F.col("micro") / F.lit(float(MICRO)) * F.lit(CREDIT_PRICE) / F.lit(markup))
    margin = F.when(F.col("revenue") > 0, (F.col("revenue") - F.col("provider_cost")) / F.col("revenue") * 100)
    return out.select("credits", F.round("revenue", 6).alias("revenue"), F.round("provider_cost", 6).alias("provider_cost"), F.round(margin, 4).alias("margin"))
