"""Archives and reviews: evidence, roll-ups, integrity, listings, numbered lists, quantities."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import one_by_one
from . import graph
from .turns import best_tier, latest_per_key, unique_only

#: Confidences of semantic relations (name alone, structured, documented, called).
CONFIDENCE = {"name": 0.3, "structured": 0.62, "documented": 0.55, "called": 0.75}
#: Spans of one row of equal ones in :func:`dimension_chains`, at most, about.
ALIKE = 500
#: Rows of a part of :func:`crossing_pairs`, about.
PART = 500_000


def valid_evidence(df: DataFrame, path: str, digest: str, window: list[str], counters: list[str], kinds: tuple[str, list[str]]) -> DataFrame:
    """Rows whose path is relative with an image suffix, whose digest is 64 hex digits, whose window (low, high, ...) is
    finite and in order, whose counters are not negative and whose kind is known."""
    ok = F.col(path).rlike(r"(?i)^(?!/)(?!.*\.\.).+\.(png|jpg|jpeg|webp)$") & F.col(digest).rlike("^[0-9a-f]{64}$") & F.col(kinds[0]).isin(kinds[1])
    for c in window:
        ok = ok & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    for low, high in zip(window[::2], window[1::2], strict=True):
        ok = ok & (F.col(low) < F.col(high))
    for c in counters:
        ok = ok & (F.col(c) >= 0)
    return df.where(F.coalesce(ok, F.lit(False)))


def recent_files(df: DataFrame, stamps: list[str], as_of: Column, days: int, status: tuple[str, str] | None = None, deleted: str | None = None) -> DataFrame:
    """Rows of which any stamp lies in the last ``days`` before ``as_of``; deleted ones go if a flag column is named."""
    hit = F.lit(False)
    for s in stamps:
        hit = hit | F.coalesce((F.col(s) >= as_of - F.expr(f"interval {days} days")) & (F.col(s) <= as_of), F.lit(False))
    out = df.where(hit)
    out = out.where(F.col(status[0]) == status[1]) if status else out
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def included_users(users: DataFrame, user: str, mail: str, domain: str, msgs: DataFrame, runs: DataFrame) -> DataFrame:
    """Users with messages or runs, but of the excluded mail domain: user, has_messages, has_runs, archive_gap."""
    m, r = msgs.select(user).distinct().withColumn("_m", F.lit(True)), runs.select(user).distinct().withColumn("_r", F.lit(True))
    out = users.where(~F.coalesce(F.lower(F.col(mail)).endswith("@" + domain), F.lit(False))).join(m, user, "left").join(r, user, "left")
    out = out.select(user, F.coalesce("_m", F.lit(False)).alias("has_messages"), F.coalesce("_r", F.lit(False)).alias("has_runs"))
    return out.where("has_messages or has_runs").withColumn("archive_gap", ~F.col("has_messages"))


def associate(evidence: DataFrame, ident: str, tiers: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(ident, turn_id, tier): the first tier in which a key of the evidence names one turn only. tiers: (evidence
    column, table with the key and turn_id, its key)."""
    found = None
    for n, (column, turns, key) in enumerate(tiers, 1):
        clear = unique_only(turns.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), "turn_id").distinct(), ["_k"])
        one = evidence.select(ident, F.col(column).alias("_k")).join(clear, "_k").select(ident, "turn_id", F.lit(n).alias("tier"))
        found = one if found is None else found.unionByName(one)
    return best_tier(found, [ident])


def turn_feedback(turns: DataFrame, feedback: DataFrame, turn: str, key: str, conversation: str, *order: Column) -> DataFrame:
    """Per turn the newest feedback with its key, of the same conversation where both are known.

    A key may have very many turns and feedbacks, so a turn meets three feedbacks at most: the newest of its key without
    a conversation, the newest in its own, and, if its own is unknown, the newest of all. ``order`` must be total."""
    f = feedback.withColumnRenamed(conversation, "_c")
    t = turns.select(turn, key, conversation)
    newest = latest_per_key(f, [key, "_c"], *order)  # a null conversation is a group of its own
    known = t.where(F.col(conversation).isNotNull())
    own = known.join(newest.withColumnRenamed("_c", conversation), [key, conversation]).drop(conversation)
    open_ = known.join(newest.where("_c is null").drop("_c"), key).drop(conversation)
    free = t.where(F.col(conversation).isNull()).join(latest_per_key(newest, [key], *order).drop("_c"), key).drop(conversation)
    return latest_per_key(own.unionByName(open_).unionByName(free), [turn], *order)


def rollup_counts(df: DataFrame, levels: list[str], verdict: str, known: list[str]) -> DataFrame:
    """Counts at each level of a roll-up (null: all below): every row in ``count``, known verdicts in their own column."""
    return df.rollup(*levels).agg(F.count("*").alias("count"), *[F.count_if(F.col(verdict) == v).alias(v) for v in known])


def locate_by_signature(seeds: DataFrame, instances: DataFrame, ident: str, signature: str) -> tuple[DataFrame, DataFrame]:
    """(instances that share a seed's signature, seeds without one)."""
    own = seeds.select(ident).join(instances.where(F.col(signature).isNotNull()).select(ident, signature), ident)
    hits = instances.join(own.select(signature).distinct(), signature, "left_semi")
    return hits.select(ident, signature), seeds.select(ident).join(own, ident, "left_anti")


def owner_rollup(df: DataFrame, owner: str, project: str, size: str, at: str) -> DataFrame:
    """Per owner: projects, files, bytes, latest, and the largest project (ties: the smaller name)."""
    per = df.groupBy(owner, project).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.max(at).alias("latest"))
    return per.groupBy(owner).agg(F.count("*").alias("projects"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.max("latest").alias("latest"), F.min(F.struct((-F.col("bytes")).alias("b"), F.col(project).alias("p")))["p"].alias("largest"))


def corpus_integrity(files: DataFrame, blobs: DataFrame, key: str, size: str) -> DataFrame:
    """One row: files, missing blobs, size mismatches, blobs that no file names."""
    b = blobs.select(F.col(key), F.col(size).alias("_s")).distinct()
    j = files.join(b, key, "left").agg(F.count("*").alias("files"), F.count_if(F.col("_s").isNull()).alias("missing"), F.count_if(F.col("_s") != F.col(size)).alias("mismatched"))
    return j.crossJoin(b.join(files.select(key), key, "left_anti").agg(F.count("*").alias("dangling")))  # single rows


def listing(parents: DataFrame, key: str, children: DataFrame, child_key: str, flagged: DataFrame) -> DataFrame:
    """Parents with their number of children and whether any is flagged."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("children"))
    f = flagged.select(F.col(child_key).alias(key)).distinct().withColumn("pending", F.lit(True))
    return parents.join(n, key, "left").join(f, key, "left").select(key, F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("pending", F.lit(False)).alias("pending"))


def pattern_list(patterns: DataFrame, observations: DataFrame, key: str, created: str, seen: str) -> DataFrame:
    """Patterns with their number of observations and when they were last seen (else made)."""
    o = observations.groupBy(key).agg(F.count("*").alias("observations"), F.max(seen).alias("_last"))
    return patterns.join(o, key, "left").select(key, F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("_last", created).alias("last_seen"))


def search_semantics(descriptions: DataFrame, links: DataFrame, query: str, text: str, description: str, pattern: str, k: int) -> DataFrame:
    """The ``k`` patterns with most linked descriptions that hold the text (any case); ties: the smaller pattern."""
    hits = descriptions.where(F.lower(F.col(text)).contains(query.lower())).select(description).distinct()
    return links.join(hits, description, "left_semi").groupBy(pattern).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), pattern).limit(k)


def extract_numbered(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, number, text): lines that start with a number and a dot or bracket; lines after one that do not start so
    are part of it. Lines before the first number go."""
    number = F.regexp_extract(text, r"^\s*(\d{1,4})\s*[.、)）]", 1)
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_n", F.when(number != "", number.cast("int"))).withColumn("_i", F.count("_n").over(w)).where("_i > 0")
    body = F.trim(F.regexp_replace(F.col(text), r"^\s*\d{1,4}\s*[.、)）]\s*", ""))
    body = F.when(F.col("_n").isNotNull(), body).otherwise(F.trim(F.col(text)))
    joined = marked.withColumn("_t", body).groupBy(group, "_i").agg(F.max("_n").alias("number"), F.array_sort(F.collect_list(F.struct(order, "_t"))).alias("parts"))
    return joined.select(group, "number", F.array_join(F.transform("parts", lambda p: p["_t"]), " ").alias("text"))


def normalize_quantity(text: Column, units: dict[str, float]) -> tuple[Column, Column]:
    """(value, status) of a literal with a unit: explicit with a known unit, drawing_unit without, else unresolved."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-zµ\"]*)\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-zµ\"]*)\s*$", 2))
    factor = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])[unit]
    amount = number.try_cast("decimal(38,10)").cast("double")
    status = F.when(amount.isNull(), "unresolved").when(unit == "", "drawing_unit").when(factor.isNull(), "unresolved").otherwise("explicit")
    return F.when(status != "unresolved", amount * F.coalesce(factor, F.lit(1.0))), status


def harvest_paths(column: Column, depth: int = 10) -> Column:
    """All texts under keys that end in "path", at any depth of a JSON text, JSON inside texts included; sorted."""

    def walk(x: object, level: int, key: str, out: set) -> None:
        if level > depth:
            return
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, level + 1, str(k), out)
        elif isinstance(x, list):
            for v in x:
                walk(v, level + 1, key, out)
        elif isinstance(x, str):
            if x[:1] in "{[" and x:
                try:
                    walk(json.loads(x), level + 1, key, out)
                    return
                except ValueError:
                    pass
            if key.lower().endswith("path"):
                out.add(x)

    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            rows = []
            for x in s:
                out: set = set()
                walk(x if x is not None else None, 0, "", out)
                rows.append(sorted(out))
            yield pd.Series(rows)

    return run(column)


def semantic_families(atoms: DataFrame, name: str, kind: str, families: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(matches, rejected): atoms whose kind and name fit a family (family, kind, pattern), with its confidence; names
    that fit but whose kind does not are rejected."""
    found = F.filter(F.array(*[F.when(F.col(name).rlike(p), F.struct(F.lit(f).alias("family"), (F.col(kind) == k).alias("ok"))) for f, k, p in families]), lambda x: x.isNotNull())
    rows = atoms.select("*", F.explode(found).alias("_f")).select("*", "_f.family", "_f.ok").drop("_f")
    return rows.where("ok").drop("ok").withColumn("confidence", F.lit(CONFIDENCE["structured"])), rows.where("not ok").drop("ok").withColumn("confidence", F.lit(CONFIDENCE["name"]))


def crossing_pairs(df: DataFrame, crossing: str, ident: str) -> DataFrame:
    """(a, b) of parts that share a crossing, in both directions. A crossing has two or a few parts.

    Crossings are dealt once, and pairs once in one direction, into parts whose number grows with the rows, so what a task
    holds does not."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART))
    # a number of partitions of one's own is not coalesced by the bytes read, which say nothing of the pairs
    held = df.where(F.col(crossing).isNotNull()).select(crossing, ident).repartition(parts, crossing).groupBy(crossing).agg(F.array_sort(F.collect_set(ident)).alias("p"))
    each = held.where(F.size("p") > 1).select("p", F.posexplode("p").alias("i", "a"))
    pairs = each.select("a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b")).repartition(parts, "a", "b").distinct()
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*")


def dimension_chains(spans: DataFrame, group: str, grid: float) -> DataFrame:
    """(group, a, b, relation) of spans with a common station: duplicate, continuous (one ends where the other starts),
    common_baseline (equal starts) or shared_datum (equal ends). spans: id, low, high; stations are quantised.

    The rows are all pairs, so their number grows with the square of the spans at a station. Spans of equal ends are one row
    of up to ALIKE ids, and such rows are joined, so what is shuffled does not; pairs are made as they are read. The rows are
    dealt over many tasks, a station with more than a task's share of the pairs in salted parts, so no task holds its pairs."""
    parts = 4 * int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = spans.select(group, "id", F.bround(F.col("low") / grid, 0).cast("long").alias("l"), F.bround(F.col("high") / grid, 0).cast("long").alias("h"))
    classes = graph.checkpointed(q.groupBy(F.col(group).alias("_g"), F.col("l").alias("_l"), F.col("h").alias("_h")).agg(F.count("*").alias("_n")))
    ends = classes.select("_g", F.explode(F.array_distinct(F.array("_l", "_h"))).alias("_at"), "_n").groupBy("_g", "_at").agg(F.sum("_n").cast("double").alias("_m"))
    whole = ends.agg(F.sum(F.col("_m") * F.col("_m"))).first()[0] or 1.0
    salts = graph.checkpointed(ends.select("_g", "_at", F.least(F.ceil(F.col("_m") * F.col("_m") * parts / whole), F.lit(parts)).cast("int").alias("salts")))
    for end in ("l", "h"):
        of = salts.select(F.col("_g").alias("_g2"), F.col("_at"), F.col("salts").alias(f"{end}_salts"))
        classes = classes.join(of, F.col("_g").eqNullSafe(F.col("_g2")) & F.col(f"_{end}").eqNullSafe(F.col("_at"))).drop("_g2", "_at")
    most = F.least("_n", F.greatest("l_salts", "h_salts", F.ceil(F.col("_n") / F.lit(ALIKE)))).cast("int")
    # nulls make a class of their own, which a join on the ends would lose
    same = q[group].eqNullSafe(F.col("_g")) & q["l"].eqNullSafe(F.col("_l")) & q["h"].eqNullSafe(F.col("_h"))
    cut = q.join(classes, same).withColumn("_part", F.pmod(F.xxhash64("id"), most))
    keys = [group, "l", "h", "l_salts", "h_salts", "_part"]
    alike = graph.checkpointed(cut.groupBy(*keys).agg(F.collect_list("id").alias("ids")).select(*keys, "ids"))
    side = lambda c, ids, *names: alike.select(F.col(group).alias(names[0]), F.col("ids").alias(ids), F.col("l").alias(names[1]), F.col("h").alias(names[2]), c.alias(names[3]))
    a = lambda end: side(F.pmod("_part", F.col(f"{end}_salts")).cast("int"), "as", group, "al", "ah", "_salt").repartition(parts, group, f"a{end}", "_salt")
    b = lambda end: side(F.explode(F.sequence(F.lit(0), F.col(f"{end}_salts") - 1)), "bs", "_g", "bl", "bh", "_s").repartition(parts, "_g", f"b{end}", "_s")

    def pairs(x: str, y: str, relation: Column, apart: Column) -> DataFrame:
        # a number of partitions of one's own is not coalesced by the bytes read, which say nothing of the pairs
        met = a(x).join(b(y), (F.col(group) == F.col("_g")) & (F.col(f"a{x}") == F.col(f"b{y}")) & (F.col("_salt") == F.col("_s")) & apart)
        each = met.select(group, F.explode(one_by_one("as")).alias("a"), "bs", relation.alias("relation"))
        return each.select(group, "a", F.explode("bs").alias("b"), "relation")

    chain = pairs("h", "l", F.lit("continuous"), F.lit(True)).where("a <> b")
    base = pairs("l", "l", F.when(F.col("ah") == F.col("bh"), "duplicate").otherwise("common_baseline"), F.lit(True)).where("a < b")
    datum = pairs("h", "h", F.lit("shared_datum"), F.col("al") != F.col("bl")).where("a < b")
    return chain.unionByName(base).unionByName(datum)


def _stations(spans: DataFrame, group: str, grid: float) -> DataFrame:
    at = lambda c: F.bround(F.col(c) / grid, 0).cast("long")
    return spans.select(F.col(group).alias("g"), "id", at("low").alias("l"), at("high").alias("h")).where("l is not null and h is not null")


def nested_spans(spans: DataFrame, group: str, grid: float) -> DataFrame:
    """(group, id, container): of each span that lies inside another of its group, sharing one end at most, the one that
    reaches furthest (ties: the smaller id). spans: id, low, high.

    A sweep over distinct spans: in the order of starts, the longest first, the furthest end so far. The order is cut into
    ranges, and a range starts with the furthest end of those before it, so a group of very many spans is many tasks, and
    no pairs of spans are formed.
    """
    q = graph.checkpointed(_stations(spans, group, grid))
    once = q.groupBy("g", "l", (-F.col("h")).alias("back")).agg(F.min("id").alias("first"))
    ranged = graph.checkpointed(once.repartitionByRange("g", "l", "back").withColumn("_range", F.spark_partition_id()))
    best, so_far = F.struct((-F.col("back")).alias("h"), (-F.col("first")).alias("less")), (Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_range", "g").agg(F.max(best).alias("top"))
    before = parts.select("_range", "g", F.max("top").over(Window.partitionBy("g").orderBy("_range").rowsBetween(*so_far)).alias("_before"))
    sweep = F.max(best).over(Window.partitionBy("_range", "g").orderBy("l", "back").rowsBetween(*so_far))
    found = ranged.withColumn("_here", sweep).join(before, ["_range", "g"]).select("g", "l", (-F.col("back")).alias("h"), F.greatest("_here", "_before").alias("top"))
    inside = found.where("top.h >= h").select("g", "l", "h", (-F.col("top.less")).alias("container"))
    return q.join(inside, ["g", "l", "h"]).select(F.col("g").alias(group), "id", "container")


def span_chains(spans: DataFrame, group: str, grid: float) -> DataFrame:
    """(id, chain): spans of a group of which one ends where another starts, over any number of steps, named by the
    smallest id; spans without a neighbour are left out. At a station each span is linked with the first of those that
    go on from it, so a station of n spans has n links, not pairs."""
    q = graph.checkpointed(_stations(spans, group, grid))
    starts = q.groupBy("g", F.col("l").alias("s")).agg(F.min("id").alias("to"))
    ends = q.groupBy("g", F.col("h").alias("s")).agg(F.min("id").alias("to"))
    links = q.withColumn("s", F.col("h")).join(starts, ["g", "s"]).select(F.col("id").alias("src"), F.col("to").alias("dst"))
    links = links.union(q.withColumn("s", F.col("l")).join(ends, ["g", "s"]).select("id", "to"))
    return graph.components(links).select(F.col("node").alias("id"), F.col("component").alias("chain"))


def chain_totals(spans: DataFrame, group: str, grid: float) -> DataFrame:
    """(chain, parts, low, high, parents): chains whose parts fill the length from end to end once, and how many spans
    beside the parts measure that length as a whole."""
    q = _stations(spans, group, grid)
    of = q.join(span_chains(spans, group, grid), "id")
    whole = of.groupBy("g", "chain").agg(F.count("*").alias("parts"), F.min("l").alias("low"), F.max("h").alias("high"), F.sum(F.col("h") - F.col("l")).alias("length")).where("length = high - low")
    same = q.join(of.select("id", F.col("chain").alias("own")), "id", "left").select("g", F.col("l").alias("low"), F.col("h").alias("high"), "own", F.lit(1).alias("one"))
    met = whole.join(same, ["g", "low", "high"], "left").where("own is null or own <> chain")
    counts = met.groupBy("g", "chain").agg(F.count("one").alias("parents"))
    return whole.join(counts, ["g", "chain"], "left").select("chain", "parts", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.coalesce("parents", F.lit(0)).alias("parents"))
