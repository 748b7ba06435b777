"""Counts with reasons, layers, sequences, profiles, identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cuts, graph, identity


def excluded_by(reasons: dict[str, Column]) -> Column:
    """The first reason whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(reasons.items()):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def audited_count(df: DataFrame, identity: str, reasons: dict[str, Column], order: str) -> DataFrame:
    """reason, rows: how many count (``counted``), how many go for each reason, and how many repeat an identity that
    counts already (``repeated``; the first by ``order`` counts)."""
    marked = df.withColumn("reason", excluded_by(reasons))
    once = F.row_number().over(Window.partitionBy(identity, F.col("reason").isNull()).orderBy(order))
    out = marked.withColumn("reason", F.coalesce("reason", F.when(once > 1, "repeated").otherwise("counted")))
    return out.groupBy("reason").agg(F.count("*").alias("rows"))


def count_by_basis(df: DataFrame, group: str, label: str) -> DataFrame:
    """Per group: rows, distinct labels (any case), share labelled, and whether the two counts disagree."""
    norm = F.lower(F.trim(F.col(label)))
    out = df.groupBy(group).agg(F.count("*").alias("occurrences"), F.countDistinct(norm).alias("labels"), F.count(F.col(label)).alias("_l"))
    return out.withColumn("label_coverage", F.when(F.col("occurrences") == 0, 1.0).otherwise(F.col("_l") / F.col("occurrences"))).withColumn("conflict", F.col("labels") != F.col("occurrences")).drop("_l")


def duplicate_labels(df: DataFrame, label: str, ident: str) -> DataFrame:
    """label, n, the smallest id; the ids stay rows of ``df`` (a label may have very many)."""
    return df.groupBy(F.lower(F.trim(F.col(label))).alias("label")).agg(F.count("*").alias("n"), F.min(ident).alias("first")).where("n > 1")


def check_threshold(value: Column, limit: float) -> Column:
    return F.when(value.isNull(), "insufficient").when(value >= limit, "pass").otherwise("fail")


def layer_usage(defs: DataFrame, entities: DataFrame, name: str, ident: str, n: int = 3) -> DataFrame:
    """Per layer (any case): defined, entities, the first ``n`` ids, and status used, unused or undefined."""
    key = F.lower(F.trim(F.col(name)))
    d = defs.groupBy(key.alias("layer")).agg(F.count("*").alias("definitions"))
    ranked = entities.withColumn("layer", key).withColumn("_rn", F.row_number().over(Window.partitionBy("layer").orderBy(ident)))
    e = ranked.groupBy("layer").agg(F.count("*").alias("entities"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= n, F.col(ident)))).alias("samples"))
    out = d.join(e, "layer", "full").withColumn("definitions", F.coalesce("definitions", F.lit(0))).withColumn("entities", F.coalesce("entities", F.lit(0)))
    return out.withColumn("status", F.when(F.col("definitions") == 0, "undefined").when(F.col("entities") == 0, "unused").otherwise("used"))


def sequence_audit(df: DataFrame, group: str, number: str) -> DataFrame:
    """Per group: low, high, numbers, duplicates, gaps (how many numbers are missing between low and high), starts_at_one,
    contiguous. Missing numbers themselves are listed by :func:`sequence_gaps`."""
    per = df.where(F.col(number).isNotNull()).groupBy(group, number).agg(F.count("*").alias("_n"))
    out = per.groupBy(group).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("numbers"), F.sum((F.col("_n") > 1).cast("int")).alias("duplicates"))
    gaps = F.col("high") - F.col("low") + 1 - F.col("numbers")
    return out.withColumn("gaps", gaps).withColumn("starts_at_one", F.col("low") == 1).withColumn("contiguous", F.col("gaps") == 0)


def sequence_gaps(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, first, last) of each run of missing numbers between a group's smallest and largest."""
    w = Window.partitionBy(group).orderBy(number)
    steps = df.where(F.col(number).isNotNull()).select(group, number).distinct().withColumn("_before", F.lag(number).over(w))
    return steps.where(F.col(number) - F.col("_before") > 1).select(group, (F.col("_before") + 1).alias("first"), (F.col(number) - 1).alias("last"))


def top_values(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Per group the ``n`` most frequent values, ties by value."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("_rn") <= n).drop("_rn")


def key_path_profile(df: DataFrame, json: str, unit: str, examples: int = 6) -> DataFrame:
    """Per top-level key of JSON objects: rows that have it, rows where it is empty, units that have it, the
    smallest examples."""
    each = df.select(unit, F.explode(F.from_json(F.col(json), "map<string,string>")).alias("path", "value"))
    empty = F.coalesce(F.trim("value").isin("", "null", "[]", "{}"), F.lit(True))
    values = each.where(~empty).groupBy("path", "value").agg(F.count("*").alias("_n"))
    some = values.withColumn("_rn", F.row_number().over(Window.partitionBy("path").orderBy("value"))).where(F.col("_rn") <= examples).groupBy("path").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return each.groupBy("path").agg(F.count("*").alias("seen"), F.count_if(empty).alias("empty"), F.countDistinct(unit).alias("units")).join(some, "path", "left")


def json_paths(df: DataFrame, json: str, unit: str, max_depth: int = 10) -> DataFrame:
    """(unit, path, kind, text) of everything inside JSON texts, down to ``max_depth``: "a.b" is a key of an object in a,
    "a[]" an element of an array. kind: object, array, null or scalar; text: the value, nested ones as JSON. Text that is no
    JSON has no paths. Each level is saved once, and only nested values are read again for the next."""
    level = df.select(unit, F.lit("").alias("path"), F.col(json).alias("text"))
    levels = []
    for _ in range(max_depth):
        level.select(unit, "path", F.try_parse_json("text").alias("v")).createOrReplaceTempView(view := f"json_{uuid.uuid4().hex}")
        rows = df.sparkSession.sql(f"select v.`{unit}`, v.path as above, e.key, e.value from {view} v, lateral variant_explode(v.v) e")
        path = F.when(F.col("key").isNull(), F.concat("above", F.lit("[]"))).when(F.col("above") == "", F.col("key")).otherwise(F.concat("above", F.lit("."), "key"))
        kind = F.schema_of_variant("value")
        kind = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(F.is_variant_null("value"), "null").otherwise("scalar")
        rows = rows.select(unit, path.alias("path"), kind.alias("kind"), F.when(kind == "scalar", F.variant_get("value", "$", "string")).otherwise(F.to_json("value")).alias("text"))
        rows = graph.checkpointed(rows)
        df.sparkSession.catalog.dropTempView(view)
        levels.append(rows)
        level = rows.where("kind in ('object', 'array')")
        if level.isEmpty():
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def path_profile(df: DataFrame, json: str, unit: str, examples: int = 6, max_depth: int = 10) -> DataFrame:
    """Per path of :func:`json_paths`: seen, empty (null, "", [] or {}), units that have it, the smallest ``examples``
    distinct scalar values. Values are ranked in 64 parts of a path before they are ranked together, so a path that
    every row has is no single task."""
    paths = json_paths(df, json, unit, max_depth)
    empty = (F.col("kind") == "null") | F.trim(F.col("text")).isin("", "[]", "{}")
    facts = paths.groupBy("path").agg(F.count("*").alias("seen"), F.count_if(empty).alias("empty"))
    units = paths.select("path", unit).distinct().groupBy("path").agg(F.count("*").alias("units"))
    values = paths.where((F.col("kind") == "scalar") & ~empty).select("path", "text").distinct()
    part = Window.partitionBy("path", F.pmod(F.xxhash64("text"), F.lit(64))).orderBy("text")
    first = values.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= examples)
    first = first.withColumn("_rank", F.row_number().over(Window.partitionBy("path").orderBy("text"))).where(F.col("_rank") <= examples)
    shown = first.groupBy("path").agg(F.array_sort(F.collect_list("text")).alias("examples"))
    return facts.join(units, "path").join(shown, "path", "left").select("path", "seen", "empty", "units", "examples")


def attach(rows: DataFrame, anns: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(anns, keys)


def repeated_groups(df: DataFrame, keys: list[str], k: int, x: str, y: str, tol: float) -> DataFrame:
    """Groups of at least ``k`` equal shapes and how they lie: row, column or scattered."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("w"), (F.max(y) - F.min(y)).alias("h")).where(F.col("n") >= k)
    return g.withColumn("alignment", F.when(F.col("h") <= tol, "row").when(F.col("w") <= tol, "column").otherwise("scattered"))


def feature_groups(df: DataFrame, keys: list[str], k: int, tol: float) -> tuple[DataFrame, DataFrame]:
    """(groups, spacings) of groups of at least ``k`` equal features. groups: keys, n, alignment; spacings: keys, station,
    spacing (from a feature to the next along the group's axis, if more than half of ``tol``).

    alignment, the first that holds: local_x_row or local_y_column (extent across of at most twice ``tol``),
    pair_spacing_only (two features), oblique_row_in_view_plane (none further than twice ``tol`` from the principal axis, and
    some spacing), local_grid_candidate (four or more, on several stations of ``tol`` both ways), distributed_in_local_frame.
    Only the first four have an axis. df: keys (null keys are no group), id, x, y; rows without x or y are left out.

    The axis comes from sums, the spacings from one order of all rows that is cut into ranges, so a large group is many tasks.
    """
    rows = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).na.drop(subset=keys)
    on = lambda c: F.count_distinct(F.round(F.col(c) / tol)) > 1
    extent = lambda c: F.max(c) - F.min(c)
    turn = 0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), extent("x").alias("_w"), extent("y").alias("_h"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), turn.alias("_turn"), (on("x") & on("y")).alias("_grid")).where(F.col("n") >= k)
    facts = graph.checkpointed(facts)
    at = rows.join(facts, keys)
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    station = F.when(F.col("_h") <= 2 * tol, F.col("x")).when(F.col("_w") <= 2 * tol, F.col("y")).otherwise(dx * F.cos("_turn") + dy * F.sin("_turn"))
    at = at.select(*keys, station.alias("station"), "id", F.abs(dy * F.cos("_turn") - dx * F.sin("_turn")).alias("_off"))
    order = cuts.next_in_order(at, *keys, "station", "id")
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(f"next.{c}") == F.col(c))
    steps = graph.checkpointed(order.select(*keys, "station", "_off", F.when(same, F.col("next.station") - F.col("station")).alias("spacing")))
    wide = F.col("spacing") > tol / 2
    seen = steps.groupBy(*keys).agg(F.max("_off").alias("_off"), F.count_if(wide).alias("_steps"))
    alignment = (
        F.when(F.col("_h") <= 2 * tol, "local_x_row").when(F.col("_w") <= 2 * tol, "local_y_column").when(F.col("n") == 2, "pair_spacing_only")
        .when((F.col("_off") <= 2 * tol) & (F.col("_steps") > 0) & (F.col("n") > 2), "oblique_row_in_view_plane").when((F.col("n") >= 4) & F.col("_grid"), "local_grid_candidate").otherwise("distributed_in_local_frame")
    )
    groups = graph.checkpointed(facts.join(seen, keys).select(*keys, "n", alignment.alias("alignment")))
    lined = groups.where("alignment not in ('local_grid_candidate', 'distributed_in_local_frame')").select(*keys)
    return groups, steps.where(wide).join(lined, keys).select(*keys, "station", "spacing")


def identity_pairs(reps: DataFrame, ident: str, key: str) -> DataFrame:
    """Links (src, dst) that give the same classes as all pairs that share a key: each item with the first of its key.
    Pairs themselves would grow with the square of a key's rows. Not for merging under exclusions: see :func:`identity.resolve_groups`."""
    first = reps.groupBy(key).agg(F.min(ident).alias("src"))
    return reps.where(F.col(key).isNotNull()).join(first, key).where(F.col(ident) != F.col("src")).select("src", F.col(ident).alias("dst"))


def count_interval(same: DataFrame, nodes: DataFrame, proven: str, different: DataFrame | None = None) -> DataFrame:
    """One row: lower (all possible merges made) and upper (only proven ones) bounds of how many things there are.
    ``different`` (a, b): pairs proven to be two things, which no merge may bring together (see :func:`identity.resolve_identity`)."""
    n = nodes.select("node")
    if different is None:
        lower = graph.components(same.select("src", "dst"), n).agg(F.countDistinct("component").alias("lower"))
    else:
        merged = identity.resolve_identity(same.select(F.col("src").alias("a"), F.col("dst").alias("b")), different)
        alone = n.distinct().join(merged, "node", "left_anti").select("node", F.col("node").alias("cluster"))
        lower = merged.select("node", "cluster").unionByName(alone).agg(F.countDistinct("cluster").alias("lower"))
    upper = graph.components(same.where(proven).select("src", "dst"), n).agg(F.countDistinct("component").alias("upper"))
    return lower.crossJoin(upper)  # single rows


def search_texts(df: DataFrame, text: str, unit: str, ident: str, query: str, limit: int, regex: bool = False) -> DataFrame:
    """Hits in order of (unit, id), at most ``limit``, each with its unit's number of hits and whether hits were cut."""
    body = F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    hits = df.where(F.col(text).rlike(query) if regex else body.contains(query.lower()))
    per = hits.groupBy(unit).agg(F.count("*").alias("unit_hits"))
    total = hits.agg(F.count("*").alias("_all"))
    first = hits.orderBy(unit, ident).limit(limit)
    return first.join(per, unit).crossJoin(total).withColumn("truncated", F.col("_all") > limit).select(unit, ident, "unit_hits", "truncated")  # total: one row


def ranked_search(df: DataFrame, ident: str, text: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best rows (BM25) that hold all terms, from term counts of the rows that hold any."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    times = lambda term: F.size(words) - F.size(F.array_remove(words, term))
    docs = df.select(ident, F.size(words).alias("n"), *[times(term).alias(f"_t{i}") for i, term in enumerate(terms)])
    counts = [F.sum((F.col(f"_t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))]
    stats = docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *counts).first()  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        d = stats[f"d{i}"] or 0
        idf = F.log(F.lit(1 + ((stats["docs"] or 0) - d + 0.5) / (d + 0.5)))
        tf = F.col(f"_t{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.lit(stats["mean"] or 1.0)))
    every = docs
    for i in range(len(terms)):
        every = every.where(f"_t{i} > 0")
    return every.select(ident, F.round(score, 6).alias("score")).orderBy(F.desc("score"), ident).limit(k)


def entity_profile(df: DataFrame, drawing: str, n: int = 200) -> DataFrame:
    """drawing, fact, key, sub, n, layers: what a drawing is made of, the ``n`` most frequent of each fact (then by key).

    df: drawing, type, layer, name, on_sheet, text_override. Facts of what lies on a sheet: "type", "layer", "layer_type"
    (key: the layer, sub: the type), "block" (references by block name, with the sorted names of their layers) and
    "dimension" (key: override or geometry). Contents of block definitions count as "definition_type" alone.
    """
    text = lambda c, empty: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(empty)).otherwise(F.col(c))
    kind, layer, none = F.lower(text("type", "(unknown)")), text("layer", "(empty)"), F.lit("")
    fact = lambda name, key, sub=none: F.struct(F.lit(name).alias("fact"), key.alias("key"), sub.alias("sub"))
    measured = F.when(F.trim(F.coalesce(F.col("text_override"), none)) == "", "geometry").otherwise("override")
    placed = F.array(
        fact("type", kind), fact("layer", layer), fact("layer_type", layer, kind),
        F.when(kind == "block_reference", fact("block", text("name", "(unnamed)"))), F.when(kind == "dimension", fact("dimension", measured)),
    )
    facts = F.filter(F.when(F.coalesce(F.col("on_sheet"), F.lit(False)), placed).otherwise(F.array(fact("definition_type", kind))), lambda x: x.isNotNull())
    rows = df.select(drawing, layer.alias("_layer"), F.explode(facts).alias("f")).select(drawing, "f.*", "_layer")
    counts = rows.groupBy(drawing, "fact", "key", "sub").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("fact") == "block", F.col("_layer")))), ",").alias("layers"))
    rank = F.row_number().over(Window.partitionBy(drawing, "fact").orderBy(F.desc("n"), "key", "sub"))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def bounds_union(df: DataFrame, drawing: str) -> DataFrame:
    """drawing, n, minx, miny, maxx, maxy: the box around all boxes of a drawing that lie in world space (world), their
    corners in any order; a box with a null corner doesn't count."""
    whole = df.where("world and x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    ends = [F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"), F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy")]
    return whole.groupBy(drawing).agg(F.count("*").alias("n"), *ends)
