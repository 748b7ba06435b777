"""Catalogs and knowledge bases: validation, merging, facets, cubes, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, equal: dict[str, object] | None = None, member: dict[str, object] | None = None, query: str | None = None, over: list[str] | None = None) -> DataFrame:
    """Rows with the given values, with members of array columns, with a text (any case) in one of the columns
    ``over``; a None value filters nothing."""
    out = df
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == F.lit(v)) if v is not None else out
    for c, v in (member or {}).items():
        out = out.where(F.array_contains(c, v)) if v is not None else out
    if query:
        hit = [F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False)) for c in over or []]
        out = out.where(reduce(Column.__or__, hit, F.lit(False)))
    return out


def page(df: DataFrame, key: str, limit: int, offset: int = 0, after: object = None) -> DataFrame:
    """A page in key order: by offset, or (for deep pages) by the last key of the page before."""
    out = df if after is None else df.where(F.col(key) > F.lit(after))
    return out.orderBy(key).offset(offset).limit(limit)


def facet(df: DataFrame, column: str) -> DataFrame:
    """value, n: the number of rows of each value, most first, then by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def facet_array(df: DataFrame, column: str) -> DataFrame:
    return facet(df.select(F.explode(column).alias("value")), "value")


def scope_cube(df: DataFrame, ident: str, scope: str, hosts: str) -> DataFrame:
    """scope, host, n: distinct ids for every (scope or all, host or all). Hosts are an array; counts without the
    host take each row once, counts with it each host once, so nothing is exploded that need not be."""
    rows = df.dropDuplicates([ident])
    without = rows.rollup(scope).agg(F.count("*").alias("n"), F.grouping(scope).alias("g")).where(f"g = 1 or {scope} is not null")
    without = without.select(F.col(scope).alias("scope"), F.lit(None).cast("string").alias("host"), "n")
    each = rows.select(scope, F.explode(F.array_distinct(hosts)).alias("host"))
    per = each.groupBy(scope, "host").agg(F.count("*").alias("n")).select(F.col(scope).alias("scope"), F.col("host").cast("string"), "n")
    every = per.groupBy("host").agg(F.sum("n").alias("n")).select(F.lit(None).cast(dict(df.dtypes)[scope]).alias("scope"), "host", "n")
    return without.unionByName(per).unionByName(every)


def row_errors(df: DataFrame, rules: dict[str, Column], name: str = "errors") -> DataFrame:
    """``df`` with the codes of the rules that a row breaks (a rule is a condition that must not hold)."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()])))


def unknown_references(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")


def classify_first(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule (regular expression) that the text fits."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def all_tags(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The names of all rules that fit, in the order of the rules; the default's name last."""
    tags = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for p, n in rules]))
    return F.array_union(tags, F.array(F.lit(default))) if default else F.array_distinct(tags)


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default: object) -> DataFrame:
    """``left`` with a column of ``right``, or the default where there is no row."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def pending(items: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` items by key that are not done."""
    return items.join(done.select(key).distinct(), key, "left_anti").orderBy(key).limit(n)


def merge_unique(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """The union of parts, and the keys that occur in it more than once (with how often)."""
    every = reduce(DataFrame.unionByName, parts)
    return every, every.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def three_way(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: both, left or right."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return x.join(y, key, "full").select(key, side.alias("side"))


def strongest(parts: list[DataFrame], key: str, grade: str, grades: list[str], tie: str) -> DataFrame:
    """The union of edges, each key once: at the best grade (first in ``grades``), then by ``tie``."""
    every = reduce(DataFrame.unionByName, parts)
    rank = F.array_position(F.array(*[F.lit(g) for g in grades]), F.col(grade))
    best = every.groupBy(key).agg(F.min(F.struct(F.when(rank > 0, rank).otherwise(len(grades) + 1).alias("_r"), F.col(tie).alias("_t"), F.struct(*[c for c in every.columns if c != key]).alias("_row"))).alias("m"))
    return best.select(key, "m._row.*")


def manifest(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per count: (name, value, n); the rows' digest is a sum of row hashes, which order does not change and
    in which repeated rows do not cancel."""
    total = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("d"))
    out = total.select(F.lit("rows").alias("name"), F.lit(None).cast("string").alias("value"), "n").unionByName(total.select(F.lit("digest").alias("name"), F.col("d").alias("value"), "n"))
    for c in by:
        out = out.unionByName(df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("name"), "value", "n"))
    return out


def count_differences(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of counts (keys, n) that differ, a missing one as null."""
    return actual.withColumnRenamed("n", "actual").join(expected.withColumnRenamed("n", "expected"), keys, "full").where("not (actual <=> expected)")


def node_summary(nodes: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Nodes with the number of rows that each child table has for them; children are summed up before the join."""
    out = nodes
    for name, (df, column) in children.items():
        out = out.join(df.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def register(new: DataFrame, existing: DataFrame, key: list[str], payload: str, order: str) -> DataFrame:
    """``new`` with status: accepted (first of a new key), duplicate (its payload is known) or conflict (the key is
    known with another payload). Of equal new keys the first by ``order`` counts."""
    known = existing.groupBy(*key).agg(F.first(payload).alias("_known"))
    first = Window.partitionBy(*key).orderBy(order)
    out = new.join(known, key, "left").withColumn("_first", F.coalesce("_known", F.first(payload).over(first))).withColumn("_rn", F.row_number().over(first))
    status = F.when(F.col(payload) != F.col("_first"), "conflict").when(F.col("_known").isNotNull() | (F.col("_rn") > 1), "duplicate").otherwise("accepted")
    return out.withColumn("status", status).drop("_known", "_first", "_rn")


def match_ranked(queries: DataFrame, patterns: DataFrame, query: str, pattern: str, hashes: list[str], k: int) -> DataFrame:
    """Per query the ``k`` best patterns that agree in one of the hashes; the first hash is the strongest. Which
    hashes agreed is listed.

    A hash may have very many patterns. One of the best ``k`` whose strongest agreement is some hash is among the first
    ``k`` patterns of that hash's value, so only those meet the queries; then all hashes of such a pair are compared."""
    pairs = None
    for h in hashes:
        first = patterns.select(h, pattern).where(F.col(h).isNotNull()).distinct()
        first = first.withColumn("_rn", F.row_number().over(Window.partitionBy(h).orderBy(pattern))).where(F.col("_rn") <= k).drop("_rn")
        one = queries.select(query, h).join(first, h).select(query, pattern)
        pairs = one if pairs is None else pairs.unionByName(one)
    theirs = patterns.select(pattern, *[F.col(h).alias(f"_{h}") for h in hashes])
    met = pairs.distinct().join(theirs, pattern).join(queries.select(query, *hashes), query)
    agreed = F.filter(F.array(*[F.when(F.col(h) == F.col(f"_{h}"), F.struct(F.lit(rank).alias("rank"), F.lit(h).alias("kind"))) for rank, h in enumerate(hashes, 1)]), lambda x: x.isNotNull())
    found = met.select(query, pattern, F.explode(agreed).alias("a")).select(query, pattern, "a.rank", "a.kind")
    per = found.groupBy(query, pattern).agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return per.withColumn("_rn", F.row_number().over(Window.partitionBy(query).orderBy("rank", pattern))).where(F.col("_rn") <= k).drop("_rn")


def apply_snapshot(current: DataFrame, incoming: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys, digest, change: added, unchanged, changed or deleted."""
    a = current.select(*keys, F.col(digest).alias("_old"), F.lit(1).alias("_a"))
    b = incoming.select(*keys, F.col(digest).alias("_new"), F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, F.coalesce("_new", "_old").alias(digest), change.alias("change"))


def plan_rescan(files: DataFrame, manifest_: DataFrame, path: str) -> DataFrame:
    """path, plan: keep (size and time are known), rehash (they differ) or scan (new)."""
    known = manifest_.select(path, F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.lit(1).alias("_k"))
    plan = F.when(F.col("_k").isNull(), "scan").when((F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")), "keep").otherwise("rehash")
    return files.join(known, path, "left").select(path, plan.alias("plan"))


def merge_scan(previous: DataFrame, scanned: DataFrame, path: str, value: str, ok: str) -> DataFrame:
    """The new record where the scan went well, else the last good one."""
    new = scanned.select(path, F.when(F.col(ok), F.col(value)).alias("_new"))
    return previous.select(path, F.col(value).alias("_old")).join(new, path, "full").select(path, F.coalesce("_new", "_old").alias(value)).where(F.col(value).isNotNull())


def multiset_jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the sum of the smaller counts over the sum of the larger; 1 if both are empty."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("_a")), b.groupBy(*keys).agg(F.count("*").alias("_b"))
    j = x.join(y, keys, "full").select(F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))
    s = j.agg(F.sum(F.least("_a", "_b")).alias("both"), F.sum(F.greatest("_a", "_b")).alias("every"))
    return s.select(F.when(F.coalesce("every", F.lit(0)) == 0, 1.0).otherwise(F.col("both") / F.col("every")).alias("jaccard"))


def coverage(done: Column, of: Column) -> Column:
    """A share whose empty denominator is 1."""
    return F.when(of == 0, F.lit(1.0)).otherwise(done / of)


def flag_conflicts(props: DataFrame, keys: list[str], *value: Column) -> DataFrame:
    """``props`` with conflict: whether the key has more than one distinct value."""
    return props.withColumn("conflict", F.size(F.collect_set(F.struct(*value)).over(Window.partitionBy(*keys))) > 1)


def evaluate_rules(df: DataFrame, must: dict[str, Column], must_any: dict[str, Column], should: dict[str, Column], must_not: dict[str, Column], weak: float = 0.5) -> DataFrame:
    """``df`` with status and missing (the names of must-rules that fail): rejected if something is excluded or
    missing, abstained if no alternative holds, ambiguous if fewer than ``weak`` of the should-rules hold, else
    supported. A null condition does not hold."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    missing = F.array_compact(F.array(*[F.when(~holds(c), F.lit(n)) for n, c in must.items()])).cast("array<string>")
    excluded = reduce(Column.__or__, [holds(c) for c in must_not.values()], F.lit(False))
    some = reduce(Column.__or__, [holds(c) for c in must_any.values()], F.lit(not must_any))
    share = sum((holds(c).cast("int") for c in should.values()), F.lit(0)) / F.lit(max(1, len(should)))
    out = df.withColumn("missing", missing)
    status = F.when(excluded | (F.size("missing") > 0), "rejected").when(~some, "abstained").when(F.lit(bool(should)) & (share < weak), "ambiguous").otherwise("supported")
    return out.withColumn("status", status)


def rank_context(scopes: DataFrame, scope: str, text: str, lexicon: list[tuple[str, str, float]]) -> DataFrame:
    """Per scope the best label: weights of the lexicon's terms (term, label, weight) that its texts hold, relative to
    the largest. status: unique, ambiguous (two labels share the top) or abstained (no term)."""
    hits = F.filter(F.array(*[F.when(F.lower(F.col(text)).contains(term), F.struct(F.lit(label).alias("label"), F.lit(w).alias("w"))) for term, label, w in lexicon]), lambda x: x.isNotNull())
    score = scopes.select(scope, F.explode(hits).alias("h")).groupBy(scope, "h.label").agg(F.sum("h.w").alias("score"))
    top = score.withColumn("_rn", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("score"), "label"))).withColumn("_n", F.count("*").over(Window.partitionBy(scope, "score")))
    best = top.where("_rn = 1").select(scope, "label", "score", F.when(F.col("_n") > 1, "ambiguous").otherwise("unique").alias("status"))
    return scopes.select(scope).distinct().join(best, scope, "left").withColumn("status", F.coalesce("status", F.lit("abstained")))
