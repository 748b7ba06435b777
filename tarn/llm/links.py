"""Classes of similar items that share a bucket, without emitting all pairs of a bucket.

Every bucket names a leader, its most central item, and the others are verified against it alone. That settles a bucket of
near copies; what is left are buckets whose items are not all joined by links. They are resolved exactly, settled items
taking part: in a small bucket all pairs of items that are not joined are verified; in a crowded one the items that are not
joined to the leader meet all its items in blocks of bounded size, where the numbers of common tokens, one matrix product
for a pair of blocks, leave few pairs to verify, and a pair of blocks gives no more links than it has items. So the classes
are the components of all similar pairs of the buckets. The number of jobs does not depend on the size of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, saved_with_mark

#: Rows of one leader's group that one task verifies; items and bytes of a block.
GROUP, BLOCK, BLOCK_BYTES = 500, 500, 1 << 19
#: Buckets of more items are crowded.
FEW = 24


def verified(pairs: DataFrame, items: DataFrame, similar: Callable[[bytes, bytes], bool], kind: str) -> DataFrame:
    """Those of ``pairs`` (a, b) of whose blobs (items: id, blob) ``similar`` holds.

    A leader's (b's) blob is joined to its group in parts of about GROUP rows, so a large group is no single task.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("n"))
    split = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("n")).cast("int")).drop("n")
    leaders = items.join(parts, items["id"] == parts["b"]).select("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.col("blob").alias("blob_b"))
    mine = items.select(F.col("id").alias("a"), F.col("blob").alias("blob_a"))
    both = split.join(mine, "a").join(leaders, ["b", "part"]).select("a", "b", "blob_a", "blob_b")

    def run(batches):
        for x in batches:
            ok = [similar(p.as_buffer().to_pybytes(), q.as_buffer().to_pybytes()) for p, q in zip(x.column(2), x.column(3), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def shared_buckets(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (id, band, key) whose bucket holds two items or more, saved, with central: how many rows the
    item's buckets hold together. A text and its edited copies share more buckets with it than with each other, so it is
    their most central one."""
    sizes = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = saved(keys.join(sizes, ["band", "key"]).select("id", "band", "key", "n"), "buckets")
    central = rows.groupBy("id").agg(F.sum("n").alias("central"))
    return saved(rows.drop("n").join(central, "id"), "buckets")


def _across(rows: DataFrame, on: list[str]) -> DataFrame:
    """(a, b): the pairs of items of different roots that share a group (the columns ``on``; rows: these, id, root).
    One side of a large group is dealt in parts, the other is sent to each of them."""
    groups = rows.groupBy(*on).agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rows = rows.select(*on, "id", "root").join(groups.select(*on, F.ceil(F.col("n") / F.lit(GROUP)).cast("int").alias("n")), on)
    one = rows.select(*on, F.col("id").alias("a"), F.col("root").alias("ra"), F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("part"))
    two = rows.select(*on, F.col("id").alias("b"), F.col("root").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    return one.join(two, [*on, "part"]).where("ra < rb").select("a", "b")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of ``left`` has in common with each of ``right`` (distinct tokens in each)."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right))
    both = np.intersect1d(a, b)
    for at in range(0, len(both), 4096):
        some = both[at : at + 4096]
        sides = []
        for tokens, rows, n in ((a, row_a, len(left)), (b, row_b, len(right))):
            spot = np.minimum(np.searchsorted(some, tokens), len(some) - 1)
            mine = some[spot] == tokens
            m = np.zeros((n, len(some)), np.float32)
            m[rows[mine], spot[mine]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _met_before(left: list[list[dict]], right: list[list[dict]], band: int) -> np.ndarray:
    """Which of ``left`` share with which of ``right`` a bucket (each: band, key) of a band before ``band``."""
    out = np.zeros((len(left), len(right)), bool)
    for before in range(band):
        a, b = (np.array([next((s["key"] for s in own if s["band"] == before), None) for own in side], object) for side in (left, right))
        has_a, has_b = (np.array([k is not None for k in side]) for side in (a, b))
        if has_a.any() and has_b.any():
            out[np.ix_(has_a, has_b)] |= a[has_a].astype(np.int64)[:, None] == b[has_b].astype(np.int64)[None, :]
    return out


def _in_blocks(rows: DataFrame, every_row: DataFrame, items: DataFrame, similar: Callable[[bytes, bytes], bool], tokens: Callable[[bytes], np.ndarray], likely: Callable, kind: str) -> DataFrame:
    """(a, b): links that join all roots of each bucket which similar pairs join (rows: band, key, id, root, main; main is
    the leader's root). every_row: those of all open buckets; a pair meets in the first band that both share."""
    own = every_row.groupBy("id").agg(F.collect_list(F.struct("band", "key")).alias("own"))
    blobs = items.join(own, "id").select("id", "blob", "own")
    full = saved(rows.join(blobs, "id").select("band", "key", "id", "root", "main", "blob", "own"), "crowded")
    apart = F.col("root") != F.col("main")
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    size = F.length("blob")
    sizes = full.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(size).alias("b"), F.count(F.when(apart, 1)).alias("na"), F.sum(F.when(apart, size)).alias("ba"))
    sizes = sizes.select("band", "key", blocks(F.col("na"), F.col("ba")).alias("ni"), blocks(F.col("n"), F.col("b")).alias("nj"))
    dealt = full.join(sizes, ["band", "key"])
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, data = ["band", "key", "i", "j"], ["id", "root", "blob", "own"]
    one = dealt.where(apart).select(*keys[:2], part("ni").alias("i"), every("nj").alias("j"), *data)
    # under names of its own, as both sides stem from one table
    two = dealt.select(*keys[:2], every("ni").alias("i"), part("nj").alias("j"), *data).toDF(*[f"{c}_b" for c in keys + data])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if x.num_rows and y.num_rows:
            (ia, ra, ba, sa), (ib, rb, bb, sb) = ([t.column(c + end).to_pylist() for c in data] for t, end in ((x, ""), (y, "_b")))
            ta, tb = [tokens(v) for v in ba], [tokens(v) for v in bb]
            number = {r: i for i, r in enumerate(dict.fromkeys(ra + rb))}
            parent = list(range(len(number)))

            def top(i: int) -> int:
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            na, nb = np.array([len(v) for v in ta])[:, None], np.array([len(v) for v in tb])[None, :]
            qa, qb = np.array([number[r] for r in ra]), np.array([number[r] for r in rb])
            open_ = likely(_common(ta, tb), na, nb) & (qa[:, None] != qb[None, :]) & ~_met_before(sa, sb, x.column("band")[0].as_py())
            for i, j in np.argwhere(open_).tolist():
                p, q = top(qa[i]), top(qb[j])
                if p != q and similar(ba[i], bb[j]):
                    parent[q] = p
                    found.append((ia[i], ib[j]))
        a, b = zip(*found, strict=True) if found else ((), ())
        of = pa.int64() if kind == "bigint" else pa.binary()
        return pa.table({"a": pa.array(a, of), "b": pa.array(b, of)})

    return one.groupBy(*keys).cogroup(two.groupBy(*[f"{c}_b" for c in keys])).applyInArrow(meet, f"a {kind}, b {kind}")


def bucket_classes(keys: DataFrame, items: DataFrame, similar: Callable[[bytes, bytes], bool], tokens: Callable[[bytes], np.ndarray], likely: Callable) -> DataFrame:
    """(node, root): the components of all similar pairs of items in one bucket, for the items that have any; root is one
    of the component's items.

    keys: id, band int, key long, central, as :func:`shared_buckets` leaves them; items: id, blob. tokens: the distinct
    64-bit tokens of a blob; likely(common, n_a, n_b), of arrays: true wherever so many common tokens can mean a similar
    pair.
    """
    kind = dict(keys.dtypes)["id"]
    first = F.min(F.struct((-F.col("central")).alias("c"), F.xxhash64("id").alias("h"), "id")).alias("l")
    leaders = saved(keys.groupBy("band", "key").agg(first, F.count("*").alias("m")).select("band", "key", F.col("l.id").alias("leader"), "m"), "leaders")
    met = keys.join(leaders, ["band", "key"]).where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    roots = saved(components(saved(verified(met, items, similar, kind), "links")), "roots")
    # a settled item stays a candidate for all that no link has joined to it yet
    rows = keys.join(roots, keys["id"] == roots["node"], "left").select("band", "key", "id", F.coalesce("root", "id").alias("root"))
    parted = rows.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "key")
    main = leaders.join(roots, leaders["leader"] == roots["node"], "left").select("band", "key", "m", F.coalesce("root", "leader").alias("main"))
    parted = saved(parted.join(main, ["band", "key"]), "parted")
    rows, n, _ = saved_with_mark(rows.join(parted, ["band", "key"]), "open", "id")
    if not n:
        return roots
    more = saved(verified(_across(rows.where(F.col("m") <= FEW), ["band", "key"]).distinct(), items, similar, kind), "links")
    crowded = rows.where(F.col("m") > FEW).select("band", "key", "id", "root", "main")
    if not crowded.isEmpty():
        more = more.union(saved(_in_blocks(crowded, rows, items, similar, tokens, likely, kind), "links"))
    of = rows.select("id", "root").distinct()
    across = more.join(of.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(of.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    merged = components(across.select("ra", "rb"), "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("top"))
    # every root that was joined to another, with all the items below it
    every = roots.unionByName(merged.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti"))
    return every.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
