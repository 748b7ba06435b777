"""Which representations show one object: assertions by rule, merging under exclusions, attachment of schedule rows."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heapreplace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: How a representation shows its object.
PHYSICAL = ["instance_view", "schematic_instance", "aggregated_representation"]
TYPE_ONLY = ["legend_symbol", "type_detail"]
SCHEDULE = "schedule_record"


def _sided(reps: DataFrame) -> DataFrame:
    side = F.when(F.col("mode").isin(PHYSICAL), "physical").when(F.col("mode").isin(TYPE_ONLY), "type").when(F.col("mode") == SCHEDULE, "schedule").otherwise("other")
    return reps.where(F.col("class").isNotNull()).withColumn("side", side)


def _labelled(sided: DataFrame) -> DataFrame:
    """A row per representation and distinct label, without case and outer space."""
    labels = F.array_distinct(F.transform("labels", lambda x: F.lower(F.trim(x))))
    return sided.withColumn("label", F.explode(labels)).where("label <> ''")


def assertion_groups(reps: DataFrame) -> DataFrame:
    """(edge, class, context, signature, label, id, side): what rules say of pairs of representations, as groups.

    All pairs of a key would grow with its square, so each assertion is a key with its members. Its pairs are

    - represents_type: a member of side type with any other of the class;
    - different_object_proven: physical members of one class and context;
    - same_type_only: members of one class and signature;
    - same_object_supported: a schedule member with a physical one of the same label, of any class;
    - same_object_possible: members of one class and label that are no case of the first, second or fourth kind.

    A group stands only if it has such a pair; the key's unused columns are null. reps: id, class, context, mode, signature,
    labels. No class: no assertion. A null context is shared with none; null or empty signatures and labels say nothing.
    """
    r = _sided(reps)
    named = _labelled(r)
    n = lambda side: F.count_if(F.col("side") == side)
    physical = F.col("side") == "physical"
    places = F.count_distinct(F.when(physical, F.col("context"))) + F.count_if(physical & F.col("context").isNull())
    kinds = {
        "represents_type": (r, ["class"], (n("type") > 0) & (F.count("*") > 1)),
        "different_object_proven": (r.where("side = 'physical' and context is not null"), ["class", "context"], F.count("*") > 1),
        "same_type_only": (r.where("signature <> ''"), ["class", "signature"], F.count("*") > 1),
        "same_object_supported": (named.where("side in ('schedule', 'physical')"), ["label"], (n("schedule") > 0) & (n("physical") > 0)),
        "same_object_possible": (named.where("side <> 'type'"), ["class", "label"], (places > 1) | (n("schedule") > 1) | ((n("other") > 0) & (F.count("*") > 1))),
    }
    out = None
    for edge, (members, key, holds) in kinds.items():
        groups = members.groupBy(*key).agg(holds.alias("_holds")).where("_holds").select(*key)
        columns = [F.col(c) if c in key else F.lit(None).cast("string").alias(c) for c in ("class", "context", "signature", "label")]
        one = members.join(groups, key).select(F.lit(edge).alias("edge"), *columns, "id", "side")
        out = one if out is None else out.unionByName(one)
    return out


def exclusive_keys(reps: DataFrame) -> DataFrame:
    """(node, key): physical representations that share a key (class and context) are proven to be different objects."""
    r = _sided(reps).where("side = 'physical' and context is not null")
    return r.select(F.col("id").alias("node"), F.to_json(F.struct("class", "context")).alias("key"))


def resolve_identity(same: DataFrame, different: DataFrame | None = None, exclusive: DataFrame | None = None, limit: int = 100_000, block: int = 200_000) -> DataFrame:
    """(node, cluster): the pairs ``same`` (a, b) merge in sorted order, each unless it would bring together two nodes
    proven different: a pair of ``different`` (a, b), or two nodes with one key of ``exclusive`` (node, key). A cluster is
    named by its smallest node. Pairs with a null or equal ends are left out.

    The order matters only inside a connected component. Those of up to ``limit`` rows are merged one by one, a group
    each; larger ones in blocks of about ``block`` pairs of the order, one after another: see :func:`_in_blocks`.
    """
    kind = dict(same.dtypes)["a"]
    pairs = graph.checkpointed(same.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    comp = graph.checkpointed(graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    keys = pairs.sparkSession.createDataFrame([], f"node {kind}, key string")
    if exclusive is not None:
        keys = keys.unionByName(exclusive.where("key is not null").select("node", F.concat(F.lit("key "), F.col("key").cast("string")).alias("key")))
    if different is not None:
        named = different.where("a <> b").withColumn("key", F.concat(F.lit("pair "), F.to_json(F.array(F.least("a", "b"), F.greatest("a", "b")))))
        keys = keys.unionByName(named.select(F.col("a").alias("node"), "key")).unionByName(named.select(F.col("b").alias("node"), "key"))
    # a key that one node of a component holds alone excludes nothing
    held = keys.distinct().join(comp, "node")
    shared = held.groupBy("component", "key").agg(F.count("*").alias("_n")).where("_n > 1").select("component", "key")
    held = graph.checkpointed(held.join(shared, ["component", "key"]).select("component", "node", "key"))
    links = pairs.join(comp.withColumnRenamed("node", "a"), "a")
    none = F.lit(None).cast("string")
    rows = links.select("component", "a", "b", none.alias("key")).unionByName(held.select("component", F.col("node").alias("a"), F.col("node").alias("b"), "key"))
    sizes = graph.checkpointed(rows.groupBy("component").agg(F.count("*").alias("_n")))
    small = sizes.where(F.col("_n") <= limit).select("component")
    out = rows.join(small, "component").groupBy("component").applyInPandas(_one_by_one, f"node {kind}, cluster {kind}")
    large = sizes.where(F.col("_n") > limit).select("component")
    if large.isEmpty():
        return out
    return out.unionByName(_in_blocks(links.join(large, "component", "left_semi").select("a", "b"), held.join(large, "component", "left_semi").select("node", "key"), block))


def _one_by_one(f: pd.DataFrame) -> pd.DataFrame:
    """One component: rows without a key are pairs, the others a node and a key it holds."""
    is_pair = f["key"].isna()
    pairs = sorted(zip(f["a"][is_pair], f["b"][is_pair], strict=True))
    top = _merged(pairs, zip(f["a"][~is_pair], f["key"][~is_pair], strict=True))
    nodes = sorted({x for p in pairs for x in p})
    return pd.DataFrame({"node": nodes, "cluster": [top(x) for x in nodes]})


def _merged(pairs: Iterable[tuple], held: Iterable[tuple]) -> Callable:
    """The cluster of a node, after ``pairs`` merged in the order given; held: nodes and their keys."""
    above, holds = {}, {}
    for node, key in held:
        holds.setdefault(node, set()).add(key)

    def top(x):
        path = []
        while x in above:
            path.append(x)
            x = above[x]
        for p in path:
            above[p] = x
        return x

    for pair in pairs:
        low, high = sorted(map(top, pair))
        less, more = sorted((holds.get(low, set()), holds.get(high, set())), key=len)
        if low != high and less.isdisjoint(more):
            above[high] = low
            more |= less
            holds[low] = more
            holds.pop(high, None)
    return top


def _in_blocks(pairs: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """The clusters that merging in order gives, of components that fit no task.

    The order is cut into blocks of about ``block`` pairs. A block meets the clusters that the blocks before it made: its
    pairs become pairs of clusters, and of the keys only those that two of its clusters hold matter. So a task holds one
    block, and the number of blocks grows with the pairs, whatever waits for what. Two clusters with one key never
    merge, so a cluster holds each key once.
    """
    kind = dict(pairs.dtypes)["a"]
    label = graph.checkpointed(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("cluster", F.col("node")))
    held = graph.checkpointed(keys.select(F.col("node").alias("cluster"), "key").distinct())
    blocks = math.ceil(pairs.count() / block)
    ranged = graph.checkpointed(pairs.repartitionByRange(blocks, "a", "b").withColumn("block", F.spark_partition_id()))
    none = lambda kind: F.lit(None).cast(kind)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        is_pair = f["key"].isna()
        order = f[is_pair].sort_values(["a", "b"])
        top = _merged(zip(order["x"], order["y"], strict=True), zip(f["x"][~is_pair], f["key"][~is_pair], strict=True))
        old = sorted({*order["x"], *order["y"]})
        out = pd.DataFrame({"cluster": old, "to": [top(x) for x in old]})
        return out[out["cluster"] != out["to"]]

    for i in range(blocks):
        at = ranged.where(F.col("block") == i)
        for end, name in (("a", "x"), ("b", "y")):
            at = at.join(label.select(F.col("node").alias(end), F.col("cluster").alias(name)), end)
        at = graph.checkpointed(at.where("x <> y").select("x", "y", "a", "b"))
        touched = at.select(F.col("x").alias("cluster")).union(at.select("y")).distinct()
        mine = held.join(touched, "cluster", "left_semi")
        met = mine.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
        rows = at.withColumn("key", none("string")).unionByName(mine.join(met, "key").select(F.col("cluster").alias("x"), none(kind).alias("y"), none(kind).alias("a"), none(kind).alias("b"), "key"))
        moved = graph.checkpointed(rows.groupBy(F.lit(i).alias("block")).applyInPandas(run, f"cluster {kind}, to {kind}"))
        follow = lambda df, moved=moved: df.join(moved, "cluster", "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to")
        before = label, held, at, moved
        label, held = graph.checkpointed(follow(label)), graph.checkpointed(follow(held))
        for df in before:
            graph.dropped(df)
    return label


#: No group, no key: those that there are have numbers from 0.
NONE = -1


def resolve_groups(members: DataFrame, exclusive: DataFrame | None = None, limit: int = 1_000_000, block: int = 1_000_000, heads: int = 16) -> DataFrame:
    """(node, cluster): what :func:`resolve_identity` gives for all pairs of nodes that share a group, without the pairs.
    members: group, node; exclusive: node, key. Nulls, and nodes that share no group, are left out.

    Links to the first node of a group would not do: where the first is kept apart from two others, these may still merge.
    Two clusters that a key keeps apart stay so, and a cluster that met a group's later nodes once need not meet them
    again. So each cluster meets a group once, in the order of its nodes, and of those with one key the ones up to
    the first that merges: about a cluster squared per group, not a node squared.

    Components of up to ``limit`` memberships are a group each, larger ones go through :func:`_groups_in_blocks`."""
    kind = dict(members.dtypes)["node"]
    m = members.where("group is not null and node is not null").select("group", "node").distinct()
    # a number for a name: what tasks hold is small, and no two names share one
    names = m.groupBy("group").agg(F.min("node").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    names = graph.checkpointed(names.withColumn("id", F.monotonically_increasing_id()))
    m = graph.checkpointed(m.join(names, "group").select(F.col("id").alias("group"), "node", "first"))
    comp = graph.checkpointed(graph.components(m.select(F.col("first").alias("src"), F.col("node").alias("dst"))))
    m = m.select("group", "node").join(comp, "node")
    held = m.sparkSession.createDataFrame([], f"component {kind}, node {kind}, key long")
    if exclusive is not None:
        # a key that one node of a component holds alone excludes nothing
        of = exclusive.where("key is not null").select("node", "key").distinct().join(comp, "node")
        keys = of.groupBy("component", "key").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        keys = graph.checkpointed(keys.withColumn("id", F.monotonically_increasing_id()))
        held = of.join(keys, ["component", "key"]).select("component", "node", F.col("id").alias("key"))
    held = graph.checkpointed(held)
    none = F.lit(NONE).cast("long")
    rows = graph.checkpointed(m.select("component", "group", "node", none.alias("key")).unionByName(held.select("component", none.alias("group"), "node", "key")))
    sizes = graph.checkpointed(rows.groupBy("component").agg(F.count("*").alias("_n")))
    small = sizes.where(F.col("_n") <= limit).select("component")
    out = rows.join(small, "component").groupBy("component").applyInPandas(_groups_at_once, f"node {kind}, cluster {kind}")
    large = sizes.where(F.col("_n") > limit).select("component")
    if large.isEmpty():
        return out
    mine = rows.join(large, "component", "left_semi")
    return out.unionByName(_groups_in_blocks(mine.where(F.col("key") == NONE).select("group", "node"), mine.where(F.col("group") == NONE).select("node", "key"), block, heads))


def _groups_at_once(f: pd.DataFrame) -> pd.DataFrame:
    """One component: rows without a key are memberships, the others a node and a key it holds."""
    held, f = f[f["group"] == NONE], f[f["key"] == NONE][["group", "node"]]
    first = held.groupby("node")["key"].min()
    f = f.assign(cluster=f["node"], key=f["node"].map(first).fillna(NONE).astype("int64") if len(held) else NONE, cut=False)
    to, _ = _groups_merged(f, held["node"], held["key"])
    return to.rename_axis("node").reset_index(name="cluster")


def _groups_merged(f: pd.DataFrame, holders: Iterable, keys: Iterable, until: object = None) -> tuple[pd.Series, object]:
    """(the clusters after their pairs merged in order, by the clusters and nodes before, the node whose pairs come next).

    f: group, node, the cluster it is in by now, a key that the cluster holds (or NONE), cut: this is the last row here of
    the group and key, but not the last there is. Stops at ``until``, or before a node whose pairs need a row that is not here.
    """
    f = f.sort_values("node")
    code, names = pd.factorize(pd.concat([f["cluster"], f["node"]]), sort=True)
    same = list(range(len(names)))  # one object per number
    above, holds, tested = same[:], {}, {}
    cluster = dict(zip((same[i] for i in code[len(f) :]), (same[i] for i in code[: len(f)]), strict=True))
    for x, key in zip(pd.Index(names).get_indexer(list(holders)), keys, strict=True):
        holds.setdefault(same[x], set()).add(int(key))
    queues, of, cuts, met = {}, {}, set(), {}
    for x, group, key, cut in zip(code[len(f) :], f["group"], f["key"], f["cut"], strict=True):
        group, key = int(group), int(key)
        queues.setdefault(group, {}).setdefault(key, []).append(same[x])
        of.setdefault(same[x], []).append(group)
        if cut:
            cuts.add((group, key))
    free, log = frozenset(), []
    edge = min((queues[g][k][-1] for g, k in cuts), default=len(names))  # later nodes may have rows that are not here

    def top(x: int) -> int:
        root = x
        while above[root] != root:
            root = above[root]
        while x != root:
            above[x], x = root, above[x]
        return root

    def pairs_of(a: int) -> bool:
        """Merges the pairs whose first is ``a``; False if a row is missing."""
        x = top(cluster[a])
        todo = [g for g in of[a] if g not in tested.get(x, free)]
        mine, heap = holds.get(x, free), []
        for g in todo:
            met[g] = met.get(g, 0) + 1
            if met[g] % 8 == 0:  # what met the group needs no meeting any more
                queues[g] = {k: [b for b in q if b > a and g not in tested.get(top(cluster[b]), free)] for k, q in queues[g].items()}
                queues[g] = {k: q for k, q in queues[g].items() if q or (g, k) in cuts}
            for k, q in queues[g].items():
                if k not in mine:
                    i = bisect_right(q, a)
                    if i < len(q):
                        heap.append((q[i], g, k, i, q))
                    elif (g, k) in cuts:
                        return False
        heapify(heap)
        while heap:
            b, g, k, i, q = heap[0]
            if k in mine:
                heappop(heap)
                continue
            y = top(cluster[b])
            if x != y:
                less, more = sorted((mine, holds.get(y, free)), key=len)
                if less.isdisjoint(more):
                    (low, high), mine = sorted((x, y)), set(more) if more is free else more
                    above[high] = low
                    log.append((low, high))
                    mine |= less
                    holds.pop(x, None), holds.pop(y, None)
                    few, many = sorted((tested.pop(x, free), tested.pop(y, free)), key=len)
                    x, holds[low], tested[low] = low, mine, set(few) if many is free else many
                    tested[low] |= few
            if k in mine:
                heappop(heap)
            elif i + 1 < len(q):
                heapreplace(heap, (q[i + 1], g, k, i + 1, q))
            elif (g, k) in cuts:
                return False
            else:
                heappop(heap)
        tested.setdefault(x, set()).update(todo)
        return True

    stop = until
    for a in of:
        if until is not None and names[a] >= until:
            break
        if a > edge:
            stop = names[a]
            break
        done = len(log)
        if not pairs_of(a):
            # the pairs of this node come with the next rows
            stop = names[a]
            above[:] = same
            for low, high in log[:done]:
                above[high] = low
            break
    return pd.Series(names[[top(x) for x in same]], index=names), stop


def _groups_in_blocks(entries: DataFrame, held: DataFrame, block: int, heads: int) -> DataFrame:
    """The clusters of :func:`resolve_groups`, of components that fit no task.

    The order is cut into blocks, one after another. A block has the groups of its nodes, about ``block`` rows: of each
    group and key the first ``heads`` nodes that are left, of each cluster its first node only, beside the keys that two of
    its clusters hold. Where these nodes do not suffice the block ends, and the next begins there. Nodes without
    a key are all read, since the first cluster that meets them takes them.
    """
    kind = dict(entries.dtypes)["node"]
    first = held.groupBy("node").agg(F.min("key").alias("key"))
    live = graph.checkpointed(entries.join(first, "node", "left").select("group", "node", F.col("node").alias("cluster"), F.coalesce("key", F.lit(NONE).cast("long")).alias("key")))
    label = graph.checkpointed(live.select("node", "cluster").distinct())
    held = graph.checkpointed(held.select(F.col("node").alias("cluster"), "key"))
    queue = Window.partitionBy("group", "key").orderBy("node")

    def run_to(until: object) -> Callable:
        def run(f: pd.DataFrame) -> pd.DataFrame:
            holds, f = f[f["group"] == NONE], f[f["group"] != NONE]
            to, stop = _groups_merged(f, holds["cluster"], holds["key"], until)
            to = to[to.index.isin(f["cluster"]) & (to.index != to)]
            return pd.DataFrame({"cluster": [*to.index.tolist(), None], "to": [*to.tolist(), stop]}, dtype=object)

        return run

    while not live.isEmpty():
        ranked = live.withColumn("_place", F.when(F.col("key") == NONE, 0).otherwise(F.row_number().over(queue))).withColumn("cut", (F.col("_place") == heads) & F.lead("node").over(queue).isNotNull())
        loaded = graph.checkpointed(ranked.where(F.col("_place") <= heads).drop("_place"))
        groups = graph.checkpointed(loaded.groupBy("group").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"))
        ranges = math.ceil(8 * (groups.agg(F.sum("n")).first()[0] or 0) / block) or 1
        dealt = groups.repartitionByRange(ranges, "first").groupBy(F.spark_partition_id().alias("_range")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        until, total = None, 0
        for r in dealt.orderBy("first").collect():  # a row per range
            if total and total + r["n"] > block:
                until = r["first"]
                break
            total += r["n"]
        now = groups if until is None else groups.where(F.col("first") < F.lit(until))
        mine = loaded.join(now.select("group"), "group", "left_semi")
        keys = held.join(mine.select("cluster").distinct(), "cluster", "left_semi")
        met = keys.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
        keys = keys.join(met, "key").select(F.lit(NONE).cast("long").alias("group"), F.col("cluster").alias("node"), "cluster", "key", F.lit(False).alias("cut"))
        rows = mine.select("group", "node", "cluster", "key", "cut").unionByName(keys)
        moved = graph.checkpointed(rows.groupBy(F.lit(0).alias("_one")).applyInPandas(run_to(until), f"cluster {kind}, to {kind}"))
        end = moved.where("cluster is null").first()
        stop = end["to"] if end else None
        if stop is not None and groups.where(F.col("first") < F.lit(stop)).isEmpty():
            heads *= 2  # not one node was done
        follow = lambda df, moved=moved: df.join(moved.where("cluster is not null"), "cluster", "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to")
        before = live, loaded, groups, label, held, moved
        label, held = graph.checkpointed(follow(label)), graph.checkpointed(follow(held))
        if stop is None:
            for df in before:
                graph.dropped(df)
            break
        left = follow(live).groupBy("group", "cluster").agg(F.min(F.struct("node", "key")).alias("m")).select("group", "m.node", "cluster", "m.key")
        live = graph.checkpointed(left.where(F.col("node") >= F.lit(stop)))
        for df in before:
            graph.dropped(df)
    return label


def attach_schedules(reps: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cluster): schedule records whose labels name physical representations of one cluster only; a record that names
    several, or none, is not attached. clusters: node, cluster; a physical representation without a row is its own."""
    named = _labelled(_sided(reps)).select("id", "side", "label")
    at = named.where("side = 'physical'").join(clusters.select(F.col("node").alias("id"), "cluster"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    per = at.groupBy("label").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    met = named.where("side = 'schedule'").join(per, "label").groupBy("id").agg(F.min("low").alias("cluster"), F.max("high").alias("high"))
    return met.where("cluster = high").select("id", "cluster")
