"""Bridges and articulation points of graphs whose components fit no task, by joins.

A spanning forest grows by each tree taking its smallest edge to another tree; its Euler tour is ranked by pointer
doubling, so that a subtree is an interval of places. The lowest and highest place that edges outside the tree reach
from an interval come from tables of doubled width. Blocks are the components of tree edges that such edges tie together.
The number of rounds grows with the logarithm of the nodes; no step groups more than the edges of a node, and orders
around a node are cut into ranges, so a hub is no single task.

Before that :func:`contracted` deals the edges into chunks of bounded size and keeps of each what other chunks can change.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, components

#: Edges of a chunk, about; and the least number of chunks.
CHUNK, LEAST = 100_000, 8


def _blocks(u: np.ndarray, v: np.ndarray, n: int) -> tuple[list[tuple[int, list[int], int]], list[int]]:
    """The biconnected blocks of a simple graph on nodes 0 to n - 1, by one depth-first search: (top, the other nodes, the
    edge from top on), a block after all blocks below it; and the root of each node's search."""
    ends, other = np.concatenate((u, v)), np.concatenate((v, u))
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    other, edge = other[order].tolist(), (order % max(len(u), 1)).tolist()
    at, low, root, held, out = first[:-1], [0] * n, [-1] * n, [], []
    place, clock = [0] * n, 0
    for start in range(n):
        if place[start]:
            continue
        clock += 1
        place[start] = low[start] = clock
        root[start] = start
        path = [(start, -1)]
        while path:
            x, via = path[-1]
            if at[x] < first[x + 1]:
                i = at[x]
                at[x] = i + 1
                y = other[i]
                if not place[y]:
                    clock += 1
                    place[y] = low[y] = clock
                    root[y] = start
                    held.append(y)
                    path.append((y, edge[i]))
                elif edge[i] != via and place[y] < low[x]:
                    low[x] = place[y]
                continue
            path.pop()
            if path:
                up = path[-1][0]
                low[up] = min(low[up], low[x])
                if low[x] >= place[up]:
                    block = [held.pop()]
                    while block[-1] != x:
                        block.append(held.pop())
                    out.append((up, block, via))
    return out, root


def _contract(f: pd.DataFrame, shared: np.ndarray) -> pd.DataFrame:
    """One chunk (u, v, m: distinct pairs, how many edges) whose nodes ``shared`` have edges elsewhere. Rows (kind, root, a,
    b, m): bridges and articulation points of the whole graph; "edge" for what stays open; "link" from a part's smallest
    node (root) to its shared nodes (b), and one row of a null b.

    A block of which one side at most leads to shared nodes hangs on the rest, so what it holds is settled. Of any other
    block count those nodes alone that lead to shared ones: edges from the two smallest to all others join them as the
    block does, whatever node is taken away.
    """
    nodes, at = np.unique(np.concatenate((f["u"].to_numpy(), f["v"].to_numpy())), return_inverse=True)
    u, v, m = at[: len(f)], at[len(f) :], f["m"].to_numpy()
    n = len(nodes)
    own = np.isin(nodes, shared).tolist()
    blocks, root = _blocks(u, v, n)
    below, inside, around = [int(x) for x in own], [], [0] * n
    for top, block, _ in blocks:
        inside.append(sum(below[x] for x in block))
        below[top] += inside[-1]
        around[top] += 1
        for x in block:
            around[x] += 1
    rows, hung, ids = [], set(), nodes.tolist()
    for (top, block, edge), mine in zip(blocks, inside, strict=True):
        start = ids[root[top]]
        ends = sorted([x for x in block if below[x]] + ([top] if below[root[top]] > mine else []))
        single = len(block) == 1
        if len(ends) < 2:
            hung.update(block, (top,))
            if single and m[edge] == 1:
                a, b = sorted((ids[top], ids[block[0]]))
                rows.append(("bridge", start, a, b, None))
        elif len(ends) == 2:
            rows.append(("edge", start, ids[ends[0]], ids[ends[1]], min(int(m[edge]), 2) if single else 2))
        else:
            x, y = ids[ends[0]], ids[ends[1]]
            rows += [("edge", start, one, ids[z], 2) for z in ends[2:] for one in (x, y)] + [("edge", start, x, y, 2)]
    rows += [("articulation", ids[root[x]], ids[x], None, None) for x in hung if around[x] > 1 or own[x]]
    rows += [("link", ids[x], ids[x], None, None) for x in set(root)]
    rows += [("link", ids[root[x]], ids[root[x]], ids[x], None) for x in range(n) if own[x]]
    out = pd.DataFrame(rows, columns=["kind", "root", "a", "b", "m"])
    return out.astype({"root": "int64", "a": "int64", "b": "Int64", "m": "Int64"})


def contracted(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a graph (u, v, m: distinct pairs, u < v, how many edges): what its chunks settle, what stays, and its components.

    (root, kind, a, b): bridges and articulation points; (root, u, v, m): a graph whose further ones are all that is left,
    m at most 2; (root, component): each root's component (its smallest node). Edges are dealt by their larger node, into
    about CHUNK a chunk; a chunk that a hub overfills is dealt by both nodes.
    """
    n = pairs.count()
    k = max(LEAST, -(-n // CHUNK))
    dealt = pairs.withColumn("_c", F.pmod(F.xxhash64("v"), F.lit(k)).cast("int"))
    parts = dealt.groupBy("_c").agg(F.ceil(F.count("*") / F.lit(2 * CHUNK)).cast("int").alias("_n"))
    dealt = dealt.join(F.broadcast(parts), "_c")  # a row per chunk
    dealt = checkpointed(dealt.withColumn("chunk", F.col("_c") + k * F.pmod(F.xxhash64("u"), F.col("_n"))).select("chunk", "u", "v", "m"))
    held = dealt.select("chunk", F.col("u").alias("node")).union(dealt.select("chunk", "v")).distinct()
    several = held.groupBy("node").agg(F.collect_list("chunk").alias("chunks")).where(F.size("chunks") > 1)
    shared = several.select(F.explode("chunks").alias("chunk"), "node")

    def run(f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return _contract(f, s["node"].to_numpy()) if len(f) else pd.DataFrame({"kind": [], "root": [], "a": [], "b": [], "m": []})

    out = checkpointed(dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(run, "kind string, root long, a long, b long, m long"))
    link = out.where("kind = 'link'")
    comp = components(link.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")), link.select(F.col("root").alias("node")))
    roots = checkpointed(link.select("root").distinct().join(comp.withColumnRenamed("node", "root"), "root"))
    rest = out.where("kind = 'edge'").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.least(F.sum("m"), F.lit(2)).alias("m"), F.min("root").alias("root"))
    facts = out.where("kind in ('bridge', 'articulation')").select("root", "kind", "a", "b").distinct()
    return facts, checkpointed(rest.select("root", "u", "v", "m")), roots


def next_in_order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with next: the struct of ``keys`` of the row after it, in the order of ``keys`` over the whole table (null for
    the last). The order is cut into ranges; each range's last row meets the first of the next range."""
    ranged = checkpointed(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    me = F.struct(*keys)
    first = ranged.groupBy("_range").agg(F.min(me).alias("_first"))
    after = first.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))  # a row per range
    inside = F.lead(me).over(Window.partitionBy("_range").orderBy(*keys))
    return ranged.withColumn("next", inside).join(after, "_range").withColumn("next", F.coalesce("next", "_after")).drop("_range", "_after")


def last_pointers(at: DataFrame) -> DataFrame:
    """``at`` (node, to) with every ``to`` followed until it points to itself: each round doubles the steps."""
    at = checkpointed(at)
    while True:
        on = at.select(F.col("node").alias("to"), F.col("to").alias("then"))
        further = checkpointed(at.join(on, "to").select("node", F.col("then").alias("to"), (F.col("to") != F.col("then")).alias("moved")))
        at = further.select("node", "to")
        if further.where("moved").isEmpty():
            return at


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """(u, v), u < v: edges of a spanning forest of ``pairs`` (u, v), distinct, u < v. Every round each tree takes its
    smallest edge to another tree, so the number of trees at least halves."""
    label = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().select("node", F.col("node").alias("tree"))
    label, taken, open_ = checkpointed(label), [], pairs.select("u", "v")
    while True:
        a, b = (label.select(F.col("node").alias(c), F.col("tree").alias(f"t{c}")) for c in "uv")
        open_ = checkpointed(open_.join(a, "u").join(b, "v").where("tu <> tv").select("u", "v", "tu", "tv"))
        if open_.isEmpty():
            break
        ends = open_.select(F.col("tu").alias("tree"), F.col("tv").alias("other"), "u", "v").union(open_.select("tv", "tu", "u", "v"))
        pick = checkpointed(ends.groupBy("tree").agg(F.min(F.struct("u", "v", "other")).alias("m")).select("tree", "m.u", "m.v", "m.other"))
        taken.append(pick.select("u", "v").distinct())
        # two trees that took the same edge: the smaller is the root of what hangs together
        back = pick.select(F.col("tree").alias("other"), F.col("other").alias("back"))
        to = F.when((F.col("back") == F.col("tree")) & (F.col("tree") < F.col("other")), F.col("tree")).otherwise(F.col("other"))
        roots = last_pointers(pick.join(back, "other").select(F.col("tree").alias("node"), to.alias("to")))
        label = checkpointed(label.join(roots.select(F.col("node").alias("tree"), "to"), "tree", "left").select("node", F.coalesce("to", "tree").alias("tree")))
        open_ = open_.select("u", "v")
    return reduce(DataFrame.union, taken) if taken else pairs.select("u", "v").limit(0)


def tour_places(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, parent, first, last) of every node of a forest but its roots: the places of the arcs from and to its
    parent in a tour around its tree. tree: u, v; roots: node, root."""
    arcs = tree.select(F.col("u").alias("a"), F.col("v").alias("b")).union(tree.select("v", "u"))
    around = next_in_order(arcs, "a", "b")
    first = arcs.groupBy("a").agg(F.min("b").alias("b0"))
    # after the arc (b, a) comes a's next after b, or a's first; the tour ends before the first arc of the root
    turn = around.join(first, "a").select("a", "b", F.when(F.col("next.a") == F.col("a"), F.col("next.b")).alias("on"), "b0")
    turn = turn.join(roots.select(F.col("node").alias("a"), "root"), "a")
    succ = F.coalesce("on", F.when(F.col("a") != F.col("root"), F.col("b0")))
    at = turn.select("root", F.struct(F.col("b").alias("a"), F.col("a").alias("b")).alias("arc"), F.when(succ.isNotNull(), F.struct(F.col("a"), succ.alias("b"))).alias("succ"))
    at = checkpointed(at.withColumn("left", F.when(F.col("succ").isNull(), 0).otherwise(1).cast("long")))
    while not at.where("succ is not null").isEmpty():
        on = at.select(F.col("arc").alias("succ"), F.col("succ").alias("then"), F.col("left").alias("more"))
        going = at.where("succ is not null").join(on, "succ").select("root", "arc", F.col("then").alias("succ"), (F.col("left") + F.col("more")).alias("left"))
        at = checkpointed(at.where("succ is null").unionByName(going))
    most = at.groupBy("root").agg(F.max("left").alias("most"))
    place = at.join(most, "root").select("root", F.col("arc.a").alias("a"), F.col("arc.b").alias("b"), (F.col("most") - F.col("left")).alias("place"))
    place = checkpointed(place)
    back = place.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("place").alias("last"))
    down = place.join(back, ["a", "b"]).where("place < last")
    return checkpointed(down.select("root", F.col("b").alias("node"), F.col("a").alias("parent"), F.col("place").alias("first"), "last"))


def interval_extremes(values: DataFrame, spans: DataFrame) -> DataFrame:
    """(root, node, low, high): the least ``low`` and greatest ``high`` of ``values`` (root, place, low, high: every place
    from 0 on, once) from first to last of ``spans`` (root, node, first, last). Tables of intervals of 1, 2, 4, ... places:
    two of them cover a span."""
    spans = checkpointed(spans.withColumn("k", F.floor(F.log2(F.col("last") - F.col("first") + F.lit(1.5))).cast("int")))
    top = spans.agg(F.max("k")).first()[0]  # one row
    table, out = values, []
    for k in range((top if top is not None else -1) + 1):
        if k:
            shifted = table.select("root", (F.col("place") - (1 << (k - 1))).alias("place"), F.col("low").alias("l2"), F.col("high").alias("h2"))
            table = checkpointed(table.join(shifted, ["root", "place"], "left").select("root", "place", F.least("low", "l2").alias("low"), F.greatest("high", "h2").alias("high")))
        mine = spans.where(F.col("k") == k)
        ends = mine.select("root", "node", F.explode(F.array(F.col("first"), F.col("last") - (1 << k) + 1)).alias("place"))
        out.append(checkpointed(ends.join(table, ["root", "place"]).groupBy("root", "node").agg(F.min("low").alias("low"), F.max("high").alias("high"))))
    return reduce(DataFrame.unionByName, out) if out else spans.select("root", "node", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))


def cut_facts_by_joins(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(component, kind, a, b) as :func:`tarn.operators.graph.cut_facts`, whatever the size of a component. edges: src,
    dst; comp: node, component (its smallest node)."""
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("m"))
    pairs = checkpointed(pairs)
    tree = checkpointed(spanning_forest(pairs))
    down = tour_places(tree, comp.select("node", F.col("component").alias("root")))
    root = comp.where("node = component").select(F.col("node"), F.lit(-1).cast("long").alias("first"), F.lit(1 << 62).cast("long").alias("last"))
    places = checkpointed(down.select("node", "first", "last").unionByName(root))
    # edges beside the tree: those it left out, and further ones between the same two nodes
    beside = pairs.where("m > 1").select("u", "v").unionByName(pairs.select("u", "v").join(tree, ["u", "v"], "left_anti"))
    a, b = (places.select(F.col("node").alias(c), F.col("first").alias(f"f{c}"), F.col("last").alias(f"l{c}")) for c in "uv")
    beside = checkpointed(beside.join(a, "u").join(b, "v"))
    reach = beside.select(F.col("u").alias("node"), F.col("fv").alias("to")).union(beside.select("v", "fu")).groupBy("node").agg(F.min("to").alias("to_low"), F.max("to").alias("to_high"))
    own = down.join(reach, "node", "left").select("root", F.col("first").alias("place"), F.least("first", "to_low").alias("low"), F.greatest("first", "to_high").alias("high"))
    up = down.select("root", F.col("last").alias("place"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    ends = interval_extremes(own.unionByName(up), down.select("root", "node", "first", "last"))
    facts = checkpointed(down.join(ends.drop("root"), "node"))
    bridges = facts.where("low >= first and high <= last").select(F.col("root").alias("component"), F.lit("bridge").alias("kind"), F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    # tree edges, named by their lower node, that lie on one cycle
    across = beside.where("not (fu <= fv and lv <= lu) and not (fv <= fu and lu <= lv)").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    parent = places.select(F.col("node").alias("parent"), F.col("first").alias("fp"), F.col("last").alias("lp"))
    through = facts.where("parent <> root").join(parent, "parent").where("low < fp or high > lp").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    block = components(across.unionByName(through), facts.select("node"))
    at = facts.select("root", "node", "parent").join(block, "node")
    touched = at.select("root", "node", "component").union(at.select("root", "parent", "component")).groupBy("root", "node").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    points = touched.where("low <> high").select(F.col("root").alias("component"), F.lit("articulation").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"))
    return bridges.unionByName(points)
