"""Graph operators as iterative joins; rounds are written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-tarn-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tarn/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a :func:`checkpointed` table that is no longer read."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def min_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of every node that a root reaches; edges: src, dst; roots: node. Only the frontier is joined."""
    seen = frontier = checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    links = edges.select("src", "dst").distinct()
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        new = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = checkpointed(seen.union(frontier)) if depth % 5 == 0 else seen.union(frontier)
    return seen


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.select("node").join(min_depth(edges, roots), "node", "left_anti")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on cycles, or between cycles: what is left when nodes without in- or out-edges are trimmed again and again."""
    rest = checkpointed(edges.select("src", "dst").distinct())
    n = rest.count()
    while n:
        sources, targets = rest.select(F.col("src").alias("dst")).distinct(), rest.select(F.col("dst").alias("src")).distinct()
        rest = checkpointed(rest.join(sources, "dst", "left_semi").join(targets, "src", "left_semi"))
        left = rest.count()
        if left == n:
            break
        n = left
    return rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that is connected; isolated ``nodes`` are their own. Large and small
    stars in turn until nothing changes."""
    e = checkpointed(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = checkpointed(large.join(least, "u").select(F.explode(pair).alias("e")).select("e.*").where("u <> v").distinct())
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    out = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    every = (every.union(nodes.select("node")) if nodes is not None else every).distinct()
    return every.join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def graph_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, cycle_rank (edges - nodes + components), isolated, dangling (degree 1),
    parallel (edges beyond the first between two nodes), self_loops."""
    e = edges.select("src", "dst")
    degree = e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    per = nodes.select("node").distinct().join(degree, "node", "full").withColumn("degree", F.coalesce("degree", F.lit(0)))
    a = per.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if(F.col("degree") == 1).alias("dangling"))
    pairs = e.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("n"))
    b = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(F.col("u") != F.col("v"), F.col("n") - 1)), F.lit(0)).alias("parallel"), F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("n"))), F.lit(0)).alias("self_loops"))
    c = components(e, nodes).agg(F.countDistinct("component").alias("components"))
    return a.crossJoin(b).crossJoin(c).withColumn("cycle_rank", F.col("edges") - F.col("nodes") + F.col("components"))  # single rows


def cut_facts(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """(component, kind, a, b): bridges (a < b) and articulation points (a, null). edges: src, dst; self-loops count
    nothing, parallel edges are no bridge. Chunks of edges are contracted first, side by side. Components of which
    up to ``most`` edges are left are searched depth first, each in one task; larger ones go by joins, with the same rows
    (see :mod:`tarn.operators.cuts`)."""
    from .cuts import contracted, cut_facts_by_joins

    ends = F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    pairs = checkpointed(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").groupBy(*ends).agg(F.count("*").alias("m")))
    settled, rest, roots = contracted(pairs)
    settled = settled.join(roots, "root").select("component", "kind", "a", "b")
    open_ = rest.join(roots, "root").select("component", F.col("u").alias("src"), F.col("v").alias("dst"), F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_i")).drop("_i")
    open_ = checkpointed(open_)
    over = checkpointed(open_.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component"))
    inside, beyond = open_, None
    if not over.isEmpty():
        inside, large = open_.join(over, "component", "left_anti"), open_.join(over, "component", "left_semi")
        # the smallest node of a component need not be among those that are left of it
        comp = checkpointed(components(large))
        of = large.select(F.col("src").alias("node"), F.col("component").alias("whole")).distinct().join(comp, "node").groupBy("component").agg(F.min("whole").alias("whole"))
        beyond = cut_facts_by_joins(large.select("src", "dst"), comp).join(of, "component").select(F.col("whole").alias("component"), "kind", "a", "b")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        adj: dict = {}
        for i, (a, b) in enumerate(zip(f["src"], f["dst"], strict=True)):
            adj.setdefault(a, []).append((b, i))
            adj.setdefault(b, []).append((a, i))
        root, order, low, rows, cut = min(adj), {}, {}, [], set()
        stack, order[root], low[root], children = [(root, -1, iter(adj[root]))], 0, 0, 0
        while stack:
            node, via, edges_ = stack[-1]
            for other, i in edges_:
                if i == via:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                else:
                    order[other] = low[other] = len(order)
                    children += node == root
                    stack.append((other, i, iter(adj[other])))
                    break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > order[up]:
                        rows.append(("bridge", min(up, node), max(up, node)))
                    if low[node] >= order[up] and up != root:
                        cut.add(up)
        if children > 1:
            cut.add(root)
        rows += [("articulation", x, None) for x in sorted(cut)]
        out = pd.DataFrame(rows, columns=["kind", "a", "b"]).astype({"b": "Int64"})
        out.insert(0, "component", f["component"].iloc[0])
        return out

    found = inside.groupBy("component").applyInPandas(run, "component long, kind string, a long, b long").unionByName(settled)
    found = found if beyond is None else found.unionByName(beyond)
    return found.distinct()  # a point may be one both inside a chunk and between chunks


def shortest_path(edges: DataFrame, start: object, end: object) -> DataFrame:
    """(step, node, edge) of a path with the fewest edges, either direction; of equal ones that whose nodes, from the
    end backwards, are smallest; of parallel edges the smallest id. No rows if there is none. edges: id, src, dst."""
    both = edges.select("src", "dst", "id").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id"))
    both = checkpointed(both.groupBy("src", "dst").agg(F.min("id").alias("edge")))
    spark = edges.sparkSession
    seen = frontier = checkpointed(spark.createDataFrame([(start, 0)], ["node", "depth"]).select(F.col("node").cast(dict(edges.dtypes)["src"]), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("parent"), F.lit(None).cast(dict(edges.dtypes)["id"]).alias("edge"), F.col("depth").cast("int")))
    depth = 0
    while not frontier.isEmpty() and frontier.where(F.col("node") == F.lit(end)).isEmpty():
        depth += 1
        step = frontier.select(F.col("node").alias("src")).join(both, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(F.col("src").alias("p"), "edge")).alias("m"))
        frontier = checkpointed(step.join(seen, "node", "left_anti").select("node", F.col("m.p").alias("parent"), F.col("m.edge").alias("edge"), F.lit(depth).alias("depth")))
        seen = checkpointed(seen.union(frontier))
    rows, node = [], end
    for _ in range(depth + 1):  # one lookup a step
        found = seen.where(F.col("node") == F.lit(node)).first()
        if not found:
            break
        rows.append((found["depth"], found["node"], found["edge"]))
        node = found["parent"]
    return spark.createDataFrame(rows[::-1], f"step int, node {dict(edges.dtypes)['src']}, edge {dict(edges.dtypes)['id']}")


def sectors(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, sector): the first root (by ``ord``) that reaches the node. roots: node, ord; edges: src, dst."""
    best = checkpointed(roots.select("node", F.col("ord").alias("sector")))
    links = edges.select("src", "dst").distinct()
    changed = best
    while not changed.isEmpty():
        new = changed.join(links, changed["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("sector").alias("sector"))
        changed = checkpointed(new.join(best.withColumnRenamed("sector", "old"), "node", "left").where("old is null or sector < old").select("node", "sector"))
        best = checkpointed(best.union(changed).groupBy("node").agg(F.min("sector").alias("sector")))
    return best


def audit_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, id): dangling ends, atomic nodes with children, other nodes without, names that repeat.
    nodes: node, name, atomic; edges: src, dst."""
    ids = nodes.select("node")
    dangling = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(ids, "node", "left_anti")
    parents = edges.select(F.col("src").alias("node")).distinct()
    name = F.regexp_replace(F.lower("name"), r"[\s\p{Punct}]+", "")
    same = nodes.withColumn("k", name).withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n > 1").select("node")
    parts = {"dangling": dangling, "atomic_with_children": nodes.where("atomic").join(parents, "node", "left_semi").select("node"), "composite_without_children": nodes.where("not atomic").join(parents, "node", "left_anti").select("node"), "duplicate_name": same}
    out = None
    for code, df in parts.items():
        one = df.select(F.lit(code).alias("code"), F.col("node").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


def radial_layout(nodes: DataFrame, depth: str, sector: str, ident: str) -> DataFrame:
    """x, y of each node: radius 180 + 55 x depth (the centre at depth 0), angle by its place in the sector order."""
    w = Window.partitionBy(depth)
    angle = 2 * 3.141592653589793 * (F.row_number().over(w.orderBy(sector, ident)) - 1) / F.count("*").over(w)
    radius = F.when(F.col(depth) == 0, F.lit(0)).otherwise(180 + 55 * F.col(depth))
    return nodes.withColumn("_a", angle).select("*", F.round(radius * F.cos("_a"), 6).alias("x"), F.round(radius * F.sin("_a"), 6).alias("y")).drop("_a")
