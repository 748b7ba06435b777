"""Positions of requirements around their root: sectors of its children, radius by origin and depth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, sectors

#: How far each origin lies from the customer's words, and relations that make the hierarchy.
ORIGINS = {"customer_stated": 1, "normalized": 2, "domain_decomposition": 3}
HIERARCHY = ["contains_requirement", "decomposes_to"]
VERSION = "initial-semantic-v1"


def places_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with place (from 0) and many (rows) within its ``keys``, in the order of ``order``. The order of the whole table
    is cut into ranges and a table of one row per range and key adds up those before, so a large group is many tasks.
    Keys are not null."""
    ranged = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = sizes.select("_range", *keys, (F.sum("_n").over(group.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("many"))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1
    out = ranged.withColumn("_at", inside).join(before, ["_range", *keys])
    return out.withColumn("place", F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def propagated(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, sector): ``assigned`` (node, sector) carried along ``edges`` (id, src, dst, ord) in passes over them in the order
    (ord, src, dst, id): an edge gives its target, if it has none yet, what its source has by then.

    A node's turn is (pass, edge): along an edge it is the source's own pass if the edge comes later in it, else the
    next. A later turn at the source is never an earlier one at the target, so relaxing smallest turns gives the turns
    of the passes, with joins of what has changed alone. Nodes of ``assigned`` keep their sector.
    """
    at = F.struct("ord", "src", "dst", "id")
    links = checkpointed(edges.where("src is not null and dst is not null").withColumn("ord", F.coalesce("ord", F.lit(0))).select(F.col("src").alias("node"), F.col("dst").alias("to"), at.alias("edge")))
    links = links.join(assigned.select(F.col("node").alias("to")), "to", "left_anti")
    turn = F.struct(F.lit(1).alias("pass"), F.lit(None).cast(links.schema["edge"].dataType).alias("edge"))
    changed = checkpointed(assigned.select("node", turn.alias("turn"), "sector"))
    best = changed.limit(0)
    while not changed.isEmpty():
        later = F.col("turn.edge").isNull() | (F.col("edge") > F.col("turn.edge"))
        reached = changed.join(links, "node").select(F.col("to").alias("node"), F.struct((F.col("turn.pass") + F.when(later, 0).otherwise(1)).alias("pass"), "edge").alias("turn"), "sector")
        first = reached.groupBy("node").agg(F.min(F.struct("turn", "sector")).alias("m")).select("node", "m.turn", "m.sector")
        old = best.select("node", F.col("turn").alias("_old"))
        changed = checkpointed(first.join(old, "node", "left").where("_old is null or turn < _old").drop("_old"))
        best = checkpointed(best.unionByName(changed).groupBy("node").agg(F.min(F.struct("turn", "sector")).alias("m")).select("node", "m.turn", "m.sector"))
    return assigned.select("node", "sector").unionByName(best.select("node", "sector"))


def assign_sectors(edges: DataFrame, root: object) -> tuple[DataFrame, int]:
    """((node, sector), number of sectors, at least 1). The root's contained children, by (ord, dst, id), open a sector
    each; what they reach over the hierarchy has the first that reaches it, the rest what :func:`propagated` gives.
    edges: id, src, dst, kind, ord; a null ord is 0."""
    e = edges.withColumn("ord", F.coalesce("ord", F.lit(0)))
    top = checkpointed(places_in_order(e.where((F.col("src") == F.lit(root)) & (F.col("kind") == HIERARCHY[0])), [], ["ord", "dst", "id"]))
    roots = top.groupBy(F.col("dst").alias("node")).agg(F.min("place").alias("ord"))
    own = sectors(roots, e.where(F.col("kind").isin(HIERARCHY)))
    return propagated(own, e), max(top.count(), 1)


def _unit(text: Column) -> Column:
    """A number from 0 to 1 that the text alone decides."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64 - 1)


def positions(nodes: DataFrame, edges: DataFrame, root: object, dimensions: int = 2) -> DataFrame:
    """(node, sector, x, y, z, radius, source, locked) of every node, rounded to six decimals.

    A stored x and y (and z, in three dimensions) stay. Else the radius is 0 for the root, and 180 by the rank of the
    origin + 55 for each level below the first; the angle lies in the node's sector, 82 % of its width shared evenly by
    its nodes of one depth in order of (smallest ord and id of an edge to it, node), the middle for one alone; without a
    sector it comes from the node's name, as does the height in three dimensions. An unknown origin has no position.

    nodes: node, origin, depth, x, y, z, locked; edges: see :func:`assign_sectors`. A null depth is 0.
    """
    sector, n = assign_sectors(edges, root)
    came = edges.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), "id")).alias("came"))
    all_ = nodes.withColumn("depth", F.coalesce("depth", F.lit(0))).join(sector, "node", "left").join(came, "node", "left")
    all_ = checkpointed(all_.withColumn("_root", F.col("node") == F.lit(root)))
    inside = all_.where("not _root and sector is not null").withColumn("_ord", F.coalesce("came.ord", F.lit(0))).withColumn("_edge", F.col("came.id"))
    middle, span = 2 * math.pi * F.col("sector") / n, 2 * math.pi / n * 0.82
    ranked = places_in_order(inside.select("node", "sector", "depth", "_ord", "_edge"), ["sector", "depth"], ["_ord", "_edge", "node"])
    ranked = ranked.select("node", F.when(F.col("many") == 1, middle).otherwise(middle - span / 2 + span * F.col("place") / (F.col("many") - 1)).alias("_in"))
    name = lambda what: _unit(F.concat(F.lit(f"{VERSION}:{what}:"), F.col("node").cast("string")))
    angle = F.when(F.col("_root"), 0.0).otherwise(F.coalesce("_in", 2 * math.pi * name("theta")))
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in ORIGINS.items() for v in kv]), F.col("origin"))
    radius = F.when(F.col("_root"), 0.0).otherwise((180 * rank + 55 * F.greatest(F.col("depth") - 1, F.lit(0))).cast("double"))
    tilt = (name("phi") * 2 - 1) * (math.pi / 8) if dimensions == 3 else F.lit(0.0)
    kept = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("z").isNotNull() if dimensions == 3 else F.lit(True))
    z = F.col("z").cast("double") if dimensions == 3 else F.lit(0.0)
    out = all_.join(ranked, "node", "left").withColumn("_angle", angle).withColumn("_radius", radius).withColumn("_tilt", tilt).withColumn("_z", z)
    far = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("_z") ** 2)
    place = lambda stored, made: F.round(F.when(kept, stored).otherwise(made), 6) + 0.0
    return out.select(
        "node",
        "sector",
        place(F.col("x"), F.col("_radius") * F.cos("_angle") * F.cos("_tilt")).alias("x"),
        place(F.col("y"), F.col("_radius") * F.sin("_angle") * F.cos("_tilt")).alias("y"),
        place(F.col("_z"), F.col("_radius") * F.sin("_tilt")).alias("z"),
        F.when(kept, F.round(far, 6)).otherwise(F.col("_radius")).alias("radius"),
        F.when(kept, "stored").otherwise(f"generated:{VERSION}").alias("source"),
        F.when(kept, F.coalesce("locked", F.lit(False))).otherwise(F.col("_root")).alias("locked"),
    )
