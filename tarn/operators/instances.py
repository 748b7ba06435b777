"""Nested block references expanded to instances, with affine placement.

A transform is a 4 x 4 matrix, row by row, as an array of 16 doubles; a point is a column. A level of nesting is one join
of the instances so far with the entities of their definitions; every level is saved before the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def product(a: Column, b: Column) -> Column:
    """The matrix that does ``b``, then ``a``."""
    cell = lambda n: reduce(Column.__add__, [F.get(a, (n - n % 4 + k).cast("int")) * F.get(b, (n % 4 + 4 * k).cast("int")) for k in range(4)])
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def translation(x: Column, y: Column) -> Column:
    cells = [F.lit(v) for v in IDENTITY]
    cells[3], cells[7] = x, y
    return F.array(*cells)


def placement(x: Column, y: Column, angle: Column, sx: Column, sy: Column) -> Column:
    """Scale, then turn by ``angle`` (radians, against the clock), then move."""
    cos, sin, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return F.array(cos * sx, -sin * sy, zero, x, sin * sx, cos * sy, zero, y, zero, zero, one, zero, zero, zero, zero, one)


def applied(m: Column, x: Column, y: Column) -> Column:
    """The place of (x, y) under ``m``, as a struct."""
    return F.struct((F.get(m, 0) * x + F.get(m, 1) * y + F.get(m, 3)).alias("x"), (F.get(m, 4) * x + F.get(m, 5) * y + F.get(m, 7)).alias("y"))


def expand_affine(defs: DataFrame, entities: DataFrame, max_depth: int = 32) -> tuple[DataFrame, DataFrame]:
    """What a drawing shows: (occurrences, diagnostics) of the recursive walk from the root spaces.

    defs: definition, is_root (of definitions that differ in case only, a root first, then the smallest counts). entities:
    owner, handle, target (null: an entity of its own; else a reference to that definition), matrix (null: identity), rows,
    cols, row_gap, col_gap (null: one, no gap).
    occurrences: id (the path from the root), root, owner, handle, kind (entity, reference), depth, row, col, world: the
    product of all matrices above with the reference's own and its cell's shift, which lies inside the reference's matrix;
    an entity's is that of its definition's instance.
    diagnostics: code, id (of the reference), handle. In this order: TARGET_DEFINITION_MISSING;
    MAX_NESTING_DEPTH_REACHED; CYCLIC_BLOCK_REFERENCE, if the target is on the path already. Such references are kept, and
    not walked into. Without a root there is the one row NO_ROOT_SPACE. Names compare in any case. A reference of many
    rows and columns is one row for each cell, as the result is.
    """
    key = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    defs = defs.groupBy(key("definition").alias("d")).agg(F.max(F.coalesce("is_root", F.lit(False))).alias("is_root")).where("d is not null")
    defs = checkpointed(defs)
    whole = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(0)).cast("int")
    gap = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    identity = F.array(*[F.lit(v) for v in IDENTITY])
    own = entities.select(key("owner").alias("d"), F.col("handle").cast("string").alias("handle"), key("target").alias("target"), F.coalesce("matrix", identity).alias("matrix"), whole("rows").alias("rows"), whole("cols").alias("cols"), gap("row_gap").alias("row_gap"), gap("col_gap").alias("col_gap"))
    own = checkpointed(own.where("d is not null").join(defs.select(F.col("d").alias("target"), F.lit(True).alias("known")), "target", "left"))
    level = defs.where("is_root").select(F.col("d").alias("root"), "d", F.concat(F.lit("root:"), "d").alias("path"), F.array("d").alias("above"), identity.alias("world"))
    level, found, wrong = checkpointed(level), [], []
    if level.isEmpty():
        wrong.append(level.sparkSession.range(1).select(F.lit("NO_ROOT_SPACE").alias("code"), F.lit("").alias("id"), F.lit("").alias("handle")))
    for depth in range(max_depth + 1):
        met = level.join(own, "d")
        plain = met.where("target is null").select(F.concat("path", F.lit("/ent:"), "handle").alias("id"), "root", F.col("d").alias("owner"), "handle", F.lit("entity").alias("kind"), F.lit(depth).alias("depth"), F.lit(0).alias("row"), F.lit(0).alias("col"), "world")
        cells = met.where("target is not null and rows > 0 and cols > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
        local = product(F.col("matrix"), translation(F.col("col") * F.col("col_gap"), F.col("row") * F.col("row_gap")))
        cells = cells.withColumn("local", local).withColumn("world", product(F.col("world"), F.col("local")))
        cells = cells.withColumn("id", F.concat("path", F.lit("/ref:"), "handle", F.lit("["), F.col("row").cast("string"), F.lit(","), F.col("col").cast("string"), F.lit("]")))
        issue = F.when(F.col("known").isNull(), "TARGET_DEFINITION_MISSING").when(F.lit(depth + 1 > max_depth), "MAX_NESTING_DEPTH_REACHED").when(F.array_contains("above", F.col("target")), "CYCLIC_BLOCK_REFERENCE")
        cells = checkpointed(cells.select("id", "root", F.col("d").alias("owner"), "handle", "row", "col", "world", "target", "above", issue.alias("issue")))
        found += [plain, cells.select("id", "root", "owner", "handle", F.lit("reference").alias("kind"), F.lit(depth).alias("depth"), "row", "col", "world")]
        wrong.append(cells.where("issue is not null").select(F.col("issue").alias("code"), "id", "handle"))
        level = cells.where("issue is null").select("root", F.col("target").alias("d"), F.col("id").alias("path"), F.concat("above", F.array("target")).alias("above"), "world")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, wrong)
