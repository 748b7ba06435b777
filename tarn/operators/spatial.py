"""Spatial joins and measures on a grid; points (x, y), boxes (minx, miny, maxx, maxy).

Every join meets in grid cells first, so there is no cross join; a pair that meets in several cells counts in the
cell of the lower left corner of its overlap only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def _level(size: float) -> Column:
    """The grid of a box: cells of ``size``, doubled until a cell is as wide and as high as the box. Null corners: null."""
    span = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) + F.col("minx") * 0 + F.col("miny") * 0
    return F.when(span <= size, 0).otherwise(F.ceil(F.log2(span / size)).cast("int"))


def _in_cells(boxes: DataFrame, size: float, others: list[int]) -> DataFrame:
    """A row for each cell that a box touches (four at most), in its own grid and in each wider grid of ``others``."""
    levels = F.array_union(F.array("_own"), F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("_own")))
    out = boxes.select("*", F.explode(levels).alias("_level")).withColumn("_w", F.lit(size) * F.pow(F.lit(2.0), F.col("_level")))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("_w")), F.floor(F.col(high) / F.col("_w"))))
    return out.withColumn("_cx", span("minx", "maxx")).withColumn("_cy", span("miny", "maxy"))


def box_join(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs (a_id, b_id) of boxes that overlap or touch. Both: id, minx, miny, maxx, maxy; a null corner meets nothing.

    A box lies in a grid whose cells are as large as itself, the smallest of ``size``; two boxes meet in the wider of
    their grids. So a box has at most four rows for each size of box there is, however wide it is; there are at most about
    two thousand sizes (powers of two), and mostly a few. Many small boxes in one cell of a wide box are one key, which
    adaptive execution splits, as the other side is few rows.
    """
    names = ("id", "minx", "miny", "maxx", "maxy")
    return _met(a.select(*names), b.select(*names), size).select(F.col("id").alias("a_id"), "b_id")


def _met(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """As :func:`box_join`, with all columns of ``a``, and those of the boxes of ``b`` as b_id, b_minx ..."""
    a, b = (x.withColumn("_own", _level(size)).where("_own is not null and minx <= maxx and miny <= maxy") for x in (a, b))
    levels = [[r[0] for r in x.select("_own").distinct().collect()] for x in (a, b)]  # powers of two
    left = _in_cells(a, size, levels[1])
    right = _in_cells(b, size, levels[0])
    right = right.select("_level", "_cx", "_cy", *[F.col(c).alias(f"b_{c}") for c in ("id", "minx", "miny", "maxx", "maxy", "_own")])
    met = left.join(right, ["_level", "_cx", "_cy"]).where("_level = greatest(_own, b__own) and minx <= b_maxx and b_minx <= maxx and miny <= b_maxy and b_miny <= maxy")
    own = (F.floor(F.greatest("minx", "b_minx") / F.col("_w")) == F.col("_cx")) & (F.floor(F.greatest("miny", "b_miny") / F.col("_w")) == F.col("_cy"))
    return met.where(own)


def radius_join(points: DataFrame, queries: DataFrame, r: float) -> DataFrame:
    """(query, point, distance) within ``r``. points: id, x, y; queries: id, x, y, each looked up in 3 x 3 cells."""
    p = points.select(F.col("id").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"), cell_of(F.col("x"), r).alias("_cx"), cell_of(F.col("y"), r).alias("_cy"))
    near = lambda c: F.explode(F.sequence(cell_of(F.col(c), r) - 1, cell_of(F.col(c), r) + 1))
    q = queries.select(F.col("id").alias("query"), "x", "y").withColumn("_cx", near("x")).withColumn("_cy", near("y"))
    met = q.join(p, ["_cx", "_cy"]).withColumn("distance", F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2))
    return met.where(F.col("distance") <= r).select("query", "point", "distance")


def smallest_container(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """(point, box) for the smallest box around each point; ties: the smaller id. points: id, x, y."""
    at = points.select("id", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    met = box_join(at, boxes, size).join(boxes.select(F.col("id").alias("b_id"), area.alias("a")), "b_id")
    return met.groupBy(F.col("a_id").alias("point")).agg(F.min(F.struct("a", F.col("b_id").alias("box"))).alias("m")).select("point", F.col("m.box").alias("box"))


def _corners(kind: DataFrame, ident: str) -> DataFrame:
    return kind.select(F.col("id").alias(ident), F.col("minx").alias("bx1"), F.col("miny").alias("by1"), F.col("maxx").alias("bx2"), F.col("maxy").alias("by2"))


def _bounds(segments: DataFrame) -> DataFrame:
    return segments.select("id", F.least("x1", "x2").alias("minx"), F.least("y1", "y2").alias("miny"), F.greatest("x1", "x2").alias("maxx"), F.greatest("y1", "y2").alias("maxy"))


#: Cells that the bounds of a segment are wide at most, in its own grid.
SPREAD = 8
#: Legs of a polyline that carry those before them.
FEW_LEGS = 32


def _meets(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a segment has a point in the closed box (bx1, by1, bx2, by2).

    Their bounds overlap, and the corners of the box don't all lie on one side of the segment's line: exact, as the axes
    and the line's normal are all directions that can part the two."""
    side = lambda x, y: F.signum((x2 - x1) * (F.col(y) - y1) - (y2 - y1) * (F.col(x) - x1))
    sides = [side(x, y) for x, y in (("bx1", "by1"), ("bx1", "by2"), ("bx2", "by1"), ("bx2", "by2"))]
    overlap = (F.least(x1, x2) <= F.col("bx2")) & (F.col("bx1") <= F.greatest(x1, x2)) & (F.least(y1, y2) <= F.col("by2")) & (F.col("by1") <= F.greatest(y1, y2))
    return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _segment_boxes(segments: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """The rows of ``segments`` (x1, y1, x2, y2 and any others), each with each box that it meets (box, bx1, by1, bx2, by2), once.

    A box lies in one cell, that of its lower left corner, of a grid whose cells are as large as itself; a segment in the
    cells along it of a grid of which it is SPREAD cells wide at most; two meet in the wider of their grids. The test is
    made where they meet: pairs are not shuffled, however many there are."""
    span = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    own = lambda v, unit: F.when(v <= unit, 0).otherwise(F.ceil(F.log2(v / unit)).cast("int"))
    left = segments.withColumn("_own", own(span, size * SPREAD)).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    right = _corners(boxes, "box").withColumn("_own", own(F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")), size)).where("_own is not null and bx1 <= bx2 and by1 <= by2")
    levels = [[r[0] for r in x.select("_own").distinct().collect()] for x in (left, right)]  # powers of two

    def gridded(df: DataFrame, others: list[int]) -> DataFrame:
        every = F.array_union(F.array("_own"), F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("_own")))
        return df.select("*", F.explode(every).alias("_level")).withColumn("_w", F.lit(size) * F.pow(F.lit(2.0), F.col("_level")))

    left, w = gridded(left, levels[1]), F.col("_w")
    # the boxes of a cell reach into the next one; a millionth of a cell is for rounding
    along = lambda p, q: F.explode(F.sequence(F.floor(F.least(p, q) / w - 1.000001).cast("long"), F.floor(F.greatest(p, q) / w + 0.000001).cast("long")))
    left = left.withColumn("_cx", along("x1", "x2")).withColumn("_cy", along("y1", "y2"))
    side = lambda i, j: (F.col("x2") - F.col("x1")) * ((F.col("_cy") + j) * w - F.col("y1")) - (F.col("y2") - F.col("y1")) * ((F.col("_cx") + i) * w - F.col("x1"))
    sides = [side(i, j) for i in (-0.000001, 2.000001) for j in (-0.000001, 2.000001)]
    left = left.where((F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)).drop("_w")
    right = gridded(right, levels[0]).select("_level", F.floor(F.col("bx1") / w).cast("long").alias("_cx"), F.floor(F.col("by1") / w).cast("long").alias("_cy"), "box", "bx1", "by1", "bx2", "by2", F.col("_own").alias("_other"))
    met = left.join(right, ["_level", "_cx", "_cy"]).where((F.col("_level") == F.greatest("_own", "_other")) & _meets(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    return met.drop("_level", "_cx", "_cy", "_own", "_other")


def segment_box_join(segments: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """(segment, box) where a point of the segment lies in the closed box. segments: id (unique), x1, y1, x2, y2."""
    return _segment_boxes(segments.select("id", "x1", "y1", "x2", "y2"), boxes, size).select(F.col("id").alias("segment"), "box")


def _each_leg() -> Column:
    """The legs of a row's polyline (points, closed): array<struct<at, p, q>>."""
    n = F.size("points")
    to = lambda i: F.get("points", F.when(i + 1 < n, i + 1).otherwise(F.lit(0)))
    last = F.when(n == 1, 1).otherwise(n - 1 + (F.coalesce(F.col("closed"), F.lit(False)) & (n > 2)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(i.alias("at"), F.get("points", i).alias("p"), F.when(n == 1, F.get("points", F.lit(0))).otherwise(to(i)).alias("q")))


def legs(lines: DataFrame) -> DataFrame:
    """(line, id, x1, y1, x2, y2) of polylines (id, points array<struct<x, y>>, closed): the legs between neighbouring
    points, of closed ones also from the last to the first; a line of one point has one leg without length. id: line and
    place, as a struct."""
    rows = lines.where(F.size("points") > 0).select(F.col("id").alias("line"), F.explode(_each_leg()).alias("e"))
    return rows.select("line", F.struct("line", "e.at").alias("id"), F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def winding(points: Column, x: Column, y: Column) -> Column:
    """How often a closed ring goes around (x, y), 0 outside of it."""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))

    def step(p: Column, q: Column) -> Column:
        left = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return F.when((p["y"] <= y) & (q["y"] > y) & (left > 0), 1).when((p["y"] > y) & (q["y"] <= y) & (left < 0), -1).otherwise(0)

    return F.aggregate(F.zip_with(points, turned, step), F.lit(0), lambda s, v: s + v)


def line_box_join(lines: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """(line, box) where a polyline (id, points, closed) meets the closed box: a leg does, or the box lies inside a closed
    line. Legs meet boxes one by one, so a long line is no wide box.

    A pair is given where its first leg meets the box: a leg carries those before it, so pairs are neither shuffled nor
    held to find equal ones. Legs of lines of more than FEW_LEGS carry none; the pairs of these are made distinct."""
    each = _each_leg()
    meets = lambda e: F.coalesce(_meets(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]), F.lit(False))
    some = lines.where(F.size("points") > 0).select(F.col("id").alias("line"), each.alias("legs"))
    few = some.where(F.size("legs") <= FEW_LEGS).select("line", F.posexplode("legs").alias("_at", "e"), "legs").withColumn("legs", F.slice("legs", F.lit(1), F.col("_at")))
    many = some.where(F.size("legs") > FEW_LEGS).select("line", F.explode("legs").alias("e"))
    ends = [F.col(f"e.{p}.{c}").alias(f"{c}{n}") for n, p in ((1, "p"), (2, "q")) for c in ("x", "y")]
    crossed = _segment_boxes(few.select("line", *ends, "legs"), boxes, size).where(~F.exists("legs", meets)).select("line", "box")
    if not many.isEmpty():
        crossed = crossed.unionByName(_segment_boxes(many.select("line", *ends), boxes, size).select("line", "box").distinct())
    x, y = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    rings = lines.where(F.col("closed") & (F.size("points") > 2))
    around = rings.select("id", F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy"), "points", each.alias("legs"))
    # what no leg meets lies inside the line's bounds as a whole
    inside = _met(around, boxes, size).where("minx <= b_minx and b_maxx <= maxx and miny <= b_miny and b_maxy <= maxy")
    inside = inside.select("id", "points", "legs", "b_id", *[F.col(f"b_{c}").alias(n) for c, n in (("minx", "bx1"), ("miny", "by1"), ("maxx", "bx2"), ("maxy", "by2"))])
    inside = inside.where(~F.exists("legs", meets)).where(winding(F.col("points"), F.col("bx1"), F.col("by1")) != 0)
    return crossed.unionByName(inside.select(F.col("id").alias("line"), F.col("b_id").alias("box")))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    at = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / square, F.lit(0.0)), F.lit(1.0)))
    return F.sqrt((x - x1 - at * dx) ** 2 + (y - y1 - at * dy) ** 2)


def _cells_along(each: DataFrame, w: float) -> DataFrame:
    """Legs (x1, y1, x2, y2) with each cell (_cx, _cy) of the grid ``w`` that they touch; a few cells that they only come
    close to may be among them."""
    dx, slack = F.col("x2") - F.col("x1"), w * 1e-6
    column = F.sequence(F.floor((F.least("x1", "x2") - slack) / w).cast("long"), F.floor((F.greatest("x1", "x2") + slack) / w).cast("long"))
    at = lambda x, other: F.when(dx == 0, F.lit(other)).otherwise(F.least(F.greatest((x - F.col("x1")) / dx, F.lit(0.0)), F.lit(1.0)))
    y = lambda x, other: F.col("y1") + at(x, other) * (F.col("y2") - F.col("y1"))
    ya, yb = y(F.col("_cx") * w - slack, 0.0), y((F.col("_cx") + 1) * w + slack, 1.0)
    rows = each.select("*", F.explode(column).alias("_cx"))
    return rows.select("*", F.explode(F.sequence(F.floor((F.least(ya, yb) - slack) / w).cast("long"), F.floor((F.greatest(ya, yb) + slack) / w).cast("long"))).alias("_cy"))


def _between(w: float) -> tuple[Column, Column]:
    """Distance of (x, y) to the cell (_cx, _cy), and to its furthest corner; the cell is taken a little larger."""
    out = []
    for c, v in (("_cx", "x"), ("_cy", "y")):
        low, high = (F.col(c) - 0.001) * w, (F.col(c) + 1.001) * w
        out.append((F.greatest(low - F.col(v), F.col(v) - high, F.lit(0.0)), F.greatest(F.col(v) - low, high - F.col(v))))
    return tuple(F.sqrt(px**2 + py**2) for px, py in zip(*out, strict=True))


def nearest_lines(points: DataFrame, lines: DataFrame, start: float, tie: float = 0.0, cap: int = 1) -> DataFrame:
    """(point, distance, nearest, n_ties, targets) for every point: the distance to the nearest polyline, that line (the
    smaller id of equals), how many lie within ``tie`` of that distance, and these, by (distance, id), null if more than
    ``cap``; all null if there are no lines. points: id, x, y; lines: id, points, closed.

    Legs lie in the cells along them. A point goes down a pyramid of the cells that have legs, four times as fine each time:
    a cell is left out if another one's furthest corner, and the tie, are nearer than it. The legs of its best cell give
    a distance that the nearest line is not beyond; those of the cells within it, and the tie, are looked at. So a point
    meets the lines around its nearest one however far that is, and nothing is left out beyond some distance. The finest
    cells shrink as points grow denser, down to a thirty-second of a leg's mean length; ``start`` is their size where
    the legs have no extent. Points at one place go as one.
    """
    each = graph.checkpointed(legs(lines).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select("line", "x1", "y1", "x2", "y2"))
    ident = dict(lines.dtypes)["id"]
    long = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    low, high = (lambda c: F.min(F.least(f"{c}1", f"{c}2"))), (lambda c: F.max(F.greatest(f"{c}1", f"{c}2")))
    seen = each.agg(F.count("*").alias("n"), F.avg(long).alias("mean"), (high("x") - low("x")).alias("w"), (high("y") - low("y")).alias("h")).first()  # one row
    if not seen["n"]:
        none = {"distance": "double", "nearest": ident, "n_ties": "long", "targets": f"array<{ident}>"}
        return points.select(F.col("id").alias("point"), *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])
    at = graph.checkpointed(points.where("x is not null and y is not null").select("x", "y").distinct())
    size = max(0.6 * (seen["w"] * seen["h"] / max(at.count(), 1)) ** 0.5, seen["mean"] / 32, max(seen["w"], seen["h"]) / 2**40) or float(start)
    cells = graph.checkpointed(_cells_along(each, size))
    filled, depth = [graph.checkpointed(cells.select("_cx", "_cy").distinct())], 0
    while size * 4**depth < max(seen["w"], seen["h"]):
        depth += 1
        filled.append(filled[-1].select(F.floor(F.col("_cx") / 4).alias("_cx"), F.floor(F.col("_cy") / 4).alias("_cy")).distinct())
    top = F.array(*[F.struct(F.lit(r[0]).alias("_cx"), F.lit(r[1]).alias("_cy")) for r in filled[depth].collect()])  # nine at most
    near, far = _between(size * 4**depth)
    found = at.select("x", "y", F.explode(top).alias("c")).select("x", "y", "c.*").withColumn("_near", near).withColumn("_far", far)
    of_place = Window.partitionBy("x", "y")
    for level in range(depth - 1, -1, -1):
        near, far = _between(size * 4**level)
        known = found.select("x", "y", "_cx", "_cy", F.min("_far").over(of_place).alias("_most"), "_near").where(F.col("_near") <= F.col("_most") + tie)
        step = lambda c: F.explode(F.sequence(F.col(c) * 4, F.col(c) * 4 + 3))
        finer = known.withColumn("_i", step("_cx")).select("x", "y", "_most", F.col("_i").alias("_cx"), "_cy").withColumn("_j", step("_cy")).select("x", "y", "_most", "_cx", F.col("_j").alias("_cy"))
        finer = finer.withColumn("_near", near).withColumn("_far", far).where(F.col("_near") <= F.col("_most") + tie)
        found = graph.checkpointed(finer.join(filled[level], ["_cx", "_cy"]).select("x", "y", "_cx", "_cy", "_near", "_far"))
    distance = segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    best = found.groupBy("x", "y").agg(F.min(F.struct("_far", "_cx", "_cy")).alias("b")).select("x", "y", "b._cx", "b._cy")
    most = graph.checkpointed(best.join(cells, ["_cx", "_cy"]).groupBy("x", "y").agg(F.min(distance).alias("_most")))
    asked = found.join(most, ["x", "y"]).where(F.col("_near") <= F.col("_most") + tie).select("x", "y", "_most", "_cx", "_cy")
    met = asked.join(cells, ["_cx", "_cy"]).withColumn("d", distance).where(F.col("d") <= F.col("_most") + tie)
    met = met.groupBy("x", "y", "line").agg(F.min("d").alias("d"))
    ties = met.withColumn("distance", F.min("d").over(of_place)).where(F.col("d") <= F.col("distance") + tie)
    ties = ties.withColumn("_rank", F.row_number().over(of_place.orderBy("d", "line")))
    ties = ties.groupBy("x", "y", "distance").agg(F.count("*").alias("n_ties"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= max(cap, 1), F.struct("d", "line")))).alias("t"))
    hit = ties.select("x", "y", "distance", F.get("t", F.lit(0))["line"].alias("nearest"), "n_ties", F.when(F.col("n_ties") <= cap, F.transform("t", lambda x: x["line"])).alias("targets"))
    return points.select(F.col("id").alias("point"), "x", "y").join(hit, ["x", "y"], "left").select("point", "distance", "nearest", "n_ties", "targets")


def nearest(points: DataFrame, targets: DataFrame, far: float, start: float) -> DataFrame:
    """(point, target, distance) of the nearest target within ``far``; target null if there is none. Rings double from
    ``start``; only points without a hit go on. Ties: the smaller id. Both: id, x, y."""
    found, left, r = None, points, start
    while True:
        hit = radius_join(targets, left, min(r, far)).groupBy("query").agg(F.min(F.struct("distance", "point")).alias("m"))
        hit = graph.checkpointed(hit.select(F.col("query").alias("point"), F.col("m.point").alias("target"), F.col("m.distance").alias("distance")))
        found = hit if found is None else found.unionByName(hit)
        if r >= far:
            break
        left = left.join(hit.select(F.col("point").alias("id")), "id", "left_anti")
        r *= 2
    return points.select(F.col("id").alias("point")).join(found, "point", "left")


def distance_bucket(distance: Column, coincident: float, near: float, local: float) -> Column:
    return F.when(distance.isNull(), "no_geometry").when(distance <= coincident, "coincident").when(distance <= near, "near").when(distance <= local, "local").otherwise("far")


def _turn(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> Column:
    return F.signum((F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax)))


def segment_pairs(segments: DataFrame, size: float) -> DataFrame:
    """(a, b, kind), a < b, of segments that meet: proper, touching or collinear. segments: id, x1, y1, x2, y2."""
    boxes = _bounds(segments)
    pairs = box_join(boxes, boxes, size).where("a_id < b_id")
    p = segments.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    q = segments.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"q{c}") for c in ("x1", "y1", "x2", "y2")])
    both = pairs.join(p, "a_id").join(q, "b_id")
    o1, o2 = _turn("px1", "py1", "px2", "py2", "qx1", "qy1"), _turn("px1", "py1", "px2", "py2", "qx2", "qy2")
    o3, o4 = _turn("qx1", "qy1", "qx2", "qy2", "px1", "py1"), _turn("qx1", "qy1", "qx2", "qy2", "px2", "py2")
    both = both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), o1.alias("o1"), o2.alias("o2"), o3.alias("o3"), o4.alias("o4"))
    # their boxes overlap, so collinear ones meet
    kind = F.when(F.expr("o1 = 0 and o2 = 0"), "collinear").when(F.expr("o1 * o2 < 0 and o3 * o4 < 0"), "proper").when(F.expr("o1 * o2 <= 0 and o3 * o4 <= 0"), "touching")
    return both.select("a", "b", kind.alias("kind")).where("kind is not null")


def line_length(points: Column) -> Column:
    """Of a polyline array<struct<x, y>>."""
    step = lambda p, q: F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2)
    n = F.size(points)
    legs = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), step)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, x: s + x))


def ring_area(points: Column) -> Column:
    """Shoelace area of a closed ring (the last point joins the first)."""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    parts = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) / 2)


def translation_signature(points: Column, grid: float) -> Column:
    """SHA-256 of the points relative to the first, on a grid: equal for shifted copies."""
    first = F.get(points, 0)
    relative = F.transform(points, lambda p: F.concat_ws(",", F.bround((p["x"] - first["x"]) / grid, 0).cast("long").cast("string"), F.bround((p["y"] - first["y"]) / grid, 0).cast("long").cast("string")))
    return F.sha2(F.array_join(relative, ";"), 256)


def geometry_signature(shapes: Column, grid: float, step: float, mirror: bool = True) -> Column:
    """SHA-256 of what stays of a group of shapes (array<struct<kind, points array<struct<x, y>>>>) when it is moved,
    turned and scaled, and, with ``mirror``, mirrored: the kinds; leg lengths over their median (``grid`` at least); turns
    between legs in half circles; distances of the shapes' centres over the same median. Each is sorted and rounded to
    ``step``. Null for no shapes. Distances grow with the square of the shapes of one group, which is a symbol's size."""
    points = F.transform(shapes, lambda s: s["points"])
    drawn = F.filter(points, lambda p: F.size(p) > 0)
    ahead = lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    behind = lambda p: F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
    steps = lambda p: F.zip_with(behind(p), ahead(p), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    long = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
    vectors = F.transform(drawn, steps)
    lengths = F.array_sort(F.filter(F.flatten(F.transform(vectors, lambda vs: F.transform(vs, long))), lambda x: x > 0))

    def turn(a: Column, b: Column) -> Column:
        angle = F.atan2(a["x"] * b["y"] - a["y"] * b["x"], a["x"] * b["x"] + a["y"] * b["y"]) / 3.141592653589793
        return F.when((long(a) > 0) & (long(b) > 0), F.abs(angle) if mirror else angle)

    turns = F.array_sort(F.filter(F.flatten(F.transform(vectors, lambda vs: F.zip_with(behind(vs), ahead(vs), turn))), lambda x: x.isNotNull()))
    mean = lambda p, c: F.aggregate(p, F.lit(0.0), lambda t, q: t + q[c]) / F.size(p)
    centres = F.transform(drawn, lambda p: F.struct(mean(p, "x").alias("x"), mean(p, "y").alias("y")))
    apart = lambda a: lambda b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)
    gaps = F.flatten(F.transform(centres, lambda a, i: F.transform(F.slice(centres, i + 2, F.size(centres)), apart(a))))
    n = F.size(lengths)
    middle = (F.get(lengths, F.floor((n - 1) / 2).cast("int")) + F.get(lengths, F.floor(n / 2).cast("int"))) / 2
    scale = F.greatest(F.coalesce(middle, F.lit(grid)), F.lit(grid))
    whole = lambda values: F.array_join(F.array_sort(F.transform(values, lambda v: F.bround(v / step, 0).cast("long"))), ",")
    kinds = F.array_join(F.array_sort(F.transform(shapes, lambda s: s["kind"])), ",")
    text = F.concat_ws("|", kinds, whole(F.transform(lengths, lambda v: v / scale)), whole(turns), whole(F.transform(gaps, lambda v: v / scale)))
    return F.when(F.size(shapes) > 0, F.sha2(text, 256))


def snap_endpoints(points: DataFrame, tol: float) -> DataFrame:
    """(id, cluster, x, y): points within ``tol`` of each other, over any number of steps, share a cluster; its place is
    the member with the highest priority, then nearest to the centre, then the smallest id. points: id, x, y, priority."""
    pairs = radius_join(points, points, tol).where("query < point").select(F.col("query").alias("src"), F.col("point").alias("dst"))
    comp = graph.components(pairs, points.select(F.col("id").alias("node")))
    c = points.join(comp.withColumnRenamed("node", "id"), "id")
    w = Window.partitionBy("component")
    far = (F.col("x") - F.avg("x").over(w)) ** 2 + (F.col("y") - F.avg("y").over(w)) ** 2
    c = c.withColumn("_far", F.round(far, 12))
    best = c.groupBy("component").agg(F.min(F.struct(-F.col("priority").cast("int"), "_far", "id", "x", "y")).alias("m"))
    return c.select("id", "component").join(best, "component").select("id", F.col("component").alias("cluster"), "m.x", "m.y")


def snap_plan(endpoints: DataFrame, tol: float) -> DataFrame:
    """(id, cluster, x, y, displacement, exceeds, collapses) for each endpoint: the cluster of endpoints within ``tol`` of
    each other over any number of steps, named by its smallest id; the place it snaps to; how far that is; whether
    some member of the cluster snaps further than ``tol``; whether both ends of an open curve are in the cluster.

    The place is that of the member with priority, then nearest to the members' centre, then with the smallest sum of
    distances to all members, then the smallest id; distances are compared to nine decimals. endpoints: id, x, y,
    priority, curve, closed; null priority: none; null closed: open; a null curve collapses nothing; a null x or y: left out.

    Copies of a place are one place with a number, so a pile of endpoints is no pile of pairs. Sums of distances are only
    taken where different places are equally near to the centre, for these places alone.
    """
    ends = endpoints.where("x is not null and y is not null").withColumn("priority", F.coalesce("priority", F.lit(False)))
    rank = F.min(F.struct((~F.col("priority")).alias("late"), "id")).alias("m")
    places = graph.checkpointed(ends.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("id"), rank).select("id", "x", "y", "n", F.col("m.late").alias("late"), F.col("m.id").alias("own")))
    pairs = radius_join(places, places, tol).where("query < point").select(F.col("query").alias("src"), F.col("point").alias("dst"))
    comp = graph.components(pairs, places.select(F.col("id").alias("node")))
    at = graph.checkpointed(places.join(comp.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id").drop("id"))
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    centre = at.groupBy("cluster").agg(weighted("x").alias("mx"), weighted("y").alias("my"))
    far = F.round(F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2), 9)
    tried = at.join(centre, "cluster").withColumn("far", far)
    best = tried.groupBy("cluster").agg(F.min(F.struct("late", "far")).alias("best"))
    tied = tried.join(best, "cluster").where((F.col("late") == F.col("best.late")) & (F.col("far") == F.col("best.far"))).select("cluster", "x", "y", "own")
    tied = graph.checkpointed(tied)
    several = tied.groupBy("cluster").agg(F.count("*").alias("_n")).where("_n > 1").select("cluster")
    asked = tied.join(several, "cluster", "left_semi")
    cost = asked.join(at.select("cluster", F.col("x").alias("px"), F.col("y").alias("py"), "n"), "cluster").groupBy("cluster", "own").agg(F.sum(F.col("n") * F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)).alias("cost"))
    chosen = tied.join(cost, ["cluster", "own"], "left").groupBy("cluster").agg(F.min(F.struct(F.round(F.coalesce("cost", F.lit(0.0)), 9), "own", "x", "y")).alias("m")).select("cluster", F.col("m.x").alias("sx"), F.col("m.y").alias("sy"))
    moved = graph.checkpointed(ends.join(at.select("x", "y", "cluster"), ["x", "y"]).join(chosen, "cluster").withColumn("displacement", F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)))
    curves = moved.where(F.col("curve").isNotNull() & ~F.coalesce("closed", F.lit(False))).groupBy("cluster", "curve").agg(F.count("*").alias("_n")).where("_n > 1")
    collapsed = curves.select("cluster").distinct().withColumn("_c", F.lit(True))
    furthest = moved.groupBy("cluster").agg(F.max("displacement").alias("_far"))
    out = moved.join(furthest, "cluster").join(collapsed, "cluster", "left")
    return out.select("id", "cluster", F.col("sx").alias("x"), F.col("sy").alias("y"), "displacement", (F.col("_far") > tol).alias("exceeds"), F.coalesce("_c", F.lit(False)).alias("collapses"))


def spatial_groups(boxes: DataFrame, gap: float, size: float) -> DataFrame:
    """(node, component): boxes that overlap when each is widened by ``gap``, over any number of steps."""
    wide = boxes.select("id", (F.col("minx") - gap).alias("minx"), (F.col("miny") - gap).alias("miny"), (F.col("maxx") + gap).alias("maxx"), (F.col("maxy") + gap).alias("maxy"))
    pairs = box_join(wide, wide, size).where("a_id < b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return graph.components(pairs, boxes.select(F.col("id").alias("node")))


def cluster_1d(df: DataFrame, group: str, value: str, tol: float) -> DataFrame:
    """(group, cluster, n, middle): sorted values split where the gap exceeds ``tol``; middle is the median."""
    w = Window.partitionBy(group).orderBy(value)
    cut = df.withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(w) > tol).cast("int"), F.lit(0)))
    return cut.withColumn("cluster", F.sum("_new").over(w)).groupBy(group, "cluster").agg(F.count("*").alias("n"), F.median(value).alias("middle"))


def gap_stats(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_gap", F.col(value) - F.lag(value).over(w)).groupBy(group).agg(F.count("_gap").alias("gaps"), F.median("_gap").alias("pitch"))


def split_lines(df: DataFrame, line: str, left: str, right: str, height: str, ratio: float, *ties: Column) -> DataFrame:
    """``df`` with part: items of a line, left to right, split where the gap exceeds ratio x the larger height. Items with
    equal ends may differ in height; ``ties`` says which comes first."""
    w = Window.partitionBy(line).orderBy(left, right, *ties)
    wide = F.col(left) - F.lag(right).over(w) > ratio * F.greatest(F.col(height), F.lag(height).over(w))
    return df.withColumn("_new", F.coalesce(wide.cast("int"), F.lit(0))).withColumn("part", F.sum("_new").over(w)).drop("_new")


def query_representations(df: DataFrame, class_id: str | None = None, status: str | None = None, mode: str | None = None, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows (class_id, status, mode, minx, miny, maxx, maxy) that equal what is asked for and whose box overlaps or
    touches ``bounds``; what is None isn't asked for. A box with a null corner meets no bounds."""
    for name, wanted in (("class_id", class_id), ("status", status), ("mode", mode)):
        if wanted is not None:
            df = df.where(F.col(name) == F.lit(wanted))
    if bounds is not None:
        x1, y1, x2, y2 = bounds
        df = df.where((F.col("minx") <= x2) & (F.col("maxx") >= x1) & (F.col("miny") <= y2) & (F.col("maxy") >= y1))
    return df
