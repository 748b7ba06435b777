"""Queries over points, boxes, layers and versions, which embeddings, lineitem and events stand in for."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import diff as D
from ..operators import graph, identity
from ..operators import spatial as S
from ..operators import text_index as TI
from .registry import query, t

_POINTS = "points AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 1000) AS x, round(embedding[2]::DOUBLE * 1000) AS y, label FROM embeddings)"
_BOXES = _POINTS + ", boxes AS (SELECT id, x - id % 7 AS minx, y - id % 5 AS miny, x + id % 6 AS maxx, y + id % 4 AS maxy FROM points)"


def _points(spark, d):
    e = t(spark, d, "embeddings")
    r = lambda i: F.round(F.get("embedding", i).cast("double") * 1000)
    return e.select(F.col("vec_id").alias("id"), r(0).alias("x"), r(1).alias("y"), "label")


def _boxes(spark, d):
    p = _points(spark, d)
    return p.selectExpr("id", "x - id % 7 as minx", "y - id % 5 as miny", "x + id % 6 as maxx", "y + id % 4 as maxy")


@query(f"WITH {_BOXES} SELECT a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.id < b.id AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy")
def region_join(spark, d):
    b = _boxes(spark, d)
    return S.box_join(b, b, 8.0).where("a_id < b_id")


_SEGMENTS = _BOXES + ", s AS (SELECT id, x AS x1, y AS y1, x + id % 41 - 20 AS x2, y + id % 37 - 18 AS y2 FROM points), wide AS (SELECT * FROM boxes UNION ALL SELECT -1, min(x), min(y), max(x), max(y) FROM points)"
#: Does segment (x1, y1, x2, y2) meet the box's diagonal (u1, v1, u2, v2)? What crosses a box without an end in it crosses one of them.
_DIAGONAL = """(sign((x2 - x1) * (v1 - y1) - (y2 - y1) * (u1 - x1)) * sign((x2 - x1) * (v2 - y1) - (y2 - y1) * (u2 - x1)) <= 0
 AND sign((u2 - u1) * (y1 - v1) - (v2 - v1) * (x1 - u1)) * sign((u2 - u1) * (y2 - v1) - (v2 - v1) * (x2 - u1)) <= 0
 AND least(x1, x2) <= greatest(u1, u2) AND least(u1, u2) <= greatest(x1, x2) AND least(y1, y2) <= greatest(v1, v2) AND least(v1, v2) <= greatest(y1, y2))"""
_MEETS = f"""(x1 BETWEEN minx AND maxx AND y1 BETWEEN miny AND maxy OR x2 BETWEEN minx AND maxx AND y2 BETWEEN miny AND maxy
 OR {_DIAGONAL.replace("u1", "minx").replace("v1", "miny").replace("u2", "maxx").replace("v2", "maxy")} OR {_DIAGONAL.replace("u1", "minx").replace("v1", "maxy").replace("u2", "maxx").replace("v2", "miny")})"""


def _wide(spark, d):
    """The boxes, and one (-1) around all points."""
    p = _points(spark, d)
    return _boxes(spark, d).unionByName(p.selectExpr("-1L as id", "x", "y").groupBy("id").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy")))


@query(f"WITH {_SEGMENTS} SELECT s.id AS segment, b.id AS box FROM s JOIN wide b ON {_MEETS}")
def segment_region_join(spark, d):
    s = _points(spark, d).selectExpr("id", "x as x1", "y as y1", "x + id % 41 - 20 as x2", "y + id % 37 - 18 as y2")
    return S.segment_box_join(s, _wide(spark, d), 8.0)


def _lines(spark, d):
    corner = lambda x, y: f"struct({x} as x, {y} as y)"
    return _points(spark, d).selectExpr("id", f"array({corner('x', 'y')}, {corner('x + id % 83 - 41', 'y + id % 13')}, {corner('x + id % 5', 'y + id % 71 - 35')}) as points", "id % 3 = 0 as closed")


_LINES = _BOXES + """, c AS (SELECT id, x AS ax, y AS ay, x + id % 83 - 41 AS bx, y + id % 13 AS "by", x + id % 5 AS cx, y + id % 71 - 35 AS cy FROM points),
legs AS (SELECT id AS line, ax AS x1, ay AS y1, bx AS x2, "by" AS y2 FROM c UNION ALL SELECT id, bx, "by", cx, cy FROM c UNION ALL SELECT id, cx, cy, ax, ay FROM c WHERE id % 3 = 0)"""


@query(f"""WITH {_LINES}, turns AS (SELECT c.id AS line, b.id AS box, sign((bx - ax) * (miny - ay) - ("by" - ay) * (minx - ax)) AS o1, sign((cx - bx) * (miny - "by") - (cy - "by") * (minx - bx)) AS o2, sign((ax - cx) * (miny - cy) - (ay - cy) * (minx - cx)) AS o3
 FROM c JOIN boxes b ON c.id % 3 = 0 AND least(ax, bx, cx) <= minx AND minx <= greatest(ax, bx, cx) AND least(ay, "by", cy) <= miny AND miny <= greatest(ay, "by", cy))
SELECT DISTINCT line, b.id AS box FROM legs JOIN boxes b ON {_MEETS} UNION SELECT line, box FROM turns WHERE o1 = o2 AND o2 = o3 AND o1 <> 0""")
def line_region_join(spark, d):
    return S.line_box_join(_lines(spark, d), _boxes(spark, d), 8.0)


@query(f"""WITH {_LINES}, p AS (SELECT id AS point, x * 3 + 7 AS x, y * 3 - 11 AS y FROM points), g AS (SELECT * FROM legs),
q AS (SELECT point, line, min(sqrt((x - x1 - u * (x2 - x1)) ** 2 + (y - y1 - u * (y2 - y1)) ** 2)) AS d FROM (
 SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1) END AS u FROM p, g) GROUP BY 1, 2),
m AS (SELECT *, min(d) OVER (PARTITION BY point) AS best FROM q), r AS (SELECT point, best, line, d, count(*) OVER (PARTITION BY point) AS n FROM m WHERE d <= best + 0.3711)
SELECT point, round(any_value(best), 6) AS distance, any_value(n) AS n_ties, CASE WHEN any_value(n) <= 3 THEN string_agg(line::VARCHAR, ',' ORDER BY d, line) END AS targets,
 CASE WHEN any_value(best) <= 1e-9 THEN 'coincident' WHEN any_value(best) <= 1 THEN 'near' WHEN any_value(best) <= 100 THEN 'local' ELSE 'far' END AS bucket FROM r GROUP BY point""")
def nearest_geometry(spark, d):
    p = _points(spark, d).selectExpr("id", "x * 3 + 7 as x", "y * 3 - 11 as y")
    near = S.nearest_lines(p, _lines(spark, d), 8.0, tie=0.3711, cap=3)
    return near.select("point", F.round("distance", 6).alias("distance"), "n_ties", F.array_join("targets", ",").alias("targets"), S.distance_bucket(F.col("distance"), 1e-9, 1.0, 100.0).alias("bucket"))


@query(f"WITH {_POINTS} SELECT q.id AS query, p.id AS point, round(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2), 6) AS distance FROM points q JOIN points p ON q.id % 10 = 0 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2 <= 100")
def radius_join(spark, d):
    p = _points(spark, d)
    return S.radius_join(p, p.where("id % 10 = 0"), 10.0).select("query", "point", F.round("distance", 6).alias("distance"))


@query(f"WITH {_BOXES} SELECT p.id AS point, arg_min(b.id, ((maxx - minx) * (maxy - miny), b.id)) AS box FROM points p JOIN boxes b ON p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy GROUP BY 1")
def smallest_container(spark, d):
    return S.smallest_container(_points(spark, d), _boxes(spark, d), 8.0)


@query(f"""WITH {_POINTS}, m AS (SELECT q.id AS point, p.id AS target, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d FROM points q JOIN points p ON q.id % 4 = 1 AND p.id % 4 = 2 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2 <= 3600),
n AS (SELECT point, arg_min(target, (d, target)) AS target, min(d) AS d FROM m GROUP BY 1)
SELECT q.id AS point, target, CASE WHEN d IS NULL THEN 'no_geometry' WHEN d <= 1 THEN 'coincident' WHEN d <= 10 THEN 'near' WHEN d <= 30 THEN 'local' ELSE 'far' END AS bucket FROM points q LEFT JOIN n ON point = q.id WHERE q.id % 4 = 1""")
def nearest_buckets(spark, d):
    p = _points(spark, d)
    return S.nearest(p.where("id % 4 = 1"), p.where("id % 4 = 2"), 60.0, 15.0).select("point", "target", S.distance_bucket(F.col("distance"), 1.0, 10.0, 30.0).alias("bucket"))


@query(f"""WITH {_POINTS}, s AS (SELECT id, x AS x1, y AS y1, x + id % 9 - 4 AS x2, y + id % 7 - 3 AS y2 FROM points),
p AS (SELECT a.id AS a, b.id AS b, sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) AS o1, sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) AS o2,
 sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) AS o3, sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) AS o4
 FROM s a JOIN s b ON a.id < b.id AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2))
SELECT a, b, CASE WHEN o1 = 0 AND o2 = 0 THEN 'collinear' WHEN o1 * o2 < 0 AND o3 * o4 < 0 THEN 'proper' ELSE 'touching' END AS kind FROM p WHERE o1 * o2 <= 0 AND o3 * o4 <= 0 OR o1 = 0 AND o2 = 0""")
def intersect_pairs(spark, d):
    s = _points(spark, d).selectExpr("id", "x as x1", "y as y1", "x + id % 9 - 4 as x2", "y + id % 7 - 3 as y2")
    return S.segment_pairs(s, 8.0)


@query("""WITH e AS (SELECT vec_id, unnest(range(1, len(embedding) // 2)) AS i, embedding FROM embeddings)
SELECT vec_id, round(sum(sqrt((embedding[2*i+1]::DOUBLE - embedding[2*i-1]::DOUBLE) ** 2 + (embedding[2*i+2]::DOUBLE - embedding[2*i]::DOUBLE) ** 2)), 6) AS length FROM e GROUP BY 1""")
def line_lengths(spark, d):
    pts = F.transform(F.sequence(F.lit(0), F.expr("size(embedding) div 2 - 1")), lambda i: F.struct(F.get("embedding", (2 * i).cast("int")).cast("double").alias("x"), F.get("embedding", (2 * i + 1).cast("int")).cast("double").alias("y")))
    return t(spark, d, "embeddings").select("vec_id", F.round(S.line_length(pts), 6).alias("length"))


@query(f"WITH {_BOXES} SELECT id, (maxx - minx) * (maxy - miny) AS area FROM boxes")
def ring_areas(spark, d):
    b = _boxes(spark, d)
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))])
    return b.select("id", S.ring_area(ring).alias("area"))


@query(f"WITH {_BOXES} SELECT (id % 7 + id % 6)::BIGINT AS w, (id % 5 + id % 4)::BIGINT AS h, count(*) AS n FROM boxes GROUP BY 1, 2")
def shifted_shapes(spark, d):
    b = _boxes(spark, d)
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("minx", "miny"), ("maxx", "maxy"))])
    return b.groupBy(S.translation_signature(ring, 1.0).alias("s")).agg(F.first((F.col("maxx") - F.col("minx")).cast("long")).alias("w"), F.first((F.col("maxy") - F.col("miny")).cast("long")).alias("h"), F.count("*").alias("n")).drop("s")


_SNAP = f"{_POINTS}, s AS (SELECT a.id AS src, b.id AS dst FROM points a JOIN points b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4), r AS (SELECT id AS node, id AS low FROM points UNION SELECT s.dst, r.low FROM r JOIN s ON s.src = r.node WHERE r.low < s.dst)"


@query(f"WITH RECURSIVE {_SNAP} SELECT node AS id, min(low) AS cluster FROM r GROUP BY 1")
def endpoint_clusters(spark, d):
    p = _points(spark, d).withColumn("priority", F.col("id") % 5 == 0)
    return S.snap_endpoints(p, 2.0).select("id", "cluster")


@query(f"""WITH RECURSIVE {_SNAP}, c AS (SELECT points.*, id % 5 > 0 AS late, id // 2 AS curve, id % 14 < 2 AS closed, cluster FROM points JOIN (SELECT node AS id, min(low) AS cluster FROM r GROUP BY 1) USING (id)),
m AS (SELECT *, round(sqrt((x - avg(x) OVER w) ** 2 + (y - avg(y) OVER w) ** 2), 9) AS far FROM c WINDOW w AS (PARTITION BY cluster)),
k AS (SELECT a.cluster, a.id, a.x, a.y, any_value(a.late) AS late, any_value(a.far) AS far, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 9) AS cost FROM m a JOIN m b USING (cluster) GROUP BY 1, 2, 3, 4),
z AS (SELECT cluster, arg_min(struct_pack(x := x, y := y), (late, far, cost, id)) AS p FROM k GROUP BY 1),
d AS (SELECT c.*, p.x AS sx, p.y AS sy, sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2) AS displacement FROM c JOIN z USING (cluster)),
f AS (SELECT DISTINCT cluster FROM d WHERE NOT closed GROUP BY cluster, curve HAVING count(*) > 1)
SELECT id, cluster, sx AS x, sy AS y, displacement, max(displacement) OVER (PARTITION BY cluster) > 2 AS exceeds, cluster IN (SELECT cluster FROM f) AS collapses FROM d""")
def snap_plan(spark, d):
    """Where endpoints snap to, and clusters that reach too far or collapse a curve."""
    return S.snap_plan(_points(spark, d).selectExpr("id", "x", "y", "id % 5 = 0 as priority", "id div 2 as curve", "id % 14 < 2 as closed"), 2.0)


@query(f"WITH RECURSIVE {_BOXES}, s AS (SELECT a.id AS src, b.id AS dst FROM boxes a JOIN boxes b ON a.id <> b.id AND a.minx - 1 <= b.maxx + 1 AND b.minx - 1 <= a.maxx + 1 AND a.miny - 1 <= b.maxy + 1 AND b.miny - 1 <= a.maxy + 1), r AS (SELECT id AS node, id AS low FROM boxes UNION SELECT s.dst, r.low FROM r JOIN s ON s.src = r.node WHERE r.low < s.dst) SELECT node, min(low) AS component FROM r GROUP BY 1")
def spatial_groups(spark, d):
    return S.spatial_groups(_boxes(spark, d), 1.0, 8.0)


@query("""WITH c AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER w > 5 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)),
g AS (SELECT user_id, value, sum(n) OVER (PARTITION BY user_id ORDER BY value) AS cluster FROM c) SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(median(value), 6) AS middle FROM g GROUP BY 1, 2""")
def value_clusters(spark, d):
    return S.cluster_1d(t(spark, d, "events"), "user_id", "value", 5.0).withColumn("middle", F.round("middle", 6))


@query("""WITH g AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) SELECT user_id, count(g) AS gaps, round(median(g), 6) AS pitch FROM g GROUP BY 1""")
def gap_stats(spark, d):
    return S.gap_stats(t(spark, d, "events"), "user_id", "event_id", "value").withColumn("pitch", F.round("pitch", 6))


@query(f"""WITH {_BOXES}, l AS (SELECT id, floor(miny / 10) AS line, minx, maxx, maxy - miny AS h FROM boxes), n AS (SELECT *, CASE WHEN minx - lag(maxx) OVER w > 1.5 * greatest(h, lag(h) OVER w) THEN 1 ELSE 0 END AS n FROM l WINDOW w AS (PARTITION BY line ORDER BY minx, maxx))
SELECT CAST(line AS BIGINT) AS line, sum(n)::BIGINT + 1 AS parts FROM n GROUP BY 1""")
def text_line_parts(spark, d):
    b = _boxes(spark, d).withColumn("line", F.floor(F.col("miny") / 10)).withColumn("h", F.col("maxy") - F.col("miny"))
    return S.split_lines(b, "line", "minx", "maxx", "h", 1.5, F.desc("id")).groupBy("line").agg((F.max("part") + 1).alias("parts"))


# ------------------------------------------------------------------ audits


@query("""WITH m AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS o, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity > 40 THEN 'bulk' END AS r FROM lineitem),
k AS (SELECT r, row_number() OVER (PARTITION BY l_partkey, r IS NULL ORDER BY o) AS n FROM m) SELECT coalesce(r, CASE WHEN n > 1 THEN 'repeated' ELSE 'counted' END) AS reason, count(*) AS rows FROM k GROUP BY 1""")
def audited_count(spark, d):
    li = t(spark, d, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.audited_count(li, "l_partkey", {"returned": F.col("l_returnflag") == "R", "bulk": F.col("l_quantity") > 40}, "o")


@query("SELECT p_type, count(*) AS occurrences, count(DISTINCT lower(trim(p_name))) AS labels, count(p_name)::DOUBLE / count(*) AS label_coverage, count(DISTINCT lower(trim(p_name))) <> count(*) AS conflict FROM part GROUP BY 1")
def count_by_basis(spark, d):
    return A.count_by_basis(t(spark, d, "part"), "p_type", "p_name")


@query("SELECT lower(trim(p_name)) AS label, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_labels(spark, d):
    return A.duplicate_labels(t(spark, d, "part"), "p_name", "p_partkey")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'insufficient' WHEN quality >= 1 THEN 'pass' ELSE 'fail' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def threshold_check(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", A.check_threshold(F.col("quality"), 1).alias("verdict"))


@query("""WITH d AS (SELECT lower(p_brand) AS layer, count(*) AS definitions FROM part WHERE p_partkey % 9 = 0 GROUP BY 1), e AS (SELECT lower(p_brand) AS layer, count(*) AS entities, array_to_string((list(p_partkey ORDER BY p_partkey))[1:3], ',') AS samples FROM part WHERE p_size > 48 GROUP BY 1)
SELECT coalesce(d.layer, e.layer) AS layer, coalesce(definitions, 0) AS definitions, coalesce(entities, 0) AS entities, coalesce(samples, '') AS samples, CASE WHEN definitions IS NULL THEN 'undefined' WHEN entities IS NULL THEN 'unused' ELSE 'used' END AS status FROM d FULL JOIN e ON d.layer = e.layer""")
def layer_usage(spark, d):
    p = t(spark, d, "part")
    out = A.layer_usage(p.where("p_partkey % 9 = 0"), p.where("p_size > 48"), "p_brand", "p_partkey")
    return out.withColumn("samples", F.coalesce(F.array_join(F.col("samples").cast("array<string>"), ","), F.lit("")))


@query("""WITH p AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, min(p_size) AS low, max(p_size) AS high, count(*) AS numbers, count(*) FILTER (n > 1) AS duplicates, max(p_size) - min(p_size) + 1 - count(*) AS gaps, min(p_size) = 1 AS starts_at_one, max(p_size) - min(p_size) + 1 = count(*) AS contiguous FROM p GROUP BY 1""")
def sequence_audit(spark, d):
    return A.sequence_audit(t(spark, d, "part"), "p_brand", "p_size")


@query("""WITH s AS (SELECT DISTINCT p_brand, p_size FROM part), l AS (SELECT *, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS b FROM s) SELECT p_brand, b + 1 AS first, p_size - 1 AS last FROM l WHERE p_size - b > 1""")
def sequence_gaps(spark, d):
    return A.sequence_gaps(t(spark, d, "part"), "p_brand", "p_size")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 2")
def top_values(spark, d):
    return A.top_values(t(spark, d, "events"), "user_id", "event_type", 2)


@query("""SELECT 'k' AS path, count(*) AS seen, CAST(0 AS BIGINT) AS empty, count(DISTINCT user_id) AS units, (SELECT array_to_string(list(v ORDER BY v), ',') FROM (SELECT DISTINCT json_extract_string(props, '$.k') AS v FROM events ORDER BY v LIMIT 6)) AS examples FROM events""")
def key_path_profile(spark, d):
    return A.key_path_profile(t(spark, d, "events"), "props", "user_id").withColumn("examples", F.array_join("examples", ","))


@query(f"WITH {_POINTS} SELECT label, x, count(*) AS n, CASE WHEN max(y) - min(y) <= 20 THEN 'row' ELSE 'column' END AS alignment FROM points GROUP BY 1, 2 HAVING count(*) >= 2")
def repeated_shapes(spark, d):
    return A.repeated_groups(_points(spark, d), ["label", "x"], 2, "x", "y", 20.0).select("label", "x", "n", "alignment")


_FEATURES = [
    "CASE WHEN id div 5 % 5 = 4 THEN concat(id div 5, '/', id % 2) ELSE concat(id div 5, '') END AS g",
    "id",
    "CASE id div 5 % 5 WHEN 1 THEN 4.0 + id % 2 WHEN 2 THEN 10.0 * (id % 5) * (id % 5) ELSE x END AS x",
    "CASE id div 5 % 5 WHEN 0 THEN 7.0 WHEN 2 THEN 7.0 * (id % 5) * (id % 5) + id % 2 ELSE y END AS y",
]


@query(f"""WITH {_POINTS}, f AS (SELECT {", ".join(_FEATURES).replace(" div ", " // ")} FROM points),
a AS (SELECT g, count(*) AS n, max(x) - min(x) AS w, max(y) - min(y) AS h, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t, count(DISTINCT round(x / 3)) > 1 AND count(DISTINCT round(y / 3)) > 1 AS grid FROM f GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT *, CASE WHEN h <= 6 THEN x WHEN w <= 6 THEN y ELSE (x - mx) * cos(t) + (y - my) * sin(t) END AS s, abs((y - my) * cos(t) - (x - mx) * sin(t)) AS o FROM f JOIN a USING (g)),
c AS (SELECT *, lead(s) OVER (PARTITION BY g ORDER BY s, id) - s AS d FROM b),
k AS (SELECT g, any_value(n) AS n, count(*) FILTER (d > 1.5) AS steps, min(d) FILTER (d > 1.5) AS low, max(d) FILTER (d > 1.5) AS high, CASE WHEN any_value(h) <= 6 THEN 'local_x_row' WHEN any_value(w) <= 6 THEN 'local_y_column' WHEN any_value(n) = 2 THEN 'pair_spacing_only'
 WHEN max(o) <= 6 AND steps > 0 THEN 'oblique_row_in_view_plane' WHEN any_value(n) >= 4 AND any_value(grid) THEN 'local_grid_candidate' ELSE 'distributed_in_local_frame' END AS alignment FROM c GROUP BY 1)
SELECT g, n, alignment, CASE WHEN alignment[1] = 'l' AND alignment <> 'local_grid_candidate' OR alignment[1] IN ('p', 'o') THEN steps ELSE 0 END AS steps, CASE WHEN alignment NOT IN ('local_grid_candidate', 'distributed_in_local_frame') THEN round(low, 6) END AS low,
 CASE WHEN alignment NOT IN ('local_grid_candidate', 'distributed_in_local_frame') THEN round(high, 6) END AS high FROM k""")
def feature_groups(spark, d):
    """How groups of repeated features lie, with the number and the range of their spacings."""
    groups, spacings = A.feature_groups(_points(spark, d).selectExpr(*_FEATURES), ["g"], 2, 3.0)
    per = spacings.groupBy("g").agg(F.count("*").alias("steps"), F.round(F.min("spacing"), 6).alias("low"), F.round(F.max("spacing"), 6).alias("high"))
    return groups.join(per, "g", "left").select("g", "n", "alignment", F.coalesce("steps", F.lit(0)).alias("steps"), "low", "high")


@query("WITH f AS (SELECT p_name, min(p_partkey) AS src FROM part GROUP BY 1) SELECT src, p_partkey AS dst FROM part JOIN f USING (p_name) WHERE p_partkey <> src")
def identity_links(spark, d):
    return A.identity_pairs(t(spark, d, "part"), "p_partkey", "p_name")


_NESTED = """r AS (SELECT p_partkey AS u, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size FROM part),
v AS (SELECT u, 'name' AS path, 'scalar' AS k, name AS x FROM r UNION ALL SELECT u, 'dims', 'object', NULL FROM r UNION ALL SELECT u, 'dims.size', 'scalar', size::VARCHAR FROM r WHERE size % 7 > 0
 UNION ALL SELECT u, 'dims.tags', CASE WHEN size % 5 = 0 THEN 'empty' ELSE 'array' END, NULL FROM r UNION ALL SELECT u, 'dims.tags[]', 'object', NULL FROM r, (VALUES (1), (2)) WHERE size % 5 > 0
 UNION ALL SELECT u, 'dims.tags[].t', 'scalar', brand FROM r WHERE size % 5 > 0 UNION ALL SELECT u, 'dims.tags[].t', 'scalar', kind FROM r WHERE size % 5 > 0
 UNION ALL SELECT u, 'dims.tags[].odd', CASE WHEN u % 2 = 1 THEN 'scalar' ELSE 'empty' END, CASE WHEN u % 2 = 1 THEN '{"a":1}' END FROM r WHERE size % 5 > 0)"""


@query(f"""WITH {_NESTED}, d AS (SELECT path, x, row_number() OVER (PARTITION BY path ORDER BY x) AS n FROM (SELECT DISTINCT path, x FROM v WHERE k = 'scalar')), e AS (SELECT path, string_agg(x, ';' ORDER BY n) AS examples FROM d WHERE n <= 6 GROUP BY 1)
SELECT path, count(*) AS seen, count(*) FILTER (k = 'empty') AS empty, count(DISTINCT u) AS units, any_value(e.examples) AS examples FROM v LEFT JOIN e USING (path) GROUP BY path""")
def nested_key_paths(spark, d):
    """Paths below the top level of JSON made of the parts; a text that looks like JSON stays a text."""
    one = "named_struct('t', p_brand, 'odd', cast(null as string))"
    two = "named_struct('t', p_type, 'odd', if(p_partkey % 2 = 1, '{\"a\":1}', ''))"
    tags = f"slice(array({one}, {two}), 1, if(p_size % 5 = 0, 0, 2))"
    doc = f"to_json(named_struct('name', p_name, 'dims', named_struct('size', if(p_size % 7 > 0, p_size, null), 'tags', {tags})))"
    p = t(spark, d, "part").selectExpr("p_partkey as u", f"{doc} as doc")
    return A.path_profile(p, "doc", "u").withColumn("examples", F.array_join("examples", ";"))


@query(f"""WITH {_LINES}, s AS (SELECT id, [bx - ax, "by" - ay] AS v, [cx - bx, cy - "by"] AS w FROM c),
m AS (SELECT id, sqrt(v[1] ** 2 + v[2] ** 2) AS l1, sqrt(w[1] ** 2 + w[2] ** 2) AS l2, abs(atan2(v[1] * w[2] - v[2] * w[1], v[1] * w[1] + v[2] * w[2])) / pi() AS u FROM s),
q AS (SELECT id, list_sort(list_filter([l1, l2], lambda x: x > 0)) AS l, CASE WHEN l1 > 0 AND l2 > 0 THEN u END AS u FROM m),
k AS (SELECT id, list_transform(l, lambda x: round_even(x / greatest(coalesce((l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2, 0.001), 0.001) / 0.0101, 0)) AS l, round_even(u / 0.0101, 0) AS u FROM q),
g AS (SELECT *, min(id) OVER (PARTITION BY l, u) AS same FROM k) SELECT id, same, 4 AS copies, 1 AS signatures FROM g""")
def shape_signatures(spark, d):
    """Each line, a turned, a mirrored and a shifted and doubled copy have one signature; lines by it."""
    copies = {0: ("q.x", "q.y"), 1: ("-q.y", "q.x"), 2: ("-q.x", "q.y"), 3: ("2 * q.x + 11", "2 * q.y - 5")}
    lines, shapes = _lines(spark, d), None
    for n, (x, y) in copies.items():
        one = lines.select("id", F.lit(n).alias("copy"), F.expr(f"array(named_struct('kind', 3, 'points', transform(points, q -> named_struct('x', {x}, 'y', {y}))))").alias("shapes"))
        shapes = one if shapes is None else shapes.unionByName(one)
    of = shapes.select("id", S.geometry_signature(F.col("shapes"), 0.001, 0.0101).alias("s"))
    per = of.groupBy("id").agg(F.count("*").cast("int").alias("copies"), F.countDistinct("s").cast("int").alias("signatures"), F.min("s").alias("s"))
    first = per.groupBy("s").agg(F.min("id").alias("same"))
    return per.join(first, "s").select("id", "same", "copies", "signatures")


@query()
def resolve_identity(spark, d):
    """Merging in order under constraints; compared with plain Python in tests."""
    p = t(spark, d, "part")
    same = A.identity_pairs(p, "p_partkey", "p_name").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return identity.resolve_identity(same, same.where("b % 3 = 0"))


_MODE = "CASE WHEN p_size % 8 < 3 THEN 'instance_view' WHEN p_size % 8 = 3 THEN 'schematic_instance' WHEN p_size % 8 = 4 THEN 'legend_symbol' WHEN p_size % 8 = 5 THEN 'schedule_record' WHEN p_size % 8 = 6 THEN 'unknown' ELSE 'aggregated_representation' END"
_REPS = [
    "p_partkey AS id",
    "CASE WHEN p_partkey % 41 > 0 THEN p_type END AS class",
    "CASE WHEN p_partkey % 17 > 0 THEN concat(p_brand, '/', p_partkey % 50) END AS context",
    f"{_MODE} AS mode",
    "concat(p_size, '/', p_partkey % 37) AS signature",
    "CASE WHEN p_partkey % 9 > 0 THEN concat(p_name, ' ', p_partkey % 100) ELSE '' END AS name",
    "concat(' ', upper(p_brand), ' ', p_partkey % 60) AS mark",
]


def _reps(spark, d):
    return t(spark, d, "part").selectExpr(*_REPS).withColumn("labels", F.array("name", "mark")).drop("name", "mark")


_SIDES = f"""reps AS (SELECT {", ".join(_REPS)} FROM part), r AS (SELECT *, CASE WHEN mode IN ('instance_view', 'schematic_instance', 'aggregated_representation') THEN 'physical' WHEN mode = 'legend_symbol' THEN 'type' WHEN mode = 'schedule_record' THEN 'schedule' ELSE 'other' END AS side FROM reps WHERE class IS NOT NULL),
l AS (SELECT DISTINCT id, class, context, side, lower(trim(x)) AS label FROM (SELECT *, unnest([name, mark]) AS x FROM r) WHERE trim(x) <> '')"""


@query(f"""WITH {_SIDES}, g AS (SELECT DISTINCT 'represents_type' AS edge, a.class, NULL AS context, NULL AS signature, NULL AS label, unnest([a.id, b.id]) AS id, unnest([a.side, b.side]) AS side FROM r a JOIN r b ON a.class = b.class AND a.id < b.id AND (a.side = 'type' OR b.side = 'type')
UNION SELECT 'different_object_proven', a.class, a.context, NULL, NULL, unnest([a.id, b.id]), 'physical' FROM r a JOIN r b ON a.class = b.class AND a.context = b.context AND a.id < b.id AND a.side = 'physical' AND b.side = 'physical'
UNION SELECT 'same_type_only', a.class, NULL, a.signature, NULL, unnest([a.id, b.id]), unnest([a.side, b.side]) FROM r a JOIN r b ON a.class = b.class AND a.signature = b.signature AND a.id < b.id
UNION SELECT 'same_object_supported', NULL, NULL, NULL, a.label, unnest([a.id, b.id]), unnest([a.side, b.side]) FROM l a JOIN l b ON a.label = b.label AND a.side = 'schedule' AND b.side = 'physical'),
p AS (SELECT a.class, a.label FROM l a JOIN l b ON a.class = b.class AND a.label = b.label AND a.id < b.id AND a.side <> 'type' AND b.side <> 'type'
 AND NOT (a.side = 'physical' AND b.side = 'physical' AND a.context IS NOT DISTINCT FROM b.context AND a.context IS NOT NULL) AND (a.side, b.side) NOT IN (('physical', 'schedule'), ('schedule', 'physical')))
SELECT * FROM g UNION ALL SELECT 'same_object_possible', class, NULL, NULL, label, id, side FROM l SEMI JOIN p USING (class, label) WHERE side <> 'type'""")
def identity_assertions(spark, d):
    """What the rules say of pairs of representations, as groups of members."""
    return identity.assertion_groups(_reps(spark, d))


@query()
def identity_clusters(spark, d):
    """Physical representations of one name or mark merge in the order of all their pairs, but never two of one class and
    context; compared with plain Python in tests."""
    return identity.resolve_groups(_marks(spark, d).select(F.col("label").alias("group"), F.col("id").alias("node")), identity.exclusive_keys(_reps(spark, d)))


def _marks(spark, d):
    r = _reps(spark, d).where(F.col("class").isNotNull() & F.col("mode").isin(identity.PHYSICAL))
    return r.select("id", F.explode("labels").alias("label")).where("label <> ''")


def _same_marks(spark, d):
    """All pairs that share a name or mark, as the tests merge them; identity_clusters takes the groups instead."""
    m = _marks(spark, d)
    return m.select(F.col("id").alias("a"), "label").join(m.select(F.col("id").alias("b"), "label"), "label").where("a < b").select("a", "b").distinct()


@query(f"""WITH {_SIDES}, c AS (SELECT id, min(id) OVER (PARTITION BY class, context) AS cluster FROM r WHERE side = 'physical' AND context IS NOT NULL),
m AS (SELECT s.id, coalesce(c.cluster, p.id) AS cluster FROM l s JOIN l p ON s.side = 'schedule' AND p.side = 'physical' AND s.label = p.label LEFT JOIN c ON c.id = p.id)
SELECT id, min(cluster) AS cluster FROM m GROUP BY 1 HAVING count(DISTINCT cluster) = 1""")
def schedule_attachments(spark, d):
    """Schedule records with the one cluster that their labels name; here what shares class and context is a cluster."""
    reps = _reps(spark, d)
    at = reps.where(F.col("class").isNotNull() & F.col("context").isNotNull() & F.col("mode").isin(identity.PHYSICAL))
    first = at.groupBy("class", "context").agg(F.min("id").alias("cluster"))
    return identity.attach_schedules(reps, at.join(first, ["class", "context"]).select(F.col("id").alias("node"), "cluster"))


@query("""WITH t AS (SELECT doc_id, source FROM documents WHERE contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ation the')), c AS (SELECT source, count(*) AS unit_hits FROM t GROUP BY 1)
SELECT source, doc_id, unit_hits, (SELECT count(*) > 30 FROM t) AS truncated FROM t JOIN c USING (source) ORDER BY source, doc_id LIMIT 30""")
def text_search(spark, d):
    return A.search_texts(t(spark, d, "documents"), "text", "source", "doc_id", "ation the", 30)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'and')) AS t1 FROM w),
s AS (SELECT count(*) AS d, avg(n) AS m, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)
SELECT doc_id, round(ln(1 + (d - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (d - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM c, s WHERE t0 > 0 AND t1 > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def ranked_search(spark, d):
    return A.ranked_search(t(spark, d, "documents"), "doc_id", "text", ["the", "and"], 20)


_WORDS = """w AS (SELECT doc_id, lang, source, f.field, list_filter(regexp_split_to_array(strip_accents(lower(f.body)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
 FROM (SELECT *, unnest([{'field': 'title', 'body': split_part(coalesce(text, ''), chr(10), 1)}, {'field': 'text', 'body': coalesce(text, '')}, {'field': 'lang', 'body': coalesce(lang, '')}, {'field': 'source', 'body': coalesce(source, '')}]) AS f FROM documents)),
n AS (SELECT doc_id, lang, source, sum(len(w)) AS size FROM w GROUP BY 1, 2, 3), t AS (SELECT count(*) AS docs, avg(size) AS mean FROM n)"""
_SCORE = "greatest(ln((docs - n{0} + 0.5) / (n{0} + 0.5)), 1e-6) * h{0} * 2.2 / (h{0} + 1.2 * (0.25 + 0.75 * size / mean))"
_INDEXES: dict[tuple[str, str], TI.TextIndex] = {}


def _index(spark, d):
    """The index over all documents, built once in a session."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
        fields = {"title": title, "text": F.col("text"), "lang": F.col("lang"), "source": F.col("source")}
        path = f"{graph.shared_folder(spark)}/tarn/index-{uuid.uuid4().hex}"
        _INDEXES[key] = TI.build_index(t(spark, d, "documents"), "doc_id", fields, path, {"lang": F.col("lang"), "source": F.col("source")})
    return _INDEXES[key]


@query(f"""WITH {_WORDS}, h AS (SELECT doc_id, field, len(list_filter(w, lambda x: x = 'en')) AS h0, len(list_filter(w, lambda x: x = 'the')) AS h1 FROM w),
s AS (SELECT doc_id, sum(h0) AS h0, sum(h1) AS h1, list_sort(list(field) FILTER (h0 + h1 > 0)) AS matched FROM h GROUP BY 1), r AS (SELECT count(*) FILTER (h0 > 0) AS n0, count(*) FILTER (h1 > 0) AS n1 FROM s)
SELECT doc_id AS id, round({_SCORE.format(0)} + {_SCORE.format(1)}, 6) AS score, array_to_string(matched, ',') AS matched_fields FROM s JOIN n USING (doc_id), t, r WHERE h0 > 0 AND h1 > 0 ORDER BY score DESC, id LIMIT 40""")
def ranked_search_fields(spark, d):
    """Both words anywhere in four fields, best first."""
    return TI.search(_index(spark, d), "En  THE", 40).withColumn("matched_fields", F.array_join("matched_fields", ","))


@query(f"""WITH {_WORDS}, h AS (SELECT doc_id, field, len(list_filter(range(1, len(w)), lambda i: w[i] = 'la' AND w[i+1] = 'le')) AS h0, len(list_filter(w, lambda x: x = 'de')) AS h1 FROM w WHERE field IN ('text', 'title')),
s AS (SELECT doc_id, sum(h0) AS h0, sum(h1) AS h1, list_sort(list(field) FILTER (h0 + h1 > 0)) AS matched FROM h GROUP BY 1), r AS (SELECT count(*) FILTER (h0 > 0) AS n0, count(*) FILTER (h1 > 0) AS n1 FROM s)
SELECT doc_id AS id, round({_SCORE.format(0)} + {_SCORE.format(1)}, 6) AS score, array_to_string(matched, ',') AS matched_fields FROM s JOIN n USING (doc_id), t, r WHERE h0 > 0 AND h1 > 0 AND source <> 'web' ORDER BY score DESC, id LIMIT 40""")
def phrase_search(spark, d):
    """A phrase and a word, in two fields of rows that aren't from the web."""
    return TI.search(_index(spark, d), "la-le dé", 40, fields=["text", "title"], where="source <> 'web'").withColumn("matched_fields", F.array_join("matched_fields", ","))


# ------------------------------------------------------------------ versions


@query("""WITH a AS (SELECT p_name AS k, min(p_partkey) AS i FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT p_name AS k, min(p_partkey) AS i FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1 HAVING count(*) = 1) SELECT a.i AS a_id, b.i AS b_id FROM a JOIN b USING (k)""")
def stable_matches(spark, d):
    p = t(spark, d, "part")
    return D.match_stable(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 <> 1"), "p_name", "p_partkey")


@query(f"WITH {_POINTS} SELECT 100.0::DOUBLE AS dx, 50.0::DOUBLE AS dy, count(*) FILTER (id % 5 > 0)::DOUBLE / count(*) AS share, 'computed' AS status FROM points")
def alignment(spark, d):
    p = _points(spark, d).selectExpr("x as ax", "y as ay", "x + 100 + if(id % 5 = 0, 7 * (id + 1), 0) as bx", "y + 50 as by")
    return D.infer_alignment(p, 1.0)


@query(f"""WITH {_POINTS}, m AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 12 AS s FROM points a JOIN points b ON a.label = b.label AND a.id % 2 = 0 AND b.id % 2 = 1 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 144),
r AS (SELECT *, row_number() OVER wa AS ra, row_number() OVER wb AS rb, lead(s) OVER wa - s AS xa, lead(s) OVER wb - s AS xb FROM m WINDOW wa AS (PARTITION BY a_id ORDER BY s, a_id, b_id), wb AS (PARTITION BY b_id ORDER BY s, a_id, b_id))
SELECT a_id, b_id, CASE WHEN coalesce(xa, 9) <= 0.01 OR coalesce(xb, 9) <= 0.01 THEN 'ambiguous' ELSE 'matched' END AS status FROM r WHERE ra = 1 AND rb = 1""")
def fallback_matches(spark, d):
    p = _points(spark, d)
    return D.match_fallback(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["label"], 0.0, 0.0, 12.0).select("a_id", "b_id", "status")


@query("""WITH a AS (SELECT * FROM part WHERE p_partkey % 10 <> 1), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_name END AS p_name FROM part WHERE p_partkey % 10 <> 2)
SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, CASE WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_partkey IS NULL THEN 'added' WHEN a.p_size <> b.p_size THEN 'geometry' WHEN a.p_name <> b.p_name THEN 'semantic' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def version_changes(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_name")
    a, b = p.where("id % 10 <> 1"), p.where("id % 10 <> 2").selectExpr("id", "if(id % 7 = 0, p_size + 1, p_size) as p_size", "if(id % 4 = 0, 'x', p_name) as p_name")
    pairs = D.match_stable(a, b, "id")
    return D.classify_changes(pairs, a, b, {"geometry": F.col("a.p_size") != F.col("b.p_size"), "semantic": F.col("a.p_name") != F.col("b.p_name")})


@query("""WITH l AS (SELECT p_partkey AS id, p_brand AS key, CASE p_partkey % 3 WHEN 0 THEN 'geometry' WHEN 1 THEN 'unchanged' ELSE 'style' END AS c FROM part), m AS (SELECT key, min(id) AS moved FROM l WHERE c = 'geometry' GROUP BY 1) SELECT key, moved, id AS stale FROM l JOIN m USING (key) WHERE c = 'unchanged'""")
def sync_candidates(spark, d):
    p = t(spark, d, "part").selectExpr("p_partkey as id", "p_brand as key", "case p_partkey % 3 when 0 then 'geometry' when 1 then 'unchanged' else 'style' end as change")
    return D.sync_candidates(p.select("id", "change"), p.select("id", "key"))


@query("""WITH a AS (SELECT o_custkey AS k, min(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT o_custkey AS k, min(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'closed' WHEN a.s = b.s THEN 'persisting' ELSE 'state_changed' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def issue_lifecycle(spark, d):
    o = t(spark, d, "orders")
    return D.issue_lifecycle(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderstatus")


@query("""WITH r AS (SELECT p_partkey AS ref, p_brand AS code, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS sheet FROM part), d AS (SELECT p_partkey AS drawing, upper(p_brand) AS number, p_size AS sheet FROM part WHERE p_partkey % 11 = 0),
m AS (SELECT ref, count(DISTINCT drawing) AS n, count(DISTINCT d.sheet) AS s FROM r JOIN d ON upper(code) = number AND (r.sheet IS NULL OR r.sheet = d.sheet) GROUP BY 1)
SELECT r.ref, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 OR n = s THEN 'supported' ELSE 'possible' END AS status FROM r LEFT JOIN m USING (ref)""")
def drawing_references(spark, d):
    p = t(spark, d, "part")
    refs = p.selectExpr("p_partkey as ref", "p_brand as code", "if(p_partkey % 2 = 0, p_size, null) as sheet")
    return D.resolve_references(refs, p.where("p_partkey % 11 = 0").selectExpr("p_partkey as drawing", "p_brand as number", "p_size as sheet"))


@query("""WITH d AS (SELECT p_brand AS number, p_size AS sheet, p_type AS revision FROM part WHERE p_brand <> 'Brand#3')
SELECT 'duplicate_sheet' AS code, number || '/' || sheet AS value FROM d GROUP BY number, sheet HAVING count(*) > 1 UNION ALL SELECT 'several_revisions', number FROM d GROUP BY 2 HAVING count(DISTINCT revision) > 1
UNION ALL SELECT DISTINCT 'missing_drawing', p_brand FROM part WHERE p_brand NOT IN (SELECT number FROM d)""")
def drawing_set_audit(spark, d):
    p = t(spark, d, "part")
    return D.drawing_set_audit(p.where("p_brand <> 'Brand#3'").selectExpr("p_brand as number", "p_size as sheet", "p_type as revision"), p.selectExpr("p_brand as code"))


@query("""WITH i AS (SELECT p_partkey AS id, p_partkey % 20 AS drawing, p_type AS family, p_size % 5 AS m1, p_size % 3 AS m2 FROM part), l AS (SELECT DISTINCT p_partkey % 20 AS link FROM part),
m AS (SELECT link, a.id AS a_id, b.id AS b_id, (abs(a.m1 - b.m1) <= 0.5)::INT + (abs(a.m2 - b.m2) <= 0.5)::INT AS s FROM l JOIN i a ON a.drawing = link JOIN i b ON b.drawing = (link + 1) % 20 AND a.family = b.family),
r AS (SELECT *, row_number() OVER (PARTITION BY link, a_id ORDER BY s DESC, b_id) AS rn, count(*) OVER (PARTITION BY link, a_id, s) AS n FROM m)
SELECT link, a_id, b_id AS best, CASE WHEN n > 1 THEN 'possible' WHEN s = 2 THEN 'supported' ELSE 'conflicted' END AS status FROM r WHERE rn = 1""")
def interface_candidates(spark, d):
    i = t(spark, d, "part").selectExpr("p_partkey as id", "p_partkey % 20 as drawing", "p_type as family", "p_size % 5 as m1", "p_size % 3 as m2")
    links = i.selectExpr("drawing as link", "drawing as a_drawing", "(drawing + 1) % 20 as b_drawing").distinct()
    return D.compare_interfaces(links, i, i, 0.5)


@query("""WITH i AS (SELECT p_partkey AS id, p_partkey % 20 AS drawing, p_type AS kind, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'round' ELSE 'square' END AS shape, CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END AS w, (p_size % 7 + 1)::DOUBLE AS h, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice / 100 END AS dim, p_size || '/' || p_partkey % 3 AS sig FROM part),
l AS (SELECT DISTINCT drawing AS link, drawing % 3 > 0 AS supported, drawing % 2 = 0 AS comparable FROM i),
m AS (SELECT link, supported, comparable, a.id AS a_id, b.id AS b_id, (a.sig = b.sig)::INT AS same, list_filter([{'x': a.w, 'y': b.w, 'd': FALSE}, {'x': a.h, 'y': b.h, 'd': FALSE}, {'x': a.dim, 'y': b.dim, 'd': TRUE}], lambda e: e.x IS NOT NULL AND e.y IS NOT NULL) AS e
 FROM l JOIN i a ON a.drawing = link JOIN i b ON b.drawing = (link + 1) % 20 AND a.kind = b.kind AND (a.shape = '' OR b.shape = '' OR a.shape = b.shape)),
s AS (SELECT *, list_transform(e, lambda v: {'s': greatest(0, 1 - abs(v.x - v.y) / greatest(v.x, v.y, 0.1)), 'w': abs(v.x - v.y) <= greatest(0.1, 0.02 * greatest(v.x, v.y)), 'd': v.d}) AS j FROM m),
t AS (SELECT *, round((list_sum(list_transform(j, lambda v: v.s)) + same) / (len(j) + same), 9) AS score, len(list_filter(j, lambda v: v.w)) + same AS n_support, len(list_filter(j, lambda v: NOT v.w AND (v.d OR comparable))) > 0 AS conflict FROM s),
f AS (SELECT *, row_number() OVER w AS rn, round(first_value(score) OVER w - score, 11) <= 0.01 AS near FROM t WINDOW w AS (PARTITION BY link, a_id ORDER BY score DESC, b_id)),
o AS (SELECT link, a_id, string_agg(b_id, ',' ORDER BY b_id) AS others FROM f WHERE near AND rn > 1 GROUP BY 1, 2)
SELECT link, a_id, b_id AS best, CASE WHEN others IS NULL AND conflict AND supported THEN 'conflicted' WHEN others IS NULL AND NOT conflict AND score >= 0.9 AND n_support >= 2 AND supported THEN 'supported' ELSE 'possible' END AS status, score, n_support::INT AS n_support, coalesce(others, '') AS others
FROM f LEFT JOIN o USING (link, a_id) WHERE rn = 1""")
def interface_comparisons(spark, d):
    """Interfaces of linked drawings with their best counterpart: two metrics, an authored dimension, a signature."""
    i = t(spark, d, "part").selectExpr("p_partkey as id", "p_partkey % 20 as drawing", "p_type as kind", "case p_size % 4 when 0 then '' when 1 then 'round' else 'square' end as shape",
        "map('w', if(p_partkey % 3 > 0, double(p_size), null), 'h', double(p_size % 7 + 1)) as metrics", "if(p_partkey % 5 = 0, map('d', p_retailprice / 100), map()) as dimensions", "concat(p_size, '/', p_partkey % 3) as signature")
    links = i.selectExpr("drawing as link", "drawing as a_drawing", "(drawing + 1) % 20 as b_drawing", "drawing % 3 > 0 as supported", "drawing % 2 = 0 as comparable").distinct()
    return D.interface_comparisons(links, i).drop("resolution").withColumn("others", F.array_join("others", ","))


@query("""WITH q AS (SELECT p_type, p_brand, quantile_cont(p_size::DOUBLE, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM part GROUP BY 1, 2)
SELECT a.p_brand || a.p_type AS a, b.p_brand || b.p_type AS b, round((abs(a.q[1] - b.q[1]) + abs(a.q[2] - b.q[2]) + abs(a.q[3] - b.q[3]) + abs(a.q[4] - b.q[4]) + abs(a.q[5] - b.q[5])) / 5, 6) AS distance FROM q a JOIN q b ON a.p_type = b.p_type AND a.p_brand || a.p_type < b.p_brand || b.p_type""")
def view_similarity(spark, d):
    p = t(spark, d, "part").withColumn("view", F.concat("p_brand", "p_type")).withColumn("v", F.col("p_size").cast("double"))
    return D.view_similarity(p, "p_type", "view", "v", 5)


_WEIGHTS = {"distributions": {"edge": 0.3, "radial": 0.25}, "histogram": 0.2, "counts": {"edges": 0.1, "vertices": 0.1, "faces": 0.05}}
_BINS = ", ".join(f"count(*) FILTER (p_size % 5 = {i})" for i in range(5))
_SHARES = [i / 32 for i in range(33)]
_DISTANCE = "CASE WHEN a.{0} IS NULL AND b.{0} IS NULL THEN 1 WHEN a.{0} IS NULL OR b.{0} IS NULL THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(1, 34), lambda i: abs(a.{0}[i] - b.{0}[i]))) / 33) END"
_LESS = "least(a.{0}, b.{0}) / greatest(a.{0}, b.{0})"


@query(f"""WITH v AS (SELECT concat(p_brand, '/', p_type) AS view, quantile_cont(p_size / 50, {_SHARES}) FILTER (p_size % 6 > 0) AS e, quantile_cont((p_retailprice - 900) / 1200, {_SHARES}) AS r,
 count(*) AS n, count(DISTINCT p_name) AS m, count(DISTINCT p_size) AS f, [{_BINS}] AS h FROM part GROUP BY 1)
SELECT a, b, round(s, 9) AS similarity FROM (SELECT a.view AS a, b.view AS b, 0.3 * {_DISTANCE.format("e")} + 0.25 * {_DISTANCE.format("r")} + 0.2 * (list_sum(list_transform(range(1, 6), lambda i: least(a.h[i], b.h[i]))) / list_sum(list_transform(range(1, 6), lambda i: greatest(a.h[i], b.h[i]))))
 + 0.1 * {_LESS.format("n")} + 0.1 * {_LESS.format("m")} + 0.05 * {_LESS.format("f")} AS s FROM v a JOIN v b ON a.view < b.view) WHERE round(s, 9) >= 0.812345""")
def similar_views(spark, d):
    """Views (here parts of a brand and type) alike in two distributions, a histogram and three counts."""
    p = t(spark, d, "part").withColumn("view", F.concat_ws("/", "p_brand", "p_type"))
    values = p.where("p_size % 6 > 0").selectExpr("view", "'edge' as feature", "p_size / 50 as value").unionByName(p.selectExpr("view", "'radial' as feature", "(p_retailprice - 900) / 1200 as value"))
    per = p.groupBy("view").agg(F.count("*").alias("edges"), F.countDistinct("p_name").alias("vertices"), F.countDistinct("p_size").alias("faces"))
    counts = per.unpivot("view", ["edges", "vertices", "faces"], "feature", "n")
    bins = p.selectExpr("view", "string(p_size % 5) as bin", "1 as n")
    return D.similar_views(D.view_features(values, counts, bins, _WEIGHTS), _WEIGHTS, 0.812345)[0]


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS d, p_partkey % 13 = 0 AS p, p_size > 40 AS m FROM part) SELECT id, CASE WHEN p THEN 'pointed' WHEN d IN (SELECT d FROM p WHERE p) THEN 'pointed_by_other' WHEN m THEN 'in_documentation' ELSE 'unpointed' END AS coverage FROM p""")
def bom_coverage(spark, d):
    p = t(spark, d, "part").selectExpr("p_partkey as id", "p_name as definition", "p_size")
    return D.bom_coverage(p.select("id", "definition"), p.where("id % 13 = 0"), p.where("p_size > 40"))


@query(f"""WITH {_LINES}, leaf AS (SELECT line, x1, y1, x2, y2, CASE WHEN line % 6 = 5 THEN NULL WHEN line % 31 = 3 THEN -1 ELSE line END AS owner FROM legs), inst AS (SELECT id, label % 5 AS definition, x, y FROM points),
p AS (SELECT 's' AS what, id AS n, id AS segment, x * 1.5 + 3 AS x, y * 1.5 - 2 AS y FROM points WHERE label % 3 = 0 UNION ALL SELECT 'a', id, id % 90, x * 1.25, y * 1.25 FROM points),
q AS (SELECT what, n, segment, line, owner, min(sqrt((x - x1 - u * (x2 - x1)) ** 2 + (y - y1 - u * (y2 - y1)) ** 2)) AS d FROM (
 SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1) END AS u FROM p, leaf) GROUP BY ALL),
n AS (SELECT what, n, segment, arg_min(struct_pack(o := owner), (d, line)).o AS owner, min(d) AS d FROM q GROUP BY 1, 2, 3),
seg AS (SELECT n.segment, CASE WHEN d > 20.123 THEN 'anchor_unresolved' WHEN owner IS NULL THEN 'not_matchable_loose_geometry' WHEN definition IS NULL THEN 'anchor_unresolved' ELSE 'computed' END AS status, definition FROM n LEFT JOIN inst ON inst.id = owner WHERE what = 's'),
pt AS (SELECT DISTINCT segment, owner FROM n WHERE what = 'a' AND d <= 20.123 AND owner IS NOT NULL),
reg AS (SELECT id, arg_min(k, (area, k)) AS region FROM (SELECT points.id, b.id AS k, (b.maxx - b.minx) * (b.maxy - b.miny) AS area FROM points JOIN (SELECT id, x - 60 AS minx, y - 60 AS miny, x + 60 + id % 5 AS maxx, y + 60 AS maxy FROM points WHERE label % 11 = 4) b ON x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy) GROUP BY 1),
m AS (SELECT seg.segment, status, inst.id AS instance, region, CASE WHEN inst.id IS NULL THEN NULL WHEN (seg.segment, inst.id) IN (SELECT segment, owner FROM pt) THEN 1 WHEN inst.id IN (SELECT owner FROM pt) THEN 2 WHEN coalesce(region % 2 = 0, FALSE) THEN 3 ELSE 4 END AS k
 FROM seg LEFT JOIN inst ON status = 'computed' AND inst.definition = seg.definition LEFT JOIN reg ON reg.id = inst.id)
SELECT segment, status, region, count(*) FILTER (k = 1) AS pointed, count(*) FILTER (k = 2) AS pointed_by_other_item, count(*) FILTER (k = 3) AS in_documentation_region, count(*) FILTER (k = 4) AS unpointed_candidate FROM m GROUP BY 1, 2, 3""")
def instance_coverage(spark, d):
    """Coverage of a parts list from where its leaders point, by segment and view region."""
    p = _points(spark, d)
    leaves = _lines(spark, d).withColumn("owner", F.expr("case when id % 6 = 5 then null when id % 31 = 3 then -1 else id end"))
    instances = p.selectExpr("id", "label % 5 as definition", "x", "y")
    segments = p.where("label % 3 = 0").selectExpr("id as segment", "x * 1.5 + 3 as x", "y * 1.5 - 2 as y")
    annotations = p.selectExpr("id % 90 as segment", "id as annotation", "x * 1.25 as x", "y * 1.25 as y")
    regions = p.where("label % 11 = 4").selectExpr("id", "if(id % 2 = 0, 'documentation_region', 'view') as kind", "x - 60 as minx", "y - 60 as miny", "x + 60 + id % 5 as maxx", "y + 60 as maxy")
    return D.instance_coverage(segments, annotations, leaves, instances, regions, 20.123, 8.0)[1]


@query("""WITH s AS (SELECT p_brand AS g, p_partkey AS id, p_size AS l, p_size + 1 + p_partkey % 9 AS h FROM part) SELECT x.g, z.id AS parent, x.id AS first, y.id AS second FROM s x JOIN s y ON x.g = y.g AND x.h = y.l JOIN s z ON z.g = x.g AND z.l = x.l AND z.h = y.h""")
def partition_equations(spark, d):
    return D.partition_equations(t(spark, d, "part").selectExpr("p_brand as g", "p_partkey as id", "p_size as low", "p_size + 1 + p_partkey % 9 as high"), "g", 1.0)


@query(f"WITH {_POINTS} SELECT id, x - id % 7 AS minx, y - id % 5 AS miny, x + id % 6 AS maxx, y + id % 4 AS maxy FROM points WHERE label % 2 = 1 AND id % 3 = 1 AND x - id % 7 <= 90 AND x + id % 6 >= -40 AND y - id % 5 <= 60 AND y + id % 4 >= -70")
def scoped_region(spark, d):
    p = _points(spark, d).selectExpr("id", "string(label % 2) as class_id", "string(id % 3) as status", "'plan' as mode", "x - id % 7 as minx", "y - id % 5 as miny", "x + id % 6 as maxx", "y + id % 4 as maxy")
    return S.query_representations(p, "1", "1", "plan", (-40.0, -70.0, 90.0, 60.0)).drop("class_id", "status", "mode")


_ENTITY = [
    "CAST(year(l_shipdate) AS INT) AS drawing",
    "CASE l_linenumber % 4 WHEN 0 THEN 'Dimension' WHEN 1 THEN 'block_reference' WHEN 2 THEN 'line' END AS type",
    "CASE WHEN l_suppkey % 3 > 0 THEN concat(l_returnflag, l_linestatus) ELSE '' END AS layer",
    "CASE WHEN l_suppkey % 7 > 0 THEN concat('B', l_suppkey % 50) END AS name",
    "l_linenumber <> 6 AS on_sheet",
    "CASE WHEN l_quantity > 25 THEN '3 m' ELSE ' ' END AS text_override",
    "l_linenumber <> 2 AS world",
    "l_quantity AS x1",
    "l_extendedprice AS y1",
    "CASE WHEN l_tax > 0.01 THEN l_discount END AS x2",
    "l_tax AS y2",
]
_ENTITIES = f"entities AS (SELECT {', '.join(_ENTITY)} FROM lineitem)"


def _entities(spark, d):
    return t(spark, d, "lineitem").selectExpr(*_ENTITY)


@query(f"""WITH {_ENTITIES}, e AS (SELECT drawing, coalesce(lower(type), '(unknown)') AS type, CASE WHEN layer = '' THEN '(empty)' ELSE layer END AS layer, coalesce(name, '(unnamed)') AS name, on_sheet, trim(text_override) <> '' AS own FROM entities),
f AS (SELECT drawing, 'type' AS fact, type AS key, '' AS sub, NULL AS l FROM e WHERE on_sheet UNION ALL SELECT drawing, 'layer', layer, '', NULL FROM e WHERE on_sheet UNION ALL SELECT drawing, 'layer_type', layer, type, NULL FROM e WHERE on_sheet
 UNION ALL SELECT drawing, 'block', name, '', layer FROM e WHERE on_sheet AND type = 'block_reference' UNION ALL SELECT drawing, 'dimension', CASE WHEN own THEN 'override' ELSE 'geometry' END, '', NULL FROM e WHERE on_sheet AND type = 'dimension'
 UNION ALL SELECT drawing, 'definition_type', type, '', NULL FROM e WHERE NOT on_sheet),
g AS (SELECT drawing, fact, key, sub, count(*) AS n, coalesce(string_agg(DISTINCT l, ',' ORDER BY l), '') AS layers FROM f GROUP BY 1, 2, 3, 4)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY drawing, fact ORDER BY n DESC, key, sub) <= 20""")
def entity_profile(spark, d):
    return A.entity_profile(_entities(spark, d), "drawing", 20)


@query(f"WITH {_ENTITIES} SELECT drawing, count(*) AS n, min(least(x1, x2)) AS minx, min(least(y1, y2)) AS miny, max(greatest(x1, x2)) AS maxx, max(greatest(y1, y2)) AS maxy FROM entities WHERE world AND x2 IS NOT NULL GROUP BY 1")
def bounds_union(spark, d):
    return A.bounds_union(_entities(spark, d), "drawing")
