"""Joins of geometry, nested instances, spans, cuts of graphs and the text index against plain Python."""

import math
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.operators import cuts, graph, instances, review, spatial, text_index

BOX = "id long, minx double, miny double, maxx double, maxy double"


def test_boxes_of_all_sizes_meet(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        size = 2.0 ** rng.randint(-3, 14)
        x, y = rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)
        rows.append((i, x, y, x + size * rng.random(), y + size * rng.random()))
    rows += [(400, -1e6, -1e6, 1e6, 1e6), (401, 5.0, 5.0, 5.0, 5.0), (402, 8.0, 8.0, 16.0, 16.0), (403, 16.0, 16.0, 24.0, 24.0), (404, None, 0.0, 1.0, 1.0), (405, 3.0, 3.0, 1.0, 1.0)]
    got = sorted(map(tuple, spatial.box_join(spark.createDataFrame(rows[:250] + rows[400:], BOX), spark.createDataFrame(rows[200:], BOX), 8.0).collect()))
    fine = [r for r in rows if r[1] is not None and r[1] <= r[3]]
    want = sorted((a[0], b[0]) for a in fine if a[0] < 250 or a[0] >= 400 for b in fine if b[0] >= 200 and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert got == want


def test_a_wide_box_has_few_rows(spark):
    wide = spark.createDataFrame([(0, -1e9, -1e9, 1e9, 1e9)], BOX).withColumn("_own", spatial._level(1.0))
    assert spatial._in_cells(wide, 1.0, [0, 5, 40]).count() <= 8


def test_lines_meet_boxes(spark):
    lines = [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], True), (2, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], False), (3, [(4.5, 4.5)], False), (4, [], True), (5, [(-5.0, 5.0), (20.0, 5.5)], None)]
    boxes = [(1, 4.0, 4.0, 5.0, 6.0), (2, 9.0, 9.0, 30.0, 30.0), (3, -1.0, 4.0, 0.0, 4.5), (4, 11.0, 1.0, 12.0, 2.0)]
    df = spark.createDataFrame(lines, "id long, points array<struct<x: double, y: double>>, closed boolean")
    got = sorted(map(tuple, spatial.line_box_join(df, spark.createDataFrame(boxes, BOX), 2.0).collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (2, 2), (3, 1), (5, 1)]


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0 if dx == dy == 0 else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_nearest_lines_however_far(spark):
    rng = random.Random(3)
    lines = [(i, [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(1, 4))], rng.random() < 0.3) for i in range(60)]
    points = [(i, rng.uniform(-20, 120), rng.uniform(-20, 120)) for i in range(80)] + [(80, 1e6, -1e6), (81, None, 3.0)]
    df = spark.createDataFrame(lines, "id long, points array<struct<x: double, y: double>>, closed boolean")
    at = spark.createDataFrame(points, "id long, x double, y double")
    got = {r["point"]: (r["distance"], r["n_ties"], r["targets"]) for r in spatial.nearest_lines(at, df, 4.0, tie=2.0, cap=2).collect()}
    assert len(got) == 82 and got[81] == (None, None, None)
    for i, x, y in points[:81]:
        d = []
        for k, pts, closed in lines:
            ring = pts + pts[:1] if closed and len(pts) > 2 else pts + pts if len(pts) == 1 else pts
            d.append((min(distance((x, y), a, b) for a, b in zip(ring, ring[1:], strict=False)), k))
        best = min(d)[0]
        near = [k for v, k in sorted(d) if v <= best + 2.0]
        assert got[i][0] == pytest.approx(best) and got[i][1] == len(near) and got[i][2] == (near if len(near) <= 2 else None)
    nothing = spatial.nearest_lines(at, df.limit(0), 4.0).collect()
    assert len(nothing) == 82 and all(r["targets"] is None and r["distance"] is None for r in nothing)


def test_text_index(spark):
    rows = [(1, "The quick-brown fox", "Title one", "a"), (2, "quick fox brown", None, "a"), (3, None, "Brown, QUICK brown", "b"), (4, "Épée und quick brown", "", "b"), (5, "", "", "a")]
    df = spark.createDataFrame(rows, "id long, body string, title string, layer string")
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    text_index.build_index(df, "id", {"body": F.col("body"), "title": F.col("title")}, path, {"layer": F.col("layer")}, buckets=4)
    index = text_index.open_index(spark, path)
    ask = lambda *a, **k: [(r["id"], r["matched_fields"]) for r in text_index.search(index, *a, **k).collect()]
    assert index.docs == 5 and index.fields == ("body", "title")
    assert sorted(ask("QUICK brown")) == [(1, ["body"]), (2, ["body"]), (3, ["title"]), (4, ["body"])]
    assert sorted(ask("quick-brown")) == [(1, ["body"]), (3, ["title"]), (4, ["body"])]
    assert ask("epee") == [(4, ["body"])] and ask("quick", fields=["title"]) == [(3, ["title"])]
    assert sorted(ask("fox one")) == [(1, ["body", "title"])] and ask("quick", k=1, where="layer = 'b'")[0][0] in (3, 4)
    assert ask("nowhere quick") == []
    with pytest.raises(ValueError, match="no such fields"):
        text_index.search(index, "x", fields=["nope"])
    with pytest.raises(ValueError, match="needs a word"):
        text_index.search(index, " -- ")
    plan = text_index.search(index, "quick")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_nested_turned_grids(spark):
    quarter, one = math.pi / 2, 1.0
    entities = [("R", "a", "B", 10.0, 20.0, quarter, 2.0, 2, 3), ("b", "c", "C", 1.0, 0.0, math.pi / 6, -1.0, 1, 2), ("C", "e", None, 0.0, 0.0, 0.0, one, 1, 1), ("C", "loop", "b", 0.0, 0.0, 0.0, one, 1, 1), ("C", "gone", "Z", 0.0, 0.0, 0.0, one, 1, 1), ("C", "none", "C", 0.0, 0.0, 0.0, one, 0, 1)]
    df = spark.createDataFrame(entities, "owner string, handle string, target string, x double, y double, angle double, sx double, rows int, cols int")
    own = df.select("owner", "handle", "target", instances.placement(F.col("x"), F.col("y"), F.col("angle"), F.col("sx"), F.lit(1.0)).alias("matrix"), "rows", "cols", F.lit(7.0).alias("row_gap"), F.lit(5.0).alias("col_gap"))
    defs = spark.createDataFrame([("r", True), ("B", False), ("b", None), ("C", False), (None, True)], "definition string, is_root boolean")
    found, wrong = instances.expand_affine(defs, own, 5)
    got = {r["id"]: r for r in found.collect()}

    def local(x, y, angle, sx, row, col):
        px, py = col * 5.0 * sx, row * 7.0
        return (math.cos(angle), math.sin(angle), sx), (x + math.cos(angle) * px - math.sin(angle) * py, y + math.sin(angle) * px + math.cos(angle) * py)

    n = 0
    for i in range(2):
        for j in range(3):
            (c, s, k), (x, y) = local(10.0, 20.0, quarter, 2.0, i, j)
            for m in range(2):
                _, (u, v) = local(1.0, 0.0, math.pi / 6, -1.0, 0, m)
                want = (x + c * k * u - s * v, y + s * k * u + c * v)
                r = got[f"root:R/ref:a[{i},{j}]/ref:c[0,{m}]"]
                e = got[f"root:R/ref:a[{i},{j}]/ref:c[0,{m}]/ent:e"]
                assert (r["world"][3], r["world"][7]) == pytest.approx(want) and e["world"] == r["world"] and (e["kind"], e["depth"]) == ("entity", 2)
                n += 1
    assert n == 12 and len(got) == 6 + 12 + 12 * 3
    codes = sorted((r["code"], r["handle"]) for r in wrong.collect())
    assert codes == [("CYCLIC_BLOCK_REFERENCE", "loop")] * 12 + [("TARGET_DEFINITION_MISSING", "gone")] * 12
    cut = instances.expand_affine(defs, own, 1)[1].collect()
    assert sorted({r["code"] for r in cut}) == ["MAX_NESTING_DEPTH_REACHED", "TARGET_DEFINITION_MISSING"] or {r["code"] for r in cut} == {"MAX_NESTING_DEPTH_REACHED"}
    assert [r["code"] for r in instances.expand_affine(defs.where("not is_root"), own)[1].collect()] == ["NO_ROOT_SPACE"]


def test_cuts_by_joins_equal_the_search(spark):
    rng = random.Random(5)
    edges = [(100 * c + rng.randrange(n), 100 * c + rng.randrange(n)) for c, n, m in ((0, 30, 36), (1, 12, 30), (2, 40, 41)) for _ in range(m)]
    edges += [(500 + i, 501 + i) for i in range(20)] + [(700, 701 + i) for i in range(9)] + [(701, 702), (900, 901), (900, 901), (950, 950)]
    df = spark.createDataFrame(edges, "src long, dst long")
    a, b = (sorted(map(repr, graph.cut_facts(df, most).collect())) for most in (10**6, 0))
    assert a == b and len(a) > 30


def test_chunks_keep_only_what_others_can_change(spark):
    # 400 nodes with three edges each to 30 hubs; a node with one edge; a chain that ends in a ring
    rng = random.Random(8)
    edges = [(100 + i, h) for i in range(400) for h in rng.sample(range(30), 3)] + [(600, 3), (600, 601), (601, 602), (602, 603), (603, 601), (604, 5), (604, 5), (605, 604)]
    pairs = spark.createDataFrame([(min(e), max(e), edges.count(e)) for e in sorted(set(edges))], "u long, v long, m long")
    facts, rest, roots = cuts.contracted(pairs)
    nodes = {x for r in rest.collect() for x in (r["u"], r["v"])}
    assert len(nodes & set(range(100, 500))) < 40 and nodes >= set(range(30)) and rest.count() < len(edges) / 2
    assert {r["component"] for r in roots.collect()} == {0}
    for most in (10**6, 0):
        got = {tuple(r) for r in graph.cut_facts(spark.createDataFrame(edges, "src long, dst long"), most).collect()}
        bridges, points = {(3, 600), (600, 601), (604, 605)}, {3, 600, 601, 604, 5}
        assert got == {(0, "bridge", a, b) for a, b in bridges} | {(0, "articulation", a, None) for a in points}


def test_contracted_chunks_of_random_graphs():
    rng = random.Random(9)

    def parts(edges: list, nodes: set) -> dict:
        top = {x: x for x in nodes}

        def find(x: int) -> int:
            while top[x] != x:
                x = top[x]
            return x

        for a, b, _ in edges:
            top[find(a)] = find(b)
        return {x: find(x) for x in nodes}

    def facts(edges: list) -> set:
        nodes = {x for e in edges for x in e[:2]}
        whole = len(set(parts(edges, nodes).values()))
        out = {("bridge", e[0], e[1]) for e in edges if e[2] == 1 and len(set(parts([x for x in edges if x is not e], nodes).values())) > whole}
        return out | {("articulation", x, None) for x in nodes if len(set(parts([e for e in edges if x not in e[:2]], nodes - {x}).values())) > whole}

    for _ in range(300):
        n = rng.randrange(2, 16)
        seen = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(1, 2 * n))}
        edges = [(a, b, rng.choice((1, 1, 1, 2))) for a, b in sorted(seen)]
        k = rng.randrange(1, 4)
        chunks = [[e for e in edges if (e[1] if k < 3 else e[0] + e[1]) % k == c] for c in range(k)]
        ends = [{x for e in c for x in e[:2]} for c in chunks]
        got, left = set(), {}
        for c, mine in zip(chunks, ends, strict=True):
            if c:
                others = set().union(*[x for x in ends if x is not mine])
                f = cuts._contract(pd.DataFrame(c, columns=["u", "v", "m"]), np.array(sorted(mine & others), np.int64))
                for r in f.itertuples():
                    if r.kind == "edge":
                        left[r.a, r.b] = left.get((r.a, r.b), 0) + r.m
                    elif r.kind != "link":
                        got.add((r.kind, r.a, None if pd.isna(r.b) else r.b))
        assert facts(edges) == got | facts([(a, b, m) for (a, b), m in left.items()])


def test_next_in_order_over_ranges(spark):
    rows = sorted({(i * i % 7, i * 31 % 100) for i in range(300)})
    got = {(r["a"], r["b"]): r["next"] for r in cuts.next_in_order(spark.createDataFrame(rows, "a int, b int"), "a", "b").collect()}
    assert got == dict(zip(rows, [*rows[1:], None], strict=True))


def test_crossing_pairs_in_parts_by_rows(spark, monkeypatch):
    # the number of parts follows the rows, whatever the shuffle partitions; repeated and null parts count nothing
    monkeypatch.setattr(review, "PART", 5)
    rng = random.Random(4)
    rows = [(rng.randrange(20), rng.choice([None, *range(12)])) for _ in range(100)] + [(None, 1), (None, 2), (50, 3)]
    got = review.crossing_pairs(spark.createDataFrame(rows, "c long, p long"), "c", "p")
    want = {(p, q) for c, p in rows for d, q in rows if c == d and None not in (c, p, q) and p != q}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and got.rdd.getNumPartitions() > 20


def test_spans(spark):
    rng = random.Random(6)
    rows = [(g, 1000 * g + i, float(a := rng.randrange(40)), float(a + rng.randrange(1, 15))) for g in range(3) for i in range(60)] + [(9, 1, 0.0, 1.0), (9, 2, None, 4.0)]
    df = spark.createDataFrame(rows, "g int, id long, low double, high double")
    got = {r["id"]: r["container"] for r in review.nested_spans(df, "g", 1.0).collect()}
    want = {}
    for g, i, lo, hi in rows[:-2]:
        best = max(((h2, -j) for g2, j, l2, h2 in rows[:-2] if g2 == g and l2 <= lo and h2 >= hi and (l2 < lo or h2 > hi)), default=None)
        if best:
            want[i] = -best[1]
    assert got == want


def test_signatures_of_turned_and_mirrored_symbols(spark):
    rng = random.Random(9)
    symbol = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]), (2, [(6.0, 1.0), (7.0, 5.0)]), (2, [(1.0, 9.0)])]

    def moved(shapes, angle, k, dx, dy, mirror):
        c, s = math.cos(angle), math.sin(angle)
        at = lambda x, y: (dx + k * (c * x * mirror - s * y), dy + k * (s * x * mirror + c * y))
        return [(kind, [at(*p) for p in pts]) for kind, pts in shapes]

    rows = [(i, moved(symbol, rng.uniform(0, 6), rng.uniform(0.5, 9), rng.uniform(-99, 99), rng.uniform(-99, 99), 1)) for i in range(6)]
    rows += [(6, moved(symbol, 1.0, 2.0, 3.0, 4.0, -1)), (7, symbol[::-1]), (8, [symbol[0], symbol[1], (3, symbol[2][1])]), (9, [(1, [(0.0, 0.0), (4.0, 0.0), (4.5, 3.0)]), *symbol[1:]]), (10, []), (11, [(1, [])])]
    df = spark.createDataFrame(rows, "id int, shapes array<struct<kind: int, points: array<struct<x: double, y: double>>>>")
    both = df.select("id", spatial.geometry_signature(F.col("shapes"), 0.001, 0.01).alias("m"), spatial.geometry_signature(F.col("shapes"), 0.001, 0.01, mirror=False).alias("o"))
    got = {r["id"]: r for r in both.collect()}
    assert len({got[i]["m"] for i in range(8)}) == 1 and got[8]["m"] != got[0]["m"] != got[9]["m"]
    assert len({got[i]["o"] for i in range(6)}) == 1 and got[6]["o"] != got[0]["o"]
    assert got[10]["m"] is None and got[11]["m"] is not None


def test_paths_inside_json(spark):
    from tarn.operators import audit

    rows = [("u1", '{"a": {"b": [1, {"c": null}, []], "": 2}, "t": "{\\"x\\": 1}"}'), ("u2", '[{"k": true}, "s"]'), ("u2", "not json"), ("u3", None), ("u3", "{}"), ("u4", '{"a": ""}')]
    df = spark.createDataFrame(rows, "u string, j string")
    got = sorted((r["u"], r["path"], r["kind"], r["text"]) for r in audit.json_paths(df, "j", "u").collect())
    assert got == sorted(
        [
            ("u1", "a", "object", '{"":2,"b":[1,{"c":null},[]]}'),
            ("u1", "a.", "scalar", "2"),
            ("u1", "a.b", "array", '[1,{"c":null},[]]'),
            ("u1", "a.b[]", "scalar", "1"),
            ("u1", "a.b[]", "object", '{"c":null}'),
            ("u1", "a.b[]", "array", "[]"),
            ("u1", "a.b[].c", "null", "null"),
            ("u1", "t", "scalar", '{"x": 1}'),
            ("u2", "[]", "object", '{"k":true}'),
            ("u2", "[].k", "scalar", "true"),
            ("u2", "[]", "scalar", "s"),
            ("u4", "a", "scalar", ""),
        ]
    )
    profile = {r["path"]: tuple(r)[1:] for r in audit.path_profile(df, "j", "u", examples=1).collect()}
    assert profile["a"] == (2, 1, 2, None) and profile["a.b[]"] == (3, 1, 1, ["1"]) and profile["a.b[].c"] == (1, 1, 1, None)
    assert len(audit.json_paths(df, "j", "u", max_depth=1).collect()) == 5


def test_line_box_pairs_are_not_shuffled(spark):
    """pairs of lines and boxes are tested where they meet, each given once; also of long lines and wide boxes."""
    rng = random.Random(22)
    lines = []
    for i in range(60):
        x, y, n = rng.randint(-60, 60), rng.randint(-60, 60), 40 if i % 20 == 0 else rng.randint(1, 5)
        lines.append((i, [(x + rng.randint(-50, 50), y + rng.randint(-50, 50)) for _ in range(n)], i % 3 == 0))
    boxes = [(i, x := rng.randint(-90, 90), y := rng.randint(-90, 90), x + rng.randint(0, 20), y + rng.randint(0, 20)) for i in range(80)] + [(80, -200, -200, 200, 200)]

    def meets(p, q, b):
        _, x1, y1, x2, y2 = b
        sides = [(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) for x in (x1, x2) for y in (y1, y2)]
        return min(p[0], q[0]) <= x2 and max(p[0], q[0]) >= x1 and min(p[1], q[1]) <= y2 and max(p[1], q[1]) >= y1 and min(sides) <= 0 <= max(sides)

    def inside(points, x, y):
        turns = 0
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            left = (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
            turns += (p[1] <= y < q[1] and left > 0) - (q[1] <= y < p[1] and left < 0)
        return turns != 0

    expected = []
    for i, points, closed in lines:
        ring = closed and len(points) > 2
        legs = list(zip(points, points[1:], strict=False)) + [(points[-1], points[0])] * ring or [(points[0], points[0])]
        expected += [(i, b[0]) for b in boxes if any(meets(p, q, b) for p, q in legs) or ring and inside(points, b[1], b[2])]
    table = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p], c) for i, p, c in lines], "id long, points array<struct<x double, y double>>, closed boolean")
    all_boxes = spark.createDataFrame([(b[0], *map(float, b[1:])) for b in boxes], "id long, minx double, miny double, maxx double, maxy double")
    assert sorted(map(tuple, spatial.line_box_join(table, all_boxes, 8.0).collect())) == sorted(expected)
    short = spatial.line_box_join(table.where("size(points) <= 5"), all_boxes, 8.0)
    assert "Exchange" not in short._jdf.queryExecution().executedPlan().toString().split("Join")[0]


def test_far_points_meet_few_lines(spark):
    """a far point looks at the lines around its nearest one, not at all in a box of up to twice that distance; the
    distances that are computed are far fewer than points times lines."""
    rng = random.Random(18)
    lines = [(i, [(x := rng.uniform(-100, 100), y := rng.uniform(-100, 100)), (x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)), (x, y + 3)], i % 2 == 0) for i in range(300)]
    at = [(i, rng.uniform(-1500, 1500), rng.uniform(-1500, 1500)) for i in range(150)] + [(150, 0.0, 0.0), (151, 0.0, 0.0), (152, None, 1.0)]

    def away(px, py, p, q):
        dx, dy = q[0] - p[0], q[1] - p[1]
        u = min(max(((px - p[0]) * dx + (py - p[1]) * dy) / (dx * dx + dy * dy), 0), 1)
        return math.hypot(px - p[0] - u * dx, py - p[1] - u * dy)

    want = {}
    for i, x, y in at[:-1]:
        d = sorted((min(away(x, y, p, q) for p, q in list(zip(s, s[1:], strict=False)) + [(s[2], s[0])] * c), j) for j, s, c in lines)
        near = [j for v, j in d if v <= d[0][0] + 2.0]
        want[i] = (round(d[0][0], 6), len(near), near if len(near) <= 3 else None)
    points = spark.createDataFrame(at, "id long, x double, y double")
    table = spark.createDataFrame(lines, "id long, points array<struct<x double, y double>>, closed boolean")
    made, plain = [], spatial.segment_distance
    try:
        seen = spark.sparkContext.accumulator(0)
        counted = F.udf(lambda d: (seen.add(1), d)[1], "double")
        spatial.segment_distance = lambda *c: counted(plain(*c))
        got = {r["point"]: (r["distance"], r["n_ties"], r["targets"]) for r in spatial.nearest_lines(points, table, 8.0, tie=2.0, cap=3).collect()}
        made.append(seen.value)
    finally:
        spatial.segment_distance = plain
    assert got.pop(152) == (None, None, None)
    assert {i: (round(d, 6), n, t) for i, (d, n, t) in got.items()} == want
    assert made[0] < 152 * 300 / 4
