"""Identity of representations, clusters of endpoints and similar views against plain Python."""

import math
import random

import pytest

import __spark_entry__ as entry
from tarn.operators import audit, diff, identity, spatial

SF = "/root/testdata/sf0.001"


def merged(pairs, keys):
    """The clusters of merging in order; keys: node to the set of keys it holds."""
    cluster = {x: {x} for p in pairs for x in p}
    for a, b in sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]}):
        x, y = cluster[a], cluster[b]
        if x is not y and not set().union(*(keys.get(n, set()) for n in x)) & set().union(*(keys.get(n, set()) for n in y)):
            both = x | y
            for n in both:
                cluster[n] = both
    return {n: min(c) for n, c in cluster.items()}


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_merging_in_order(spark, seed):
    rng = random.Random(seed)
    nodes, n_keys = (40, 12) if seed % 2 else (60, 60)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(70)]
    if seed == 2:  # a hub and a chain
        pairs = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(30, 59)] + [(29, 30)]
    held = [(rng.randrange(nodes), f"k{rng.randrange(n_keys)}") for _ in range(30)]
    apart = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(15)]
    keys = {}
    for n, k in held + [(n, p) for p in apart if p[0] != p[1] for n in p]:
        keys.setdefault(n, set()).add(k)
    want = merged([p for p in pairs if p[0] != p[1]], keys)
    same = spark.createDataFrame([*pairs, (None, 3), (3, None), (pairs[0][1], pairs[0][0])], "a long, b long")
    different, exclusive = spark.createDataFrame([*apart, (None, 1)], "a long, b long"), spark.createDataFrame([*held, (1, None), (None, "k1")], "node long, key string")
    for limit in (0, 100_000):
        got = {r["node"]: r["cluster"] for r in identity.resolve_identity(same, different, exclusive, limit).collect()}
        assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_blocks_of_the_order_equal_merging_in_order(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    held = [(rng.randrange(60), f"k{rng.randrange(20)}") for _ in range(40)]
    keys = {}
    for n, k in held:
        keys.setdefault(n, set()).add(k)
    same, exclusive = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(held, "node long, key string")
    got = {r["node"]: r["cluster"] for r in identity.resolve_identity(same, None, exclusive, limit=0, block=12).collect()}
    assert got == merged([p for p in pairs if p[0] != p[1]], keys)


def test_nothing_to_merge(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert identity.resolve_identity(none, none).collect() == []
    one = spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string")
    assert sorted(map(tuple, identity.resolve_identity(one, limit=0).collect())) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_clusters_of_the_parts(spark):
    from tarn.plans import spatial_queries as q

    keys = {}
    for r in identity.exclusive_keys(q._reps(spark, SF)).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    want = merged([tuple(r) for r in q._same_marks(spark, SF).collect()], keys)
    got = {r["node"]: r["cluster"] for r in entry.queries()["identity_clusters"](spark, SF).collect()}
    assert got == want and len(set(got.values())) < len(got)


def test_interval_under_constraints(spark):
    same = spark.createDataFrame([(1, 2, True), (2, 3, False), (3, 4, False)], "src long, dst long, sure boolean")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    different = spark.createDataFrame([(1, 4)], "a long, b long")
    assert tuple(audit.count_interval(same, nodes, "sure", different).first()) == (4, 5)


def test_schedule_rows(spark):
    schema = "id long, class string, context string, mode string, signature string, labels array<string>"
    reps = [
        (1, "pump", "v1", "instance_view", "s", ["P-1"]),
        (2, "pump", "v2", "instance_view", "s", ["p-1 ", "P-2"]),
        (3, "row", None, "schedule_record", None, ["P-1"]),
        (4, "row", None, "schedule_record", None, ["P-2"]),
        (5, "row", None, "schedule_record", None, ["P-9", None, ""]),
        (6, "pump", "v2", "instance_view", "", None),
        (7, None, "v2", "instance_view", "s", ["P-1"]),
    ]
    df = spark.createDataFrame(reps, schema)
    alone = spark.createDataFrame([], "node long, cluster long")
    assert sorted(map(tuple, identity.attach_schedules(df, alone).collect())) == [(4, 2)]
    together = spark.createDataFrame([(1, 1), (2, 1)], "node long, cluster long")
    assert sorted(map(tuple, identity.attach_schedules(df, together).collect())) == [(3, 1), (4, 1)]
    got = {}
    for r in identity.assertion_groups(df).collect():
        got.setdefault((r["edge"], r["label"]), []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {
        ("different_object_proven", None): [2, 6],
        ("same_type_only", None): [1, 2],
        ("same_object_supported", "p-1"): [1, 2, 3],
        ("same_object_supported", "p-2"): [2, 4],
        ("same_object_possible", "p-1"): [1, 2],
    }
    assert identity.assertion_groups(df.limit(0)).count() == 0


WEIGHTS = {"distributions": {"edge": 0.5, "radial": 0.2}, "histogram": 0.2, "counts": {"edges": 0.1}}


def quantiles(v, n=33):
    v = sorted(v)
    at = [i / (n - 1) * (len(v) - 1) for i in range(n)]
    return [v[int(p)] + (p - int(p)) * (v[min(int(p) + 1, len(v) - 1)] - v[int(p)]) for p in at]


def alike(a, b):
    total = 0.0
    for name, w in WEIGHTS["distributions"].items():
        p, q = a[name], b[name]
        total += w * (1.0 if not p and not q else 0.0 if not p or not q else max(0.0, 1 - sum(abs(x - y) for x, y in zip(quantiles(p), quantiles(q), strict=True)) / 33))
    keys = a["h"].keys() | b["h"].keys()
    more = sum(max(a["h"].get(k, 0), b["h"].get(k, 0)) for k in keys)
    total += 0.2 * (sum(min(a["h"].get(k, 0), b["h"].get(k, 0)) for k in keys) / more if more else 1.0)
    return total + 0.1 * (min(a["n"], b["n"]) / max(a["n"], b["n"]) if a["n"] or b["n"] else 1.0)


def test_similar_views(spark):
    rng = random.Random(7)
    views = {}
    for i in range(60):
        base = rng.choice([0.1, 0.5, 3.0, -2.0])
        views[f"v{i:02}"] = {"edge": [base + rng.random() / 3 for _ in range(rng.randrange(4))], "radial": [rng.random() for _ in range(rng.randrange(3))], "h": {str(rng.randrange(4)): rng.randrange(1, 4) for _ in range(rng.randrange(3))}, "n": rng.randrange(4)}
    for i in range(60, 75):
        views[f"v{i}"] = views["v03"]  # copies
    values = [(v, f, x) for v, r in views.items() for f in ("edge", "radial") for x in r[f]] + [("v00", "edge", None), ("v00", "strange", 9.0)]
    counts = [(v, "edges", r["n"]) for v, r in views.items()]
    bins = [(v, k, n) for v, r in views.items() for k, n in r["h"].items()] + [("v01", None, 4), ("v01", "9", 0)]
    features = diff.view_features(spark.createDataFrame(values, "view string, feature string, value double"), spark.createDataFrame(counts, "view string, feature string, n long"), spark.createDataFrame(bins, "view string, bin string, n long"), WEIGHTS)
    pairs, members = diff.similar_views(features, WEIGHTS, 0.77)
    like = {r["view"]: r["like"] for r in members.collect()}
    assert like.keys() == views.keys() and all(like[f"v{i}"] == "v03" for i in range(60, 75))
    first = sorted(set(like.values()))
    want = {(a, b): round(alike(views[a], views[b]), 6) for a in first for b in first if a < b and alike(views[a], views[b]) >= 0.77}
    assert {(r["a"], r["b"]): round(r["similarity"], 6) for r in pairs.collect()} == want and len(want) > 20
    none = features.limit(0)
    assert diff.similar_views(none, WEIGHTS, 0.77)[0].count() == 0
    with pytest.raises(ValueError):
        diff.similar_views(none, WEIGHTS, 0.5)


def test_snapping_of_endpoints(spark):
    schema = "id long, x double, y double, priority boolean, curve long, closed boolean"
    rows = [(1, 0.0, 0.0, None, 1, None), (2, 1.0, 0.0, None, 1, None), (3, 50.0, 0.0, False, 2, True), (4, 50.5, 0.0, True, 2, True), (5, None, 0.0, True, 3, None), (6, 90.0, 9.0, None, None, None)]
    rows += [(10 + i, 200.0 + i, 7.0, None, 10 + i, False) for i in range(5)]  # a row that reaches further than the tolerance
    # four corners as near to the centre as each other, one of them with more copies; then two whose sums are equal
    rows += [(20, 300.0, 0.0, None, None, None), (21, 301.0, 0.0, None, None, None), (22, 301.0, 1.0, None, None, None), (23, 300.0, 1.0, None, None, None)]
    rows += [(30 + i, 400.0, 4.0, None, None, None) for i in range(200)]
    got = {r["id"]: tuple(r)[1:] for r in spatial.snap_plan(spark.createDataFrame(rows, schema), 1.0).collect()}
    assert got[1] == (1, 0.0, 0.0, 0.0, False, True) and got[2] == (1, 0.0, 0.0, 1.0, False, True)
    assert got[3] == (3, 50.5, 0.0, 0.5, False, False) and 5 not in got and got[6] == (6, 90.0, 9.0, 0.0, False, False)
    assert got[10] == (10, 202.0, 7.0, 2.0, True, False)
    assert got[22][:3] == (20, 300.0, 0.0) and got[22][4] and math.isclose(got[22][3], math.sqrt(2))
    assert all(got[30 + i] == (30, 400.0, 4.0, 0.0, False, False) for i in range(200)) and len(got) == len(rows) - 1
    assert spatial.snap_plan(spark.createDataFrame([], schema), 1.0).count() == 0


def test_groups_of_features(spark):
    rows = [("row", i, 10.0 * i, 1.0 + i % 2) for i in range(4)] + [("column", i, 5.0, float(i * i)) for i in range(5)]
    rows += [("pair", 0, 0.0, 0.0), ("pair", 1, 30.0, 40.0), ("oblique", 0, 0.0, 0.0), ("oblique", 1, 30.0, 40.0), ("oblique", 2, 90.0, 120.0)]
    rows += [("grid", i, 20.0 * (i % 2), 20.0 * (i // 2)) for i in range(4)] + [("spread", 0, 0.0, 0.0), ("spread", 1, 50.0, 0.0), ("spread", 2, 0.0, 50.0)]
    rows += [("one", 0, 0.0, 0.0), (None, 0, 0.0, 0.0), (None, 1, 9.0, 9.0), ("one", 1, None, 3.0)] + [("heap", i, 7.0, 7.0) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    groups, spacings = audit.feature_groups(df, ["g"], 2, 1.0)
    assert {(r["g"], r["n"], r["alignment"]) for r in groups.collect()} == {
        ("row", 4, "local_x_row"),
        ("column", 5, "local_y_column"),
        ("pair", 2, "pair_spacing_only"),
        ("oblique", 3, "oblique_row_in_view_plane"),
        ("grid", 4, "local_grid_candidate"),
        ("spread", 3, "distributed_in_local_frame"),
        ("heap", 3, "local_x_row"),
    }
    got = {}
    for r in spacings.collect():
        got.setdefault(r["g"], []).append(round(r["spacing"], 6))
    assert {g: sorted(v) for g, v in got.items()} == {"row": [10.0] * 3, "column": [1.0, 3.0, 5.0, 7.0], "pair": [50.0], "oblique": [50.0, 100.0]}
    none = audit.feature_groups(df.limit(0), ["g"], 2, 1.0)
    assert none[0].count() == none[1].count() == 0


def test_interfaces_of_linked_drawings(spark):
    schema = "drawing string, id string, kind string, shape string, metrics map<string,double>, dimensions map<string,double>, signature string"
    w = lambda v: {"w": v, "h": 10.0}
    interfaces = [
        ("A", "a1", "flange", "round", w(50.0), {}, "s"),
        ("A", "a2", "slot", None, w(20.0), None, None),
        ("A", "a3", "bore", "round", w(8.0), {"d": 4.0}, ""),
        ("A", "a4", "key", "", {}, {}, None),
        ("A", "a5", "rib", "", w(1.0), {}, None),
        ("B", "b1", "flange", "", w(50.5), {}, "s"),
        ("B", "b2", "flange", "square", w(50.0), {}, "s"),
        ("B", "b3", "slot", "round", w(30.0), {}, None),
        ("B", "b4", "slot", "square", w(30.0), {}, None),
        ("B", "b5", "bore", "round", w(8.0), {"d": 5.0}, ""),
        ("B", "b6", "key", "", None, None, None),
    ]
    i = spark.createDataFrame(interfaces, schema)
    links = spark.createDataFrame([(1, "A", "B", True, False), (2, "A", "B", None, None)], "link int, a_drawing string, b_drawing string, supported boolean, comparable boolean")
    got = {(r["link"], r["a_id"]): (r["best"], r["status"], r["resolution"].split("_")[0], r["n_support"], list(r["others"])) for r in diff.interface_comparisons(links, i).collect()}
    assert got == {
        (1, "a1"): ("b1", "supported", "unique", 3, []),
        (2, "a1"): ("b1", "possible", "compatible", 3, []),
        **{(k, "a2"): ("b3", "possible", "multiple", 1, ["b4"]) for k in (1, 2)},
        (1, "a3"): ("b5", "conflicted", "unique", 2, []),
        (2, "a3"): ("b5", "possible", "metric", 2, []),
        **{(k, "a4"): ("b6", "possible", "same", 0, []) for k in (1, 2)},
    }
    assert diff.interface_comparisons(links, i.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_merging_all_their_pairs(spark, seed):
    rng = random.Random(seed)
    nodes = 60 if seed % 2 else 140
    members = [(f"g{rng.randrange(12)}", rng.randrange(nodes)) for _ in range(2 * nodes)] + [("alone", 5)]
    held = [(rng.randrange(nodes), f"k{rng.randrange(9)}") for _ in range(nodes)]
    keys, groups = {}, {}
    for n, k in held:
        keys.setdefault(n, set()).add(k)
    for g, n in members:
        groups.setdefault(g, set()).add(n)
    want = merged([(a, b) for x in groups.values() for a in x for b in x if a < b], keys)
    df = spark.createDataFrame([*members, (None, 1), ("g1", None)], "group string, node long")
    exclusive = spark.createDataFrame([*held, (1, None)], "node long, key string")
    for limit, block, heads in ((1000, 1, 1), (0, 200, 6)):
        got = {r["node"]: r["cluster"] for r in identity.resolve_groups(df, exclusive, limit, block, heads).collect()}
        assert got == want


def test_first_of_a_mark_may_be_kept_apart(spark):
    # 1 and 2 are one object already; 3 and 4 can't join it but each other
    members = [("a", 1), ("a", 2), ("b", 1), ("b", 3), ("b", 4)]
    held = [(2, "k"), (3, "k"), (1, "m"), (4, "m")]
    df, exclusive = spark.createDataFrame(members, "group string, node long"), spark.createDataFrame(held, "node long, key string")
    for limit in (1000, 0):
        assert {tuple(r) for r in identity.resolve_groups(df, exclusive, limit).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert identity.resolve_groups(df.limit(0), exclusive).collect() == []


def test_parts_of_one_mark_that_merge_without_its_first(spark):
    from tarn.plans import spatial_queries as q

    keys = {}
    for r in identity.exclusive_keys(q._reps(spark, "/root/testdata/sf0.01")).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    by = {}
    for r in q._marks(spark, "/root/testdata/sf0.01").collect():
        by.setdefault(r["label"], set()).add(r["id"])
    want = merged([(a, b) for x in by.values() for a in x for b in x if a < b], keys)
    assert {r["node"]: r["cluster"] for r in entry.queries()["identity_clusters"](spark, "/root/testdata/sf0.01").collect()} == want
