"""Sectors and positions of requirements against plain Python."""

import hashlib
import math
import random

import pytest

import __spark_entry__ as entry
from tarn.operators import layout


def plain_sectors(edges, root):
    top = sorted((o, d, i) for i, s, d, k, o in edges if s == root and k == "contains_requirement")
    out = {}
    for n, (_, start, _) in enumerate(top):
        todo, seen = [start], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                out.setdefault(x, n)
                todo += [d for i, s, d, k, o in edges if s == x and k in ("contains_requirement", "decomposes_to")]
    again = True
    while again:
        again = False
        for _, s, d, _ in sorted((o, s, d, i) for i, s, d, k, o in edges):
            if d not in out and s in out:
                out[d], again = out[s], True
    return out, max(len(top), 1)


def unit(what, node):
    return int(hashlib.sha256(f"initial-semantic-v1:{what}:{node}".encode()).hexdigest()[:16], 16) / (2**64 - 1)


@pytest.mark.parametrize("seed", range(3))
def test_positions(spark, seed):
    rng = random.Random(seed)
    kinds = ["contains_requirement", "decomposes_to", "refines", "refines", "supports"]
    edges = [(f"e{i}", rng.choice([0, 0, *range(40)]), rng.randrange(1, 40), rng.choice(kinds), rng.randrange(3)) for i in range(45)]
    edges += [(f"f{i}", i + 1, i, "refines", 0) for i in range(40, 46)]  # against the order: a pass each
    edges += [("g", 3, 46, "refines", 1), ("h", 0, 3, "contains_requirement", 2)]
    want, n = plain_sectors(edges, 0)
    e = spark.createDataFrame(edges, "id string, src long, dst long, kind string, ord int")
    got, count = layout.assign_sectors(e, 0)
    assert {r["node"]: r["sector"] for r in got.collect()} == want and count == n
    nodes = [(i, rng.choice(list(layout.ORIGINS)), rng.randrange(4), None, None, None, None) for i in range(50)] + [(50, "normalized", 2, 3.0, 4.0, None, True), (51, "strange", 1, None, None, None, None)]
    df = spark.createDataFrame(nodes, "node long, origin string, depth int, x double, y double, z double, locked boolean")
    rank = {"customer_stated": 1, "normalized": 2, "domain_decomposition": 3}
    came, groups = {}, {}
    for i, _, d, _, o in edges:
        came[d] = min(came.get(d, (o, i)), (o, i))
    for node, _, depth, *_ in nodes[1:]:
        if node in want:
            groups.setdefault((want[node], depth), []).append(node)
    for dims in (2, 3):
        rows = {r["node"]: r for r in layout.positions(df, e, 0, dims).collect()}
        assert len(rows) == 52 and rows[51]["x"] is None
        for node, origin, depth, *_ in nodes[:50]:
            mates = sorted(groups.get((want.get(node), depth), []), key=lambda m: (came.get(m, (0, "")), m))
            if node == 0:
                angle = 0.0
            elif node not in want:
                angle = 2 * math.pi * unit("theta", node)
            else:
                middle, span = 2 * math.pi * want[node] / n, 2 * math.pi / n * 0.82
                angle = middle if len(mates) == 1 else middle - span / 2 + span * mates.index(node) / (len(mates) - 1)
            radius = 0 if node == 0 else 180 * rank[origin] + 55 * max(depth - 1, 0)
            tilt = (unit("phi", node) * 2 - 1) * math.pi / 8 if dims == 3 else 0.0
            place = (radius * math.cos(angle) * math.cos(tilt), radius * math.sin(angle) * math.cos(tilt), radius * math.sin(tilt))
            assert tuple(rows[node][c] for c in "xyz") == pytest.approx(place, abs=2e-6), node
            assert rows[node]["source"] == "generated:initial-semantic-v1" and rows[node]["locked"] == (node == 0)
        stored = rows[50]
        assert (stored["x"], stored["radius"], stored["source"], stored["locked"]) == (3.0, 5.0, "stored", True) if dims == 2 else stored["source"] == "generated:initial-semantic-v1"


def test_no_edges(spark):
    e = spark.createDataFrame([], "id string, src long, dst long, kind string, ord int")
    got, n = layout.assign_sectors(e, 0)
    assert got.count() == 0 and n == 1
    nodes = spark.createDataFrame([(0, None, None, None, None, None, None)], "node long, origin string, depth int, x double, y double, z double, locked boolean")
    assert tuple(layout.positions(nodes, e, 0).first()) == (0, None, 0.0, 0.0, 0.0, 0.0, "generated:initial-semantic-v1", True)
    assert layout.places_in_order(nodes.limit(0), ["depth"], ["node"]).count() == 0


def test_places_of_a_large_group(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 = 0 as g", "hash(id) as h")
    rows = layout.places_in_order(df, ["g"], ["h", "id"]).collect()
    for g in (True, False):
        ordered = sorted((r["h"], r["id"]) for r in rows if r["g"] == g)
        assert [r["id"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["place"])] == [i for _, i in ordered]
        assert {r["many"] for r in rows if r["g"] == g} == {len(ordered)}
