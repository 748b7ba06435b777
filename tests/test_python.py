"""Queries that SQL cannot express, against plain Python; sources; column functions on odd values."""

import json
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarn.functions import columns as C
from tarn.operators import audit, graph, identity, ledger, turns
from tarn.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in ("orders", "events", "part", "conversations"):
        c.execute(f"create view {x} as select * from '{SF}/{x}.parquet'")
    return c


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_nfkc(spark, duck):
    want = {(a, b): unicodedata.normalize("NFKC", x).lower() for a, b, x in duck.execute("select conv_id, turn, text from conversations").fetchall()}
    assert {(r["conv_id"], r["turn"]): r["nfkc"] for r in rows(spark, "normalised_texts")} == want


def test_draw_down_in_order(spark):
    charges = spark.createDataFrame([(1, 1, 10, 3), (1, 2, 20, 5), (1, 3, 30, 4), (2, 4, 5, 2)], "org long, charge_id long, at long, credits long")
    grants = spark.createDataFrame([(1, 7, 15.0, 1, 0), (1, 8, None, 4, 0), (1, 9, 40.0, 2, 25)], "org long, grant_id long, ends double, credits long, starts long")
    got = sorted((r["charge_id"], r["grant_id"] if r["grant_id"] is not None else -1, r["credits"]) for r in ledger.draw_down_in_order(charges, grants).collect())
    assert got == [(1, 7, 1), (1, 8, 2), (2, -1, 3), (2, 8, 2), (3, -1, 2), (3, 9, 2), (4, -1, 2)]


def test_golden_prices(spark):
    assert [ledger.rate(p) for p in ledger.PRICES["flagship"]] == [1667, 208, 2083, 5000]
    calls = spark.createDataFrame([(1000, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (10, 0, 50, 50)], "input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    got = [(r["micro_credits"], r["credits"]) for r in ledger.priced(calls).collect()]
    assert got == [(1_667_000, 2), (5000, 1), (0, 0), (2080, 1)]


def test_split_grants(spark):
    charges = spark.createDataFrame([(1, 1, 1, 3)], "org long, charge_id long, at long, credits long")
    grants = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 9, 1000)], "org long, grant_id long, ends long, credits long")
    given, missing = ledger.draw_down(charges, grants)
    assert [(r["grant_id"], r["credits"]) for r in given.orderBy("grant_id").collect()] == [(1, 1), (2, 2)] and missing.count() == 0
    given, missing = ledger.draw_down(charges, grants.where("grant_id = 1"))
    assert given.count() == 1 and missing.first()["unbacked"] == 2


def test_budget_pick(spark, duck):
    by = {}
    for user, kind, score, tokens, event in duck.execute("select user_id, event_type, value, event_id % 900, event_id from events").fetchall():
        by.setdefault(user, []).append((kind, score, tokens, event))
    want = set()
    for user, items in by.items():
        if sum(x[2] for x in items) <= 2000:
            want |= {(user, x[3]) for x in items}
            continue
        best = {}
        for x in sorted(items, key=lambda x: (-x[1], x[3])):
            best.setdefault(x[0], x[3])
        left = 2000
        for x in sorted(items, key=lambda x: (x[3] not in best.values(), -x[1], x[3])):
            if x[2] <= left:
                left -= x[2]
                want.add((user, x[3]))
    assert {(r["user_id"], r["event_id"]) for r in rows(spark, "budget_pick")} == want


def test_turns_golden(spark):
    data = [("c", 0, "assistant", "early"), ("c", 1, "user", "question 1"), ("c", 2, "assistant", "answer 1"), ("c", 3, "assistant", " "), ("c", 4, "user", "question 2"), ("c", 5, "user", ""), ("c", 6, "assistant", None)]
    got = turns.slice_turns(spark.createDataFrame(data, "conversation_id string, ordinal int, role string, content string")).orderBy("turn_no").collect()
    assert [(r["question"], r["answer"], r["previous_question"], r["n_messages"]) for r in got] == [("question 1", "answer 1", None, 3), ("question 2", None, "question 1", 1)]


def cuts(edges):
    nodes = {x for e in edges for x in e}

    def parts(es, ns):
        left, n = set(ns), 0
        adj = {x: set() for x in ns}
        for a, b in es:
            if a in adj and b in adj:
                adj[a].add(b)
                adj[b].add(a)
        while left:
            todo = [left.pop()]
            n += 1
            while todo:
                for y in adj[todo.pop()] & left:
                    left.discard(y)
                    todo.append(y)
        return n

    whole = parts(edges, nodes)
    bridges = {(min(e), max(e)) for i, e in enumerate(edges) if e[0] != e[1] and parts(edges[:i] + edges[i + 1 :], nodes) > whole}
    points = {x for x in nodes if parts([e for e in edges if x not in e], nodes - {x}) > whole}
    return bridges, points


def test_cuts_equal_removal(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 8), (8, 7), (9, 9), (5, 10), (10, 11)]
    got = graph.cut_facts(spark.createDataFrame(edges, "src long, dst long")).collect()
    bridges, points = cuts([e for e in edges if e[0] != e[1]])
    assert {(r["a"], r["b"]) for r in got if r["kind"] == "bridge"} == bridges and {r["a"] for r in got if r["kind"] == "articulation"} == points


def test_square_with_spur(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (4, 5)], "src long, dst long")
    facts = graph.graph_facts(spark.range(1, 7).withColumnRenamed("id", "node"), edges).first().asDict()
    assert facts == {"nodes": 6, "isolated": 1, "dangling": 1, "edges": 5, "parallel": 0, "self_loops": 0, "components": 2, "cycle_rank": 1}
    many = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, 1), (2, 2)], "src long, dst long")
    assert graph.graph_facts(spark.range(1, 3).withColumnRenamed("id", "node"), many).first()["cycle_rank"] == 4


def test_shortest_path(spark):
    up = lambda x: [x, *up(x // 3)] if x else [0]
    a, b = up(500), up(700)
    meet = next(x for x in a if x in b)
    want = a[: a.index(meet) + 1] + b[: b.index(meet)][::-1]
    got = sorted(rows(spark, "shortest_path"), key=lambda r: r["step"])
    assert [r["node"] for r in got] == want
    assert graph.shortest_path(spark.createDataFrame([(1, 1, 2)], "id long, src long, dst long"), 1, 9).count() == 0


def test_identity_keeps_proven_different_apart(spark):
    same = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "a long, b long")
    apart = spark.createDataFrame([(1, 4)], "a long, b long")
    got = {r["node"]: r["cluster"] for r in identity.resolve_identity(same, apart).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 10: 10, 11: 10}
    assert len(rows(spark, "resolve_identity")) > 0


def test_jsonl(spark, tmp_path):
    lines = ["", '{"a": 2, "b": "one', "two", 'three"}', '{"a": 3}', "never {"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    got = [json.loads(r["record"]) for r in tables.repair_jsonl(df).orderBy("line_no").collect()[:-1]]
    assert got == [{"a": 2, "b": "one\ntwo\nthree"}, {"a": 3}]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnope\n{"a": 2}\n')
    from pyspark.sql.types import LongType, StructField, StructType

    good, bad = tables.read_jsonl_tolerant(spark, str(tmp_path), StructType([StructField("a", LongType())]))
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["line"] for r in bad.collect()] == ["nope"]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tables.read_jsonl(spark, str(tmp_path), "a long").collect()
    with pytest.raises(ValueError, match="another dataset"):
        tables.publish_dataset(spark.createDataFrame([(1, "x")], "a long, dataset_id string"), str(tmp_path / "d"), "y")


def test_columns_on_odd_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("  a \n b ",), ("（3）",), ("12",), ("x1",)], "v string")
    assert [r[0] for r in df.select(C.norm_space(F.col("v"))).collect()] == ["", "", "a b", "（3）", "12", "x1"]
    assert [r[0] for r in df.select(C.parse_number_cell(F.col("v"))).collect()] == [None, None, None, 3, 12, None]
    assert [r[0] for r in df.select(C.safe_counter(F.col("v"))).collect()] == [0, 0, 0, 0, 12, 0]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.5,), (3.5,)], "v double")
    assert [r[0] for r in odd.select(C.quantize(F.col("v"), 1.0)).collect()] == [None, None, None, 2, 4]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


def test_graph_queries_read_whole_tables(spark, duck):
    orders = duck.execute("select o_custkey, o_orderkey from orders").fetchall()
    edges = [(c, o * 7 % 1000) for c, o in orders]
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(adj):
        todo = [] if x in want else [x]
        while todo:
            if (y := todo.pop()) not in want:
                want[y] = x
                todo += adj[y]
    assert {r["node"]: r["component"] for r in rows(spark, "components_whole")} == want
    facts = rows(spark, "graph_facts_whole")[0]
    assert (facts["edges"], facts["nodes"], facts["components"]) == (len(edges), len(adj), len(set(want.values())))
    degree = [x for e in edges for x in e]
    leaves = {x for x in adj if len(adj[x]) == 1 and degree.count(x) == 1}
    got = rows(spark, "cut_facts")
    assert {x for r in got if r["kind"] == "bridge" for x in (r["a"], r["b"])} >= leaves and all(r["component"] == want[r["a"]] for r in got)
    ring = {(c, o % 300) for c, o in orders}
    n = -1
    while n != len(ring):
        n, into, out = len(ring), {b for _, b in ring}, {a for a, _ in ring}
        ring = {(a, b) for a, b in ring if a in into and b in out}
    assert {r["node"] for r in rows(spark, "cycle_nodes_whole")} == {x for e in ring for x in e}


def test_other_queries_read_whole_tables(spark, duck):
    by = {}
    for o, s in duck.execute(f"select l_orderkey, l_suppkey from '{SF}/lineitem.parquet'").fetchall():
        by.setdefault(o, set()).add(s)
    assert {tuple(r) for r in rows(spark, "crossing_pairs_whole")} == {(a, b) for x in by.values() for a in x for b in x if a != b}
    spans = duck.execute("select p_brand, p_partkey, p_size, p_size + 1 + p_partkey % 9 from part").fetchall()
    want = set()
    for g, a, al, ah in spans:
        for h, b, bl, bh in spans:
            if g == h:
                want |= {(g, a, b, "continuous")} if ah == bl and a != b else set()
                if a < b and al == bl:
                    want.add((g, a, b, "duplicate" if ah == bh else "common_baseline"))
                elif a < b and ah == bh:
                    want.add((g, a, b, "shared_datum"))
    assert {tuple(r) for r in rows(spark, "dimension_chains_whole")} == want
    parents = {c for c, _ in duck.execute("select distinct o_custkey, 0 from orders").fetchall()}
    ends = parents | {o for o, in duck.execute("select distinct o_orderkey % 400 from orders").fetchall()}
    nodes = {c for c, in duck.execute(f"select c_custkey from '{SF}/customer.parquet'").fetchall()}
    got = {}
    for r in rows(spark, "audit_graph_whole"):
        got.setdefault(r["code"], set()).add(r["id"])
    assert got.get("dangling", set()) == ends - nodes and got["atomic_with_children"] == {x for x in nodes & parents if x % 3 == 0}
    assert got.get("composite_without_children", set()) == {x for x in nodes - parents if x % 3}


def test_count_interval_keeps_different_things_apart(spark):
    from tarn.operators import audit

    same = spark.createDataFrame([(1, 2, True), (2, 3, False), (4, 5, False)], "src long, dst long, sure boolean")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    apart = spark.createDataFrame([(1, 3)], "a long, b long")
    row = audit.count_interval(same, nodes, "sure", apart).first()
    assert (row["lower"], row["upper"]) == (4, 5)
    assert audit.count_interval(same, nodes, "sure").first()["lower"] == 3


def test_charges_draw_down_grants_in_order(spark):
    from tarn.operators import ledger

    charges = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 2, 3), (2, 3, 1, 5), (3, 4, 1, 2)], "org long, charge_id long, at long, credits long")
    grants = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 9, 1000), (2, 3, 5, 1), (2, 4, None, 4)], "org long, grant_id long, ends long, credits long")
    used, open_ = ledger.draw_down(charges, grants)
    assert sorted(tuple(r) for r in used.collect()) == [(1, 1, 1, 1), (1, 1, 2, 2), (1, 2, 2, 3), (2, 3, 3, 1), (2, 3, 4, 4)]
    assert [tuple(r) for r in open_.collect()] == [(3, 4, 2)]


def test_publishing_refuses_an_unknown_dataset(spark, tmp_path):
    import pytest

    from tarn.sources import tables

    rows = spark.createDataFrame([(1, "a")], "x long, dataset_id string")
    tables.publish_dataset(rows, str(tmp_path / "d"), "a", rows)
    with pytest.raises(ValueError):
        tables.publish_dataset(rows, str(tmp_path / "d"), "a", rows.where("x > 1"))


def test_snapshot_reads_its_last_version(spark, tmp_path):
    from tarn.streaming import ledger

    for v in (0, 1, 10):
        spark.createDataFrame([(v,)], "x long").write.parquet(str(tmp_path / f"v={v}"))
    assert [r["x"] for r in ledger.newest_version(spark, str(tmp_path)).collect()] == [10]


def test_messages_are_marked_deleted_then_taken_from_the_sync(spark):
    from tarn.operators import turns

    stored = spark.createDataFrame([(1, "a", "x", 0, False), (1, "b", "y", 0, False), (2, "a", "z", 0, True), (3, "a", "w", 0, False)], "c long, k string, text string, at long, is_deleted boolean")
    new = spark.createDataFrame([(1, "b", "late", 2), (1, "b", "early", 1), (1, "c", None, 1)], "c long, k string, text string, at long")
    emptied = spark.createDataFrame([(3,)], "c long")
    out = {(r["c"], r["k"]): (r["text"], r["is_deleted"]) for r in turns.sync_messages(stored, new, ["c", "k"], "at", ["text", "at"], emptied).collect()}
    assert out == {(1, "a"): ("x", True), (1, "b"): ("late", False), (1, "c"): (None, False), (2, "a"): ("z", True), (3, "a"): ("w", True)}


def test_economics_of_an_empty_window(spark):
    from tarn.operators import ledger

    none = spark.createDataFrame([], "run string, purpose string, credits long, micro_credits long")
    assert [tuple(r) for r in ledger.window_economics(none).collect()] == [(0, 0.0, 0.0, None)]
    assert ledger.credit_report(none, "run", "purpose").count() == 0


def test_a_region_asks_only_for_what_is_given(spark):
    from tarn.operators import spatial

    rows = spark.createDataFrame([(1, "door", "ok", 0.0, 1.0), (2, "door", "bad", 0.0, 1.0), (3, "door", "ok", 5.0, 6.0), (4, None, "ok", 1.0, None)], "id long, class_id string, status string, minx double, maxx double")
    rows = rows.selectExpr("*", "'plan' as mode", "minx as miny", "maxx as maxy")
    ids = lambda *a: sorted(r["id"] for r in spatial.query_representations(rows, *a).collect())
    assert ids() == [1, 2, 3, 4] and ids("door", "ok") == [1, 3] and ids(None, None, None, (1.0, 1.0, 2.0, 2.0)) == [1, 2]
