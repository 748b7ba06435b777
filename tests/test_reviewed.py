"""Faults that a review found, each with the smallest table that shows it."""

import contextlib
import datetime
import threading

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarn.operators import catalog, diff, ledger, review, spatial, text_index
from tests.test_oracles import canonical


def as_sql(spark, folder, name):
    """The query's rows over the folder's tables, and those of its SQL."""
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for x in folder.glob("*.parquet"):
        c.execute(f"create view {x.stem} as select * from '{x}/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    result = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    return canonical(tuple(r) for r in df.select(*names).collect()), canonical(result.fetchall())


@contextlib.contextmanager
def at_most(spark, seconds):
    """Jobs still running after so long are cancelled, which fails the test: all pairs of its rows would take far longer."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def _half_credits(spark, folder):
    moment = datetime.datetime(2024, 1, 20)
    events = [(1, moment, 7, "view", 10.0, "a"), (2, moment, 8, "view", 90.0, "a")]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    orders = [(n, 7 + n % 2, price, datetime.datetime(1999, 1, 1)) for n, price in enumerate([12250.0, 12350.0, 12450.0, 50.0, 150.0, 99.0])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")


def test_usage_rounds_half_credits_to_even(spark, tmp_path):
    _half_credits(spark, tmp_path)
    mine, theirs = as_sql(spark, tmp_path, "org_usage")
    assert mine == theirs and len(mine) == 2


def test_quotas_round_half_credits_to_even(spark, tmp_path):
    _half_credits(spark, tmp_path)
    mine, theirs = as_sql(spark, tmp_path, "quota_summary")
    assert mine == theirs and len(mine) == 2


def test_feedback_of_one_frequent_key(spark):
    n = 200_000
    turns = spark.range(n).selectExpr("id as turn", "'k' as key", "if(id % 3 = 0, null, id % 5) as conv")
    feedback = spark.range(n).selectExpr("id as fb", "'k' as key", "if(id % 7 = 6, null, id % 7) as conv")
    with at_most(spark, 60):
        got = review.turn_feedback(turns, feedback, "turn", "key", "conv", F.desc("fb")).select("turn", "fb").collect()
    newest = {c: max(i for i in range(n) if (None if i % 7 == 6 else i % 7) == c) for c in [None, *range(6)]}
    want = {i: max(newest.values()) if i % 3 == 0 else max(newest[None], newest[i % 5]) for i in range(n)}
    assert {r.turn: r.fb for r in got} == want and len(got) == n


def test_matches_of_one_frequent_hash(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("id as p", "if(id < 6, 'x', concat('n', id)) as h1", "if(id < 0, '', 'k') as h2", "if(id % 2 = 0, 'e', null) as h3")
    with at_most(spark, 60):
        got = catalog.match_ranked(rows.withColumnRenamed("p", "q"), rows, "q", "p", ["h1", "h2", "h3"], 3).collect()
    assert len(got) == 3 * n
    of = {}
    for r in got:
        of.setdefault(r.q, []).append((r["rank"], r.p, r.kinds))
    assert sorted(of[4]) == [(1, 0, ["h1", "h2", "h3"]), (1, 1, ["h1", "h2"]), (1, 2, ["h1", "h2", "h3"])]
    assert sorted(of[501]) == [(1, 501, ["h1", "h2"]), (2, 0, ["h2"]), (2, 1, ["h2"])]


def test_references_to_a_code_of_many_drawings(spark):
    n = 100_000
    refs = spark.range(n).selectExpr("id as ref", "'a 1' as code", "if(id % 2 = 0, null, id % 100) as sheet")
    more = spark.createDataFrame([(-1, "A1", 3), (-1, "b", None), (-2, "c", None), (-3, "b", None), (-4, None, 1)], "ref long, code string, sheet long")
    drawings = spark.range(n).selectExpr("id as drawing", "'A1' as number", "id % 50 as sheet").union(spark.createDataFrame([(-1, "B", 1), (-2, "b", 2)], "drawing long, number string, sheet long"))
    with at_most(spark, 60):
        got = {r.ref: (r.n, r.status) for r in diff.resolve_references(refs.union(more), drawings).collect()}
    want = {i: (n, "possible") if i % 2 == 0 else (n // 50, "possible") if i % 100 < 50 else (0, "unresolved") for i in range(n)}
    assert got == want | {-1: (n // 50 + 2, "possible"), -2: (0, "unresolved"), -3: (2, "supported"), -4: (0, "unresolved")}


def test_interfaces_of_one_large_family(spark):
    n = 40_000
    a = spark.range(n).selectExpr("id % 2 as drawing", "id", "'f' as family", "if(id % 10 < 2, null, id % 3) as m1", "id % 2 as m2")
    links = spark.createDataFrame([(7, 0, 1), (8, 1, 1)], "link long, a_drawing long, b_drawing long")
    with at_most(spark, 60):
        got = {(r.link, r.a_id): (r.best, r.status) for r in diff.compare_interfaces(links, a, a, 0.5).collect()}
    m1 = lambda i: None if i % 10 < 2 else i % 3
    # other drawing: no m2 agrees; same drawing: all m2 do; an m1 that is null is compared with none
    want = {(7, i): (1 if m1(i) is None else min(j for j in range(3, 40, 2) if m1(j) == m1(i)), "possible") for i in range(0, n, 2)}
    want |= {(8, i): (1 if m1(i) is None else min(j for j in range(3, 40, 2) if m1(j) == m1(i)), "possible") for i in range(1, n, 2)}
    assert got == want


def test_compared_interfaces_of_one_large_kind(spark):
    n = 12_000
    metrics = "if(id % 4 = 3, null, map('w', double(id % 2 * 50 + 1)))"
    i = spark.range(n).selectExpr("id % 2 as drawing", "id", "'k' as kind", "if(id % 6 < 2, 'round', null) as shape", f"{metrics} as metrics", "map('d', double(if(id < 40, id, 100 + id % 2 * 300))) as dimensions", "if(id < 40, concat('s', id), '') as signature")
    twin = spark.createDataFrame([(0, n + 1, "k", "round", {"w": 1.0}, {"d": 5.0}, "s5")], i.schema)
    links = spark.createDataFrame([(7, 0, 1, True, True), (7, 0, 0, True, None)], "link long, a_drawing long, b_drawing long, supported boolean, comparable boolean")
    with at_most(spark, 90):
        got = {r.a_id: r for r in diff.interface_comparisons(links, i.union(twin)).where("a_id < 40 or a_id > 11990").collect()}
    # one link over two drawings: itself is the best for most ids below 40, then it has no other
    assert (got[4].best, got[4].others, got[4].score, got[4].status) == (4, [], 1.0, "supported")
    assert (got[n + 1].best, got[n + 1].others, got[n + 1].status) == (n + 1, [], "supported")
    late = [x for x in range(40, n, 2) if x % 4 != 3 and not (x % 6 < 2)]
    assert got[11996].best == min(x for x in range(40, n, 2))
    assert set(late) - {got[11996].best} <= set(got[11996].others) and got[11996].others == sorted(got[11996].others)


def test_coverage_of_one_large_definition(spark):
    n = 40_000
    leaves = spark.sql("select 1L as id, array(named_struct('x', 0.0d, 'y', 0.0d), named_struct('x', 10.0d, 'y', 0.0d)) as points, false as closed, 1L as owner")
    segments = spark.range(n).selectExpr("id as segment", "double(id % 10) as x", "0.5d as y")
    annotations = spark.sql("select 5L as segment, 1L as annotation, 3.0d as x, 0.0d as y")
    instances = spark.range(n).selectExpr("id", "1L as definition", "double(id) as x", "1000.0d as y")
    regions = spark.sql("select 7L as id, 'documentation_region' as kind, -1.0d as minx, 999.0d as miny, 9.5d as maxx, 1001.0d as maxy")
    with at_most(spark, 90):
        got = {tuple(r) for r in diff.instance_coverage(segments, annotations, leaves, instances, regions, 2.0, 8.0)[1].collect()}
    want = {(s, "computed", None, 0, 0, 0, n - 10) for s in range(n)} | {(s, "computed", 7, int(s == 5), int(s != 5), 9, 0) for s in range(n)}
    assert got == want


def test_repeated_references_are_counted_not_walked(spark):
    def of(n, parent, child):
        return spark.range(n).selectExpr(f"cast({parent} as long) as parent", f"{child}L as child", "0.0d as x", "0.0d as y", "1 as rows", "1 as cols", "0.0d as row_gap", "0.0d as col_gap", "true as known")

    defs = of(1, "null", 1).union(of(3000, 1, 2)).union(of(3000, 2, 3)).union(of(3000, 3, 1))
    with at_most(spark, 60):
        got = {(r.definition, r.depth, r.issue): r.n for r in diff.expand_instances(defs, 4, counted=True).collect()}
    assert got == {(1, 0, None): 1, (2, 1, None): 3000, (3, 2, None): 3000**2, (1, 3, "cycle"): 3000**3}
    few = of(1, "null", 1).union(of(3, 1, 2)).union(of(2, 2, 3))
    rows = diff.expand_instances(few, 4)
    assert "n" not in rows.columns and sorted(r.definition for r in rows.collect()) == [1] + [2] * 3 + [3] * 6


def test_pairs_of_a_large_station_are_dealt(spark):
    n = 600
    spans = spark.range(n, numPartitions=1).selectExpr("'g' as g", "id", "1 as low", "2 as high")
    per = review.dimension_chains(spans, "g", 1.0).where("relation = 'duplicate'").groupBy(F.spark_partition_id()).count().collect()
    sizes = [r["count"] for r in per]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) < 0.6 * sum(sizes)


def test_ties_of_a_text_line_have_one_order(spark):
    rows = [(1, 0, 0.0, 10.0, 1.0), (2, 0, 0.0, 10.0, 9.0), (3, 0, 20.0, 30.0, 1.0)]
    for turn in range(3):
        df = spark.createDataFrame(rows[turn:] + rows[:turn], "id long, line long, minx double, maxx double, h double").coalesce(1)
        got = {r.id: r.part for r in spatial.split_lines(df, "line", "minx", "maxx", "h", 1.5, F.desc("id")).collect()}
        assert got == {1: 0, 2: 0, 3: 1}


def test_triples_of_equal_spans_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(diff, "ALIKE", 20, raising=False)
    n = 90
    spans = spark.range(3 * n, numPartitions=1).selectExpr("'g' as g", "id", "if(id % 3 = 1, 2, 1) as low", "if(id % 3 = 0, 2, 3) as high")
    got = diff.partition_equations(spans, "g", 1.0)
    assert got.where("parent % 3 <> 2 or first % 3 <> 0 or second % 3 <> 1").isEmpty() and got.distinct().count() == n**3
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n**3 and max(sizes) < 0.6 * n**3


def test_many_grants_of_one_organisation_in_order(spark):
    n = 60_000
    at = "timestamp_seconds(1700000000 + {0})"
    charges = spark.range(n).selectExpr("if(id % 2 = 0, 1L, 2L) as org", "id as charge_id", f"{at.format('id')} as at", "3L as credits")
    # grants that ended long ago are not looked at by every charge
    grants = spark.range(n).selectExpr("1L as org", "id as grant_id", f"{at.format('-10')} as starts", f"if(id = 7, null, {at.format('-5 + id % 3')}) as ends", "1000L as credits")
    with at_most(spark, 60):
        got = ledger.draw_down_in_order(charges, grants).collect()
    alone = {(r.charge_id, r.credits) for r in got if r.org == 2 and r.grant_id is None}
    assert alone == {(i, 3) for i in range(1, n, 2)}
    mine = [r for r in got if r.org == 1]
    assert sum(r.credits for r in mine if r.grant_id == 7) == 1000 and sum(r.credits for r in mine) == 3 * n // 2
    assert {r.grant_id for r in mine} == {7, None}


def test_a_term_moves_once_a_batch(spark, tmp_path):
    n = 300
    df = spark.range(n, numPartitions=1).selectExpr("id", "concat('b a B ', if(id % 2 = 0, 'é', ''), ' a') as body", "if(id = 5, null, 'A') as title")
    index = text_index.build_index(df, "id", {"body": F.col("body"), "title": F.col("title")}, f"{tmp_path}/index", buckets=4)
    got = {(r.term, r.field, r.id): (r.size, r.positions) for r in index.postings.collect()}
    size = lambda i: 4 + (i % 2 == 0) + (i != 5)
    want = {("b", "body", i): (size(i), [0, 2]) for i in range(n)} | {("a", "body", i): (size(i), [1, 4 - i % 2]) for i in range(n)}
    want |= {("e", "body", i): (size(i), [3]) for i in range(0, n, 2)} | {("a", "title", i): (size(i), [0]) for i in range(n) if i != 5}
    assert got == want and spark.read.parquet(f"{tmp_path}/index/postings").count() == 4


def test_triples_of_many_equal_spans_are_made_when_read(spark):
    # 343 million triples, of which the memory of this session can't hold one row's
    spans = spark.range(2100, numPartitions=1).selectExpr("'g' as g", "id", "if(id % 3 = 1, 2, 1) as low", "if(id % 3 = 0, 2, 3) as high")
    with at_most(spark, 90):
        got = diff.partition_equations(spans, "g", 1.0).take(5)
    assert len(set(got)) == 5 and all((r.parent % 3, r["first"] % 3, r.second % 3) == (2, 0, 1) for r in got)


def test_chains_move_equal_spans_as_one_row(spark):
    n = 20_000
    spans = spark.range(n).selectExpr("if(id % 2 = 0, 'g', 'h') as g", "id", "id % 4 as low", "if(id % 4 = 3, null, id % 4 + 1 + id % 8 div 4) as high")
    few = spans.where("id < 80")
    rows = [(r.g, r.id, r.low, r.high) for r in few.collect()]
    want = {(g, a, b, "continuous") for g, a, _, ah in rows for h, b, bl, _ in rows if g == h and ah == bl and a != b}
    want |= {(g, a, b, "duplicate" if ah is not None and ah == bh else "common_baseline") for g, a, al, ah in rows for h, b, bl, bh in rows if g == h and al == bl and a < b}
    want |= {(g, a, b, "shared_datum") for g, a, al, ah in rows for h, b, bl, bh in rows if g == h and al != bl and ah == bh and ah is not None and a < b}
    assert sorted(map(tuple, review.dimension_chains(few, "g", 1.0).collect())) == sorted(want)
    # rows that wait to be shuffled: classes and their parts, not spans
    plan = review.dimension_chains(spans, "g", 1.0)._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = [spark.read.parquet(*plan.apply(i).relation().location().rootPaths().mkString(",").split(",")) for i in range(plan.size())]
    assert max(df.count() for df in read) < n / 50
