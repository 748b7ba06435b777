"""Queries over archives and reviews, which documents, orders, events and parts stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit as A
from ..operators import catalog as K
from ..operators import diff as D
from ..operators import instances as I
from ..operators import review as R
from .registry import query, t


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND n_chars < 2000 AND lang IN ('en', 'fr')""")
def valid_evidence(spark, d):
    x = t(spark, d, "documents").withColumn("path", F.concat(F.when(F.col("doc_id") % 3 == 0, "../").otherwise("img/"), F.col("doc_id").cast("string"), F.lit(".png")))
    x = x.withColumn("digest", F.when(F.col("doc_id") % 5 == 0, F.md5("text")).otherwise(F.sha2("text", 256))).withColumn("low", F.col("n_chars").cast("double")).withColumn("high", F.lit(2000.0))
    return R.valid_evidence(x, "path", "digest", ["low", "high"], ["n_chars"], ("lang", ["en", "fr"])).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_orderdate BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AND TIMESTAMP '1998-01-01' OR o_orderdate + INTERVAL 90 DAY BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AND TIMESTAMP '1998-01-01') AND o_orderkey % 4 <> 0")
def recent_files(spark, d):
    o = t(spark, d, "orders").withColumn("later", F.col("o_orderdate") + F.expr("interval 90 days")).withColumn("gone", F.col("o_orderkey") % 4 == 0)
    return R.recent_files(o, ["o_orderdate", "later"], F.expr("timestamp_ntz '1998-01-01'"), 30, ("o_orderstatus", "O"), "gone").select("o_orderkey")


@query("""WITH c AS (SELECT c_custkey AS u, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS m, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS r FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT u, m AS has_messages, r AS has_runs, NOT m AS archive_gap FROM c WHERE m OR r""")
def included_users(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders").withColumnRenamed("o_custkey", "u")
    users = c.select(F.col("c_custkey").alias("u"), F.concat(F.lit("x@"), "c_mktsegment").alias("mail"))
    return R.included_users(users, "u", "mail", "machinery", o.where("o_orderstatus = 'P'").select("u"), o.where("o_totalprice > 400000").select("u"))


@query("""WITH t AS (SELECT p_partkey AS turn_id, p_name || p_brand AS k1, p_name AS k2 FROM part WHERE p_partkey % 2 = 0), e AS (SELECT p_partkey AS id, p_name || p_brand AS k1, p_name AS k2 FROM part WHERE p_partkey % 2 = 1),
u1 AS (SELECT k1, min(turn_id) AS turn_id FROM t GROUP BY 1 HAVING count(*) = 1), u2 AS (SELECT k2, min(turn_id) AS turn_id FROM t GROUP BY 1 HAVING count(*) = 1)
SELECT id, coalesce(u1.turn_id, u2.turn_id) AS turn_id, CASE WHEN u1.turn_id IS NOT NULL THEN 1 ELSE 2 END AS tier FROM e LEFT JOIN u1 USING (k1) LEFT JOIN u2 USING (k2) WHERE u1.turn_id IS NOT NULL OR u2.turn_id IS NOT NULL""")
def evidence_turns(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_brand").alias("k1"), F.col("p_name").alias("k2"))
    turns = p.where("id % 2 = 0").withColumnRenamed("id", "turn_id")
    return R.associate(p.where("id % 2 = 1"), "id", [("k1", turns, "k1"), ("k2", turns, "k2")])


@query("""WITH t AS (SELECT event_id AS turn, props, CASE WHEN event_id % 3 = 0 THEN user_id END AS conv FROM events WHERE event_type = 'view'), f AS (SELECT event_id AS fb, props, CASE WHEN event_id % 2 = 0 THEN user_id END AS conv FROM events WHERE event_type = 'purchase')
SELECT turn, max(fb) AS fb FROM t JOIN f USING (props) WHERE t.conv IS NULL OR f.conv IS NULL OR t.conv = f.conv GROUP BY 1""")
def turn_feedback(spark, d):
    e = t(spark, d, "events")
    turns = e.where("event_type = 'view'").select(F.col("event_id").alias("turn"), "props", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("conv"))
    fb = e.where("event_type = 'purchase'").select(F.col("event_id").alias("fb"), "props", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("conv"))
    return R.turn_feedback(turns, fb, "turn", "props", "conv", F.desc("fb")).select("turn", "fb")


@query("""SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'""")
def review_rows(spark, d):
    o, c, n, r = (t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.where("o_orderstatus = 'F'").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return j.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS count, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (1, 2)")
def review_rollup(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    return R.rollup_counts(o.join(c, o["o_custkey"] == c["c_custkey"]), ["c_mktsegment", "c_nationkey"], "o_orderstatus", ["F", "O"])


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 97 = 0)")
def same_signature(spark, d):
    p = t(spark, d, "part")
    return R.locate_by_signature(p.where("p_partkey % 97 = 0"), p, "p_partkey", "p_name")[0]


@query("""WITH p AS (SELECT o_custkey % 20 AS owner, o_orderpriority AS project, count(*) AS files, sum(CAST(floor(o_totalprice) AS BIGINT)) AS bytes, max(o_orderdate) AS latest FROM orders GROUP BY 1, 2)
SELECT owner, count(*) AS projects, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, max(latest) AS latest, arg_min(project, (-bytes, project)) AS largest FROM p GROUP BY 1""")
def owner_rollup(spark, d):
    o = t(spark, d, "orders").withColumn("owner", F.col("o_custkey") % 20).withColumn("size", F.floor("o_totalprice").cast("long"))
    return R.owner_rollup(o, "owner", "o_orderpriority", "size", "o_orderdate").withColumnRenamed("o_orderpriority", "project")


@query("""WITH f AS (SELECT l_partkey AS k, CASE WHEN l_orderkey % 100 = 0 THEN 7 ELSE 1 END AS s FROM lineitem WHERE l_partkey % 50 <> 1), b AS (SELECT p_partkey AS k, 1 AS s FROM part WHERE p_partkey % 30 <> 2)
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM f WHERE k NOT IN (SELECT k FROM b)) AS missing, (SELECT count(*) FROM f JOIN b USING (k) WHERE f.s <> b.s) AS mismatched, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM f)) AS dangling""")
def corpus_integrity(spark, d):
    f = t(spark, d, "lineitem").where("l_partkey % 50 <> 1").selectExpr("l_partkey as k", "if(l_orderkey % 100 = 0, 7, 1) as s")
    return R.corpus_integrity(f, t(spark, d, "part").where("p_partkey % 30 <> 2").selectExpr("p_partkey as k", "1 as s"), "k", "s")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS children, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS pending FROM customer")
def conversation_listing(spark, d):
    o = t(spark, d, "orders")
    return R.listing(t(spark, d, "customer"), "c_custkey", o, "o_custkey", o.where("o_orderstatus = 'P'"))


@query("SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS observations, coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey), TIMESTAMP '1990-01-01') AS last_seen FROM customer")
def pattern_list(spark, d):
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("timestamp_ntz '1990-01-01'").alias("made"))
    return R.pattern_list(p, t(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k", "made", "o_orderdate")


@query("SELECT l_suppkey, count(*) AS hits FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt')) GROUP BY 1 ORDER BY hits DESC, l_suppkey LIMIT 10")
def semantic_search(spark, d):
    p = t(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    return R.search_semantics(p, t(spark, d, "lineitem"), "Bolt", "p_name", "l_partkey", "l_suppkey", 10)


@query("""WITH l AS (SELECT l_orderkey AS g, l_linenumber AS o, CASE WHEN l_quantity < 25 THEN l_linenumber || '. part ' || l_partkey ELSE 'and ' || l_suppkey END AS t, CASE WHEN l_quantity < 25 THEN l_linenumber END AS n, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
m AS (SELECT *, count(n) OVER (PARTITION BY g ORDER BY rn) AS i FROM l)
SELECT g, max(n) AS number, string_agg(CASE WHEN n IS NOT NULL THEN 'part ' || l_partkey ELSE t END, ' ' ORDER BY rn) AS text FROM m WHERE i > 0 GROUP BY g, i""")
def numbered_lines(spark, d):
    from pyspark.sql import Window

    li = t(spark, d, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    text = F.when(F.col("l_quantity") < 25, F.concat(F.col("l_linenumber").cast("string"), F.lit(". part "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("and "), F.col("l_suppkey").cast("string")))
    return R.extract_numbered(li.select(F.col("l_orderkey").alias("g"), "rn", text.alias("t")), "g", "rn", "t")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 10.0::DOUBLE WHEN 1 THEN p_size * 1.0::DOUBLE WHEN 2 THEN p_size * 25.4::DOUBLE END AS value, CASE p_partkey % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'drawing_unit' WHEN 2 THEN 'explicit' ELSE 'unresolved' END AS status FROM part""")
def quantities(spark, d):
    suffix = F.element_at(F.array(F.lit(" cm"), F.lit(""), F.lit("in"), F.lit(" furlong")), (F.col("p_partkey") % 4 + 1).cast("int"))
    value, status = R.normalize_quantity(F.concat(F.col("p_size").cast("string"), suffix), {"mm": 1.0, "cm": 10.0, "in": 25.4})
    return t(spark, d, "part").select("p_partkey", value.alias("value"), status.alias("status"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size::BIGINT END AS number FROM part")
def table_cells(spark, d):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" ( "), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("x")))
    return t(spark, d, "part").select("p_partkey", C.parse_number_cell(cell).alias("number"))


@query("SELECT event_id, CAST(round_even(value / 0.5, 0) AS BIGINT) AS cell FROM events")
def grid_cells(spark, d):
    return t(spark, d, "events").select("event_id", C.quantize(F.col("value"), 0.5).alias("cell"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS paths FROM events")
def harvested_paths(spark, d):
    """The path lies in JSON inside a text inside JSON."""
    inner = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("imagePath")))
    outer = F.to_json(F.struct(F.array(F.struct(inner.alias("result"))).alias("calls")))
    return t(spark, d, "events").select("event_id", F.array_join(R.harvest_paths(outer), ",").alias("paths"))


@query("SELECT p_partkey, 20 * (contains(p_name, 'red')::INT + contains(p_name, 'bolt')::INT) + CASE WHEN (contains(p_name, 'red') OR contains(p_name, 'bolt')) AND p_type = 'PROMO' THEN 5 ELSE 0 END AS relevance FROM part")
def part_relevance(spark, d):
    return t(spark, d, "part").select("p_partkey", C.relevance(F.col("p_name"), F.col("p_type"), ["red", "bolt"], {"PROMO": 5}).alias("relevance"))


@query("SELECT p_partkey, f AS family FROM part JOIN (VALUES ('fastener', 'PROMO', 'bolt'), ('drive', 'SMALL', 'gear|ring')) AS v(f, k, p) ON regexp_matches(p_name, p) AND p_type = k")
def semantic_families(spark, d):
    return R.semantic_families(t(spark, d, "part"), "p_name", "p_type", [("fastener", "PROMO", "bolt"), ("drive", "SMALL", "gear|ring")])[0].select("p_partkey", "family")


@query("SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey")
def crossing_pairs(spark, d):
    return R.crossing_pairs(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query()
def crossing_pairs_whole(spark, d):
    """crossing_pairs over all lines; compared with plain Python in tests."""
    return R.crossing_pairs(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("""WITH s AS (SELECT p_brand AS g, p_partkey AS id, p_size AS l, p_size + 1 + p_partkey % 9 AS h FROM part)
SELECT a.g, a.id AS a, b.id AS b, 'continuous' AS relation FROM s a JOIN s b ON a.g = b.g AND a.h = b.l UNION ALL SELECT a.g, a.id, b.id, CASE WHEN a.h = b.h THEN 'duplicate' ELSE 'common_baseline' END FROM s a JOIN s b ON a.g = b.g AND a.l = b.l AND a.id < b.id
UNION ALL SELECT a.g, a.id, b.id, 'shared_datum' FROM s a JOIN s b ON a.g = b.g AND a.h = b.h AND a.l <> b.l AND a.id < b.id""")
def dimension_chains(spark, d):
    return R.dimension_chains(t(spark, d, "part").selectExpr("p_brand as g", "p_partkey as id", "p_size as low", "p_size + 1 + p_partkey % 9 as high"), "g", 1.0)


@query()
def dimension_chains_whole(spark, d):
    """dimension_chains over all parts; compared with plain Python in tests."""
    return R.dimension_chains(t(spark, d, "part").selectExpr("p_brand as g", "p_partkey as id", "p_size as low", "p_size + 1 + p_partkey % 9 as high"), "g", 1.0)


_SPANS = "s AS (SELECT p_brand AS g, p_partkey AS id, p_partkey * 7 % 60 AS l, p_partkey * 7 % 60 + 1 + p_partkey % 9 + CASE WHEN p_partkey % 8 = 0 THEN 20 ELSE 0 END AS h FROM part)"


def _spans(spark, d):
    return t(spark, d, "part").selectExpr("p_brand as g", "p_partkey as id", "p_partkey * 7 % 60 as low", "p_partkey * 7 % 60 + 1 + p_partkey % 9 + if(p_partkey % 8 = 0, 20, 0) as high")


@query(f"WITH {_SPANS} SELECT b.g, b.id, arg_min(a.id, (-a.h, a.id)) AS container FROM s a JOIN s b ON a.g = b.g AND a.l <= b.l AND a.h >= b.h AND (a.l < b.l OR a.h > b.h) GROUP BY b.g, b.id")
def nested_spans(spark, d):
    return R.nested_spans(_spans(spark, d), "g", 1.0)


_CHAINS = _SPANS + """, e AS (SELECT a.id AS x, b.id AS y FROM s a JOIN s b ON a.g = b.g AND a.h = b.l UNION SELECT b.id, a.id FROM s a JOIN s b ON a.g = b.g AND a.h = b.l),
r AS (SELECT x AS id, x AS low FROM e UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.id WHERE r.low < e.y), c AS (SELECT id, min(low) AS chain FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {_CHAINS} SELECT id, chain FROM c")
def span_chains(spark, d):
    return R.span_chains(_spans(spark, d), "g", 1.0)


@query(f"""WITH RECURSIVE {_CHAINS}, w AS (SELECT g, chain, count(*) AS parts, min(l) AS low, max(h) AS high FROM c JOIN s USING (id) GROUP BY 1, 2 HAVING sum(h - l) = max(h) - min(l))
SELECT chain, parts, low, high, (SELECT count(*) FROM s LEFT JOIN c USING (id) WHERE s.g = w.g AND s.l = w.low AND s.h = w.high AND c.chain IS DISTINCT FROM w.chain) AS parents FROM w""")
def chain_totals(spark, d):
    return R.chain_totals(_spans(spark, d), "g", 1.0)


@query("SELECT p_partkey, p_type IS NOT DISTINCT FROM 'PROMO' AND p_size % 2 = 0 AS comparable, CASE WHEN p_type <> 'PROMO' THEN 'other_number' WHEN p_size % 2 = 1 THEN 'other_sheet' ELSE 'same' END AS reason FROM part")
def comparable_headers(spark, d):
    p = t(spark, d, "part")
    return D.compare_identity(p.selectExpr("p_partkey", "p_type as n", "p_size % 2 as s"), p.selectExpr("p_partkey", "'PROMO' as n", "0 as s"), "p_partkey", "n", "s")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(CASE WHEN b.doc_id % 2 = 0 THEN 'new' END, CASE WHEN a.doc_id IS NOT NULL THEN 'old' END) AS record FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) a FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0) b ON a.doc_id = b.doc_id WHERE b.doc_id % 2 = 0 OR a.doc_id IS NOT NULL")
def merged_scans(spark, d):
    x = t(spark, d, "documents")
    return K.merge_scan(x.where("doc_id % 3 = 0").selectExpr("doc_id", "'old' as record"), x.where("doc_id % 5 = 0").selectExpr("doc_id", "'new' as record", "doc_id % 2 = 0 as ok"), "doc_id", "record", "ok")


#: Part c is a definition, placed in part c div 2: turned by quarters, some mirrored, scaled by halves and doubles, some as
#: grids; every 97th also refers to its grandparent (a cycle), every 89th to a part that is not there.
_BLOCKS = """e AS (SELECT p_partkey // 2 AS owner, p_partkey AS handle, p_partkey AS target, p_partkey FROM part WHERE p_partkey > 1
 UNION ALL SELECT p_partkey, p_partkey + 1000000000, p_partkey // 4, p_partkey FROM part WHERE p_partkey % 97 = 5 AND p_partkey > 7
 UNION ALL SELECT p_partkey, p_partkey + 2000000000, -p_partkey, p_partkey FROM part WHERE p_partkey % 89 = 7 UNION ALL SELECT p_partkey, p_partkey + 3000000000, NULL, p_partkey FROM part WHERE p_partkey % 5 = 1),
q AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END AS c, CASE p_partkey % 4 WHEN 1 THEN 1.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS s, CASE WHEN p_partkey % 3 = 1 THEN 0.5 WHEN p_partkey % 3 = 2 THEN 2.0 ELSE 1.0 END * CASE WHEN p_partkey % 7 = 3 THEN -1.0 ELSE 1.0 END AS sx, CASE WHEN p_partkey % 3 = 1 THEN 0.5 WHEN p_partkey % 3 = 2 THEN 2.0 ELSE 1.0 END AS sy FROM e),
m AS (SELECT owner, handle, target, (c * sx)::DOUBLE AS a, (-s * sy)::DOUBLE AS b, (s * sx)::DOUBLE AS d, (c * sy)::DOUBLE AS f, (p_partkey % 11)::DOUBLE AS x, (p_partkey % 13)::DOUBLE AS y, CASE WHEN p_partkey % 12 = 4 THEN 2 ELSE 1 END AS rows, CASE WHEN p_partkey % 10 = 3 THEN 2 ELSE 1 END AS cols FROM q),
g AS (SELECT owner, handle, target, a, b, d, f, a * j * 4 + b * i * 8 + x AS x, d * j * 4 + f * i * 8 + y AS y, i, j FROM m, unnest(range(rows)) AS u(i), unnest(range(cols)) AS v(j) WHERE target IS NOT NULL UNION ALL SELECT owner, handle, NULL, 1, 0, 0, 1, 0, 0, 0, 0 FROM m WHERE target IS NULL),
w AS (SELECT owner, handle, target, a, b, d, f, x, y, i, j, 0 AS depth, [1::BIGINT] AS above FROM g WHERE owner = 1
 UNION ALL SELECT g.owner, g.handle, g.target, w.a * g.a + w.b * g.d, w.a * g.b + w.b * g.f, w.d * g.a + w.f * g.d, w.d * g.b + w.f * g.f, w.a * g.x + w.b * g.y + w.x, w.d * g.x + w.f * g.y + w.y, g.i, g.j, w.depth + 1, list_append(w.above, w.target)
 FROM w JOIN g ON g.owner = w.target WHERE w.depth < 9 AND NOT list_contains(w.above, w.target) AND w.target > 0)"""


def _expanded(spark, d):
    p = t(spark, d, "part").select("p_partkey")
    turn = F.expr("p_partkey % 4")
    c, s = F.when(turn == 0, 1.0).when(turn == 2, -1.0).otherwise(0.0), F.when(turn == 1, 1.0).when(turn == 3, -1.0).otherwise(0.0)
    size = F.expr("case when p_partkey % 3 = 1 then 0.5d when p_partkey % 3 = 2 then 2.0d else 1.0d end")
    sx, zero, one = size * F.expr("if(p_partkey % 7 = 3, -1.0d, 1.0d)"), F.lit(0.0), F.lit(1.0)
    matrix = F.array(c * sx, -s * size, zero, F.expr("double(p_partkey % 11)"), s * sx, c * size, zero, F.expr("double(p_partkey % 13)"), zero, zero, one, zero, zero, zero, zero, one)
    rows = [("p_partkey > 1", "p_partkey div 2", 0, "p_partkey"), ("p_partkey % 97 = 5 and p_partkey > 7", "p_partkey", 1, "p_partkey div 4"), ("p_partkey % 89 = 7", "p_partkey", 2, "-p_partkey"), ("p_partkey % 5 = 1", "p_partkey", 3, "null")]
    parts = [p.where(w).select(F.expr(owner).alias("owner"), (F.col("p_partkey") + n * 1_000_000_000).alias("handle"), F.expr(f"cast({target} as bigint)").alias("target"), matrix.alias("matrix"), F.expr("if(p_partkey % 12 = 4, 2, 1)").alias("rows"), F.expr("if(p_partkey % 10 = 3, 2, 1)").alias("cols"), F.lit(8.0).alias("row_gap"), F.lit(4.0).alias("col_gap")) for w, owner, n, target in rows]
    entities = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return I.expand_affine(p.where("p_partkey > 0").select(F.col("p_partkey").alias("definition"), (F.col("p_partkey") == 1).alias("is_root")), entities, 9)


@query(f"""WITH RECURSIVE {_BLOCKS} SELECT handle::VARCHAR AS handle, CASE WHEN target IS NULL THEN 'entity' ELSE 'reference' END AS kind, depth, i::INT AS row, j::INT AS col, a + 0.0 AS a, b + 0.0 AS b, d + 0.0 AS d, f + 0.0 AS f, x + 0.0 AS x, y + 0.0 AS y FROM w""")
def affine_instances(spark, d):
    """Every instance of a nested, turned, mirrored and scaled assembly, and its place."""
    cell = lambda i: F.get("world", i) + 0.0
    return _expanded(spark, d)[0].select("handle", "kind", "depth", "row", "col", cell(0).alias("a"), cell(1).alias("b"), cell(4).alias("d"), cell(5).alias("f"), cell(3).alias("x"), cell(7).alias("y"))


@query(f"""WITH RECURSIVE {_BLOCKS} SELECT handle::VARCHAR AS handle, CASE WHEN target < 0 THEN 'TARGET_DEFINITION_MISSING' WHEN depth = 9 THEN 'MAX_NESTING_DEPTH_REACHED' ELSE 'CYCLIC_BLOCK_REFERENCE' END AS code, count(*) AS n
FROM w WHERE target < 0 OR depth = 9 AND target IS NOT NULL OR list_contains(above, target) GROUP BY 1, 2""")
def instance_diagnostics(spark, d):
    """References that the walk keeps but does not enter."""
    return _expanded(spark, d)[1].groupBy("handle", "code").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE i AS (SELECT p_partkey % 13 AS parent, p_partkey % 29 + 13 AS child, (p_partkey % 7)::DOUBLE AS x, 1 + p_size % 2 AS cols FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT p_partkey % 29 + 13, p_partkey % 31 + 42, 2.0::DOUBLE, 1 FROM part WHERE p_partkey % 17 = 0 UNION ALL SELECT NULL, p_partkey % 13, 0.0::DOUBLE, 1 FROM part WHERE p_partkey < 13),
r AS (SELECT parent, child, x + j * 10 AS x FROM i, unnest(range(cols)) AS u(j)), w AS (SELECT child, x, 0 AS depth FROM r WHERE parent IS NULL UNION ALL SELECT r.child, w.x + r.x, depth + 1 FROM w JOIN r ON r.parent = w.child WHERE depth < 4)
SELECT child AS definition, x, depth, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def expanded_instances(spark, d):
    p = t(spark, d, "part")
    defs = p.where("p_partkey % 11 = 0").selectExpr("p_partkey % 13 as parent", "p_partkey % 29 + 13 as child", "double(p_partkey % 7) as x", "1 + p_size % 2 as cols")
    defs = defs.unionByName(p.where("p_partkey % 17 = 0").selectExpr("p_partkey % 29 + 13 as parent", "p_partkey % 31 + 42 as child", "2.0d as x", "1 as cols"))
    defs = defs.unionByName(p.where("p_partkey < 13").selectExpr("cast(null as bigint) as parent", "p_partkey % 13 as child", "0.0d as x", "1 as cols"))
    full = defs.selectExpr("*", "0.0d as y", "1 as rows", "0.0d as row_gap", "10.0d as col_gap", "true as known")
    return D.expand_instances(full, 4, counted=True).groupBy("definition", "x", "depth").agg(F.sum("n").alias("n"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT o_custkey AS a, o_orderkey * 7 % 1000 AS b, o_orderstatus = 'F' AS p FROM orders WHERE o_orderkey * 7 % 1000 < (SELECT count(*) FROM customer)), e AS (SELECT a, b, p FROM s UNION ALL SELECT b, a, p FROM s),
l AS (SELECT c_custkey AS n, c_custkey AS low FROM customer UNION SELECT e.b, l.low FROM l JOIN e ON e.a = l.n WHERE l.low < e.b), u AS (SELECT c_custkey AS n, c_custkey AS low FROM customer UNION SELECT e.b, u.low FROM u JOIN e ON e.a = u.n AND e.p WHERE u.low < e.b)
SELECT (SELECT count(DISTINCT m) FROM (SELECT min(low) AS m FROM l GROUP BY n)) AS lower, (SELECT count(DISTINCT m) FROM (SELECT min(low) AS m FROM u GROUP BY n)) AS upper""")
def count_interval(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    same = t(spark, d, "orders").selectExpr("o_custkey as src", "o_orderkey * 7 % 1000 as dst", "o_orderstatus = 'F' as proven").distinct()
    return A.count_interval(same.join(c.select(F.col("node").alias("dst")), "dst", "left_semi"), c, "proven")
