"""Queries over catalogs and graphs, which parts, customers, orders and events stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import graph as G
from ..operators import layout
from ..operators import validators as V
from .registry import query, t


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type = 'PROMO' AND list_contains(string_split(p_name, ' '), 'red') AND (contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(lower(p_name), 'ge'))")
def filter_atoms(spark, d):
    p = t(spark, d, "part").withColumn("tags", F.split("p_name", " "))
    return K.filter_rows(p, {"p_type": "PROMO", "p_brand": None}, {"tags": "red"}, "GE", ["p_name"]).unionByName(K.filter_rows(p, {"p_type": "PROMO"}, {"tags": "red"}, "Bolt", ["p_name", "p_brand"])).select("p_partkey", "p_name", "p_type").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def page_by_offset(spark, d):
    return K.page(t(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey", 25, 50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 25")
def page_by_key(spark, d):
    return K.page(t(spark, d, "orders"), "o_orderkey", 25, after=700).select("o_orderkey", "o_totalprice")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def scalar_facet(spark, d):
    return K.facet(t(spark, d, "events"), "event_type")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1")
def array_facet(spark, d):
    return K.facet_array(t(spark, d, "part").select(F.split("p_name", " ").alias("tags")), "tags")


@query("""WITH p AS (SELECT p_partkey, p_type, unnest(list_distinct(string_split(p_name, ' '))) AS host FROM part)
SELECT p_type AS scope, NULL AS host, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*) FROM part
UNION ALL SELECT p_type, host, count(DISTINCT p_partkey) FROM p GROUP BY 1, 2 UNION ALL SELECT NULL, host, count(DISTINCT p_partkey) FROM p GROUP BY 2""")
def scope_cube(spark, d):
    return K.scope_cube(t(spark, d, "part").withColumn("hosts", F.split("p_name", " ")), "p_partkey", "p_type", "hosts")


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 45 THEN 'size' END, CASE WHEN p_retailprice > 1000 THEN 'price' END, CASE WHEN p_brand NOT LIKE 'Brand#1%' THEN 'brand' END) AS errors FROM part""")
def row_errors(spark, d):
    rules = {"size": F.col("p_size") > 45, "price": F.col("p_retailprice") > 1000, "brand": ~F.col("p_brand").like("Brand#1%")}
    return K.row_errors(t(spark, d, "part"), rules).select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unknown_references(spark, d):
    known = t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return K.unknown_references(t(spark, d, "lineitem"), known, "l_partkey").select("l_orderkey", "l_partkey")


@query("SELECT page_id, CASE WHEN regexp_matches(url, 'pills|spam') THEN 'advert' WHEN regexp_matches(url, '/es/') THEN 'spanish' WHEN regexp_matches(url, '^https') THEN 'secure' END AS reason FROM pages")
def file_classes(spark, d):
    return t(spark, d, "pages").select("page_id", K.classify_first(F.col("url"), [("pills|spam", "advert"), ("/es/", "spanish"), ("^https", "secure")]).alias("reason"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(p_name, 'red|hot') THEN 'warm' END, CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'metal' END, 'part') AS tags FROM part")
def domain_tags(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(K.all_tags(F.col("p_name"), [("red|hot", "warm"), ("bolt|gear", "metal")], "part"), ",").alias("tags"))


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def curated_documents(spark, d):
    return K.with_default(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id", "quality", -1)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 40")
def next_batch(spark, d):
    return K.pending(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id", 40)


@query("SELECT k, count(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1 HAVING count(*) > 1")
def merge_collisions(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return K.merge_unique([a, b], "k")[1]


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def three_way_split(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return K.three_way(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")


@query("""SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['F', 'O', 'P'], o_orderstatus), o_orderkey) = 1""")
def strongest_edges(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return K.strongest([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")], "o_custkey", "o_orderstatus", ["F", "O", "P"], "o_orderkey")


@query("SELECT 'rows' AS name, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM part UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2")
def dataset_manifest(spark, d):
    return K.manifest(t(spark, d, "part"), ["p_type", "p_size"]).where("name <> 'digest'")


@query("""WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 300 GROUP BY 1)
SELECT coalesce(a.lang, b.lang) AS lang, a.n AS actual, b.n AS expected FROM a FULL JOIN b ON a.lang = b.lang WHERE a.n IS DISTINCT FROM b.n""")
def count_assertions(spark, d):
    x = t(spark, d, "documents")
    return K.count_differences(x.groupBy("lang").agg(F.count("*").alias("n")), x.where("n_chars > 300").groupBy("lang").agg(F.count("*").alias("n")), ["lang"])


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def node_summary(spark, d):
    return K.node_summary(t(spark, d, "nation").select("n_nationkey"), "n_nationkey", {"customers": (t(spark, d, "customer"), "c_nationkey"), "suppliers": (t(spark, d, "supplier"), "s_nationkey")})


@query("""WITH n AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 1), e AS (SELECT user_id, min(event_type) AS k FROM events WHERE event_id % 2 = 0 AND user_id % 2 = 0 GROUP BY 1),
f AS (SELECT n.*, k, coalesce(k, first_value(event_type) OVER (PARTITION BY n.user_id ORDER BY event_id)) AS first, row_number() OVER (PARTITION BY n.user_id ORDER BY event_id) AS rn FROM n LEFT JOIN e USING (user_id))
SELECT event_id, CASE WHEN event_type <> first THEN 'conflict' WHEN k IS NOT NULL OR rn > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM f""")
def register_observations(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    known = e.where("event_id % 2 = 0 and user_id % 2 = 0").groupBy("user_id").agg(F.min("event_type").alias("event_type"))
    return K.register(e.where("event_id % 2 = 1"), known, ["user_id"], "event_type", "event_id").select("event_id", "status")


@query("""WITH q AS (SELECT p_partkey AS q, p_name AS h1, p_brand AS h2, p_type AS h3 FROM part WHERE p_partkey % 50 = 0), p AS (SELECT p_partkey AS p, p_name AS h1, p_brand AS h2, p_type AS h3 FROM part),
m AS (SELECT q, p, CASE WHEN q.h1 = p.h1 THEN 1 WHEN q.h2 = p.h2 THEN 2 ELSE 3 END AS rank, concat_ws(',', CASE WHEN q.h1 = p.h1 THEN 'h1' END, CASE WHEN q.h2 = p.h2 THEN 'h2' END, CASE WHEN q.h3 = p.h3 THEN 'h3' END) AS kinds
 FROM q JOIN p ON q.h1 = p.h1 OR q.h2 = p.h2 OR q.h3 = p.h3)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank, p) <= 5""")
def fingerprint_matches(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_name").alias("h1"), F.col("p_brand").alias("h2"), F.col("p_type").alias("h3"))
    out = K.match_ranked(p.where("p % 50 = 0").withColumnRenamed("p", "q"), p, "q", "p", ["h1", "h2", "h3"], 5)
    return out.select("q", "p", "rank", F.array_join("kinds", ",").alias("kinds"))


_SNAPSHOT = "a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 4)"


@query(f"""WITH {_SNAPSHOT} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.h, a.h) AS h, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def snapshot_upsert(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return K.apply_snapshot(x.where("doc_id % 10 <> 3"), x.where("doc_id % 10 <> 4").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "new").otherwise(F.col("h"))), ["doc_id"], "h")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'scan' WHEN doc_id % 5 = 0 THEN 'rehash' ELSE 'keep' END AS plan FROM documents""")
def rescan_plan(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), F.lit(1).alias("mtime"))
    return K.plan_rescan(x, x.where("doc_id % 3 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1)), "doc_id")


@query("""WITH a AS (SELECT source, lang, count(*) AS a FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT source, lang, count(*) AS b FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2)
SELECT sum(least(coalesce(a, 0), coalesce(b, 0)))::DOUBLE / sum(greatest(coalesce(a, 0), coalesce(b, 0))) AS jaccard FROM a FULL JOIN b ON a.source = b.source AND a.lang = b.lang""")
def version_jaccard(spark, d):
    x = t(spark, d, "documents")
    return K.multiset_jaccard(x.where("doc_id % 2 = 0"), x.where("doc_id % 3 = 0"), ["source", "lang"])


@query("SELECT p_partkey, count(DISTINCT p_size) OVER (PARTITION BY p_name, p_brand) > 1 AS conflict FROM part")
def property_conflicts(spark, d):
    return K.flag_conflicts(t(spark, d, "part"), ["p_name", "p_brand"], F.col("p_size")).select("p_partkey", "conflict")


@query("""WITH c AS (SELECT lang, count(*) AS n, count(quality) AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT lang, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE k::DOUBLE / n END AS labelled FROM c""")
def label_coverage(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("quality").alias("k"), F.count("*").alias("n"))
    return x.select("lang", K.coverage(F.col("k"), F.col("n")).alias("labelled"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' OR p_size <= 2 THEN 'rejected' WHEN NOT (p_name LIKE '%bolt%' OR p_name LIKE '%gear%') THEN 'abstained'
 WHEN (CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 950 THEN 1 ELSE 0 END) / 2.0 < 0.5 THEN 'ambiguous' ELSE 'supported' END AS status FROM part""")
def rule_evaluation(spark, d):
    p = t(spark, d, "part")
    out = K.evaluate_rules(p, {"size": F.col("p_size") > 2}, {"a": F.col("p_name").like("%bolt%"), "b": F.col("p_name").like("%gear%")}, {"s": F.col("p_size") > 25, "p": F.col("p_retailprice") > 950}, {"promo": F.col("p_type") == "PROMO"})
    return out.select("p_partkey", "status")


@query("""WITH h AS (SELECT doc_id, 'a' AS label, 2.0 AS w FROM documents WHERE contains(lower(text), 'thing') UNION ALL SELECT doc_id, 'b', 1.0 FROM documents WHERE contains(lower(text), 'ation') UNION ALL SELECT doc_id, 'b', 1.0 FROM documents WHERE contains(lower(text), 'euxan')),
s AS (SELECT doc_id, label, sum(w) AS score FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rn, count(*) OVER (PARTITION BY doc_id, score) AS n FROM s)
SELECT d.doc_id, label, score::DOUBLE AS score, CASE WHEN label IS NULL THEN 'abstained' WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS status FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND rn = 1""")
def context_ranking(spark, d):
    return K.rank_context(t(spark, d, "documents"), "doc_id", "text", [("thing", "a", 2.0), ("ation", "b", 1.0), ("euxan", "b", 1.0)])


# ------------------------------------------------------------------ graphs: orders of a customer hang below it

_EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 40 AS dst FROM lineitem WHERE l_orderkey % 50 = 0)"


def _tree(spark, d):
    """Every event hangs below event_id / 3: one deep tree."""
    return t(spark, d, "events").where("event_id > 0").select(F.expr("event_id div 3").alias("src"), F.col("event_id").alias("dst"))


_TREE = "tree AS (SELECT event_id // 3 AS src, event_id AS dst FROM events WHERE event_id > 0)"


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM r JOIN tree ON src = node) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def min_depth(spark, d):
    return G.min_depth(_tree(spark, d), spark.range(1).select(F.col("id").alias("node")))


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT CAST(2 AS BIGINT) AS node UNION SELECT dst FROM r JOIN tree ON src = node) SELECT event_id AS node FROM events WHERE event_id NOT IN (SELECT node FROM r)")
def unreachable(spark, d):
    return G.unreachable(t(spark, d, "events").select(F.col("event_id").alias("node")), _tree(spark, d), spark.range(2, 3).select(F.col("id").alias("node")))


_RING = "ring AS (SELECT o_custkey AS src, o_orderkey % 300 AS dst FROM orders)"


@query(f"WITH RECURSIVE {_RING}, p AS (SELECT DISTINCT src, dst FROM ring UNION SELECT p.src, ring.dst FROM p JOIN ring ON p.dst = ring.src), c AS (SELECT DISTINCT src AS n FROM p WHERE src = dst) SELECT DISTINCT node FROM (SELECT n AS node FROM c UNION SELECT a.dst FROM p a JOIN p b ON a.dst = b.src JOIN c x ON a.src = x.n JOIN c y ON b.dst = y.n)")
def cycle_nodes(spark, d):
    return G.cycle_nodes(t(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 300).alias("dst")))


@query()
def cycle_nodes_whole(spark, d):
    """cycle_nodes over all orders; compared with plain Python in tests."""
    return G.cycle_nodes(t(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 300).alias("dst")))


def _pairs(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % 1000).alias("dst"))


_PAIRS = "e AS (SELECT o_custkey AS src, o_orderkey * 7 % 1000 AS dst FROM orders), s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS low FROM s UNION SELECT s.dst, r.low FROM r JOIN s ON s.src = r.node WHERE r.low < s.dst)"


@query(f"WITH RECURSIVE {_PAIRS} SELECT node, min(low) AS component FROM r GROUP BY 1")
def components(spark, d):
    return G.components(_pairs(spark, d))


@query(f"""WITH RECURSIVE {_PAIRS}, c AS (SELECT node, min(low) AS component FROM r GROUP BY 1), d AS (SELECT n, count(*) AS k FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
p AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS n FROM e GROUP BY 1, 2)
SELECT (SELECT count(*) FROM d) AS nodes, CAST(0 AS BIGINT) AS isolated, (SELECT count(*) FROM d WHERE k = 1) AS dangling, (SELECT count(*) FROM e) AS edges, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM p WHERE u <> v) AS parallel,
 (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM p WHERE u = v) AS self_loops, (SELECT count(DISTINCT component) FROM c) AS components, (SELECT count(*) FROM e) - (SELECT count(*) FROM d) + (SELECT count(DISTINCT component) FROM c) AS cycle_rank""")
def graph_facts(spark, d):
    e = _pairs(spark, d)
    return G.graph_facts(e.select(F.col("src").alias("node")).union(e.select("dst")), e)


@query()
def components_whole(spark, d):
    """components over all orders; compared with plain Python in tests."""
    return G.components(_pairs(spark, d))


@query()
def graph_facts_whole(spark, d):
    """graph_facts over all orders; compared with plain Python in tests."""
    e = _pairs(spark, d)
    return G.graph_facts(e.select(F.col("src").alias("node")).union(e.select("dst")), e)


@query("""WITH a AS (SELECT p_partkey AS k, p_name || '#' || p_partkey AS ck, CASE WHEN p_size % 11 = 0 THEN 'web' ELSE 'cad' END AS surface, p_partkey % 7 AS art, p_size AS s FROM part),
e AS (SELECT k, list_filter([CASE WHEN surface <> 'cad' THEN 'surface_mismatch' END, CASE WHEN s % 13 = 0 THEN 'atom_kind' END, CASE WHEN k % 17 = 0 THEN 'atom_id' END, CASE WHEN k % 19 = 0 AND k % 23 > 0 THEN 'hosts_repeat' END,
 CASE WHEN k % 23 = 0 THEN 'host_not_observed' END, CASE WHEN art = 6 THEN 'artifact_unknown' END, CASE WHEN art = 5 AND k % 3 = 0 THEN 'artifact_differs' END, CASE WHEN k % 29 = 0 THEN 'member_signature_empty' END,
 CASE WHEN k % 5 > 1 AND s % 4 = 0 THEN 'parameter_positions' END, CASE WHEN k % 5 > 0 AND s % 9 = 0 THEN 'parameter_direction' END, CASE WHEN k % 31 = 0 THEN 'is_static_missing' END], lambda x: x IS NOT NULL) AS errors FROM a)
SELECT k, array_to_string(errors, ',') AS errors FROM e WHERE len(errors) > 0""")
def atom_errors(spark, d):
    """Catalog rows made of the parts, with what is wrong with them."""
    p = t(spark, d, "part").selectExpr("p_partkey as k", "concat(p_name, '#', p_partkey) as canonical_key", "if(p_size % 11 = 0, 'web', 'cad') as surface", "p_size as s")
    artifact = "named_struct('artifact_id', concat('x', k % 7), 'kind', 'dll', 'name', if(k % 7 = 5 and k % 3 = 0, 'other', concat('n', k % 7)), 'version', '1', 'sha256', cast(null as string))"
    parameters = "transform(sequence(0, cast(k % 5 as int)), i -> named_struct('position', if(s % 4 = 0 and i = 2, 7, i), 'direction', if(s % 9 = 0 and i = 1, 'inout', 'in')))"
    p = p.withColumn("atom_id", F.when(F.col("k") % 17 == 0, "cap:cad:0").otherwise(V.atom_id(F.col("surface"), F.col("canonical_key"))))
    p = p.selectExpr(
        "*", "'1.0' as schema_version", "'inv' as inventory_id", "if(s % 13 = 0, 'gizmo', 'method') as atom_kind", "if(k % 23 = 0, array('h2'), if(k % 19 = 0, array('h1', 'h1'), array('h1', 'h2'))) as observed_host_ids", f"{artifact} as source_artifact",
        f"named_struct('name', canonical_key, 'signature', if(k % 29 = 0, '', 'f()'), 'parameters', {parameters}, 'is_static', if(k % 31 = 0, null, true)) as member", "map('file', 'f') as source_locator",
    )
    artifacts = t(spark, d, "part").selectExpr("p_partkey % 7 as n").distinct().where("n < 6").selectExpr("concat('x', n) as artifact_id", "'dll' as kind", "concat('n', n) as name", "'1' as version", "cast(null as string) as sha256")
    found = V.validate_atoms(p, artifacts, "inv", "cad", "h1", ["method", "property"])
    return found.where("size(errors) > 0").select("k", F.array_join("errors", ",").alias("errors"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 5 AS v, CASE WHEN o_orderstatus = 'F' THEN 'classified' WHEN o_orderstatus = 'O' THEN 'deferred' ELSE 'lost' END AS status FROM orders),
e AS (SELECT k, list_filter([CASE WHEN k % 41 = 0 THEN 'atom_unknown' END, CASE WHEN status = 'lost' THEN 'status' END, CASE WHEN v = 1 THEN 'operations_repeat' END, CASE WHEN v = 2 THEN 'operation_unknown' END, CASE WHEN k % 7 = 0 THEN 'tag_empty' END,
 CASE WHEN k % 9 = 4 THEN 'confidence' END, CASE WHEN k % 6 = 1 THEN 'evidence_kind' END, CASE WHEN k % 6 = 2 THEN 'evidence_empty_field' END, CASE WHEN k % 8 = 3 AND k % 6 <> 5 THEN 'verified_without_proof' END,
 CASE WHEN status = 'classified' AND v = 0 THEN 'classified_without_operations' END, CASE WHEN status = 'classified' AND k % 10 = 9 THEN 'classified_without_summary' END, CASE WHEN status = 'classified' AND k % 6 = 0 THEN 'classified_without_evidence' END,
 CASE WHEN status <> 'classified' AND k % 4 = 0 THEN 'notes_missing' END], lambda x: x IS NOT NULL) AS errors FROM a) SELECT k, array_to_string(errors, ',') AS errors FROM e WHERE len(errors) > 0""")
def enrichment_errors(spark, d):
    """Enrichment rows made of the orders, with what is wrong with them."""
    o = t(spark, d, "orders").selectExpr("o_orderkey as k", "case o_orderstatus when 'F' then 'classified' when 'O' then 'deferred' else 'lost' end as status")
    evidence = "case k % 6 when 0 then array() when 1 then array(named_struct('kind', 'rumour', 'ref', 'r', 'claim', 'c')) when 2 then array(named_struct('kind', 'signature', 'ref', '', 'claim', 'c')) when 5 then array(named_struct('kind', 'human_review', 'ref', 'r', 'claim', 'c')) else array(named_struct('kind', 'signature', 'ref', 'r', 'claim', 'c')) end"
    o = o.selectExpr(
        "*", "'1.0' as schema_version", "'inv' as inventory_id", "if(k % 41 = 0, 'none', concat('a', k)) as atom_id", "case k % 5 when 0 then array() when 1 then array('read', 'read') when 2 then array('fly') else array('read', 'edit') end as operation_kinds",
        "if(k % 7 = 0, array('t', ''), array('t')) as domain_tags", "if(k % 10 = 9, '  ', 's') as summary", "if(k % 9 = 4, 1.5d, 0.5d) as classification_confidence", f"{evidence} as evidence",
        "array(named_struct('confidence', 0.3d, 'status', if(k % 8 = 3, 'verified', 'proposed'))) as semantic_candidates", "'rule' as processor_kind", "if(k % 4 = 0, null, 'n') as notes",
    )
    atoms = t(spark, d, "orders").selectExpr("concat('a', o_orderkey) as atom_id")
    return V.validate_enrichments(o, atoms, "inv").where("size(errors) > 0").select("k", F.array_join("errors", ",").alias("errors"))


@query()
def cut_facts(spark, d):
    """Bridges and articulation points over all orders; compared with plain Python in tests."""
    return G.cut_facts(_pairs(spark, d))


@query()
def cut_facts_by_joins(spark, d):
    """As cut_facts, the graph's large component by joins; compared with plain Python in tests."""
    return G.cut_facts(_pairs(spark, d), most=1000)


@query()
def shortest_path(spark, d):
    """Ties are broken by rule; compared with plain Python in tests."""
    e = _tree(spark, d).withColumn("id", F.col("dst"))
    return G.shortest_path(e, 500, 700)


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT CAST(1 AS BIGINT) AS node, 2 AS s UNION ALL SELECT CAST(2 AS BIGINT), 1 UNION ALL SELECT dst, s FROM r JOIN tree ON src = node) SELECT node, min(s) AS sector FROM r GROUP BY 1")
def sectors(spark, d):
    roots = spark.range(1, 3).select(F.col("id").alias("node"), (3 - F.col("id")).cast("int").alias("ord"))
    return G.sectors(roots, _tree(spark, d))


_REQUIREMENTS = """e AS (SELECT event_id AS id, event_id // 7 AS src, event_id AS dst, CASE event_id % 5 WHEN 1 THEN 'reuses_requirement' WHEN 2 THEN 'decomposes_to' ELSE 'contains_requirement' END AS kind, event_id * 31 % 10 AS ord FROM events WHERE event_id > 0),
top AS (SELECT dst, row_number() OVER (ORDER BY ord, dst) - 1 AS s FROM e WHERE src = 0 AND kind = 'contains_requirement'),
r AS (SELECT 0::BIGINT AS node, 0 AS depth, NULL::BIGINT AS sector, NULL::BIGINT AS ord UNION ALL SELECT e.dst, depth + 1, CASE WHEN node = 0 THEN s ELSE sector END, e.ord FROM r JOIN e ON src = node LEFT JOIN top ON top.dst = e.dst),
p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sector, depth) AS n, (SELECT count(*) FROM top) AS k, CASE WHEN node = 0 THEN 0 ELSE 180 * (node % 3 + 1) + 55 * greatest(depth - 1, 0) END AS radius,
 CASE WHEN sector IS NULL THEN ('0x' || substr(sha256('initial-semantic-v1:theta:' || node), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0 END AS unit FROM r WINDOW w AS (PARTITION BY sector, depth ORDER BY ord, node)),
a AS (SELECT *, CASE WHEN node = 0 THEN 0 WHEN sector IS NULL THEN 2 * pi() * unit WHEN n = 1 THEN 2 * pi() * sector / k ELSE 2 * pi() * sector / k - 2 * pi() / k * 0.41 + 2 * pi() / k * 0.82 * i / (n - 1) END AS angle FROM p)"""


@query(f"WITH RECURSIVE {_REQUIREMENTS} SELECT node, sector, round(radius * cos(angle), 6) + 0.0 AS x, round(radius * sin(angle), 6) + 0.0 AS y, radius::DOUBLE AS radius FROM a")
def requirement_positions(spark, d):
    """Sectors, angles and radii of a tree of requirements; other relations carry sectors on."""
    e = t(spark, d, "events").where("event_id > 0").selectExpr("event_id as id", "event_id div 7 as src", "event_id as dst", "case event_id % 5 when 1 then 'reuses_requirement' when 2 then 'decomposes_to' else 'contains_requirement' end as kind", "event_id * 31 % 10 as ord")
    nodes = G.min_depth(e, spark.range(1).select(F.col("id").alias("node")))
    nodes = nodes.selectExpr("node", "case node % 3 when 0 then 'customer_stated' when 1 then 'normalized' else 'domain_decomposition' end as origin", "depth", "cast(null as double) as x", "cast(null as double) as y", "cast(null as double) as z", "false as locked")
    at = layout.positions(nodes, e, 0)
    return at.select("node", "sector", "x", "y", "radius")


@query("""WITH n AS (SELECT c_custkey AS node, c_mktsegment || c_nationkey::VARCHAR || (c_custkey % 90)::VARCHAR AS name, c_custkey % 3 = 0 AS atomic FROM customer), e AS (SELECT o_custkey AS src, o_orderkey % 400 AS dst FROM orders)
SELECT 'dangling' AS code, x AS id FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) WHERE x NOT IN (SELECT node FROM n)
UNION ALL SELECT 'atomic_with_children', node FROM n WHERE atomic AND node IN (SELECT src FROM e) UNION ALL SELECT 'composite_without_children', node FROM n WHERE NOT atomic AND node NOT IN (SELECT src FROM e)
UNION ALL SELECT 'duplicate_name', node FROM (SELECT node, count(*) OVER (PARTITION BY lower(name)) AS k FROM n) WHERE k > 1""")
def audit_graph(spark, d):
    return _audit(spark, d)


@query()
def audit_graph_whole(spark, d):
    """audit_graph over all orders; compared with plain Python in tests."""
    return _audit(spark, d)


def _audit(spark, d):
    n = t(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 90).cast("string")).alias("name"), (F.col("c_custkey") % 3 == 0).alias("atomic"))
    return G.audit_graph(n, t(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 400).alias("dst")))


@query("""WITH r AS (SELECT c_custkey, c_custkey % 4 AS depth, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_nationkey, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_custkey % 4) AS n FROM customer)
SELECT c_custkey, round(CASE WHEN depth = 0 THEN 0 ELSE 180 + 55 * depth END * cos(2 * pi() * i / n), 6) + 0.0 AS x FROM r""")
def radial_layout(spark, d):
    c = t(spark, d, "customer").withColumn("depth", F.col("c_custkey") % 4)
    return G.radial_layout(c, "depth", "c_nationkey", "c_custkey").select("c_custkey", (F.col("x") + 0.0).alias("x"))
