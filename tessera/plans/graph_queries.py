"""Queries over the property graph of customers, orders, parts, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dsl, graph, paths, rules, small_graphs
from tessera.operators.predicates import compile_predicate
from tessera.plans.base import query
from tessera.tables import table


def _nid(kind: str, key: str | int) -> str:
    return f"sha256('{kind}:' || {key})[1:16]"


def _edges_sql(types: tuple[str, ...]) -> str:
    parts = [f"SELECT {_nid(a, x)} AS src, {_nid(b, y)} AS dst, '{e}' AS edge_type FROM {t}" for e, t, a, x, b, y in graph.LINKS if e in types]
    return " UNION ".join(parts)


def _nodes_sql(kinds: tuple[str, ...]) -> str:
    parts = []
    for k in kinds:
        t, key, label, file, line, labels, _ = graph.KINDS[k]
        listed = ", ".join(labels) if labels else ""
        parts.append(f"SELECT {_nid(k, key)} AS id, '{k}' AS node_type, {label} AS label, {file or chr(39) * 2} AS file_path, CAST({line or 0} AS BIGINT) AS line_number, CAST([{listed}] AS VARCHAR[]) AS labels FROM {t}")
    return " UNION ALL ".join(parts)


ALL, ALL_TYPES = tuple(graph.KINDS), ("PLACES", "CONTAINS", "SUPPLIED_BY", "IN_NATION", "IN_REGION")


@query("""
SELECT count(DISTINCT o_custkey) AS n_customers, CAST(sum(n) AS BIGINT) AS n_suppliers, max(n) AS most FROM (
SELECT o_custkey, count(DISTINCT s.l_suppkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) c ON l_orderkey = o_orderkey
JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) s ON s.l_partkey = c.l_partkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_custkey)
""")
def q_flagship_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_flagship_suppliers(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_customers"), F.sum("n_suppliers").alias("n_suppliers"), F.max("n_suppliers").alias("most"))


@query(f"""
SELECT {_nid('CUSTOMER', 'c_custkey')} AS id, count(DISTINCT s.l_suppkey) AS n_suppliers FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) c ON l_orderkey = o_orderkey
JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) s ON s.l_partkey = c.l_partkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey
""")
def q_flagship_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each BUILDING customer over PLACES, CONTAINS and SUPPLIED_BY: how many suppliers it reaches. Each hop keeps distinct pairs only."""
    at = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("start"), F.col("c_custkey").alias("at"))
    for kind in ("PLACES", "CONTAINS", "SUPPLIED_BY"):
        hop = graph.key_edges(spark, sf_dir, kind).select(F.col("src").alias("at"), "dst")
        at = at.join(hop, "at").select("start", F.col("dst").alias("at")).distinct()
    counts = at.groupBy("start").agg(F.count(F.lit(1)).alias("n_suppliers"))
    return counts.select(graph.keyed("CUSTOMER", "start").alias("id"), "n_suppliers")


@query(f"SELECT id, node_type, label, file_path, line_number, array_to_string(labels, ',') AS labels FROM ({_nodes_sql(ALL)})")
def g_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_nodes(spark, sf_dir).select("id", "node_type", "label", "file_path", "line_number", F.array_join("labels", ",").alias("labels"))


@query(_edges_sql(ALL_TYPES))
def g_build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(spark, sf_dir)


@query(f"SELECT id, label FROM ({_nodes_sql(('SUPPLIER', 'NATION'))}) WHERE node_type = 'NATION'")
def g_scan_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.scan(graph.build_nodes(spark, sf_dir, ("SUPPLIER", "NATION")), "NATION").select("id", "label")


@query(f"SELECT id, label FROM ({_nodes_sql(('CUSTOMER',))}) WHERE id = {_nid('CUSTOMER', 7)}")
def g_lookup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.build_nodes(spark, sf_dir, ("CUSTOMER",))
    return nodes.filter(F.col("id") == graph.node_id(F.lit("CUSTOMER"), F.lit("7"))).select("id", "label")


def _predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_nodes(spark, sf_dir, ("PART", "CUSTOMER", "SUPPLIER"))


#: Name, predicate, and the condition of the oracle; brand is an attribute that only parts have.
PREDICATES = (
    ("equals", ("EQUALS", "p_brand", "Brand#1"), "brand IS NOT DISTINCT FROM 'Brand#1'"),
    ("equals_missing", ("EQUALS", "p_brand", None), "brand IS NULL"),
    ("not_equals_missing", ("NOT_EQUALS", "p_brand", "Brand#1"), "brand IS DISTINCT FROM 'Brand#1'"),
    ("contains", ("CONTAINS", "p_type", "AN"), "coalesce(contains(ptype, 'AN'), false)"),
    ("startswith", ("STARTSWITH", "label", "Supplier"), "starts_with(label, 'Supplier')"),
    ("endswith", ("ENDSWITH", "label", "1"), "ends_with(label, '1')"),
    ("regex", ("REGEX", "p_brand", "#[1-3]"), "coalesce(regexp_matches(brand, '#[1-3]'), false)"),
    ("in", ("IN", "p_brand", ["Brand#1", "Brand#2"]), "coalesce(brand IN ('Brand#1', 'Brand#2'), false)"),
    ("not_in_missing", ("NOT_IN", "p_brand", ["Brand#1", "Brand#2"]), "NOT coalesce(brand IN ('Brand#1', 'Brand#2'), false)"),
    ("exists", ("EXISTS", "p_brand"), "brand IS NOT NULL"),
    ("count", ("COUNT", "labels", 2), "kind = 'PART'"),
    ("and_or_not", ("AND", [("OR", [("EQUALS", "node_type", "PART"), ("EQUALS", "node_type", "SUPPLIER")]), ("NOT", [("EQUALS", "p_brand", "Brand#1")])]), "kind IN ('PART', 'SUPPLIER') AND brand IS DISTINCT FROM 'Brand#1'"),
)
_FLAT = f"""SELECT {_nid('PART', 'p_partkey')} AS id, 'PART' AS kind, p_name AS label, p_brand AS brand, p_type AS ptype FROM part
UNION ALL SELECT {_nid('CUSTOMER', 'c_custkey')}, 'CUSTOMER', c_name, NULL, NULL FROM customer UNION ALL SELECT {_nid('SUPPLIER', 's_suppkey')}, 'SUPPLIER', s_name, NULL, NULL FROM supplier"""


def _register_predicate(name: str, predicate: tuple, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _predicates(spark, sf_dir).filter(compile_predicate(predicate)).select("id", "node_type")

    run.__name__ = f"p_{name}"
    query(f"SELECT id, kind AS node_type FROM ({_FLAT}) WHERE {condition}")(run)


for _p in PREDICATES:
    _register_predicate(*_p)


def _traversal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kinds = ("CUSTOMER", "SUPPLIER", "NATION", "REGION")
    return graph.build_nodes(spark, sf_dir, kinds), graph.build_edges(spark, sf_dir, ("IN_NATION", "IN_REGION"))


@query(f"SELECT {_nid('NATION', 'c_nationkey')} AS id, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY c_nationkey")
def q_traverse_out_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = dsl.node("CUSTOMER").where(c_mktsegment="MACHINERY").outgoing("IN_NATION", "NATION")
    return q.run(*_traversal(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_nid('CUSTOMER', 'c_custkey')} AS id, c_name AS label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def q_traverse_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = dsl.node("REGION").where(label="ASIA").incoming("IN_REGION").incoming("IN_NATION", "CUSTOMER").select("id", "label")
    return q.run(*_traversal(spark, sf_dir))


@query(f"SELECT {_nid('SUPPLIER', 's_suppkey')} AS id FROM supplier ORDER BY id LIMIT 5")
def q_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.node("SUPPLIER").limit(5).select("id").run(*_traversal(spark, sf_dir))


@query(f"SELECT DISTINCT id FROM (SELECT {_nid('REGION', 'n_regionkey')} AS id FROM nation UNION ALL SELECT {_nid('CUSTOMER', 'c_custkey')} FROM customer UNION ALL SELECT {_nid('SUPPLIER', 's_suppkey')} FROM supplier)")
def q_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _traversal(spark, sf_dir)
    starts = table(spark, sf_dir, "nation").select(graph.keyed("NATION", "n_nationkey").alias("id")).join(nodes, "id")
    return graph.neighbours(starts, nodes, edges).select("id")


@query(f"SELECT min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM ({_nodes_sql(('SUPPLIER',))})")
def q_explain_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.evidence(dsl.node("SUPPLIER").run(*_traversal(spark, sf_dir)))


@query(f"SELECT DISTINCT {_nid('PART', 'a.p_partkey')} AS src, {_nid('PART', 'b.p_partkey')} AS dst, 'SAME_PLACE' AS edge_type FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey")
def g_link_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("PART", "PART", "SAME_PLACE")], "from_type string, to_type string, edge_type string")
    return graph.link_colocated(graph.build_nodes(spark, sf_dir, ("PART",)), F.broadcast(pairs))  # one row


@query(f"WITH n AS ({_nodes_sql(ALL)}), e AS ({_edges_sql(ALL_TYPES)}), o AS (SELECT src AS id, count(*) AS c FROM e GROUP BY src), i AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY dst) SELECT n.id, node_type, coalesce(o.c, 0) AS n_out, coalesce(i.c, 0) AS n_in FROM n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id")
def g_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.build_nodes(spark, sf_dir), graph.build_edges(spark, sf_dir))


@query(f"WITH n AS ({_nodes_sql(('CUSTOMER', 'ORDER', 'NATION'))}), e AS ({_edges_sql(('PLACES',))}) SELECT id, node_type FROM n WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")
def g_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(graph.build_nodes(spark, sf_dir, ("CUSTOMER", "ORDER", "NATION")), graph.build_edges(spark, sf_dir, ("PLACES",)))


@query(f"SELECT src, dst, edge_type, 'dst' AS missing FROM ({_edges_sql(('PLACES',))}) e WHERE dst NOT IN (SELECT {_nid('ORDER', 'o_orderkey')} FROM orders WHERE o_orderstatus <> 'F')")
def g_broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.build_nodes(spark, sf_dir, ("CUSTOMER", "ORDER")).filter("NOT (node_type = 'ORDER' AND label = 'F')")
    return graph.broken_edges(nodes, graph.build_edges(spark, sf_dir, ("PLACES",)))


@query(f"SELECT n_nodes, n_edges, round(n_edges / CAST(n_nodes * (n_nodes - 1) AS DOUBLE), 6) AS density FROM (SELECT count(*) AS n_nodes FROM ({_nodes_sql(ALL)})), (SELECT count(*) AS n_edges FROM ({_edges_sql(ALL_TYPES)}))")
def g_stats_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statistics(graph.build_nodes(spark, sf_dir), graph.build_edges(spark, sf_dir))


@query(f"""WITH a AS (SELECT {_nid('ORDER', 'o_orderkey')} AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT {_nid('ORDER', 'o_orderkey')} AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 0)
SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' WHEN a.s <> b.s THEN 'MODIFIED' END AS change FROM a FULL JOIN b ON a.id = b.id) WHERE change IS NOT NULL""")
def g_diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("id", graph.keyed("ORDER", "o_orderkey"))
    old = orders.filter("o_orderkey % 5 <> 0").select("id", F.col("o_orderstatus").alias("s"))
    new = orders.filter("o_orderkey % 3 <> 0").select("id", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END").alias("s"))
    return graph.compare_nodes(old, new, ["s"])


@query(f"""WITH e AS (SELECT DISTINCT {_nid('CUSTOMER', 'o_custkey')} AS src, {_nid('ORDER', 'o_orderkey')} AS dst, 'PLACES' AS edge_type, o_orderkey AS k FROM orders)
SELECT src, dst, edge_type, 'ADDED' AS change FROM e WHERE k % 3 <> 0 AND k % 5 = 0 UNION ALL SELECT src, dst, edge_type, 'REMOVED' FROM e WHERE k % 5 <> 0 AND k % 3 = 0""")
def g_diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(graph.keyed("CUSTOMER", "o_custkey").alias("src"), graph.keyed("ORDER", "o_orderkey").alias("dst"), F.lit("PLACES").alias("edge_type"), "o_orderkey")
    return graph.compare_edges(e.filter("o_orderkey % 5 <> 0").drop("o_orderkey"), e.filter("o_orderkey % 3 <> 0").drop("o_orderkey"))


#: A graph of the types of events: which follows which for some user.
_STEPS = """t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
c AS (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY src, dst), e AS (SELECT src, dst FROM c)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    steps = events.selectExpr("event_type AS src", "lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst").filter("dst IS NOT NULL")
    return steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).select("src", "dst")


def _types(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


@query(f"WITH RECURSIVE {_STEPS}, r(start, id, hops) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT r.start, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.id WHERE r.hops < 4) SELECT start, id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY start, id")
def g_reach_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    return paths.distances(edges.select(F.col("src").alias("id")).distinct(), edges, 4)


@query(f"WITH RECURSIVE {_STEPS}, r(path) AS (SELECT DISTINCT [src] FROM e UNION ALL SELECT list_append(path, e.dst) FROM r JOIN e ON e.src = path[-1] WHERE NOT list_contains(path, e.dst) AND len(path) < 4), s AS (SELECT path[1] AS start, path[-1] AS id, path, row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path), path) AS k FROM r) SELECT start, id, array_to_string(path, '>') AS path FROM s WHERE k = 1")
def g_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    return paths.shortest_paths(edges.select(F.col("src").alias("id")).distinct(), edges, 3).select("start", "id", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {_STEPS}, r(path) AS (SELECT DISTINCT [src] FROM e UNION ALL SELECT list_append(path, e.dst) FROM r JOIN e ON e.src = path[-1] WHERE NOT list_contains(path, e.dst) AND len(path) < 4) SELECT array_to_string(path, '>') AS path FROM r WHERE len(path) > 1")
def g_all_paths_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    return paths.simple_paths(edges.select(F.col("src").alias("id")).distinct(), edges, 3).select(F.array_join("path", ">").alias("path"))


_CLOSURE = f"WITH RECURSIVE {_STEPS}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)"


@query(f"{_CLOSURE} SELECT src AS id FROM r WHERE src = dst")
def g_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.on_cycles(transitions(spark, sf_dir))


@query(f"{_CLOSURE}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT n.id, least(n.id, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src = n.id), n.id)) AS comp FROM n")
def g_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    return paths.strong_components(_types(edges), edges)


@query(f"WITH RECURSIVE {_STEPS}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r(dom, id) AS (SELECT n.id, 'click' FROM n WHERE n.id <> 'click' UNION SELECT r.dom, e.dst FROM r JOIN e ON e.src = r.id WHERE e.dst <> r.dom), k(id) AS (SELECT 'click' UNION SELECT e.dst FROM k JOIN e ON e.src = k.id) SELECT a.id, d.id AS dom FROM k a, k d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.dom = d.id AND r.id = a.id)")
def g_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = small_graphs.as_one(transitions(spark, sf_dir))
    return small_graphs.dominators(edges, spark.createDataFrame([(0, "click")], "graph int, id string")).select("id", "dom")


@query(f"WITH RECURSIVE {_STEPS}, r(id, hops) AS (SELECT 'click', 0 UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.id WHERE r.hops < 6) SELECT id, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY id")
def g_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first visits; the order of visits is tested on small graphs."""
    edges = small_graphs.as_one(transitions(spark, sf_dir))
    return small_graphs.visits(edges, spark.createDataFrame([(0, "click")], "graph int, id string")).select("id", "hops")


@query(f"SELECT {_nid('SUPPLIER', 's_suppkey')} AS id, 0 AS level FROM supplier UNION ALL SELECT {_nid('CUSTOMER', 'c_custkey')}, 0 FROM customer UNION ALL SELECT {_nid('NATION', 'n_nationkey')}, 1 FROM nation UNION ALL SELECT {_nid('REGION', 'r_regionkey')}, 2 FROM region")
def g_dag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _traversal(spark, sf_dir)
    return paths.levels(nodes, edges)


@query("SELECT label, row_number() OVER (ORDER BY l, label) AS place FROM (SELECT n_name AS label, 0 AS l FROM nation UNION ALL SELECT r_name, 1 FROM region)")
def g_toposort(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.build_nodes(spark, sf_dir, ("NATION", "REGION"))
    ranked = paths.levels(nodes, graph.build_edges(spark, sf_dir, ("IN_REGION",))).join(nodes.select("id", "label"), "id")
    return ranked.selectExpr("label", "CAST(row_number() OVER (ORDER BY level, label) AS BIGINT) AS place")


@query("WITH RECURSIVE p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text), r AS (SELECT a AS v, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v) SELECT v AS id, min(c) AS comp FROM r GROUP BY v")
def g_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal texts, each linked with the first of its text."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("src"))
    edges = docs.join(first, "h").filter("doc_id <> src").select("src", F.col("doc_id").alias("dst"))
    return paths.components(docs.select(F.col("doc_id").alias("id")), edges)


@query(f"SELECT {_nid('REGION', 'r_regionkey')} AS id FROM region UNION ALL SELECT {_nid('NATION', 'n_nationkey')} FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def r_graph_rule_missing_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions without a supplier in them: a graph rule with a negated edge predicate."""
    edges = graph.build_edges(spark, sf_dir, ("IN_NATION", "IN_REGION"))
    nodes = graph.build_nodes(spark, sf_dir, ("NATION", "REGION", "SUPPLIER"))
    rule = {"any": [{"node_type_equals": "NATION"}, {"node_type_equals": "REGION"}], "not": {"incoming_edge": {"type": "IN_NATION", "source_type": "SUPPLIER"}}}
    return rules.matching(nodes, edges, rule).select("id")


@query(f"SELECT {_nid('NATION', 'n_nationkey')} AS id FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(*) BETWEEN 3 AND 5")
def r_graph_rule_edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with three to five suppliers: an edge count with bounds."""
    nodes, edges = graph.build_nodes(spark, sf_dir, ("NATION", "SUPPLIER")), graph.build_edges(spark, sf_dir, ("IN_NATION",))
    suppliers = edges.join(nodes.filter("node_type = 'SUPPLIER'").select(F.col("id").alias("src")), "src", "left_semi")
    return rules.matching(nodes, suppliers, {"node_type_equals": "NATION", "edge_count": {"direction": "incoming", "type": "IN_NATION", "min": 3, "max": 5}}).select("id")


@query(f"""WITH r AS (SELECT {_nid('NATION', 'n_nationkey')} AS id, n_nationkey AS k, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey),
f AS (SELECT 'busy' AS rule_id, 'HIGH' AS severity, id FROM r WHERE n >= 3 UNION ALL SELECT 'empty', 'MEDIUM', id FROM r WHERE n = 0 UNION ALL SELECT 'tainted', 'LOW', {_nid('REGION', 'r_regionkey')} FROM region WHERE r_regionkey % 2 = 0)
SELECT rule_id, severity, id, sha256(rule_id || '|' || id) AS fingerprint FROM f""")
def r_graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several graph rules in one pass, one of them over the taint state of flows."""
    edges = graph.build_edges(spark, sf_dir, ("IN_NATION",))
    nodes = graph.build_nodes(spark, sf_dir, ("NATION", "REGION", "SUPPLIER"))
    even = table(spark, sf_dir, "region").filter("r_regionkey % 2 = 0").select(graph.keyed("REGION", "r_regionkey").alias("id"), F.lit(True).alias("even"))
    state = F.when(F.col("even"), F.map_concat("attributes", F.create_map(F.lit("flow_taint_state"), F.lit("TAINTED")))).otherwise(F.col("attributes"))
    nodes = nodes.join(even, "id", "left").withColumn("attributes", state).drop("even")
    from_supplier = {"type": "IN_NATION", "source_type": "SUPPLIER"}
    found = [
        {"id": "busy", "severity": "HIGH", "condition": {"node_type_equals": "NATION", "edge_count": {"direction": "incoming", "type": "IN_NATION", "min": 3}}},
        {"id": "empty", "condition": {"node_type_equals": "NATION", "not": {"incoming_edge": from_supplier}}},
        {"id": "tainted", "severity": "LOW", "condition": {"flow_taint_state_equals": "TAINTED"}},
    ]
    suppliers = edges.join(nodes.filter("node_type = 'SUPPLIER'").select(F.col("id").alias("src")), "src", "left_semi")
    return rules.findings(nodes, suppliers, found)
