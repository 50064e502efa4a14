"""Reports of findings and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.base import query
from tessera.plans.graph_queries import _edges_sql
from tessera.sinks import reports
from tessera.tables import table


@query("""WITH r AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS i FROM events GROUP BY event_type)
SELECT event_id AS id, '{"ruleId":"' || e.event_type || '","ruleIndex":' || i || ',"level":"' || CASE e.event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'note' END || '","message":{"text":"user ' || user_id || '"}}' AS result
FROM events e JOIN r ON r.event_type = e.event_type""")
def k_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.expr("CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END")
    findings = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("rule_id"), severity.alias("severity"), F.concat(F.lit("user "), "user_id").alias("message"))
    return reports.sarif_results(findings)


@query("""SELECT 'orders_count{label="' || o_orderpriority || '"} ' || count(*) AS line FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'orders_sum{label="' || o_orderpriority || '"} ' || printf('%.2f', round(sum(o_totalprice), 2)) FROM orders GROUP BY o_orderpriority""")
def k_prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.prometheus(table(spark, sf_dir, "orders").select(F.lit("orders").alias("metric"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("value")))


@query(f"""SELECT '  "' || src || '" -> "' || dst || '" [label="' || edge_type || '"];' AS line FROM ({_edges_sql(('IN_NATION', 'IN_REGION'))})""")
def k_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dot_lines(graph.build_edges(spark, sf_dir, ("IN_NATION", "IN_REGION")))


@query("SELECT '  ' || n_name || '[\"' || n_name || '\"] -->|IN_REGION| ' || r_name || '[\"' || r_name || '\"]' AS line FROM (SELECT regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') AS n_name, regexp_replace(r_name, '[^A-Za-z0-9_]', '_', 'g') AS r_name FROM nation JOIN region ON r_regionkey = n_regionkey)")
def k_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.mermaid_lines(both.select(plain("n_name").alias("src"), plain("r_name").alias("dst"), F.lit("IN_REGION").alias("edge_type")))


@query("SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def k_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_lines(table(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey"))
