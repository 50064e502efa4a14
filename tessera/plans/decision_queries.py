"""Findings, decisions and measures over the driver's tables; the oracles are written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import decisions, evaluation
from tessera.operators import findings as fd
from tessera.plans.base import query
from tessera.tables import table

#: Lines of orders stand for findings, an order for a file.
CLASSES, STATUSES, LEVELS = ("SQL_INJECTION", "XSS", "CODE_INJECTION", "PATH_TRAVERSAL", "OTHER"), ("CONFIRMED", "CANDIDATE", "BLOCKED", "UNKNOWN"), ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    part, supp, order, line = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
    own = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", order.cast("string"), line.cast("string"), part.cast("string"), supp.cast("string")).alias("finding_id"), order.alias("order_id"),
        pick(CLASSES, part).alias("vulnerability_class"), own("R", line).alias("rule_key"), pick(LEVELS, supp).alias("severity"), pick(STATUSES, part + line).alias("status"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"), own("F", order * 7 + line % 2).alias("flow_id"), own("S", part).alias("source_fact_id"), own("K", supp).alias("sink_fact_id"),
        own("N", part).alias("source_node_id"), own("M", order).alias("sink_node_id"), F.when(line > 5, own("C", order)).alias("call_context"),
        F.when(supp % 3 == 0, "user_input").alias("source_role"), F.lit(None).cast("string").alias("sink_role"), (line % 3).alias("path_nodes"), F.when(part % 11 == 0, "escape").alias("barrier"),
    )


def _pick(names: tuple[str, ...], n: str) -> str:
    return f"(['{"', '".join(names)}'])[({n}) % {len(names)} + 1]"


LINES = f"""f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS finding_id, l_orderkey AS order_id, {_pick(CLASSES, 'l_partkey')} AS vulnerability_class, 'R' || l_linenumber AS rule_key,
{_pick(LEVELS, 'l_suppkey')} AS severity, {_pick(STATUSES, 'l_partkey + l_linenumber')} AS status, round(l_discount * 10, 2) AS confidence, 'F' || (l_orderkey * 7 + l_linenumber % 2) AS flow_id, 'S' || l_partkey AS source_fact_id,
'K' || l_suppkey AS sink_fact_id, 'N' || l_partkey AS source_node_id, 'M' || l_orderkey AS sink_node_id, CASE WHEN l_linenumber > 5 THEN 'C' || l_orderkey END AS call_context, CASE WHEN l_suppkey % 3 = 0 THEN 'user_input' END AS source_role, l_linenumber % 3 AS path_nodes, CASE WHEN l_partkey % 11 = 0 THEN 'escape' END AS barrier,
5 - l_suppkey % 5 AS w FROM lineitem)"""
_CALIBRATED = """c AS (SELECT order_id, max(confidence) AS base, len(list_distinct(list(source_fact_id) || list(source_role))) AS n_src, len(list_distinct(list(sink_fact_id))) AS n_snk, len(list_distinct(list(call_context))) AS n_ctx,
len(list_distinct(list(flow_id) || list('count:' || path_nodes))) AS n_flow, len(list_distinct(list(rule_key))) AS n_rule, list_distinct(list(status)) AS st, max(w) FILTER (status <> 'BLOCKED') AS w1, max(w) AS w0,
4 + CASE WHEN count(barrier) > 0 THEN 1 ELSE 0 END + CASE WHEN count(call_context) > 0 THEN 1 ELSE 0 END AS kinds, count(*) AS n, min(vulnerability_class) AS vulnerability_class FROM f GROUP BY order_id),
k AS (SELECT *, least(1.0, round(base + CASE WHEN n_src > 1 THEN 0.1 ELSE 0 END + CASE WHEN n_snk > 1 THEN 0.1 ELSE 0 END + CASE WHEN n_ctx > 1 THEN 0.05 ELSE 0 END + CASE WHEN n_flow > 1 OR n_rule > 1 THEN 0.05 ELSE 0 END, 4)) AS confidence FROM c),
v AS (SELECT *, CASE WHEN list_contains(st, 'UNKNOWN') AND NOT list_contains(st, 'CONFIRMED') AND NOT list_contains(st, 'BLOCKED') THEN 'UNKNOWN' WHEN st = ['BLOCKED'] THEN 'BLOCKED' WHEN list_contains(st, 'CONFIRMED') AND confidence >= 0.85 THEN 'CONFIRMED' WHEN confidence >= 0.6 THEN 'CANDIDATE' ELSE 'UNKNOWN' END AS status,
(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[coalesce(w1, w0)] AS severity FROM k)"""


@query(f"WITH {LINES}, {_CALIBRATED} SELECT order_id, confidence, status, severity, round(kinds / 8.0, 4) AS diversity, n FROM v")
def f_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.calibrated(lines(spark, sf_dir), "order_id")


@query(f"WITH {LINES} SELECT finding_id, severity, rule_key FROM f WHERE w >= 4")
def f_min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.at_least(lines(spark, sf_dir), "HIGH").select("finding_id", "severity", "rule_key")


@query(f"WITH {LINES} SELECT finding_id, severity, rule_key FROM f ORDER BY w DESC, finding_id")
def f_sort_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in order; the order itself is tested on a small fixture."""
    return fd.by_severity(lines(spark, sf_dir), "finding_id").select("finding_id", "severity", "rule_key")


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY sink_fact_id, vulnerability_class ORDER BY w DESC, confidence DESC, rule_key DESC, finding_id DESC) AS k, count(*) OVER (PARTITION BY sink_fact_id, vulnerability_class) AS n FROM f) SELECT sink_fact_id, vulnerability_class, finding_id, severity, confidence, n FROM r WHERE k = 1")
def f_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.strongest(lines(spark, sf_dir), ["sink_fact_id", "vulnerability_class"]).select("sink_fact_id", "vulnerability_class", "finding_id", "severity", "confidence", "n")


@query(f"""WITH {LINES}, now AS (SELECT sink_fact_id || rule_key AS fp, max(w) AS w FROM f WHERE order_id % 3 <> 0 GROUP BY 1), was AS (SELECT sink_fact_id || rule_key AS fp, max(CASE WHEN order_id % 2 = 0 THEN 1 ELSE w END) AS w FROM f WHERE order_id % 5 <> 0 GROUP BY 1)
SELECT fp AS fingerprint, CASE WHEN was.w IS NULL THEN 'NEW' WHEN now.w IS NULL THEN 'FIXED' WHEN now.w > was.w THEN 'REGRESSED' ELSE 'EXISTING' END AS status FROM now FULL JOIN was USING (fp)""")
def f_baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).withColumn("fingerprint", F.concat("sink_fact_id", "rule_key"))
    was = own.filter("order_id % 5 <> 0").withColumn("severity", F.when(F.col("order_id") % 2 == 0, "INFO").otherwise(F.col("severity")))
    return fd.compared(own.filter("order_id % 3 <> 0"), was)


@query()
def f_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings joined by shared evidence; tested against brute force on a small table, as SQL would need every pair."""
    return fd.clusters(lines(spark, sf_dir)).select("finding_id", "cluster_id").distinct()


@query(f"""WITH {LINES}, {_CALIBRATED}, p AS (SELECT *, 0.25 * CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.5 WHEN 'LOW' THEN 0.2 ELSE 0.0 END + 0.25 * confidence + 0.2 * CASE vulnerability_class WHEN 'CODE_INJECTION' THEN 1.0 WHEN 'SQL_INJECTION' THEN 0.9 WHEN 'XSS' THEN 0.85 WHEN 'PATH_TRAVERSAL' THEN 0.8 ELSE 0.5 END + 0.15 * 0.8 + 0.15 * 0.8 AS s FROM v)
SELECT order_id, round(s, 6) AS score, CASE WHEN status = 'UNKNOWN' THEN 'UNKNOWN' WHEN status = 'BLOCKED' THEN 'LOW' WHEN severity = 'CRITICAL' AND s >= 0.85 THEN 'CRITICAL' WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.5 THEN 'MEDIUM' WHEN s >= 0.25 THEN 'LOW' ELSE 'UNKNOWN' END AS priority FROM p""")
def s_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    kind = own.groupBy("order_id").agg(F.min("vulnerability_class").alias("vulnerability_class"))
    return decisions.prioritised(fd.calibrated(own, "order_id").join(kind, "order_id")).select("order_id", F.round("priority_score", 6).alias("score"), "priority")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 50 <= 1 AND l_tax * 10 <= 1 THEN round(0.3 * l_discount * 10 + 0.25 * l_quantity / 50 + 0.2 * l_tax * 10 + 0.15 * CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.5 END + 0.1 * (1 - CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END), 4) ELSE 0.0 END AS score, l_quantity / 50 <= 1 AND l_tax * 10 <= 1 AS assessed FROM lineitem""")
def s_exploitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 10).alias("controllability"), (F.col("l_quantity") / 50).alias("reachability"), (F.col("l_tax") * 10).alias("attack_surface"), (F.col("l_returnflag") == "R").alias("chain_complete"), (F.col("l_linestatus") == "F").cast("double").alias("privilege"))
    return decisions.exploitability(rows).select("l_orderkey", "l_linenumber", "l_partkey", "score", "assessed")


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#5' THEN 0.85 ELSE least(1.0, round(0.4 * least(p_retailprice / 2000, 1) + 0.3 * p_size / 50 + 0.2 * CASE p_brand WHEN 'Brand#1' THEN 0.9 WHEN 'Brand#2' THEN 0.5 ELSE 0.2 END + CASE WHEN p_brand = 'Brand#1' THEN 0.1 ELSE 0 END, 4)) END AS risk FROM part""")
def s_threat_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = spark.createDataFrame([("brand#1", 0.9, True), ("Brand#2", 0.5, False)], "vulnerability_class string, epss double, in_the_wild boolean")
    own = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_brand") != "Brand#5", F.col("p_brand")).alias("vulnerability_class"), F.least(F.col("p_retailprice") / 2000, F.lit(1.0)).alias("confidence"), (F.col("p_size") / 50).alias("criticality"))
    return decisions.threat_risk(own, F.broadcast(feed)).select("p_partkey", "risk")  # a feed of two rows


@query("""WITH x AS (SELECT c_custkey, 0.2 * CASE WHEN c_nationkey % 7 IN (0, 3) THEN 0.9 ELSE 0.7 END + 0.2 * CASE WHEN c_nationkey % 5 = 1 THEN 0.95 ELSE 0.75 END + 0.2 * CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 WHEN c_mktsegment = 'MACHINERY' THEN 0.8 ELSE 0.4 END + 0.2 * (c_nationkey % 10) / 10.0 + 0.1 * CASE WHEN c_nationkey % 5 = 2 THEN 0.9 ELSE 0.5 END + 0.1 AS s FROM customer)
SELECT c_custkey, round(s * 100, 2) AS risk, CASE WHEN round(s * 100, 2) >= 80 THEN 'CRITICAL' WHEN round(s * 100, 2) >= 60 THEN 'HIGH' WHEN round(s * 100, 2) >= 40 THEN 'MEDIUM' WHEN round(s * 100, 2) >= 20 THEN 'LOW' ELSE 'INFO' END AS level FROM x""")
def s_breach_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    own = table(spark, sf_dir, "customer").select(
        "c_custkey", F.array(F.when(n % 7 == 0, "SSRF").when(n % 7 == 3, "XXE").otherwise("XSS")).alias("roots"), F.array(F.when(n % 5 == 1, "ROOT_ACCESS").when(n % 5 == 2, "TENANT_BOUNDARY_ESCAPE").otherwise("READ")).alias("capabilities"),
        F.when(F.col("c_mktsegment") == "BUILDING", "ROOT").when(F.col("c_mktsegment") == "MACHINERY", "ORG_ADMIN").alias("privilege"), (n % 10 / 10.0).alias("business"),
    )
    return decisions.breach_risk(own).select("c_custkey", "risk", "level")


@query("""WITH x AS (SELECT o_orderkey, (['VULNERABLE', 'SAFE', 'CONFLICT', 'UNKNOWN'])[o_orderkey % 4 + 1] AS v, (['TENANT_ESCAPE', 'CLOUD_ADMIN', 'CODE_EXECUTION', 'PAYMENT_MODIFICATION', 'OTHER', 'ROOT_ACCESS'])[o_custkey % 6 + 1] AS p FROM orders)
SELECT o_orderkey, CASE v WHEN 'VULNERABLE' THEN CASE WHEN p IN ('ROOT_ACCESS', 'CLOUD_ADMIN') THEN 'CRITICAL' ELSE 'HIGH' END WHEN 'SAFE' THEN 'LOW' WHEN 'CONFLICT' THEN 'MEDIUM' ELSE 'UNKNOWN' END AS severity,
CASE v WHEN 'VULNERABLE' THEN CASE WHEN p IN ('ROOT_ACCESS', 'CLOUD_ADMIN') THEN 'P0' ELSE 'P1' END WHEN 'SAFE' THEN 'P4' WHEN 'CONFLICT' THEN 'P2' ELSE 'P3' END AS remediation,
CASE p WHEN 'TENANT_ESCAPE' THEN 'MULTI_TENANT' WHEN 'CLOUD_ADMIN' THEN 'GLOBAL' ELSE 'SERVICE' END AS blast_radius,
CASE v WHEN 'VULNERABLE' THEN CASE p WHEN 'TENANT_ESCAPE' THEN 'CRITICAL' WHEN 'PAYMENT_MODIFICATION' THEN 'HIGH' WHEN 'CLOUD_ADMIN' THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'SAFE' THEN 'LOW' ELSE 'UNKNOWN' END AS business_risk FROM x""")
def s_business_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(n) % len(names) + 1).cast("int"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", pick("o_orderkey", "VULNERABLE", "SAFE", "CONFLICT", "UNKNOWN").alias("verdict"), F.array(pick("o_custkey", "TENANT_ESCAPE", "CLOUD_ADMIN", "CODE_EXECUTION", "PAYMENT_MODIFICATION", "OTHER", "ROOT_ACCESS")).alias("properties"))
    return decisions.business_risk(own).select("o_orderkey", "severity", "remediation", "blast_radius", "business_risk")


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, (['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'BLOCKED', 'UNKNOWN', 'odd'])[o_orderkey % 7 + 1] AS p, (['REQUIRED', 'RECOMMENDED', 'OPTIONAL', 'NONE', 'BLOCKED'])[o_custkey % 5 + 1] AS r FROM orders),
d AS (SELECT k, CASE WHEN k % 31 = 0 THEN 1 WHEN k % 29 = 0 THEN 2 WHEN k % 23 = 0 THEN 3 WHEN p IN ('UNKNOWN', 'odd') OR k % 19 = 0 THEN 4 WHEN k % 13 IN (0, 1) THEN 5 WHEN p = 'BLOCKED' OR r = 'BLOCKED' OR k % 11 = 0 THEN 9 WHEN p = 'CRITICAL' AND r = 'REQUIRED' THEN 6 WHEN p = 'HIGH' AND r = 'REQUIRED' THEN 7 WHEN r = 'RECOMMENDED' THEN 8 WHEN c % 100 < 40 THEN 10 ELSE 0 END AS rule, k % 2 = 0 AS hard FROM x)
SELECT k AS o_orderkey, CASE WHEN rule BETWEEN 1 AND 4 THEN 'UNKNOWN' WHEN rule IN (5, 9) OR rule = 6 AND hard THEN 'BLOCK' WHEN rule = 0 THEN 'ALLOW' ELSE 'REVIEW' END AS decision, CASE WHEN rule NOT IN (0, 8) THEN rule END AS failed_rule FROM d""")
def s_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 31 != 0).alias("policy_valid"), (k % 29 != 0).alias("evidence_valid"), F.when(k % 23 != 0, True).alias("exploitability_valid"),
        pick(k, "CRITICAL", "high", "MEDIUM", "LOW", "BLOCKED", "UNKNOWN", "odd").alias("priority"), pick(c, "REQUIRED", "RECOMMENDED", "OPTIONAL", "NONE", "BLOCKED").alias("remediation"),
        F.when(k % 19 == 0, "UNKNOWN").alias("regression_status"), F.when(k % 13 == 0, "FAIL").when(k % 13 == 1, "changed").alias("regression_change"), F.when(k % 11 == 0, "BLOCKED").alias("cluster_status"),
        (k % 2 == 0).alias("block_unknown"), (c % 100 / 100.0).alias("confidence"), F.lit(0.40).alias("minimum_confidence"),
    )
    return decisions.gate(rows).select("o_orderkey", "decision", "failed_rule")


@query("""WITH s AS (SELECT c_nationkey AS k, o_orderdate >= TIMESTAMP '1996-01-01' AS late, count(*) FILTER (o_orderpriority LIKE '1%') AS critical, count(*) FILTER (o_orderpriority LIKE '2%') AS high, max(o_orderstatus) AS policy FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
b AS (SELECT coalesce(a.k, z.k) AS k, a.k IS NULL OR z.k IS NULL AS gone, z.critical > a.critical AS c, z.high > a.high AS h, z.policy IS DISTINCT FROM a.policy AS p FROM (SELECT * FROM s WHERE NOT late) a FULL JOIN (SELECT * FROM s WHERE late) z ON a.k = z.k)
SELECT k, CASE WHEN gone THEN 'INVALID_SNAPSHOT_INPUT' WHEN c THEN 'CRITICAL_DRIFT' WHEN h OR p THEN 'POSTURE_DRIFT' ELSE 'NO_DRIFT' END AS drift FROM b""")
def s_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each nation before and from 1996 on, as snapshots of its posture."""
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey")
    snap = own.groupBy("k", (F.col("o_orderdate") >= "1996-01-01").alias("late")).agg(F.struct(F.count_if(F.col("o_orderpriority").startswith("1")).alias("critical"), F.count_if(F.col("o_orderpriority").startswith("2")).alias("high"), F.max("o_orderstatus").alias("policy")).alias("s"))
    pairs = snap.filter("NOT late").select("k", F.col("s").alias("old")).join(snap.filter("late").select("k", F.col("s").alias("new")), "k", "full_outer")
    return decisions.drift(pairs).select("k", "drift")


_OUTCOMES = """o AS (SELECT d.doc_id, lang, source, CASE WHEN d.doc_id % 17 = 0 THEN CASE WHEN toxic = 1 THEN 'FN_EPISTEMIC' ELSE 'UNCERTAIN_TN' END WHEN n_chars > 2000 AND toxic = 1 THEN 'TP' WHEN n_chars > 2000 THEN 'FP' WHEN toxic = 1 THEN 'FN' ELSE 'TN' END AS outcome, CASE WHEN d.doc_id % 17 = 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'UNKNOWN' ELSE 'CONFLICT' END ELSE 'SAFE' END AS v FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic IS NOT NULL)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents are taken for toxic; every 17th is not decided."""
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").filter("toxic IS NOT NULL"), "doc_id")
    long, toxic, open_ = F.col("n_chars") > 2000, F.col("toxic") == 1, F.col("doc_id") % 17 == 0
    kind = F.when(open_ & toxic, "FN_EPISTEMIC").when(open_, "UNCERTAIN_TN").when(long & toxic, "TP").when(long, "FP").when(toxic, "FN").otherwise("TN")
    return both.select("doc_id", "lang", "source", kind.alias("outcome"), F.when(open_ & (F.col("doc_id") % 2 == 0), "UNKNOWN").when(open_, "CONFLICT").otherwise("SAFE").alias("engine_verdict"))


_MEASURES = """c AS (SELECT lang, count(*) AS n, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'FN_EPISTEMIC') AS fe, count(*) FILTER (v IN ('UNKNOWN', 'CONFLICT')) AS u FROM o GROUP BY lang),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn + fe > 0 THEN tp / (tp + fn + fe) ELSE 1 END AS q, CASE WHEN tp + fn + fe > 0 THEN (tp + fe) / (tp + fn + fe) ELSE 1 END AS e FROM c)"""


@query(f"WITH {_OUTCOMES}, {_MEASURES} SELECT lang, n, tp, fp, fn, fe AS fn_epistemic, round(p, 9) AS precision_, round(q, 9) AS recall_, round(e, 9) AS epistemic_recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 9) AS f1, round(u / n, 9) AS uncertainty, CASE WHEN n < 5 THEN 'EXTERNAL_VALIDITY_INSUFFICIENT' WHEN p >= 0.9 AND q >= 0.9 THEN 'PASS' ELSE 'PASS_WITH_KNOWN_GAPS' END AS verdict FROM r")
def e_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.verdict(evaluation.measures(outcomes(spark, sf_dir), "lang"))
    rates = [F.round(c, 9).alias(c) for c in ("precision_", "recall_", "epistemic_recall", "f1", "uncertainty")]
    return m.select("lang", "n", "tp", "fp", "fn", "fn_epistemic", *rates, "verdict")


@query(f"WITH {_OUTCOMES}, c AS (SELECT source, count(*) AS n, count(*) FILTER (outcome = 'TP') AS k FROM o GROUP BY source), z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c) SELECT source, n, round(abs((p + z * z / 2 / n - z * sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)), 9) AS low, round((p + z * z / 2 / n + z * sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n), 9) AS high FROM z")
def e_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = outcomes(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "TP").alias("k"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return c.select("source", "n", F.round(F.abs(low), 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"WITH {_OUTCOMES} SELECT lang, source, coalesce(round(count(*) FILTER (outcome = 'TP') / nullif(count(*) FILTER (outcome IN ('TP', 'FN', 'FN_EPISTEMIC')), 0), 4), 1.0) AS recall_ FROM o GROUP BY lang, source")
def e_lang_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_matrix(outcomes(spark, sf_dir), "lang", "source")


_CASES = "c AS (SELECT doc_id AS case_id, source, (['VULNERABLE', 'SAFE', 'UNKNOWN', 'CONFLICT'])[doc_id % 4 + 1] AS e, coalesce((['VULNERABLE', 'SAFE', 'UNKNOWN', 'CONFLICT', 'VULNERABLE', NULL])[n_chars % 6 + 1], 'UNKNOWN') AS p FROM documents WHERE doc_id % 9 <> 0 AND n_chars IS NOT NULL)"


@query(f"""WITH {_CASES}, n AS (SELECT source, count(*) AS n, count(*) FILTER (e = p AND e = 'VULNERABLE') AS tp, count(*) FILTER (e = p AND e = 'SAFE') AS tn, count(*) FILTER (e = 'SAFE' AND p = 'VULNERABLE') AS fp, count(*) FILTER (e = 'VULNERABLE' AND p IN ('SAFE', 'UNKNOWN')) AS fn, count(*) FILTER (e = p) AS ok FROM c GROUP BY source)
SELECT source, n, tp, tn, fp, fn, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 9) AS fnr, round(coalesce(tn / nullif(tn + fp, 0), 1), 9) AS specificity, round(ok / n, 9) AS decision_correctness FROM n""")
def e_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("n_chars IS NOT NULL").withColumn("case_id", F.col("doc_id"))
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    cases = docs.filter("doc_id % 9 <> 0").select("case_id", "source", pick(F.col("doc_id"), "VULNERABLE", "SAFE", "UNKNOWN", "CONFLICT").alias("expected"))
    predicted = docs.select("case_id", pick(F.col("n_chars"), "VULNERABLE", "SAFE", "UNKNOWN", "CONFLICT", "VULNERABLE", None).alias("predicted"))
    m = evaluation.independent(cases, predicted, "source")
    return m.select("source", "n", "tp", "tn", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("fpr", "fnr", "specificity", "decision_correctness")))


@query("WITH m AS (SELECT source, (['KILLED', 'SURVIVED', 'INVALID', 'KILLED', 'INCONCLUSIVE'])[doc_id % 5 + 1] AS s FROM documents) SELECT source, count(*) FILTER (s = 'KILLED') AS killed, count(*) FILTER (s = 'SURVIVED') AS survived, round(coalesce(count(*) FILTER (s = 'KILLED') / nullif(count(*) FILTER (s IN ('KILLED', 'SURVIVED')), 0), 0), 9) AS score FROM m GROUP BY source")
def e_mutation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("KILLED", "SURVIVED", "INVALID", "KILLED", "INCONCLUSIVE")))
    own = table(spark, sf_dir, "documents").select("source", F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("status"))
    return evaluation.mutation_score(own, "source").withColumn("score", F.round("score", 9))


@query(f"""WITH {_OUTCOMES}, h AS (SELECT lang, doc_id % 2 AS half, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome IN ('FN', 'FN_EPISTEMIC')) AS fn FROM o GROUP BY 1, 2), r AS (SELECT lang, half, coalesce(tp / nullif(tp + fp, 0), 1) AS p, coalesce(tp / nullif(tp + fn, 0), 1) AS q FROM h)
SELECT a.lang, round(b.p - a.p, 9) AS precision_delta, round(b.q - a.q, 9) AS recall_delta, b.p - a.p >= -0.05 AND b.q - a.q >= -0.05 AS acceptable FROM r a JOIN r b ON a.lang = b.lang AND a.half = 0 AND b.half = 1""")
def e_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = outcomes(spark, sf_dir)
    runs = [evaluation.measures(own.filter(F.col("doc_id") % 2 == i), "lang") for i in (0, 1)]
    return evaluation.regression(*runs, "lang", 0.05, 0.05).select("lang", F.round("precision__delta", 9).alias("precision_delta"), F.round("recall__delta", 9).alias("recall_delta"), "acceptable")
