"""Evidence, admission, remediation, privileges, SSA, tasks, budgets and routing over the driver's tables; oracles are written apart."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import admission as ad
from tessera.operators import graph, ssa
from tessera.plans.base import query
from tessera.plans.event_queries import _CFG, _ROWS, _functions
from tessera.plans.graph_queries import _edges_sql
from tessera.sinks import graphs
from tessera.streaming import events as ev
from tessera.streaming import workers
from tessera.tables import shared_folder, table


def _pick(n: str, *names: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.col(n) % len(names) + 1).cast("int"))


def _sql(n: str, *names: str | None) -> str:
    return "([" + ", ".join("NULL" if x is None else f"'{x}'" for x in names) + f"])[{n} % {len(names)} + 1]"


_STATES = ("CONFIRMED", "unknown", "CANDIDATE", None, "BLOCKED")


@query(f"""WITH c AS (SELECT o_orderkey AS cluster_id, {_sql('o_custkey', *_STATES)} AS status FROM orders),
f AS (SELECT l_orderkey AS cluster_id, count(*) AS n, count(DISTINCT l_suppkey % 2) > 1 AS k, count(DISTINCT CASE WHEN l_linenumber > 5 THEN 'HTML' ELSE 'SQL' END) > 1 AS s, bool_or(l_partkey % 2 = 0) AS src, bool_or(l_linenumber % 2 = 0) AS snk, count(*) FILTER (l_quantity / 45 > 1) AS bad FROM lineitem GROUP BY 1),
m AS (SELECT c.*, coalesce(k, false)::INT + coalesce(s, false)::INT + coalesce(bad, 0) AS contradictions, CASE WHEN upper(coalesce(status, 'unknown')) = 'UNKNOWN' THEN 1 ELSE 0 END + CASE WHEN n IS NULL THEN 1 ELSE 0 END + CASE WHEN src THEN 0 ELSE 1 END + CASE WHEN snk THEN 0 ELSE 1 END AS gone FROM c LEFT JOIN f USING (cluster_id))
SELECT cluster_id, contradictions, (4 - gone) / 4 AS completeness, gone = 0 AND contradictions = 0 AS evidence_valid FROM m""")
def s_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clusters, their lines as findings."""
    clusters = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cluster_id"), _pick("o_custkey", *_STATES).alias("status"))
    findings = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cluster_id"), _pick("l_suppkey", "XSS", "SQL_INJECTION").alias("vulnerability_class"), F.when(F.col("l_linenumber") > 5, "HTML").otherwise("SQL").alias("sink_category"),
        F.when(F.col("l_partkey") % 2 == 0, "s").alias("source_fact"), F.when(F.col("l_linenumber") % 2 == 0, "k").alias("sink_fact"), (F.col("l_quantity") / 45).alias("confidence"),
    )
    return ad.evidence(clusters, findings).select("cluster_id", "contradictions", "completeness", "evidence_valid")


_DECIDED, _REGRESSED, _PLANNED = ("ALLOW", "allow", "REVIEW", "ALLOW", "BLOCK", "UNKNOWN", None, "ALLOW"), ("PASS", None, "PASS", "fail", "PASS", "UNKNOWN", "PASS"), (None, "REQUIRED", "RECOMMENDED", "BLOCKED", None, None, "UNKNOWN", None, None)


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey % 101 / 80 AS s, upper({_sql('o_orderkey', *_DECIDED)}) AS d, upper({_sql('o_custkey', *_REGRESSED)}) AS r, {_sql('o_custkey', *_PLANNED)} AS p FROM orders),
x AS (SELECT k, CASE WHEN k % 37 = 0 THEN 1 WHEN k % 31 = 0 THEN 2 WHEN s > 1 THEN 3 WHEN k % 29 = 0 OR k % 23 = 0 THEN 4 WHEN d = 'UNKNOWN' THEN 5 WHEN d = 'BLOCK' THEN 6 WHEN r IN ('FAIL', 'UNKNOWN') THEN 7 WHEN p IN ('BLOCKED', 'UNKNOWN') THEN 8 WHEN d = 'REVIEW' THEN 9 WHEN s < 0.8 OR d IS NULL THEN 10 ELSE 11 END AS rule, r, p FROM o),
y AS (SELECT k, rule, CASE WHEN rule IN (1, 2, 3, 4, 5) OR rule = 7 AND r = 'UNKNOWN' OR rule = 8 AND p = 'UNKNOWN' THEN 'UNKNOWN' WHEN rule = 9 THEN 'REVIEW_REQUIRED' WHEN rule = 11 THEN 'APPROVED' ELSE 'BLOCKED' END AS admission FROM x)
SELECT k AS o_orderkey, admission, rule, CASE WHEN admission = 'APPROVED' THEN 'PERMITTED' ELSE 'PROHIBITED_' || admission END AS permission FROM y""")
def s_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 37 != 0, k).alias("artifact_id"), F.when(k % 31 == 0, -k).otherwise(k).alias("artifact_decision_id"), k.alias("decision_id"), _pick("o_orderkey", *_DECIDED).alias("decision"),
        (F.col("o_custkey") % 101 / 80).alias("confidence"), (k % 29 != 0).alias("evidence_valid"), F.when(k % 23 != 0, True).alias("exploitability_valid"), _pick("o_custkey", *_REGRESSED).alias("regression_status"), _pick("o_custkey", *_PLANNED).alias("remediation_status"),
    )
    return ad.admission(rows).select("o_orderkey", "admission", "rule", "permission")


_RELEASE, _WANTED = ("CREATED", "SECURITY_EVALUATED", "BLOCKED", "SECURITY_EVALUATED", "APPROVED"), ("SECURITY_EVALUATED", "APPROVED", "BLOCKED", "REVIEW_REQUIRED", "UNKNOWN", "CREATED")


@query(f"""WITH r AS (SELECT o_orderkey AS k, {_sql('o_orderkey', *_RELEASE)} AS a, {_sql('o_custkey', *_WANTED)} AS b, {_sql('o_custkey // 6', 'APPROVED', 'blocked', 'UNKNOWN', None)} AS m FROM orders)
SELECT k AS o_orderkey, CASE WHEN b = 'SECURITY_EVALUATED' THEN a = 'CREATED' WHEN a <> 'SECURITY_EVALUATED' OR m IS NULL OR k % 7 = 0 THEN false WHEN b IN ('APPROVED', 'BLOCKED', 'REVIEW_REQUIRED') THEN upper(m) = b ELSE true END AS allowed FROM r""")
def s_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").withColumn("_m", F.expr("o_custkey div 6"))
    wrong = F.when(F.col("o_orderkey") % 7 == 0, "e0").otherwise("e1")
    last = F.when(F.col("o_orderkey") % 2 == 0, "e1").when(F.col("o_orderkey") % 7 == 0, "e1")
    return own.select("o_orderkey", ad.release_allowed(_pick("o_orderkey", *_RELEASE), _pick("o_custkey", *_WANTED), _pick("_m", "APPROVED", "blocked", "UNKNOWN", None), wrong, last).alias("allowed"))


_WEAK = ("SQL_INJECTION", "remote_exec", "XSS", "PATH_TRAVERSAL", "CODE_INJECTION", "file_upload", "OPEN_REDIRECT", "eval_use", None)
_TRIED = ("str(x)", "parameterized_query", " Escape_HTML ", "shlex.quote", "exec()")


@query(f"""WITH c AS (SELECT p_partkey, {_sql('p_partkey', 'SQL', 'COMMAND', 'HTML', 'PATH', 'CODE', 'PATH', 'UNKNOWN', 'CODE', 'UNKNOWN')} AS s, {_sql('p_size', *_STATES)} AS st, {_sql('p_size', *_TRIED)} AS t FROM part)
SELECT p_partkey, CASE s WHEN 'SQL' THEN 'REM-SQL-01' WHEN 'COMMAND' THEN 'REM-CMD-01' WHEN 'HTML' THEN 'REM-XSS-01' WHEN 'PATH' THEN 'REM-PATH-01' WHEN 'CODE' THEN 'REM-CODE-01' ELSE 'REM-UNKNOWN' END AS pattern_id,
CASE WHEN s = 'UNKNOWN' THEN 'UNKNOWN' WHEN st = 'CONFIRMED' THEN 'REQUIRED' WHEN st = 'CANDIDATE' THEN 'RECOMMENDED' WHEN st = 'BLOCKED' THEN 'BLOCKED' ELSE 'UNKNOWN' END AS remediation_status,
CASE s WHEN 'SQL' THEN 'parameterized_query' WHEN 'COMMAND' THEN 'command_allowlist' WHEN 'HTML' THEN 'context_aware_html_escape' WHEN 'PATH' THEN 'safe_join' WHEN 'CODE' THEN 'static_dispatch' ELSE 'manual_security_audit_required' END AS primary_fix,
s <> 'UNKNOWN' AND (t = 'str(x)' OR s IN ('SQL', 'PATH') AND t = ' Escape_HTML ' OR s = 'CODE' AND t = 'exec()') AS forbidden FROM c""")
def s_remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", "p_size", _pick("p_partkey", *_WEAK).alias("vulnerability_class"), _pick("p_size", *_STATES).alias("status"))
    tried = ad.forbidden_fix(ad.sink_category(F.col("vulnerability_class")), _pick("p_size", *_TRIED))
    return ad.remediation(own).select("p_partkey", "pattern_id", "remediation_status", "primary_fix", tried.alias("forbidden"))


_OLD, _NEW = ("USER", "VERIFIED_USER", "odd", "ANONYMOUS", "TENANT_ADMIN"), ("USER", "SERVICE_ACCOUNT", "ROOT", "CLOUD_ADMIN", "ANONYMOUS", None, "ORG_ADMIN")


@query(f"""WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, {_sql('o_orderkey', *_OLD)} AS a, {_sql('o_custkey', *_NEW)} AS b FROM orders),
r AS (SELECT *, CASE a WHEN 'ANONYMOUS' THEN 0 WHEN 'USER' THEN 1 WHEN 'VERIFIED_USER' THEN 2 WHEN 'TENANT_ADMIN' THEN 3 END AS x, CASE b WHEN 'ANONYMOUS' THEN 0 WHEN 'USER' THEN 1 WHEN 'SERVICE_ACCOUNT' THEN 3 WHEN 'ORG_ADMIN' THEN 4 WHEN 'ROOT' THEN 6 WHEN 'CLOUD_ADMIN' THEN 6 END AS y FROM p),
z AS (SELECT k, b, CASE WHEN k % 3 = 0 AND k % 11 <> 0 AND x IS NOT DISTINCT FROM y THEN 1 WHEN x IS NULL OR y IS NULL OR c % 2 = 0 AND b LIKE '%ADMIN%' AND k % 4 <> 0 THEN 2 WHEN c % 5 = 0 THEN 3 WHEN x = y AND k % 13 <> 0 AND k % 3 <> 0 THEN 4 WHEN y > x AND k % 3 <> 0 THEN 5 ELSE 6 END AS step FROM r)
SELECT k AS o_orderkey, CASE step WHEN 3 THEN 'TENANT_BOUNDARY_ESCAPE' WHEN 4 THEN 'HORIZONTAL_PRIVILEGE_ESCALATION' WHEN 5 THEN CASE b WHEN 'ROOT' THEN 'ROOT_ACCESS' WHEN 'CLOUD_ADMIN' THEN 'CLOUD_ROLE_ESCALATION' ELSE 'VERTICAL_PRIVILEGE_ESCALATION' END ELSE 'VERTICAL_PRIVILEGE_ESCALATION' END AS category,
CASE WHEN step IN (1, 6) THEN 'SAFE' WHEN step = 2 THEN 'UNKNOWN' ELSE 'VULNERABLE' END AS resolution FROM z""")
def s_privilege(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("u1").alias("old_identity"), F.when(k % 13 == 0, "u1").otherwise("u2").alias("new_identity"), _pick("o_orderkey", *_OLD).alias("old_privilege"), _pick("o_custkey", *_NEW).alias("new_privilege"),
        F.when(k % 4 == 0, "jwt reuse").otherwise("click").alias("trigger"), F.when(k % 3 == 0, True).alias("authorized"), (k % 11 != 0).alias("tenant_verified"), F.lit("t1").alias("old_tenant"), F.when(c % 5 == 0, "t2").otherwise("t1").alias("new_tenant"),
        F.when(c % 2 != 0, "VALID").alias("credential"),
    )
    return ad.privilege_change(rows).select("o_orderkey", "category", "resolution")


_USED, _HELD = ("filename", "$_POST[x]", "user_pwd", "sess_token", "path"), ("cache_id", "digest", "h", "$idx")


@query(f"""WITH d AS (SELECT doc_id, {_sql('doc_id', *_USED)} AS a, {_sql('doc_id', *_HELD)} AS v, lower(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' $seen[ md5 ] = 1' WHEN doc_id % 7 = 1 THEN ' $t[h] = 2' WHEN doc_id % 11 = 0 THEN ' ETag' ELSE '' END) AS t FROM documents),
s AS (SELECT *, a IN ('user_pwd', 'sess_token') OR regexp_matches(t, 'password|passwd|pwd|secret|token|auth') AS secret FROM d)
SELECT doc_id, CASE WHEN secret AND (a = 'user_pwd' OR contains(t, 'password')) THEN 'PASSWORD_HASH' WHEN secret THEN 'SECURITY_TOKEN' WHEN regexp_matches(t, '\\$\\w+\\s*\\[\\s*(md5|sha1|hash)\\s*\\]') OR v = 'h' AND regexp_matches(t, '\\$\\w+\\s*\\[\\s*h\\s*\\]') OR contains(t, 'array_key_exists') THEN 'NON_SECURITY_IDENTIFIER'
WHEN regexp_matches(t, 'filesize|file_exists|md5_file|checksum|etag') THEN 'CHECKSUM' WHEN v IN ('cache_id', '$idx') AND a <> '$_POST[x]' THEN 'CACHE_KEY' ELSE 'UNKNOWN' END AS context FROM s""")
def s_hash_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    more = F.when(n % 7 == 0, " $seen[ md5 ] = 1").when(n % 7 == 1, " $t[h] = 2").when(n % 11 == 0, " ETag").otherwise("")
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("t"))
    return own.select("doc_id", ad.hash_context(_pick("doc_id", *_USED), _pick("doc_id", *_HELD), F.col("t")).alias("context"))


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS r FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS r FROM lineitem WHERE l_returnflag = 'A'),
d AS (SELECT coalesce(b.f, c.f) AS fixture_id, count(*) FILTER (b.f IS NULL) AS added, count(*) FILTER (c.f IS NULL) AS removed FROM b FULL JOIN c ON b.f = c.f AND b.r = c.r GROUP BY 1)
SELECT *, CASE WHEN added > 0 AND removed > 0 THEN 'MISMATCH' WHEN added > 0 THEN 'ADDED' WHEN removed > 0 THEN 'REMOVED' ELSE 'EQUIVALENT' END AS status FROM d""")
def e_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda flag: table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("fixture_id"), F.col("l_linenumber").cast("string").alias("rule_id"), F.lit("p").alias("property_name"), F.lit(None).cast("string").alias("knowledge_pack"), F.lit("HIGH").alias("severity"))
    return ad.detector_difference(own("R"), own("A"))


_VERDICTS = ("UNKNOWN", "conflict", "SAFE", "VULNERABLE", None)


@query(f"SELECT o_orderkey, {_sql('o_orderkey', *_VERDICTS)} AS before, {_sql('o_custkey', *_VERDICTS)} AS after, o_orderkey % 5 NOT IN (0, 1) OR o_custkey % 5 NOT IN (2, 3) OR o_orderkey % 3 = 0 AS valid FROM orders")
def e_epistemic_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_orderkey", _pick("o_orderkey", *_VERDICTS).alias("before"), _pick("o_custkey", *_VERDICTS).alias("after"))
    return own.withColumn("valid", ad.epistemic_change(F.col("before"), F.col("after"), F.when(F.col("o_orderkey") % 3 == 0, True)))


@query("""SELECT p_partkey AS rule_id, CASE WHEN p_size % 3 <> 0 AND p_partkey % 4 <> 0 THEN 'NO_CONDITION' ELSE '' END || '|' || CASE WHEN p_size % 5 = 0 THEN 'NO_LANGUAGE' ELSE '' END AS issues FROM part WHERE p_size % 3 <> 0 AND p_partkey % 4 <> 0 OR p_size % 5 = 0""")
def e_dead_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("").alias("pattern"), F.when(F.col("p_partkey") % 4 == 0, F.array("p_brand")).alias("symbol_triggers"), F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("languages"))
    has = lambda x: F.when(F.array_contains("issues", x), x).otherwise("")
    return ad.dead_rules(rules).select("rule_id", F.concat(has("NO_CONDITION"), F.lit("|"), has("NO_LANGUAGE")).alias("issues"))


_SSA = f"""{_CFG}, r(fn, node, var, def) AS (SELECT d.fn, cfg.dst, d.var, d.node FROM d JOIN cfg ON cfg.fn = d.fn AND cfg.src = d.node UNION SELECT r.fn, cfg.dst, r.var, r.def FROM r JOIN cfg ON cfg.fn = r.fn AND cfg.src = r.node WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.fn = r.fn AND d.node = r.node AND d.var = r.var)),
phi AS (SELECT DISTINCT fn, node, var FROM r WHERE (fn, node) IN (SELECT fn, dst FROM cfg GROUP BY 1, 2 HAVING count(*) > 1)),
v AS (SELECT fn, node, var, phi, row_number() OVER (PARTITION BY fn, var ORDER BY node, 1 - phi::INT) AS version FROM (SELECT fn, node, var, false AS phi FROM d UNION ALL SELECT fn, node, var, true FROM phi) a),
z AS (SELECT fn, node, var, max(version) AS version FROM v GROUP BY 1, 2, 3),
q(fn, node, var, def) AS (SELECT z.fn, cfg.dst, z.var, z.node FROM z JOIN cfg ON cfg.fn = z.fn AND cfg.src = z.node UNION SELECT q.fn, cfg.dst, q.var, q.def FROM q JOIN cfg ON cfg.fn = q.fn AND cfg.src = q.node WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.fn = q.fn AND z.node = q.node AND z.var = q.var))"""


@query(f"WITH RECURSIVE {_SSA} SELECT v.fn, v.node, v.var, v.version, v.phi, CASE WHEN v.phi THEN string_agg(z.version, ',' ORDER BY z.version) END AS operands FROM v LEFT JOIN q ON q.fn = v.fn AND q.node = v.node AND q.var = v.var AND v.phi LEFT JOIN z ON z.fn = q.fn AND z.node = q.def AND z.var = q.var GROUP BY v.fn, v.node, v.var, v.version, v.phi")
def d_ssa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and phis of each order's graph, with the versions that a phi takes."""
    _, cfg, defs = _functions(spark, sf_dir)
    versions, reached = ssa.converted(cfg, defs)
    operands = reached.groupBy("fn", "node", "var").agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias("operands")).withColumn("phi", F.lit(True))
    return versions.join(operands, ["fn", "node", "var", "phi"], "left").select("fn", "node", "var", F.col("version").cast("long").alias("version"), "phi", "operands")


@query(f"WITH RECURSIVE {_SSA} SELECT l.fn, l.node, u.var, coalesce((SELECT v.version FROM v WHERE v.fn = l.fn AND v.node = l.node AND v.var = u.var AND v.phi), (SELECT max(z.version) FROM q JOIN z ON z.fn = q.fn AND z.node = q.def AND z.var = q.var WHERE q.fn = l.fn AND q.node = l.node AND q.var = u.var), 0) AS version FROM l CROSS JOIN (VALUES ('x'), ('y')) u(var)")
def d_ssa_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement uses both variables."""
    nodes, cfg, defs = _functions(spark, sf_dir)
    return ssa.used(*ssa.converted(cfg, defs), nodes.withColumn("var", F.explode(F.array(F.lit("x"), F.lit("y"))))).withColumn("version", F.col("version").cast("long"))


_TAINTS = ("UNTAINTED", "TAINTED", "SANITIZED", "UNTAINTED", "CONSTRAINED", "UNTAINTED", None)


@query(f"""WITH p AS (SELECT l_orderkey AS fn, coalesce({_sql('l_partkey', *_TAINTS)}, 'UNKNOWN') AS s, l_suppkey % 3 > 0 AS i, l_partkey % 4 > 0 AS h FROM lineitem)
SELECT fn, CASE WHEN count(DISTINCT s) = 1 THEN min(s) WHEN bool_or(s IN ('TAINTED', 'CONSTRAINED')) THEN 'TAINTED' ELSE 'UNKNOWN' END AS state, CASE WHEN bool_and(i) THEN 'INTEGER ' ELSE '' END || CASE WHEN bool_and(h) THEN 'HTML_ESCAPED ' ELSE '' END AS facts FROM p GROUP BY fn""")
def d_taint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.array_compact(F.array(F.when(F.col("l_partkey") % 4 > 0, "HTML_ESCAPED"), F.when(F.col("l_suppkey") % 3 > 0, "INTEGER"), F.lit("odd")))
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fn"), _pick("l_partkey", *_TAINTS).alias("s"), facts.alias("f"))
    joined = own.groupBy("fn").agg(ssa.joined_taint(F.col("s")).alias("state"), ssa.joined_facts(F.col("f")).alias("f"))
    return joined.select("fn", "state", F.concat_ws("", F.transform("f", lambda x: F.concat(x, F.lit(" ")))).alias("facts"))


_STEPS = ("QUEUED", "RUNNING", "QUEUED", "RUNNING", "FAILED_RETRYABLE", "QUEUED", "COMPLETED", "CANCELLED", "RUNNING")


@query(f"""WITH RECURSIVE {_ROWS}, w AS (SELECT user_id, event_id, k, {_sql('event_id', *_STEPS)} AS wanted, CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END AS held FROM e),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, 'PENDING' AS state, 1 AS lease, 0 AS tries, '' AS o FROM events
UNION ALL SELECT user_id, event_id, k, CASE WHEN o = 'APPLIED' THEN wanted ELSE state END, CASE WHEN o = 'APPLIED' AND state = 'RUNNING' AND wanted = 'QUEUED' THEN lease + 1 ELSE lease END, CASE WHEN o = 'APPLIED' AND wanted = 'RUNNING' THEN tries + 1 ELSE tries END, o
FROM (SELECT w.*, r.state, r.lease, r.tries, CASE WHEN held <> lease THEN 'STALE_LEASE' WHEN state || '>' || wanted IN ('PENDING>QUEUED', 'QUEUED>RUNNING', 'QUEUED>CANCELLED', 'RUNNING>COMPLETED', 'RUNNING>FAILED_RETRYABLE', 'RUNNING>CANCELLED', 'RUNNING>QUEUED', 'FAILED_RETRYABLE>QUEUED') THEN 'APPLIED' ELSE 'INVALID_STATE' END AS o FROM r JOIN w ON w.user_id = r.user_id AND w.k = r.k + 1) a)
SELECT user_id, event_id, concat_ws(' ', o, state, lease, tries) AS outcome FROM r WHERE k > 0""")
def x_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for tasks, their events for requests."""
    own = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", _pick("event_id", *_STEPS).alias("event_type"), F.when(F.col("event_id") % 6 == 0, 2.0).otherwise(1.0).alias("value"))
    return ev.folded(own, workers.Tasks(), "outcome", T.StringType()).select("user_id", "event_id", "outcome")


@query(f"""WITH RECURSIVE {_ROWS}, r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS t0, CAST(NULL AS TIMESTAMP) AS w0, 0 AS nr, 0 AS nb, false AS off, '' AS o FROM events
UNION ALL SELECT user_id, event_id, k, t0, w1, nr + CASE WHEN o <> 'TRIPPED' AND event_type = 'error' THEN 1 ELSE 0 END, b1 + CASE WHEN o <> 'TRIPPED' AND event_type = 'purchase' THEN 1 ELSE 0 END, o <> 'ALLOWED', o
FROM (SELECT *, CASE WHEN off THEN 'TRIPPED' WHEN epoch(ts) - epoch(t0) > 2160000 THEN 'TIME_BUDGET' WHEN event_type = 'error' AND nr >= 3 THEN 'RETRY_BUDGET' WHEN k - 1 >= 15 THEN 'ACTION_BUDGET' WHEN event_type = 'purchase' AND b1 >= 1 THEN 'BLOCK_BUDGET' ELSE 'ALLOWED' END AS o
FROM (SELECT e.user_id, e.event_id, e.k, e.ts, e.event_type, coalesce(t0, e.ts) AS t0, nr, off, CASE WHEN w0 IS NULL OR epoch(e.ts) - epoch(w0) > 172800 THEN e.ts ELSE w0 END AS w1, CASE WHEN w0 IS NULL OR epoch(e.ts) - epoch(w0) > 172800 THEN 0 ELSE nb END AS b1 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) a) b)
SELECT user_id, event_id, o AS outcome FROM r WHERE k > 0""")
def x_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for retries and purchases for blocks: one block in two days, three retries, 15 actions, 25 days."""
    fold = workers.Operations(2160000, 3, 15, 1, 172800, retry="error", block="purchase")
    return ev.folded(table(spark, sf_dir, "events"), fold, "outcome", T.StringType()).select("user_id", "event_id", "outcome")


REGISTRY = [
    {"provider_id": p, "model_id": m, "priority": n, "health": h, "circuit_open": o, "cooling": c, "tokens_left": left, "capabilities": able, "input_price": a, "output_price": b}
    for p, m, n, h, o, c, left, able, a, b in (
        ("a", "m1", 1, "HEALTHY", False, False, 30, ["chat"], 3, 9), ("a", "m2", 2, "DEGRADED", False, None, None, ["chat", "code"], 2, 4), ("b", "m1", 2, "HEALTHY", True, False, None, ["chat", "code"], 1, 1),
        ("c", "m1", 3, "HEALTHY", False, False, None, ["chat", "code"], 5, 12), ("b", "m0", 3, "HEALTHY", None, False, None, ["code"], 5, 12), ("d", "m1", 0, "UNKNOWN", False, False, None, ["chat", "code"], 1, 1),
        ("e", "m1", 0, "HEALTHY", False, True, None, ["chat"], 1, 1), ("f", "m1", 0, "HEALTHY", False, False, None, ["chat"], None, 1),
    )
]


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS i, l_linenumber AS o, l_partkey % 2 = 0 AS code, l_suppkey % 3 = 0 AS deg, l_suppkey % 4 = 0 AS no_a2, CASE WHEN l_partkey % 5 > 0 THEN 240 END AS lim FROM lineitem),
c AS (SELECT *, i + o <= 30 AND NOT code AND (lim IS NULL OR 3 * i + 9 * o <= lim) AS a1, deg AND NOT no_a2 AND (lim IS NULL OR 2 * i + 4 * o <= lim) AS a2, lim IS NULL OR 5 * i + 12 * o <= lim AS c1 FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a1 THEN 'a/m1' WHEN a2 THEN 'a/m2' WHEN c1 AND code THEN 'b/m0' WHEN c1 THEN 'c/m1' END AS chosen, CASE WHEN a1 THEN 3 * i + 9 * o WHEN a2 THEN 2 * i + 4 * o WHEN c1 THEN 5 * i + 12 * o END AS cost FROM c""")
def x_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 4 == 0, F.array(F.lit("a/m2"))).alias("excluded"), F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("code"))).otherwise(F.array(F.lit("chat"))).alias("required"),
        F.col("l_quantity").cast("long").alias("input_tokens"), F.col("l_linenumber").cast("long").alias("output_tokens"), F.when(F.col("l_partkey") % 5 > 0, 240).alias("most_cost"), F.when(F.col("l_suppkey") % 3 == 0, True).alias("allow_degraded"),
    )
    chosen = F.when(F.col("provider_id").isNotNull(), F.concat_ws("/", "provider_id", "model_id"))
    return workers.routed(asked, REGISTRY).select("l_orderkey", "l_linenumber", "l_partkey", chosen.alias("chosen"), "cost")


@query("""WITH s AS (SELECT c_nationkey AS k, o_orderkey % 2 = 0 AS late, count(*) FILTER (o_orderpriority LIKE '1%') AS c, count(*) FILTER (o_orderpriority LIKE '2%') AS h FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), b AS (SELECT * FROM s WHERE NOT late AND k % 3 <> 0)
SELECT CASE WHEN s.k <> 5 THEN 't' || s.k END AS target_id, s.c, CASE WHEN s.k = 5 THEN 'INVALID_INPUT' WHEN b.k IS NULL THEN 'MISSING_BASELINE' WHEN s.c > b.c THEN 'CRITICAL_DRIFT' WHEN s.h > b.h THEN 'POSTURE_DRIFT' ELSE 'NO_DRIFT' END AS drift FROM s LEFT JOIN b ON b.k = s.k WHERE s.late""")
def x_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders of each nation against the odd ones as its registered baseline, which every third nation lacks."""
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey")
    snap = own.groupBy("k", (F.col("o_orderkey") % 2 == 0).alias("late")).agg(F.struct(F.count_if(F.col("o_orderpriority").startswith("1")).alias("critical"), F.count_if(F.col("o_orderpriority").startswith("2")).alias("high"), F.lit("p").alias("policy")).alias("snapshot"))
    named = snap.withColumn("target_id", F.when(F.col("k") != 5, F.concat(F.lit("t"), F.col("k").cast("string"))))
    found = workers.verified_targets(named.filter("late").select("target_id", "snapshot"), named.filter("NOT late AND k % 3 <> 0").select("target_id", "snapshot"))
    return found.select("target_id", F.col("snapshot.critical").alias("c"), "drift")


@query(f"SELECT src, dst, edge_type FROM ({_edges_sql(('IN_NATION', 'IN_REGION'))})")
def k_graph_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as compressed JSON lines and read again."""
    edges = graph.build_edges(spark, sf_dir, ("IN_NATION", "IN_REGION"))
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    graphs.save(edges.select(F.col("src").alias("id")).distinct(), edges, path, "json.gz")
    return graphs.load(spark, path)[1].select("src", "dst", "edge_type")


@query(f"""WITH RECURSIVE {_ROWS}, w AS (SELECT user_id, event_id, k, ts, {_sql('event_id', 'a', 'b', 'a')} AS own, 40000 + event_id % 7 * 30000 AS s FROM e),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, '' AS owner, CAST(0 AS DOUBLE) AS until, 0 AS token, '' AS o FROM events
UNION ALL SELECT user_id, event_id, k, CASE WHEN free OR own = owner THEN own ELSE owner END, CASE WHEN free OR own = owner THEN epoch(ts) + s ELSE until END, token + free::INT, CASE WHEN free OR own = owner THEN 'HELD ' || token + free::INT ELSE 'REFUSED' END
FROM (SELECT w.*, r.owner, r.until, r.token, epoch(w.ts) >= r.until AS free FROM r JOIN w ON w.user_id = r.user_id AND w.k = r.k + 1) a) SELECT user_id, event_id, o AS outcome FROM r WHERE k > 0""")
def x_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for locks that two owners ask for."""
    own = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", _pick("event_id", "a", "b", "a").alias("event_type"), (40000.0 + F.col("event_id") % 7 * 30000).alias("value"))
    return ev.folded(own, workers.Leases(), "outcome", T.StringType()).select("user_id", "event_id", "outcome")


_BEFORE, _AFTER = ("NONE", "QUEUED", "RUNNING", "RUNNING", "PENDING"), ("QUEUED", "RUNNING", "COMPLETED", "FAILED", "QUEUED", "CANCELLED", "FAILED_RETRYABLE")


@query(f"""WITH a AS (SELECT event_id, ts, user_id AS t, event_id % 3 AS v, {_sql('event_id', *_BEFORE)} AS p, {_sql('event_id', *_AFTER)} AS n FROM events), k AS (SELECT *, CASE WHEN p || '>' || n IN ('NONE>QUEUED', 'PENDING>QUEUED') THEN 'task_created_' || t
ELSE 'task_' || CASE WHEN p || '>' || n = 'QUEUED>RUNNING' THEN 'assigned' WHEN p || '>' || n = 'RUNNING>COMPLETED' THEN 'completed' WHEN n LIKE 'FAILED%' THEN 'failure' ELSE 'transition' END || '_' || t || '_' || v END AS key FROM a)
SELECT DISTINCT ON (key) key AS deduplication_key, 'evt_' || t || '_' || v AS event_id, n AS new_state, 'TASK_' || CASE p || '>' || n WHEN 'NONE>QUEUED' THEN 'CREATED' WHEN 'PENDING>QUEUED' THEN 'CREATED' WHEN 'QUEUED>RUNNING' THEN 'ASSIGNED' WHEN 'RUNNING>QUEUED' THEN 'RECOVERED' ELSE n END AS event_type FROM k WHERE t % 4 <> 0 OR NOT starts_with(key, 'task_created') ORDER BY key, ts, event_id""")
def x_outbox_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox holds the creation of every fourth task."""
    audit = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("task_id"), _pick("event_id", *_BEFORE).alias("previous_state"), _pick("event_id", *_AFTER).alias("new_state"), (F.col("event_id") % 3).alias("lease_version"))
    kept = audit.filter("task_id % 4 = 0").select(F.concat(F.lit("task_created_"), F.col("task_id").cast("string")).alias("deduplication_key")).distinct()
    return workers.rebuilt_outbox(audit, kept).select("deduplication_key", "event_id", "new_state", "event_type")
