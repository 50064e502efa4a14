"""Findings: identity, duplicates, baselines, scores, gates and evaluation, over the driver's tables."""

from __future__ import annotations

from tessera.plans.base import shared

#: Ranks of severities; events stand for findings, their type for the severity.
SEVERITY = "(VALUES ('error', 'CRITICAL', 5), ('purchase', 'HIGH', 4), ('signup', 'MEDIUM', 3), ('click', 'LOW', 2), ('view', 'INFO', 1), ('none', 'NONE', 0))"

shared("f_exact_dedup", """
SELECT sha, doc_id, n_copies FROM (SELECT <<sha2(text, 256)|||sha256(text)>> AS sha, doc_id,
  row_number() OVER (PARTITION BY <<sha2(text, 256)|||sha256(text)>> ORDER BY n_chars DESC, doc_id) AS k,
  count(*) OVER (PARTITION BY <<sha2(text, 256)|||sha256(text)>>) AS n_copies FROM {documents} WHERE text IS NOT NULL) x WHERE k = 1""")
shared("f_semantic_dedup", """
SELECT source, sha, <<max_by(doc_id, struct(n_chars, -doc_id))|||arg_max(doc_id, (n_chars, -doc_id))>> AS doc_id, count(*) AS n
FROM (SELECT source, doc_id, n_chars, <<sha2|||sha256>>(<<regexp_replace(trim(text), '[ \\\\n\\\\t]+', ' '), 256|||regexp_replace(trim(text), '[ \\n\\t]+', ' ', 'g')>>) AS sha FROM {documents}) x GROUP BY source, sha""")
shared("f_regression_sets", """
WITH was AS (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15'), now AS (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15'),
valid AS (SELECT user_id, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id)
SELECT coalesce(was.user_id, now.user_id) AS cluster_id, CASE WHEN was.user_id IS NULL THEN 'NEW' WHEN now.user_id IS NOT NULL THEN 'PERSISTENT' WHEN valid.n IS NULL THEN 'UNKNOWN' ELSE 'RESOLVED' END AS status
FROM was FULL OUTER JOIN now ON was.user_id = now.user_id LEFT JOIN valid ON valid.user_id = was.user_id""")
shared("f_severity_summary", f"""
SELECT s.severity, count(e.event_id) AS n FROM {SEVERITY} AS s(event_type, severity, weight) LEFT JOIN {{events}} e ON e.event_type = s.event_type GROUP BY s.severity""")
shared("f_group_rule", "SELECT event_type AS rule_id, count(*) AS n, min(event_id) AS first_id, count(DISTINCT user_id) AS n_users FROM {events} GROUP BY event_type")
shared("f_cluster_links", """
WITH f AS (SELECT source, <<sha2(text, 256)|||sha256(text)>> AS h, doc_id FROM {documents} WHERE text IS NOT NULL), m AS (SELECT source, h, min(doc_id) AS first_id FROM f GROUP BY source, h)
SELECT m.first_id, f.doc_id FROM f JOIN m ON m.source = f.source AND m.h = f.h WHERE f.doc_id <> m.first_id""")
shared("f_finding_id", "SELECT event_id, <<substring(sha2(concat_ws('|', event_type, CAST(user_id AS STRING), CAST(event_id AS STRING)), 256), 1, 32)|||sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)))[1:32]>> AS fingerprint FROM {events}")

shared("s_resolution_dominance", """
WITH f AS (SELECT user_id, bool_or(event_type = 'error') AS vulnerable, bool_or(event_type = 'signup') AS safe FROM {events} GROUP BY user_id)
SELECT user_id, CASE WHEN vulnerable AND safe THEN 'CONFLICT' WHEN vulnerable THEN 'VULNERABLE' WHEN safe THEN 'SAFE' ELSE 'UNKNOWN' END AS verdict FROM f""")
shared("s_evidence_confidence", """
SELECT user_id, CAST(sum(w) AS BIGINT) AS score, CASE WHEN sum(w) >= 80 THEN 'HIGH' WHEN sum(w) >= 50 THEN 'MEDIUM' WHEN sum(w) > 0 THEN 'LOW' ELSE 'NONE' END AS confidence
FROM (SELECT DISTINCT user_id, event_type, CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 WHEN 'click' THEN 10 ELSE 0 END AS w FROM {events}) x GROUP BY user_id""")
shared("s_sink_matrix", """
WITH m AS (SELECT * FROM (VALUES ('A', 'O'), ('R', 'F'), ('N', 'O')) AS t(flag, status))
SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN max(m.flag) IS NULL THEN 'INCOMPATIBLE' ELSE 'COMPATIBLE' END AS state FROM {lineitem} LEFT JOIN m ON m.flag = l_returnflag AND m.status = l_linestatus GROUP BY l_returnflag, l_linestatus""")
shared("s_privilege_escape", """
WITH r AS (SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank_now, lag(CAST(substr(o_orderpriority, 1, 1) AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank_before FROM {orders})
SELECT o_orderkey, CASE WHEN rank_before IS NULL THEN 'INITIAL' WHEN rank_now < rank_before THEN 'ESCALATION' WHEN rank_now = rank_before THEN 'SAME' ELSE 'REDUCTION' END AS transition FROM r""")
shared("s_invariants", """
SELECT l_orderkey, count(*) AS n_lines, bool_and(l_quantity > 0) AS inv_positive, bool_and(l_discount BETWEEN 0 AND 0.1) AS inv_discount, count(DISTINCT l_linestatus) <= 1 AS inv_one_status FROM {lineitem} GROUP BY l_orderkey""")

shared("e_confusion", """
WITH p AS (SELECT d.doc_id, d.lang, n_chars > 2000 AS hit, l.toxic = 1 AS truth FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id)
SELECT lang, count(CASE WHEN hit AND truth THEN 1 END) AS tp, count(CASE WHEN hit AND NOT truth THEN 1 END) AS fp, count(CASE WHEN NOT hit AND truth THEN 1 END) AS fn, count(CASE WHEN NOT hit AND NOT truth THEN 1 END) AS tn FROM p GROUP BY lang""")
shared("e_overlap", """
WITH r AS (SELECT doc_id, 'long' AS rule FROM {documents} WHERE n_chars > 2000 UNION ALL SELECT doc_id, 'toxic' FROM {labels} WHERE toxic = 1 UNION ALL SELECT doc_id, 'good' FROM {labels} WHERE quality = 1)
SELECT a.rule AS rule_a, b.rule AS rule_b, count(*) AS n FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rule < b.rule GROUP BY a.rule, b.rule""")
shared("e_per_rule", """
WITH r AS (SELECT doc_id, 'long' AS rule FROM {documents} WHERE n_chars > 2000 UNION ALL SELECT doc_id, 'en' FROM {documents} WHERE lang = 'en')
SELECT rule, count(CASE WHEN toxic = 1 THEN 1 END) AS tp, count(CASE WHEN toxic = 0 THEN 1 END) AS fp, count(CASE WHEN toxic IS NULL THEN 1 END) AS unlabelled FROM r LEFT JOIN {labels} l ON l.doc_id = r.doc_id GROUP BY rule""")
shared("e_taxonomy", """
SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 'BOTH' WHEN toxic = 1 THEN 'TOXIC' WHEN quality = 0 THEN 'POOR' ELSE 'NONE' END AS kind, count(*) AS n FROM {labels} GROUP BY 1""")
shared("e_band_match", """
WITH f AS (SELECT event_id, user_id, event_type, event_id % 100 AS line FROM {events}), g AS (SELECT event_id AS case_id, user_id, event_id % 97 AS line FROM {events} WHERE event_type = 'error'),
m AS (SELECT g.case_id, f.event_id, row_number() OVER (PARTITION BY g.case_id ORDER BY abs(f.line - g.line), f.event_id) AS k FROM g JOIN f ON f.user_id = g.user_id AND f.event_type <> 'error' AND abs(f.line - g.line) <= 3)
SELECT g.case_id, m.event_id AS match_id FROM g LEFT JOIN m ON m.case_id = g.case_id AND m.k = 1""")
shared("e_coverage_cube", "SELECT lang, source, count(*) AS n, grouping(lang) AS g_lang, grouping(source) AS g_source FROM {documents} GROUP BY CUBE (lang, source)".replace("grouping(lang)", "CAST(grouping(lang) AS INT)").replace("grouping(source)", "CAST(grouping(source) AS INT)"))
shared("e_coverage_rollup", "SELECT r_name, n_name, count(*) AS n FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
shared("e_coverage_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
shared("e_conflicts_first_seen", """
SELECT first_id, doc_id AS conflict_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY <<sha2(text, 256)|||sha256(text)>>) AS first_id FROM {documents} WHERE text IS NOT NULL) x WHERE first_id <> doc_id""")
shared("e_scorecard", """
WITH c AS (SELECT count(CASE WHEN n_chars > 2000 AND toxic = 1 THEN 1 END) AS tp, count(CASE WHEN n_chars > 2000 AND toxic = 0 THEN 1 END) AS fp, count(CASE WHEN n_chars <= 2000 AND toxic = 1 THEN 1 END) AS fn, count(CASE WHEN n_chars <= 2000 AND toxic = 0 THEN 1 END) AS tn FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id)
SELECT round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS tp_rate, round(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 9) AS fp_rate, round(fn / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS fn_rate, tp * 10 >= (tp + fn) * 9 AND fp * 20 <= fp + tn AS gate FROM c""")

shared("u_union", "SELECT l_partkey AS k FROM {lineitem} UNION SELECT p_partkey FROM {part}")
shared("u_intersect", "SELECT DISTINCT l_suppkey AS k FROM {lineitem} INTERSECT SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 0")
shared("u_except", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45")
shared("w_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM {orders}")
shared("w_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS d FROM {orders}")
shared("w_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rolling, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}")
shared("w_ntile", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS q, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), 6) AS p FROM {orders}")
