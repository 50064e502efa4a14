"""Queries of rules over nodes, temporal invariants and provenance, with SQL that works rule by rule and line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation, guards, invariants, provenance, rule_pipeline, verdicts
from tessera.plans.base import query
from tessera.tables import table

#: What events stand for: by type and number.
_ACTIONS = ("REVOKE", "USE", "CACHE_INVALIDATED", "PROOF", "GRANT", "CHECK", "LOCK", "TRANSACTION", "CONCURRENT_MUTATION", "CLIENT_STATE", "SERVER_STATE", "DB_MUTATION", "CACHE_READ", "REQUEST", "PAY", "APPROVE", "SHARED_READ", "DEBIT", "CREDIT_FAIL", "AUTH_ISSUED", "AUTH_USED", "AUTH_CHECKED", "ACTIVATE", "MUTATE", "NONCE", "TENANT_A", "TENANT_B", "STATE_RAISED", "STATE_LOWERED")


def _temporal_sql() -> str:
    """Each pattern by itself: for every second event the latest first one before it, then whether anything stands between."""
    names = "[" + ", ".join(f"'{a}'" for a in _ACTIONS) + "]"
    parts = []
    for p in invariants.TEMPORAL:
        clears = ", ".join(f"'{c}'" for c in p.clears)
        sure = "true" if p.between is None else f"EXISTS (SELECT 1 FROM e x WHERE x.key = b.key AND x.action = '{p.between}' AND x.place > a.place AND x.place < b.place)"
        parts.append(f"""SELECT b.key, '{p.category}' AS category, CASE WHEN {sure} THEN '{p.severity}' ELSE 'UNKNOWN' END AS severity, CASE WHEN {sure} THEN 'VULNERABLE' ELSE 'UNKNOWN' END AS resolution, '{p.cause}' AS cause, a.event_id AS first_event, b.event_id AS then_event
FROM e b JOIN e a ON a.key = b.key AND a.action = '{p.first}' AND a.place = (SELECT max(y.place) FROM e y WHERE y.key = b.key AND y.action = '{p.first}' AND y.place < b.place)
WHERE b.action = '{p.then}' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.key = b.key AND x.action IN ({clears}) AND x.place > a.place AND x.place < b.place)""")
    return f"WITH e AS (SELECT user_id AS key, event_id, {names}[event_id * 7 % {len(_ACTIONS)} + 1] AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) " + " UNION ALL ".join(parts)


@query(_temporal_sql())
def x_temporal_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events that break one of the temporal invariants."""
    names = F.array(*(F.lit(a) for a in _ACTIONS))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("seq"), "event_id", F.get(names, (F.col("event_id") * 7 % len(_ACTIONS)).cast("int")).alias("action"))
    return invariants.offences(events)


_DAG = """s0 AS (SELECT l_partkey AS tree, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS line, l_orderkey AS o, l_returnflag AS f FROM {lineitem}),
steps AS (SELECT tree, CAST(line AS BIGINT) AS line, 1000000 * tree + line AS id, f AS kind, concat('o', o) AS meta, CASE WHEN o % 97 = 0 THEN 'tampered' ELSE concat('o', o) END AS now FROM s0)"""


@query(f"""WITH RECURSIVE {_DAG.replace("{lineitem}", "lineitem")},
r(tree, line, a, b) AS (SELECT DISTINCT tree, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM steps UNION ALL
  SELECT r.tree, s.line, list_append(a, sha256(s.id || ':' || s.kind || ':' || s.meta || ':' || CASE WHEN s.line = 1 THEN '' WHEN s.line < 4 THEN (s.id - s.line + 1) || '=' || a[1] ELSE (s.id - s.line + s.line // 3) || '=' || a[s.line // 3] || '|' || (s.id - s.line + s.line // 2) || '=' || a[s.line // 2] END)),
    list_append(b, sha256(s.id || ':' || s.kind || ':' || s.now || ':' || CASE WHEN s.line = 1 THEN '' WHEN s.line < 4 THEN (s.id - s.line + 1) || '=' || b[1] ELSE (s.id - s.line + s.line // 3) || '=' || b[s.line // 3] || '|' || (s.id - s.line + s.line // 2) || '=' || b[s.line // 2] END))
  FROM r JOIN steps s ON s.tree = r.tree AND s.line = r.line + 1)
SELECT s.id, r.b[s.line] AS fingerprint, CASE WHEN r.a[s.line] = r.b[s.line] THEN 'SAME' WHEN s.meta <> s.now THEN 'CHANGED' ELSE 'DEPENDS' END AS status FROM steps s JOIN r ON r.tree = s.tree AND r.line = s.line""")
def p_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each part's history, each resting on two before it; some are tampered with, and what depends on them shows it."""
    steps = spark.sql(f"WITH {_DAG} SELECT * FROM steps", lineitem=table(spark, sf_dir, "lineitem"))
    preds = F.when(F.col("line") > 1, F.expr("array(id - line + greatest(1, line div 2), id - line + greatest(1, line div 3))"))
    return provenance.compared_graphs(steps.select(F.col("tree").alias("graph"), "id", "kind", "meta", "now", preds.alias("preds")))


#: A rule for each word of the benchmark: the word is the trigger, some have a pattern or an exclusion.
_RULES = """w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark), r AS (SELECT w, row_number() OVER (ORDER BY md5(w), w) AS k FROM w)"""


def _page_rules(spark: SparkSession, sf_dir: str) -> list[rule_pipeline.Rule]:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).distinct()
    first = words.orderBy(F.md5(F.col("w").cast("binary")), "w").toLocalIterator()  # rules are part of the plan; findings() checks their size
    return [rule_pipeline.Rule(f"rule {k}", "html" if k % 3 == 0 else rule_pipeline.GENERIC, ("p", "li", "a") if k % 2 == 0 else ("*",), (r["w"],), rf"[a-z]+ {r['w']}" if k % 4 == 0 else None, "the" if k % 5 == 0 else None) for k, r in enumerate(first, 1)]


@query(f"""WITH {_RULES},
n AS (SELECT page_id, pos, x, regexp_extract(x, '^<([a-z0-9]+)', 1) AS t FROM (SELECT page_id, unnest(xs) AS x, unnest(range(len(xs))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<[a-z0-9]+[^>]*>[^<]*') AS xs FROM pages)))
SELECT page_id * 100000 + pos AS node, 'rule ' || k AS rule, w AS trigger, x AS matched FROM n JOIN r ON contains(x, w)
WHERE (k % 2 = 1 OR t IN ('p', 'li', 'a')) AND regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_])' || w || '($|[^\\p{{L}}\\p{{N}}_])') AND NOT (k % 5 = 0 AND regexp_matches(lower(x), 'the')) AND (k % 4 > 0 OR regexp_matches(x, '[a-z]+ ' || w))""")
def r_rule_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each word of the benchmark, over the elements of all pages in one pass."""
    parts = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<[a-z0-9]+[^>]*>[^<]*"), F.lit(0))).alias("pos", "text"))
    nodes = parts.select((F.col("page_id") * 100000 + F.col("pos")).alias("node"), F.regexp_extract("text", "^<([a-z0-9]+)", 1).alias("node_type"), F.lit("html").alias("language"), "text", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("map<string,string>").alias("aliases"))
    return rule_pipeline.findings(nodes, _page_rules(spark, sf_dir))


@query("""WITH t AS (SELECT l_returnflag, l_linestatus, l_orderkey AS o, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) % 8 AS f, ['SQL_INJECTION', 'command_exec', ' xss ', 'PATH_TRAVERSAL', 'LDAP'][l_partkey % 5 + 1] AS category, [NULL, 'SQL_VALUE', 'SQL_ORDER_BY', 'SHELL_ARGUMENT'][l_suppkey % 4 + 1] AS context FROM lineitem),
b AS (SELECT category, context, [[], ['NUMERIC'], ['INTEGER', 'NUMERIC'], ['DIGITS_ONLY'], ['SHELL_ESCAPED'], ['HTML_ESCAPED', 'NUMERIC'], ['PATH_NORMALIZED'], ['SQL_ESCAPED']][f + 1] AS facts FROM t),
d AS (SELECT category, context, array_to_string(facts, ' ') AS facts, CASE WHEN list_contains(facts, 'INTEGER') THEN 'INTEGER' WHEN list_contains(facts, 'DIGITS_ONLY') THEN 'DIGITS_ONLY' WHEN list_contains(facts, 'NUMERIC') THEN 'NUMERIC' END AS ty FROM b),
x AS (SELECT *, CASE WHEN ty IS NOT NULL AND category = 'SQL_INJECTION' THEN CASE WHEN context IS NULL OR context = 'SQL_VALUE' THEN 'COMPATIBLE:' ELSE 'NOT_PROVEN:' END || ty
  WHEN ty IS NOT NULL AND category = 'command_exec' AND (context IS NULL OR context = 'SHELL_ARGUMENT') THEN 'COMPATIBLE:' || ty WHEN ty IS NOT NULL AND category = ' xss ' THEN 'COMPATIBLE:' || ty
  WHEN facts = 'SHELL_ESCAPED' THEN CASE category WHEN 'command_exec' THEN 'COMPATIBLE' ELSE 'NOT_PROVEN' END || ':SHELL_ESCAPED' WHEN facts LIKE 'HTML%' THEN CASE category WHEN ' xss ' THEN 'COMPATIBLE' ELSE 'NOT_PROVEN' END || ':HTML_ESCAPED'
  WHEN facts = 'PATH_NORMALIZED' AND category = 'PATH_TRAVERSAL' THEN 'COMPATIBLE:PATH_NORMALIZED' ELSE 'NOT_PROVEN:' END AS a FROM d)
SELECT category, context, facts, split_part(a, ':', 1) AS decision, nullif(split_part(a, ':', 2), '') AS fact, count(*) AS n FROM x GROUP BY ALL""")
def s_sink_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is proven of values, and whether it is enough where they go."""
    pick = lambda names, i: F.get(F.array(*(F.lit(x) for x in names)), i.cast("int"))
    sets = ((), ("NUMERIC",), ("INTEGER", "NUMERIC"), ("DIGITS_ONLY",), ("SHELL_ESCAPED",), ("HTML_ESCAPED", "NUMERIC"), ("PATH_NORMALIZED",), ("SQL_ESCAPED",))
    own = F.col("l_quantity").cast("long") % 8
    rows = table(spark, sf_dir, "lineitem").select(pick(("SQL_INJECTION", "command_exec", " xss ", "PATH_TRAVERSAL", "LDAP"), F.col("l_partkey") % 5).alias("category"), pick((None, "SQL_VALUE", "SQL_ORDER_BY", "SHELL_ARGUMENT"), F.col("l_suppkey") % 4).alias("context"), pick([" ".join(s) for s in sets], own).alias("facts"), pick([sum(guards.BIT[f] for f in s) for s in sets], own).alias("bits"))
    answer = verdicts.compatibility(F.col("bits"), F.col("category"), F.col("context"))
    return rows.withColumn("a", answer).groupBy("category", "context", "facts", "a.decision", "a.fact").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS verdict_id, l_returnflag AS rule, ['src/App.php', './src\\app.php', '././SRC/app.php', 'lib/db.php'][l_partkey % 4 + 1] AS file, 'f' || (l_suppkey % 3) AS fn, l_linenumber AS line, 'SQL' AS sc, 'v#' || (l_partkey % 2) AS vv, CASE WHEN l_suppkey % 2 = 0 THEN 'ctx' END AS cc, l_linestatus AS br,
  CASE WHEN l_partkey % 3 = 0 THEN 'a,b' ELSE 'b,c' END AS so, 'CONFIRMED' AS status, l_discount AS confidence, CAST(l_quantity AS BIGINT) AS np, l_linenumber AS ne FROM lineitem),
k AS (SELECT *, sha256(rule || '|' || CASE WHEN file = 'lib/db.php' THEN file ELSE 'src/app.php' END || '|' || fn || '|' || line || '|' || sc || '|' || vv || '|' || coalesce(cc, '') || '|' || br || '|' || so || '|' || status)[1:16] AS h FROM v),
r AS (SELECT h, verdict_id, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY confidence DESC, np DESC, ne DESC, verdict_id DESC) AS p FROM k)
SELECT 'corr_' || h AS correlation_id, verdict_id AS primary, n, n - 1 AS associated FROM r WHERE p = 1""")
def f_correlated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that are the same one by ten marks, and the richest of each."""
    files = F.array(*(F.lit(x) for x in ("src/App.php", "./src\\app.php", "././SRC/app.php", "lib/db.php")))
    sources = F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("c")))
    own = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("verdict_id"), F.col("l_returnflag").alias("rule"), F.get(files, (F.col("l_partkey") % 4).cast("int")).alias("file"), F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("function"), F.col("l_linenumber").alias("line"), F.lit("SQL").alias("sink_category"), F.concat(F.lit("v#"), F.col("l_partkey") % 2).alias("var_version"), F.when(F.col("l_suppkey") % 2 == 0, "ctx").alias("call_context"), F.col("l_linestatus").alias("branch"), sources.alias("sources"), F.lit("CONFIRMED").alias("status"), F.col("l_discount").alias("confidence"), F.col("l_quantity").cast("long").alias("n_provenance"), F.col("l_linenumber").alias("n_evidence"))
    return verdicts.correlated(own)


@query("""WITH f AS (SELECT CASE WHEN user_id % 40 < 5 THEN ['ACCOUNT_TAKEOVER', 'ROOT_ACCESS', 'CLOUD_ADMIN', 'TENANT_ESCAPE', 'CODE_EXECUTION'][user_id % 40 + 1] ELSE 'PROPERTY_' || user_id END AS property, CASE WHEN event_id % 7 = 0 THEN 'SAFE' WHEN event_id % 31 = 0 THEN 'CONFLICT' WHEN event_id % 3 = 0 THEN 'VULNERABLE' END AS r,
  user_id % 5 = 0 AS quiet, event_type = 'view' AS missing FROM events),
g AS (SELECT property, sum(CASE WHEN r = 'CONFLICT' AND NOT quiet THEN 1 ELSE 0 END) AS c, sum(CASE WHEN r = 'SAFE' AND property LIKE '%5' THEN 1 ELSE 0 END) AS s, sum(CASE WHEN r = 'VULNERABLE' AND NOT missing AND property NOT LIKE '%7' THEN 1 ELSE 0 END) AS v FROM f GROUP BY property),
h AS (SELECT property, CASE WHEN c > 0 OR (v > 0 AND s > 0) THEN 'CONFLICT' WHEN v > 0 THEN 'VULNERABLE' WHEN s > 0 THEN 'SAFE' ELSE 'UNKNOWN' END AS resolution FROM g)
SELECT property, resolution, CASE resolution WHEN 'VULNERABLE' THEN CASE WHEN property LIKE 'PROPERTY%' THEN 'HIGH' ELSE 'CRITICAL' END WHEN 'SAFE' THEN 'INFO' ELSE 'UNKNOWN' END AS severity, CASE WHEN resolution IN ('VULNERABLE', 'SAFE') THEN 'HIGH' ELSE 'UNKNOWN' END AS confidence FROM h""")
def s_property_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties and what findings prove of them."""
    names = F.array(*(F.lit(x) for x in verdicts.CRITICAL))
    own = F.col("user_id") % 40
    prop = F.when(own < 5, F.get(names, own.cast("int"))).otherwise(F.concat(F.lit("PROPERTY_"), "user_id"))
    rows = table(spark, sf_dir, "events").select(prop.alias("property"), "event_id", "user_id", "event_type")
    r = F.when(F.col("event_id") % 7 == 0, F.when(F.col("property").endswith("5"), "SAFE")).when(F.col("event_id") % 31 == 0, F.when(F.col("user_id") % 5 != 0, "CONFLICT")).when((F.col("event_id") % 3 == 0) & ~F.col("property").endswith("7"), "VULNERABLE")
    return verdicts.proofs(rows.select("property", r.alias("resolution"), F.lit(None).cast("boolean").alias("conflict"), F.lit(False).alias("safe_control"), (F.col("event_type") == "view").alias("missing")))


@query("""WITH g AS (SELECT event_id AS case_id, user_id AS file, CASE WHEN event_id % 9 > 0 THEN event_id % 97 END AS line, CASE WHEN event_id % 4 > 0 THEN 'r' || (event_id % 3) ELSE '' END AS rule FROM events WHERE event_type = 'error'),
f AS (SELECT event_id AS finding_id, epoch_us(ts) AS place, user_id AS file, CASE WHEN event_id % 11 > 0 THEN event_id % 100 END AS line, CASE WHEN event_id % 13 > 0 THEN 'r' || (event_id % 5) END AS rule, CASE WHEN event_id % 7 = 0 THEN 'r' || ((event_id + 1) % 5) END AS other FROM events WHERE event_type <> 'error'),
m AS (SELECT g.case_id, f.finding_id, row_number() OVER (PARTITION BY g.case_id ORDER BY f.place, f.finding_id) AS k FROM g JOIN f ON f.file = g.file AND (f.rule = g.rule OR g.rule = '' OR f.rule IS NULL OR f.other = g.rule) AND (f.line IS NULL OR g.line IS NULL OR abs(f.line - g.line) <= 3))
SELECT g.case_id, m.finding_id FROM g LEFT JOIN m ON m.case_id = g.case_id AND m.k = 1""")
def e_matched_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and the first finding that fits each: the same file, a rule that fits, lines near each other."""
    events = table(spark, sf_dir, "events")
    e = F.col("event_id")
    name = lambda n, m: F.concat(F.lit("r"), n % m)
    cases = events.filter("event_type = 'error'").select(e.alias("case_id"), F.col("user_id").alias("file"), F.when(e % 9 > 0, e % 97).alias("line"), F.when(e % 4 > 0, name(e, 3)).otherwise("").alias("rule"))
    found = events.filter("event_type <> 'error'").select(e.alias("finding_id"), F.col("ts").alias("place"), F.col("user_id").alias("file"), F.when(e % 11 > 0, e % 100).alias("line"), F.when(e % 13 > 0, name(e, 5)).alias("rule"), F.when(e % 7 == 0, F.array(name(e + 1, 5))).alias("correlated"))
    return evaluation.matched_cases(cases, found)
