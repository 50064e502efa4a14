"""Event-sourced, ordered and streaming queries over the events table."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import dataflow
from tessera.plans.base import query, shared
from tessera.streaming import events as ev
from tessera.streaming import stateful
from tessera.tables import shared_folder, table

shared("d_last_def", """
WITH s AS (SELECT event_id, user_id, event_type, <<last_value(CASE WHEN event_type = 'purchase' THEN event_id END, true)|||last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)>> OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM {events})
SELECT event_id AS use_id, def_id FROM s WHERE event_type = 'view'""")
shared("d_def_use", """
WITH s AS (SELECT event_id, event_type, <<last_value(CASE WHEN event_type = 'purchase' THEN event_id END, true)|||last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)>> OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM {events})
SELECT def_id, count(*) AS n_uses, min(event_id) AS first_use FROM s WHERE event_type = 'view' AND def_id IS NOT NULL GROUP BY def_id""")
shared("d_reaching", """
WITH s AS (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM {events})
SELECT user_id, CAST(version AS BIGINT) AS version, count(CASE WHEN event_type <> 'purchase' THEN 1 END) AS n_reached FROM s GROUP BY user_id, version""")
shared("d_taint_flow", """
WITH s AS (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS src, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS clean FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id AS sink_id, src AS source_id, CASE WHEN src IS NULL THEN 'UNKNOWN' WHEN clean = 1 THEN 'BLOCKED' ELSE 'CORRELATED' END AS status FROM s WHERE event_type = 'purchase'""")
shared("x_replay_state", "SELECT user_id, <<max_by(event_type, struct(ts, event_id))|||arg_max(event_type, (ts, event_id))>> AS state, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id")
shared("x_outbox_dedup", "SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS <<STRING|||VARCHAR>>) AS day, min(event_id) AS event_id, count(*) AS n FROM {events} GROUP BY user_id, event_type, CAST(ts AS DATE)")
shared("x_claim_oldest", "SELECT event_id, user_id FROM {events} WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 20")
shared("x_orphans", """
WITH off AS (SELECT user_id FROM {events} GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-29 00:00:00') SELECT event_id FROM {events} WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM off)""")
shared("x_hedged_winner", "SELECT user_id, <<min_by(event_id, struct(ts, event_id))|||arg_min(event_id, (ts, event_id))>> AS winner FROM {events} WHERE event_type = 'click' GROUP BY user_id")
shared("x_quorum", "SELECT event_type, count(DISTINCT user_id) AS votes, count(DISTINCT user_id) * 2 > (SELECT count(DISTINCT user_id) FROM {events}) AS accepted FROM {events} GROUP BY event_type")
shared("x_budget_running", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS spent FROM {events}")
shared("x_dead_letters", "SELECT user_id, count(*) AS attempts FROM {events} WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 5")


@query("SELECT event_id, least(60.0, 0.5 * power(2.0, event_id % 10)) * (event_id % 5) / 4.0 AS delay FROM events")
def x_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ev.backoff(F.col("event_id") % 10 + 1, 0.5, 60.0, F.col("event_id") % 5 / 4.0).alias("delay"))


@query("WITH b AS (SELECT event_type, event_id % 64 AS b, sha256(string_agg(event_id, ',' ORDER BY event_id)) AS h FROM events GROUP BY 1, 2) SELECT event_type, sha256(string_agg(b || ':' || h, ',' ORDER BY b || ':' || h)) AS snapshot FROM b GROUP BY event_type")
def x_snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.snapshot(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("WITH h AS (SELECT user_id, epoch(TIMESTAMP '2024-01-31') - max(epoch(ts)) AS age FROM events GROUP BY user_id) SELECT user_id, CASE WHEN age > 86400 THEN 'OFFLINE' WHEN age > 21600 THEN 'DEGRADED' ELSE 'ONLINE' END AS status FROM h")
def x_heartbeat_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "ts")
    return ev.worker_status(beats, F.lit("2024-01-31 00:00:00"), 21600, 86400).withColumnRenamed("worker", "user_id")


_CONSENSUS = "e AS (SELECT user_id, event_id // 2 AS event_id, CAST(floor(value) AS BIGINT) AS epoch, event_id % 7 AS token, event_id AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)"


@query(f"WITH {_CONSENSUS} SELECT user_id, place, CASE WHEN EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND b.event_id = e.event_id AND b.place < e.place) THEN 'DUPLICATE' WHEN EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND b.place < e.place AND (b.epoch > e.epoch OR b.token > e.token OR b.sequence > e.sequence)) THEN 'STALE' ELSE 'APPLIED' END AS verdict FROM e")
def x_stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").selectExpr("user_id", "event_id div 2 AS event_id", "CAST(floor(value) AS BIGINT) AS epoch", "event_id % 7 AS token", "event_id AS sequence", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place")
    return ev.consensus(own, "user_id").select("user_id", F.col("place").cast("long").alias("place"), "verdict")


@query("""WITH r AS (SELECT sha256('w' || w || '#' || i) AS h, 'w' || w AS worker FROM range(5) a(w), range(128) b(i)), u AS (SELECT DISTINCT user_id AS key, sha256(CAST(user_id AS VARCHAR)) AS h FROM events)
SELECT key, coalesce((SELECT arg_min(worker, r.h) FROM r WHERE r.h > u.h), (SELECT arg_min(worker, h) FROM r)) AS worker FROM u""")
def x_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()
    return ev.ring_owner(keys, [f"w{i}" for i in range(5)], 128)


#: Events of each user by number, for oracles that follow them one by one.
_ROWS = "e AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(f"""WITH RECURSIVE {_ROWS}, r AS (SELECT user_id, event_id, k, '' AS previous_hash, sha256('|' || event_id || '|' || event_type) AS event_hash FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, r.event_hash, sha256(r.event_hash || '|' || e.event_id || '|' || e.event_type) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, event_id, previous_hash, event_hash FROM r""")
def x_audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.chained(table(spark, sf_dir, "events")).select("user_id", "event_id", "previous_hash", "event_hash")


#: Events come in three deliveries by time; some of the first days come with the last one and are too late.
_CUTS = "2024-01-10", "2024-01-20"


@query(f"""WITH RECURSIVE c AS (SELECT * FROM events WHERE NOT (event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-08') AND ts <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)),
e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM c), r AS (SELECT user_id, event_id, k, '' AS previous_hash, sha256('|' || event_id || '|' || event_type) AS event_hash FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, r.event_hash, sha256(r.event_hash || '|' || e.event_id || '|' || e.event_type) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id AS key, event_id AS id, previous_hash, event_hash, (SELECT count(*) FROM events WHERE event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-08') AS n_late FROM r""")
def x_stateful_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash chains of users' events as a stream with state and timers; what comes too late is dropped and counted."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    late = (F.col("event_id") % 50 == 0) & (F.col("ts") < "2024-01-08")
    part = F.when(late | (F.col("ts") >= _CUTS[1]), 2).when(F.col("ts") >= _CUTS[0], 1).otherwise(0)
    folder = f"{shared_folder(spark)}/fed-{uuid.uuid4().hex}"
    put = lambda n: events.filter(part == n).write.mode("append").parquet(folder)
    put(0)
    fed = spark.readStream.schema(events.schema).parquet(folder)
    rows = stateful.in_order(fed, stateful.Chained(), "user_id", "ts", "event_id", "event_type")
    found, dropped = stateful.drained(rows, [functools.partial(put, 1), functools.partial(put, 2)])
    return found.withColumn("n_late", F.lit(dropped).cast("long"))


@query("WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) SELECT user_id, count(*) AS n, min(CASE WHEN event_id % 97 = 0 THEN place END) AS first_break FROM p GROUP BY user_id")
def x_audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th event is tampered with after the chain was built."""
    chain = ev.chained(table(spark, sf_dir, "events"))
    return ev.verified(chain.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("event_type"))))


@query(f"""WITH RECURSIVE {_ROWS}, r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST(3 AS DOUBLE) AS a, CAST(600 AS DOUBLE) AS b, CAST(NULL AS TIMESTAMP) AS at, 'ALLOWED' AS outcome FROM events
UNION ALL SELECT user_id, event_id, k, CASE WHEN x >= 1 AND y >= value THEN x - 1 ELSE x END, CASE WHEN x >= 1 AND y >= value THEN y - value ELSE y END, ts, CASE WHEN x < 1 THEN 'RPM_LIMIT_EXCEEDED' WHEN y < value THEN 'TPM_LIMIT_EXCEEDED' ELSE 'ALLOWED' END
FROM (SELECT e.user_id, e.event_id, e.k, e.ts, e.value, least(3.0, a + coalesce((epoch_us(e.ts) - epoch_us(r.at)) / 1e6, 0) * (1.0 / 1440 / 60)) AS x, least(600.0, b + coalesce((epoch_us(e.ts) - epoch_us(r.at)) / 1e6, 0) * (200.0 / 1440 / 60)) AS y FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) s)
SELECT user_id, event_id, outcome FROM r WHERE k > 0""")
def x_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request and 200 tokens a day, three days of them at most."""
    return ev.folded(table(spark, sf_dir, "events"), ev.Bucket(1 / 1440, 200 / 1440, 3 * 1440), "outcome", T.StringType()).select("user_id", "event_id", "outcome")


@query(f"""WITH RECURSIVE {_ROWS}, r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, 'CLOSED' AS state, CAST([] AS BOOLEAN[]) AS w, CAST(NULL AS TIMESTAMP) AS opened FROM events
UNION ALL SELECT user_id, event_id, k, s2, CASE WHEN s1 = 'CLOSED' THEN w1 WHEN s1 = 'HALF_OPEN' AND NOT bad THEN [] ELSE w END, CASE WHEN s2 = 'OPEN' AND s1 <> 'OPEN' THEN ts WHEN s2 = 'CLOSED' THEN NULL ELSE opened END
FROM (SELECT *, CASE WHEN s1 = 'OPEN' THEN 'OPEN' WHEN s1 = 'HALF_OPEN' THEN CASE WHEN bad THEN 'OPEN' ELSE 'CLOSED' END WHEN bad AND len(w1) >= 3 AND len(list_filter(w1, lambda z: z)) / len(w1) >= 0.4 THEN 'OPEN' ELSE 'CLOSED' END AS s2
FROM (SELECT e.user_id, e.event_id, e.k, e.ts, e.event_type = 'error' AS bad, w, opened, list_append(w, e.event_type = 'error')[-6:] AS w1, CASE WHEN state = 'OPEN' AND epoch(e.ts) - epoch(opened) >= 172800 THEN 'HALF_OPEN' ELSE state END AS s1 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) a) b)
SELECT user_id, event_id, state FROM r WHERE k > 0""")
def x_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens when 2 in 5 of the last six at most failed, three at least; rests two days."""
    return ev.folded(table(spark, sf_dir, "events"), ev.Circuit(6, 0.4, 3, 172800), "state", T.StringType()).select("user_id", "event_id", "state")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ev.source(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return ev.drained(w, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL '1 day', ts) - o * INTERVAL '1 day' AS start, count(*) AS n FROM events, range(2) r(o) GROUP BY ALL")
def x_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ev.source(spark, sf_dir).groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return ev.drained(w, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '1 day' THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def x_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def x_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user and type, by streaming deduplication under a watermark longer than the table's span."""
    own = ev.source(spark, sf_dir).withWatermark("ts", "90 days").select("user_id", "event_type", "ts").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return ev.drained(own).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


#: Orders stand for functions and their lines for statements, each followed by the next and sometimes the one after.
_CFG = "l AS (SELECT DISTINCT l_orderkey AS fn, l_linenumber AS node FROM lineitem), cfg AS (SELECT DISTINCT a.fn, a.node AS src, b.node AS dst FROM l a JOIN l b ON a.fn = b.fn AND (b.node = a.node + 1 OR b.node = a.node + 2 AND (a.fn + a.node) % 3 = 0)), d AS (SELECT DISTINCT fn, node, CASE WHEN (fn + node) % 2 = 0 THEN 'x' ELSE 'y' END AS var FROM l WHERE (fn + node) % 5 < 3)"
_REACHED = f"{_CFG}, r(fn, node, var, def) AS (SELECT d.fn, cfg.dst, d.var, d.node FROM d JOIN cfg ON cfg.fn = d.fn AND cfg.src = d.node UNION SELECT r.fn, cfg.dst, r.var, r.def FROM r JOIN cfg ON cfg.fn = r.fn AND cfg.src = r.node WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.fn = r.fn AND d.node = r.node AND d.var = r.var))"


def _functions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").cast("long").alias("node")).distinct()
    steps = nodes.select("fn", F.col("node").alias("src"), F.explode(F.when((F.col("fn") + F.col("node")) % 3 == 0, F.array(F.col("node") + 1, F.col("node") + 2)).otherwise(F.array(F.col("node") + 1))).alias("dst"))
    cfg = steps.join(nodes.withColumnRenamed("node", "dst"), ["fn", "dst"], "left_semi")
    k = F.col("fn") + F.col("node")
    return nodes, cfg, nodes.filter(k % 5 < 3).select("fn", "node", F.when(k % 2 == 0, "x").otherwise("y").alias("var"))


@query(f"WITH RECURSIVE {_REACHED} SELECT fn, node, var, def FROM r")
def d_reaching_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cfg, defs = _functions(spark, sf_dir)
    return dataflow.reaching(cfg, defs).select("fn", "node", "var", "def")


@query(f"WITH RECURSIVE {_REACHED} SELECT fn, node, var, CASE WHEN count(*) FILTER (def % 4 = 0) = 0 AND min(def % 2) = max(def % 2) THEN CAST(min(def % 2) AS VARCHAR) END AS value FROM r GROUP BY fn, node, var")
def d_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cfg, defs = _functions(spark, sf_dir)
    values = defs.withColumn("value", F.when(F.col("node") % 4 != 0, (F.col("node") % 2).cast("string")))
    return dataflow.constants(dataflow.reaching(cfg, defs), values).select("fn", "node", "var", "value")


@query(f"""WITH RECURSIVE {_CFG}, s AS (SELECT fn, node, CASE (fn + node) % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'sink' WHEN 2 THEN 'sanitizer' ELSE 'other' END AS role FROM l),
r(fn, source, node, clean) AS (SELECT fn, node, node, false FROM s WHERE role = 'source' UNION SELECT r.fn, r.source, cfg.dst, r.clean OR s.role = 'sanitizer' FROM r JOIN cfg ON cfg.fn = r.fn AND cfg.src = r.node JOIN s ON s.fn = cfg.fn AND s.node = cfg.dst)
SELECT a.fn, a.node AS source, b.node AS sink, CASE WHEN count(r.node) = 0 THEN 'UNKNOWN' WHEN bool_and(r.clean) THEN 'BLOCKED' ELSE 'CORRELATED' END AS status FROM s a JOIN s b ON a.fn = b.fn AND a.role = 'source' AND b.role = 'sink' LEFT JOIN r ON r.fn = a.fn AND r.source = a.node AND r.node = b.node GROUP BY ALL""")
def d_taint_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cfg, _ = _functions(spark, sf_dir)
    roles = F.element_at(F.array(*map(F.lit, ("source", "sink", "sanitizer", "other"))), ((F.col("fn") + F.col("node")) % 4 + 1).cast("int"))
    return dataflow.taint(cfg, nodes.withColumn("role", roles))
