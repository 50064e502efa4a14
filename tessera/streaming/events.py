"""Event operators: windows, hash chains, folds in order, and their streaming forms."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.tables import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, its time with a zone."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the rows there now: each batch is written to the shared folder under its number, so that one that is run again replaces itself."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'all' if mode == 'complete' else f'batch-{number}'}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    if not q.awaitTermination(600):
        q.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def chain_hash(previous: str, event_id: int, event_type: str) -> str:
    return hashlib.sha256(f"{previous}|{event_id}|{event_type}".encode()).hexdigest()


class Chain:
    """Adds a hash chain to rows sorted by key and order; state is one hash, whatever the key's length."""

    def __call__(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, ""
        for pdf in parts:
            prev, own = [], []
            for k, e, t in zip(pdf["user_id"], pdf["event_id"], pdf["event_type"], strict=True):
                last = last if k == key else ""
                key = k
                prev.append(last)
                last = chain_hash(last, e, t)
                own.append(last)
            yield pdf.assign(previous_hash=prev, event_hash=own)


def chained(events: DataFrame) -> DataFrame:
    own = events.select("user_id", "ts", "event_id", "event_type").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return own.mapInPandas(Chain(), T.StructType([*own.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())]))


def verified(chain: DataFrame) -> DataFrame:
    """user_id, n, and the place of the first row whose link or hash is wrong (null: none)."""
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    rows = chain.selectExpr("user_id", f"row_number() {w} AS place", f"previous_hash = coalesce(lag(event_hash) {w}, '') AND event_hash = sha2(concat_ws('|', previous_hash, event_id, event_type), 256) AS fine")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("fine"), F.col("place"))).cast("long").alias("first_break"))


class Bucket:
    """Requests and tokens a minute over rows sorted by key and time: ALLOWED, or which of the two limits refuses a request.

    Both buckets hold burst minutes at most and fill all the time; a refused request takes nothing from either.
    """

    def __init__(self, requests: float, tokens: float, burst: float = 1.0):
        self.full = requests * burst, tokens * burst
        self.rate = requests / 60, tokens / 60

    def __call__(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left, at = None, list(self.full), None
        for pdf in parts:
            out = []
            for k, t, asked in zip(pdf["user_id"], pdf["ts"], pdf["value"], strict=True):
                if k != key:
                    key, left, at = k, list(self.full), t
                left = [min(full, x + max(0.0, (t - at).total_seconds()) * rate) for full, x, rate in zip(self.full, left, self.rate, strict=True)]
                at = t
                out.append("RPM_LIMIT_EXCEEDED" if left[0] < 1 else "TPM_LIMIT_EXCEEDED" if left[1] < asked else "ALLOWED")
                if out[-1] == "ALLOWED":
                    left = [left[0] - 1, left[1] - asked]
            yield pdf.assign(outcome=out)


class Circuit:
    """Circuit breaker over rows sorted by key and time: the state after each request.

    CLOSED: opens when so many of the last outcomes are known and the share of failures reaches the threshold.
    OPEN: requests pass by unrecorded until the rest is over; then HALF_OPEN, and the next outcome closes or opens it.
    """

    def __init__(self, window: int = 10, threshold: float = 0.5, least: int = 5, rest_seconds: float = 30.0):
        self.window, self.threshold, self.least, self.rest = window, threshold, least, rest_seconds

    def __call__(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last, opened = None, "CLOSED", [], None
        for pdf in parts:
            out = []
            for k, t, kind in zip(pdf["user_id"], pdf["ts"], pdf["event_type"], strict=True):
                if k != key:
                    key, state, last = k, "CLOSED", []
                bad = kind == "error"
                if state == "OPEN" and (t - opened).total_seconds() >= self.rest:
                    state, opened, last = ("OPEN", t, last) if bad else ("CLOSED", None, [])
                elif state == "CLOSED":
                    last = [*last, bad][-self.window :]
                    if bad and len(last) >= self.least and sum(last) / len(last) >= self.threshold:
                        state, opened = "OPEN", t
                out.append(state)
            yield pdf.assign(state=out)


def folded(events: DataFrame, fold, column: str, kind: T.DataType) -> DataFrame:
    own = events.select("user_id", "ts", "event_id", "event_type", "value").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return own.mapInPandas(fold, T.StructType([*own.schema.fields, T.StructField(column, kind)]))


def backoff(attempt: Column, base: float, most: float, jitter: Column | None = None) -> Column:
    """Seconds before an attempt (from 1 on): twice as long each time up to most, times a jitter between 0 and 1."""
    full = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30))))
    return full if jitter is None else full * F.greatest(F.lit(0.0), F.least(F.lit(1.0), jitter))


def worker_status(beats: DataFrame, now: Column, degraded: float = 45.0, offline: float = 90.0) -> DataFrame:
    """worker and ONLINE, DEGRADED or OFFLINE by the seconds since its last beat; beats: worker, ts."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))
    own = beats.groupBy("worker").agg((age / 1e6).alias("age"))
    return own.select("worker", F.when(F.col("age") > offline, "OFFLINE").when(F.col("age") > degraded, "DEGRADED").otherwise("ONLINE").alias("status"))


def snapshot(rows: DataFrame, group: str, id_col: str, blocks: int = 64) -> DataFrame:
    """group and a hash of all its ids: of each block of ids (by remainder) the hash of these in order, then that of the blocks' hashes.

    With more blocks a block stays small whatever the size of a group; the blocks are part of the hash.
    """
    block = F.pmod(F.col(id_col), F.lit(blocks)).alias("block")
    each = rows.groupBy(group, block).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(id_col))), ","), 256).alias("h"))
    named = F.concat(F.col("block").cast("string"), F.lit(":"), F.col("h"))
    return each.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(named)), ","), 256).alias("snapshot"))


def consensus(events: DataFrame, key: str = "aggregate") -> DataFrame:
    """Events (event_id, epoch, token, sequence, place) with verdict: DUPLICATE id, STALE if any of the three is below what was seen before, else APPLIED."""
    before = f"OVER (PARTITION BY {key} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    seen = events.selectExpr("*", f"row_number() OVER (PARTITION BY {key}, event_id ORDER BY place) AS _copy", *(f"coalesce({c} < max({c}) {before}, false) AS _{c}" for c in ("epoch", "token", "sequence")))
    return seen.withColumn("verdict", F.when(F.col("_copy") > 1, "DUPLICATE").when(F.col("_epoch") | F.col("_token") | F.col("_sequence"), "STALE").otherwise("APPLIED")).select(*events.columns, "verdict")


def ring_owner(keys: DataFrame, workers: list[str], points: int) -> DataFrame:
    """key and the worker whose next point on the hash ring follows it; the ring is workers x points hashes, held as an array."""
    ring = sorted((hashlib.sha256(f"{w}#{i}".encode()).hexdigest(), w) for w in workers for i in range(points))
    array = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in ring])
    h = F.sha2(F.col("key").cast("string"), 256)
    after = F.filter(array, lambda p: p["h"] > h)
    return keys.select("key", F.coalesce(F.try_element_at(after, F.lit(1))["w"], F.lit(ring[0][1])).alias("worker"))
