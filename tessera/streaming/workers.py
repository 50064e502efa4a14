"""Work handed out: task states behind leases, budgets of automatic actions, choice of a provider, drift of targets.

Folds take rows sorted by user_id and time, as tessera.streaming.events.folded
deals them; their state is a few numbers whatever the length of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.decisions import drift

#: The states that may follow each state of a task; the rest are ends.
NEXT_STATES = {
    "PENDING": ("QUEUED",), "QUEUED": ("RUNNING", "CANCELLED"), "RUNNING": ("COMPLETED", "FAILED_RETRYABLE", "FAILED", "CANCELLED", "QUEUED"), "FAILED_RETRYABLE": ("QUEUED", "FAILED"),
}
#: The event of each change of state; any other is TASK_ and the new state.
TASK_EVENTS = {
    "NONE>QUEUED": "TASK_CREATED", "PENDING>QUEUED": "TASK_CREATED", "QUEUED>RUNNING": "TASK_ASSIGNED", "RUNNING>COMPLETED": "TASK_COMPLETED", "RUNNING>FAILED": "TASK_FAILED",
    "RUNNING>QUEUED": "TASK_RECOVERED", "RUNNING>FAILED_RETRYABLE": "TASK_FAILED_RETRYABLE", "FAILED_RETRYABLE>QUEUED": "TASK_REQUEUED",
}
PROVIDER = "struct<provider_id:string,model_id:string,priority:int,health:string,circuit_open:boolean,cooling:boolean,tokens_left:long,capabilities:array<string>,input_price:long,output_price:long>"


class Tasks:
    """The state of a task after each request, with its lease and attempts: APPLIED, STALE_LEASE or INVALID_STATE.

    A request names the state it wants (event_type) and the lease it holds (value). A running task that is queued again
    gets the next lease, so what the worker that lost it still sends is stale.
    """

    def __call__(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, lease, attempts = None, "PENDING", 1, 0
        for pdf in parts:
            out = []
            for k, wanted, held in zip(pdf["user_id"], pdf["event_type"], pdf["value"], strict=True):
                if k != key:
                    key, state, lease, attempts = k, "PENDING", 1, 0
                outcome = "STALE_LEASE" if held != lease else "APPLIED" if wanted in NEXT_STATES.get(state, ()) else "INVALID_STATE"
                if outcome == "APPLIED":
                    lease += state == "RUNNING" and wanted == "QUEUED"
                    attempts += wanted == "RUNNING"
                    state = wanted
                out.append(f"{outcome} {state} {lease} {attempts}")
            yield pdf.assign(outcome=out)


class Operations:
    """Budgets of automatic actions: ALLOWED, or the budget that trips the circuit; once tripped, all are refused as TRIPPED.

    event_type names the kinds of a retry and of a block. Blocks are counted in windows that begin with the first
    request after the last window's end.
    """

    def __init__(self, seconds: float, retries: int, actions: int, blocks: int, window: float = 3600.0, retry: str = "retry", block: str = "block"):
        self.seconds, self.retries, self.actions, self.blocks, self.window, self.retry, self.block = seconds, retries, actions, blocks, window, retry, block

    def __call__(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = start = opened = None
        retries = actions = blocks = 0
        tripped = False
        for pdf in parts:
            out = []
            for k, t, kind in zip(pdf["user_id"], pdf["ts"], pdf["event_type"], strict=True):
                if k != key:
                    key, start, opened, retries, actions, blocks, tripped = k, t, t, 0, 0, 0, False
                if tripped:
                    out.append("TRIPPED")
                    continue
                if (t - opened).total_seconds() > self.window:
                    opened, blocks = t, 0
                spent = {
                    "TIME_BUDGET": 0 < self.seconds < (t - start).total_seconds(), "RETRY_BUDGET": kind == self.retry and retries >= self.retries,
                    "ACTION_BUDGET": actions >= self.actions, "BLOCK_BUDGET": kind == self.block and blocks >= self.blocks,
                }
                outcome = next((name for name, over in spent.items() if over), "ALLOWED")
                tripped = outcome != "ALLOWED"
                retries, actions, blocks = retries + (kind == self.retry), actions + 1, blocks + (kind == self.block)
                out.append(outcome)
            yield pdf.assign(outcome=out)


def routed(requests: DataFrame, registry: list[dict], most: int = 1000) -> DataFrame:
    """requests with provider_id, model_id and cost of the first provider by (priority, provider, model) that may serve it, else nulls.

    requests: excluded and required (arrays of "provider/model" and of capabilities), input_tokens, output_tokens,
    most_cost (null: any), allow_degraded. registry: rows of PROVIDER, most of them at most, held in the plan; a price
    that is none or negative, an unknown health and a bucket with fewer tokens than asked refuse. Nothing is taken
    from a bucket by looking at it.
    """
    if len(registry) > most:
        raise ValueError(f"{len(registry)} providers; {most} at most")
    spark = requests.sparkSession
    rows = spark.createDataFrame([(registry,)], f"_registry array<{PROVIDER}>")
    asked = F.col("input_tokens") + F.col("output_tokens")
    cost = lambda p: F.col("input_tokens") * p["input_price"] + F.col("output_tokens") * p["output_price"]

    def fits(p):  # noqa: ANN001, ANN202
        healthy = (p["health"] == "HEALTHY") | ((p["health"] == "DEGRADED") & F.coalesce("allow_degraded", F.lit(False)))
        left = F.coalesce(p["tokens_left"] >= asked, F.lit(True))
        able = F.size(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.coalesce(p["capabilities"], F.array().cast("array<string>")))) == 0
        priced = (p["input_price"] >= 0) & (p["output_price"] >= 0) & (F.least(F.col("input_tokens"), F.col("output_tokens")) >= 0) & (F.col("most_cost").isNull() | (cost(p) <= F.col("most_cost")))
        out = F.coalesce(F.array_contains("excluded", F.concat_ws("/", p["provider_id"], p["model_id"])), F.lit(False))
        return F.coalesce(~out & healthy & ~F.coalesce(p["circuit_open"], F.lit(False)) & ~F.coalesce(p["cooling"], F.lit(False)) & left & able & priced, F.lit(False))

    ranked = lambda p: F.struct(p["priority"].alias("priority"), p["provider_id"].alias("provider_id"), p["model_id"].alias("model_id"), cost(p).alias("cost"))
    best = F.array_min(F.transform(F.filter("_registry", fits), ranked))
    return requests.join(F.broadcast(rows)).withColumn("_best", best).select(*requests.columns, "_best.provider_id", "_best.model_id", "_best.cost")  # one row joins all


def verified_targets(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """current (target_id, snapshot: struct of critical, high, policy; maybe a stream) with reasons and drift against the target's registered baseline.

    No target is INVALID_INPUT, no baseline MISSING_BASELINE. baselines: target_id, snapshot; one row a target.
    """
    known = baselines.select(F.col("target_id").alias("_target"), F.col("snapshot").alias("old"), F.lit(True).alias("_known"))
    both = current.withColumnRenamed("snapshot", "new").join(known, F.col("target_id") == F.col("_target"), "left")
    bad = F.when(F.coalesce("target_id", F.lit("")) == "", "INVALID_INPUT").when(F.col("_known").isNull(), "MISSING_BASELINE")
    own = drift(both)
    closed = own.withColumns({"drift": F.coalesce(bad, "drift"), "reasons": F.when(bad.isNotNull(), F.array(bad)).otherwise(F.col("reasons"))})
    return closed.drop("_target", "_known", "old").withColumnRenamed("new", "snapshot")


class Leases:
    """Who holds a lock: HELD with its fencing token, or REFUSED. An owner's own lease is renewed; one that ran out goes to whoever asks, with the next token.

    Rows are requests by an owner (event_type) for so many seconds (value).
    """

    def __call__(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = owner = until = None
        token = 0
        for pdf in parts:
            out = []
            for k, t, asks, seconds in zip(pdf["user_id"], pdf["ts"], pdf["event_type"], pdf["value"], strict=True):
                if k != key:
                    key, owner, until, token = k, None, None, 0
                free = until is None or t >= until
                if free or asks == owner:
                    token += free
                    owner, until = asks, t + pd.Timedelta(seconds=seconds)
                out.append(f"HELD {token}" if asks == owner else "REFUSED")
            yield pdf.assign(outcome=out)


def rebuilt_outbox(audit: DataFrame, outbox: DataFrame) -> DataFrame:
    """Events that audit entries ask for and the outbox (deduplication_key) lacks, under their first identity.

    audit: id, at, task_id, previous_state, new_state, lease_version. Of entries with one key the first by (at, id) counts.
    """
    old, new = F.col("previous_state"), F.col("new_state")
    kind = (
        F.when(old.isin("NONE", "PENDING") & (new == "QUEUED"), "created").when((old == "QUEUED") & (new == "RUNNING"), "assigned")
        .when((old == "RUNNING") & (new == "COMPLETED"), "completed").when(new.isin("FAILED", "FAILED_RETRYABLE"), "failure").otherwise("transition")
    )
    lease = F.col("lease_version").cast("string")
    key = F.concat_ws("_", F.lit("task"), F.col("_kind"), F.col("task_id").cast("string"), F.when(F.col("_kind") != "created", lease))
    wanted = audit.withColumn("_kind", kind).withColumn("deduplication_key", key)
    first = wanted.groupBy("deduplication_key").agg(F.min_by(F.struct("task_id", "previous_state", "new_state", "lease_version"), F.struct("at", "id")).alias("x"))
    lacking = first.join(outbox.select("deduplication_key"), "deduplication_key", "left_anti")
    change = F.concat_ws(">", "x.previous_state", "x.new_state")
    event = F.coalesce(*(F.when(change == k, F.lit(v)) for k, v in TASK_EVENTS.items()), F.concat(F.lit("TASK_"), F.col("x.new_state")))
    return lacking.select("deduplication_key", event.alias("event_type"), F.concat_ws("_", F.lit("evt"), F.col("x.task_id").cast("string"), F.col("x.lease_version").cast("string")).alias("event_id"), "x.*")
