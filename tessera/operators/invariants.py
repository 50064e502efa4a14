"""Temporal invariants: patterns of two events with something between them, or nothing, all matched in one pass.

events: key, seq, event_id, action; seq orders the events of a key and ties go by event_id. A pattern offends where an event
of its second action follows one of its first with none of what clears it in between; the pair is told. Where a pattern asks
for something between, the pair is VULNERABLE with it and UNKNOWN without, else VULNERABLE. Each action that patterns name is
one running maximum of places, so a key is sorted once, whatever the number of patterns, and only places are kept.

Null keys and actions take no part. Repeated rows are events of their own. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    category: str
    severity: str
    cause: str
    first: str
    then: str
    clears: tuple[str, ...] = ()
    between: str | None = None


#: Categories, severities and causes, each with the events that show it.
TEMPORAL = (
    Pattern("REVOCATION_DRIFT_VIOLATION", "CRITICAL", "PRIVILEGE_REVOCATION_DRIFT", "REVOKE", "USE", ("CACHE_INVALIDATED", "PROOF", "GRANT")),
    Pattern("TOCTOU_VIOLATION", "HIGH", "NON_ATOMIC_CHECK_USE", "CHECK", "USE", ("LOCK", "TRANSACTION", "PROOF"), "CONCURRENT_MUTATION"),
    Pattern("STATE_DESYNC_VIOLATION", "HIGH", "SECURITY_STATE_DESYNCHRONIZATION", "CLIENT_STATE", "SERVER_STATE", ("PROOF",)),
    Pattern("CACHE_AUTHORIZATION_DRIFT", "HIGH", "CACHE_INVALIDATION_MISSING", "DB_MUTATION", "CACHE_READ", ("CACHE_INVALIDATED", "PROOF")),
    Pattern("WORKFLOW_BYPASS_VIOLATION", "CRITICAL", "REQUIRED_WORKFLOW_STEP_SKIPPED", "REQUEST", "PAY", ("APPROVE", "PROOF")),
    Pattern("RACE_CONDITION_REACHABILITY", "HIGH", "UNSYNCHRONIZED_SHARED_MUTATION", "SHARED_READ", "CONCURRENT_MUTATION", ("LOCK", "PROOF")),
    Pattern("TRANSACTIONAL_INVARIANT_FAILURE", "HIGH", "PARTIAL_FAIL_MISSING_ROLLBACK", "DEBIT", "CREDIT_FAIL", ("TRANSACTION", "PROOF")),
    Pattern("TEMPORAL_AUTHORIZATION_VIOLATION", "HIGH", "STALE_AUTHORIZATION_CONTEXT", "AUTH_ISSUED", "AUTH_USED", ("AUTH_CHECKED", "PROOF")),
    Pattern("CAPABILITY_LIFETIME_ABUSE", "HIGH", "REVOKED_CAPABILITY_REACTIVATED", "REVOKE", "ACTIVATE", ("GRANT", "PROOF")),
    Pattern("REPLAY_ATTACK_VIOLATION", "HIGH", "MISSING_SINGLE_USE_NONCE", "MUTATE", "MUTATE", ("NONCE", "PROOF")),
    Pattern("TEMPORAL_TENANT_ISOLATION_VIOLATION", "CRITICAL", "TENANT_CONTEXT_DRIFT", "TENANT_A", "TENANT_B", ("AUTH_CHECKED", "PROOF")),
    Pattern("STATE_MONOTONICITY_VIOLATION", "MEDIUM", "SECURITY_STATE_DEGRADATION", "STATE_RAISED", "STATE_LOWERED", ("PROOF",)),
)


def offences(events: DataFrame, patterns: tuple[Pattern, ...] = TEMPORAL) -> DataFrame:
    """key, category, severity, resolution, cause, first_event, then_event: a row for each pattern and offending second event."""
    names = sorted({a for p in patterns for a in (p.first, *p.clears, *([p.between] if p.between else []))})
    order = Window.partitionBy("key").orderBy("seq", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy("key").orderBy("seq", "event_id"))
    rows = events.filter("key IS NOT NULL AND action IS NOT NULL").select("key", "seq", "event_id", "action").withColumn("place", place)
    rows = rows.select("*", *(F.max(F.when(F.col("action") == a, F.struct("place", "event_id"))).over(order).alias(f"last_{a}") for a in names))
    found = []
    for p in patterns:
        at = F.col(f"last_{p.first}")
        live = (F.col("action") == p.then) & at.isNotNull()
        for c in p.clears:
            live &= F.coalesce(F.col(f"last_{c}.place") < at["place"], F.lit(True))
        sure = F.lit(True) if p.between is None else F.coalesce(F.col(f"last_{p.between}.place") > at["place"], F.lit(False))
        resolution = F.when(sure, "VULNERABLE").otherwise("UNKNOWN")
        severity = F.when(sure, p.severity).otherwise("UNKNOWN")
        found.append(F.when(live, F.struct(F.lit(p.category).alias("category"), severity.alias("severity"), resolution.alias("resolution"), F.lit(p.cause).alias("cause"), at["event_id"].alias("first_event"))))
    rows = rows.select("key", F.col("event_id").alias("then_event"), F.explode(F.array_compact(F.array(*found))).alias("o"))
    return rows.select("key", "o.category", "o.severity", "o.resolution", "o.cause", "o.first_event", "then_event")
