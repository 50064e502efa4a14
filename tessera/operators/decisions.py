"""Scores and decisions about clusters as column expressions; what is invalid fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How exploitable each class is, the score of each severity, weights of the scores.
EXPLOITABLE = {"CODE_INJECTION": 1.0, "COMMAND_INJECTION": 0.95, "SQL_INJECTION": 0.90, "XSS": 0.85, "PATH_TRAVERSAL": 0.80}
SEVERITY_SCORE = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2}
PRIORITY = {"severity_score": 0.25, "confidence": 0.25, "exploitability": 0.20, "exposure": 0.15, "impact": 0.15}
EXPLOITABILITY = {"controllability": 0.30, "reachability": 0.25, "attack_surface": 0.20}
#: Roots, capabilities and privileges that count more in a breach.
STRONG_ROOTS = ("SSRF", "SSTI", "COMMAND_INJECTION", "IDOR", "XXE")
STRONG_CAPABILITIES = ("ROOT_ACCESS", "CLOUD_ADMIN_ACCESS", "TENANT_WIPE")
BOUNDARY = ("TENANT_BOUNDARY_ESCAPE", "INTERNAL_NETWORK_ACCESS")
BREACH = {"exploitability": 0.20, "capability": 0.20, "privilege": 0.20, "business": 0.20, "boundary": 0.10, "certainty": 0.10}
#: Properties whose loss is critical to the business, or to the machines.
BUSINESS = ("PAYMENT_MODIFICATION", "TENANT_ESCAPE", "DATA_EXFILTRATION")
MACHINES = ("CLOUD_ADMIN", "ROOT_ACCESS", "CODE_EXECUTION")
#: The states that a gate knows.
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "BLOCKED", "UNKNOWN", "NONE")
REMEDIATIONS = ("REQUIRED", "RECOMMENDED", "OPTIONAL", "NONE", "BLOCKED", "UNKNOWN")
REGRESSED = ("FAIL", "PERSISTENT", "CHANGED")


def valid(*scores: Column) -> Column:
    """Whether all scores are numbers from 0 to 1."""
    out = F.lit(True)
    for x in scores:
        out = out & F.coalesce(~F.isnan(x) & (x >= 0) & (x <= 1), F.lit(False))
    return out


def looked_up(column: Column, values: dict[str, float], other: float) -> Column:
    return F.coalesce(*[F.when(F.upper(column) == k, F.lit(v)) for k, v in values.items()], F.lit(other))


def weighted(weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))


def prioritised(clusters: DataFrame, exposure: float | Column = 0.80, impact: float | Column = 0.80) -> DataFrame:
    """clusters (vulnerability_class, severity, confidence, status) with priority_score and priority."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    own = clusters.withColumns({"severity_score": looked_up(F.col("severity"), SEVERITY_SCORE, 0.0), "exploitability": looked_up(F.col("vulnerability_class"), EXPLOITABLE, 0.50), "exposure": lit(exposure), "impact": lit(impact)})
    fine = valid(*(F.col(c) for c in PRIORITY))
    own = own.withColumn("priority_score", F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted(PRIORITY)))).otherwise(0.0))
    s = F.col("priority_score")
    state = (
        F.when(~fine | F.coalesce(F.col("status") == "UNKNOWN", F.lit(True)), "UNKNOWN")
        .when(F.col("status") == "BLOCKED", "LOW")
        .when((F.upper("severity") == "CRITICAL") & (s >= 0.85), "CRITICAL")
        .when(s >= 0.75, "HIGH").when(s >= 0.50, "MEDIUM").when(s >= 0.25, "LOW").otherwise("UNKNOWN")
    )
    return own.withColumn("priority", state).drop("severity_score", "exploitability", "exposure", "impact")


def exploitability(rows: DataFrame) -> DataFrame:
    """rows (controllability, reachability, attack_surface, chain_complete, privilege) with score and assessed."""
    fine = valid(*(F.col(c) for c in (*EXPLOITABILITY, "privilege")))
    raw = weighted(EXPLOITABILITY) + F.lit(0.15) * F.when(F.col("chain_complete"), 1.0).otherwise(0.5) + F.lit(0.10) * (1 - F.col("privilege"))
    return rows.withColumns({"score": F.when(fine, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)).otherwise(0.0), "assessed": fine})


def threat_risk(rows: DataFrame, feed: DataFrame) -> DataFrame:
    """rows (vulnerability_class, confidence, criticality) with risk; feed: vulnerability_class, epss, in_the_wild.

    A class that the feed lacks has an epss of .20; no class at all is a risk of .85.
    """
    known = feed.select(F.upper("vulnerability_class").alias("_class"), "epss", "in_the_wild").dropDuplicates(["_class"])
    both = rows.join(known, F.upper(rows["vulnerability_class"]) == F.col("_class"), "left")
    raw = 0.40 * F.col("confidence") + 0.30 * F.col("criticality") + 0.20 * F.coalesce("epss", F.lit(0.20)) + F.when(F.col("in_the_wild"), 0.10).otherwise(0.0)
    risk = F.when(F.coalesce(F.col("vulnerability_class"), F.lit("")) == "", 0.85).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw, 4))))
    return both.withColumn("risk", risk).drop("_class", "epss", "in_the_wild")


def breach_risk(rows: DataFrame) -> DataFrame:
    """rows (roots, capabilities: arrays; privilege; business) with risk from 0 to 100 and its level."""
    any_of = lambda c, names: F.coalesce(F.arrays_overlap(F.col(c), F.array(*map(F.lit, names))), F.lit(False))
    own = rows.withColumn("_f", F.struct(
        F.when(any_of("roots", STRONG_ROOTS), 0.90).otherwise(0.70).alias("exploitability"),
        F.when(any_of("capabilities", STRONG_CAPABILITIES), 0.95).otherwise(0.75).alias("capability"),
        F.when(F.col("privilege").isin("ROOT", "CLOUD_ADMIN"), 1.0).when(F.col("privilege").isin("TENANT_ADMIN", "ORG_ADMIN"), 0.80).otherwise(0.40).alias("privilege"),
        F.coalesce("business", F.lit(0.0)).alias("business"),
        F.when(any_of("capabilities", BOUNDARY), 0.90).otherwise(0.50).alias("boundary"),
        F.lit(1.0).alias("certainty"),
    ))
    score = F.round(sum((F.col(f"_f.{c}") * F.lit(w) for c, w in BREACH.items()), F.lit(0.0)) * 100, 2)
    own = own.withColumn("risk", score).drop("_f")
    r = F.col("risk")
    return own.withColumn("level", F.when(r >= 80, "CRITICAL").when(r >= 60, "HIGH").when(r >= 40, "MEDIUM").when(r >= 20, "LOW").otherwise("INFO"))


def business_risk(rows: DataFrame) -> DataFrame:
    """rows (verdict, properties: array) with severity, remediation, blast_radius and business_risk."""
    has = lambda names: F.coalesce(F.arrays_overlap(F.col("properties"), F.array(*map(F.lit, names))), F.lit(False))
    v, critical = F.col("verdict"), has(("ROOT_ACCESS", "CLOUD_ADMIN"))
    radius = F.when(has(("TENANT_ESCAPE",)), "MULTI_TENANT").when(has(("CLOUD_ADMIN",)), "GLOBAL").otherwise("SERVICE")
    wide = F.col("blast_radius") != "SERVICE"
    severity = F.when(v == "VULNERABLE", F.when(critical, "CRITICAL").otherwise("HIGH")).when(v == "SAFE", "LOW").when(v == "CONFLICT", "MEDIUM").otherwise("UNKNOWN")
    remedy = F.when(v == "VULNERABLE", F.when(critical, "P0").otherwise("P1")).when(v == "SAFE", "P4").when(v == "CONFLICT", "P2").otherwise("P3")
    risk = (
        F.when(v == "SAFE", "LOW").when(F.coalesce(v != "VULNERABLE", F.lit(True)), "UNKNOWN")
        .when(has(BUSINESS) & wide, "CRITICAL").when(has(BUSINESS), "HIGH")
        .when(wide, "HIGH").otherwise("MEDIUM")
    )
    return rows.withColumns({"severity": severity, "remediation": remedy, "blast_radius": radius}).withColumn("business_risk", risk)


def gate(rows: DataFrame) -> DataFrame:
    """rows with decision (ALLOW, REVIEW, BLOCK, UNKNOWN) and failed_rule, the number of the rule that decided against it.

    Ten rules in the order 1-5, 9, 6, 7, 8, 10: valid policy, evidence and exploitability; known states upstream; no
    regression; nothing blocked upstream; confirmed critical; confirmed high; recommended remediation; least confidence.
    Columns: policy_valid, evidence_valid, exploitability_valid, priority, remediation, regression_status,
    regression_change, cluster_status, block_unknown, confidence, minimum_confidence.
    """
    up = lambda c, other: F.upper(F.coalesce(F.col(c), F.lit(other)))
    p, r = up("priority", "UNKNOWN"), up("remediation", "UNKNOWN")
    bad = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    unknown = ~p.isin(*PRIORITIES) | ~r.isin(*REMEDIATIONS) | (p == "UNKNOWN") | (r == "UNKNOWN") | (up("regression_status", "NOT_TESTED") == "UNKNOWN")
    blocked = (p == "BLOCKED") | (r == "BLOCKED") | (up("cluster_status", "") == "BLOCKED")
    low = F.coalesce(F.col("confidence"), F.lit(1.0)) < F.col("minimum_confidence")
    ladder = [
        (bad("policy_valid"), "UNKNOWN", 1), (bad("evidence_valid"), "UNKNOWN", 2), (bad("exploitability_valid"), "UNKNOWN", 3), (unknown, "UNKNOWN", 4),
        (up("regression_change", "UNKNOWN").isin(*REGRESSED), "BLOCK", 5), (blocked, "BLOCK", 9),
        ((p == "CRITICAL") & (r == "REQUIRED") & F.coalesce(F.col("block_unknown"), F.lit(True)), "BLOCK", 6), ((p == "CRITICAL") & (r == "REQUIRED"), "REVIEW", 6),
        ((p == "HIGH") & (r == "REQUIRED"), "REVIEW", 7), (r == "RECOMMENDED", "REVIEW", None), (low, "REVIEW", 10),
    ]
    made = F.struct(F.lit("ALLOW").alias("decision"), F.lit(None).cast("int").alias("failed_rule"))
    for when, decision, rule in reversed(ladder):
        made = F.when(when, F.struct(F.lit(decision).alias("decision"), F.lit(rule).cast("int").alias("failed_rule"))).otherwise(made)
    return rows.withColumn("_g", made).select(*rows.columns, "_g.decision", "_g.failed_rule")


def drift(pairs: DataFrame) -> DataFrame:
    """pairs of snapshots (old, new: structs of critical, high and policy, or null) with reasons and drift."""
    missing = F.col("old").isNull() | F.col("new").isNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("new.critical") > F.col("old.critical"), "CRITICAL_DRIFT"),
        F.when(F.col("new.high") > F.col("old.high"), "HIGH_DRIFT"),
        F.when(~F.col("new.policy").eqNullSafe(F.col("old.policy")), "POLICY_DRIFT"),
    ))
    own = pairs.withColumn("reasons", F.when(missing, F.array(F.lit("MISSING"))).otherwise(reasons))
    kind = F.when(missing, "INVALID_SNAPSHOT_INPUT").when(F.size("reasons") == 0, "NO_DRIFT").when(F.array_contains("reasons", "CRITICAL_DRIFT"), "CRITICAL_DRIFT").otherwise("POSTURE_DRIFT")
    return own.withColumn("drift", kind)
