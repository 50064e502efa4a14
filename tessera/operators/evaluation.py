"""Measures of detectors from outcomes: strict and epistemic rates, intervals, matrices, mutation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided interval of 95 %.
Z = 1.959963984540054


def rate(k: Column, n: Column, empty: float) -> Column:
    return F.when(n > 0, k / n).otherwise(F.lit(empty))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the share k / n; 0 and 1 where n is 0."""
    p, m = k / n, n.cast("double")
    middle = (p + Z * Z / (2 * m)) / (1 + Z * Z / m)
    margin = F.lit(Z) / (1 + Z * Z / m) * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - margin)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), middle + margin)).otherwise(1.0)


def _counts() -> list[Column]:
    names = ("TP", "FP", "TN", "FN", "FN_EPISTEMIC", "UNCERTAIN_TN")
    return [F.count_if(F.col("outcome") == x).alias(x.lower()) for x in names]


def measures(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of outcomes (outcome, engine_verdict) by groups; a rate over nothing is 1, as nothing was missed.

    Precision: tp of tp + fp. Recall: tp of tp, fn and epistemic fn; the epistemic recall counts the latter as found.
    """
    verdicts = [F.count_if(F.col("engine_verdict") == x).alias(x.lower()) for x in ("UNKNOWN", "CONFLICT")]
    c = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *_counts(), *verdicts)
    hit, bad = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn") + F.col("fn_epistemic")
    c = c.withColumns({"precision_": rate(F.col("tp"), hit, 1.0), "recall_": rate(F.col("tp"), bad, 1.0), "epistemic_recall": rate(F.col("tp") + F.col("fn_epistemic"), bad, 1.0)})
    both = F.col("precision_") + F.col("recall_")
    low, high = wilson(F.col("tp"), bad)
    return c.withColumns({"f1": F.when(both > 0, 2 * F.col("precision_") * F.col("recall_") / both).otherwise(0.0), "uncertainty": rate(F.col("unknown") + F.col("conflict"), F.col("n"), 0.0), "recall_low": F.when(bad > 0, low).otherwise(1.0), "recall_high": F.when(bad > 0, high).otherwise(1.0)})


def verdict(m: DataFrame) -> DataFrame:
    """measures() with the gate's verdict: too few cases, passed, or passed with known gaps."""
    fine = (F.col("precision_") >= 0.90) & (F.col("recall_") >= 0.90)
    return m.withColumn("verdict", F.when((F.col("n") > 0) & (F.col("n") < 5), "EXTERNAL_VALIDITY_INSUFFICIENT").when((F.col("n") > 0) & fine, "PASS").otherwise("PASS_WITH_KNOWN_GAPS"))


def recall_matrix(outcomes: DataFrame, row: str, column: str) -> DataFrame:
    """Strict recall of each pair, to 4 digits; 1 where there was nothing to find."""
    bad = F.count_if(F.col("outcome").isin("TP", "FN", "FN_EPISTEMIC"))
    return outcomes.groupBy(row, column).agg(F.round(rate(F.count_if(F.col("outcome") == "TP"), bad, 1.0), 4).alias("recall_"))


def independent(cases: DataFrame, predictions: DataFrame, *by: str) -> DataFrame:
    """Predicted against expected states (case_id, expected; case_id, predicted); only predicted cases count.

    An unknown for a vulnerable case is a miss; other disagreements count in no rate but that of correct decisions.
    """
    both = predictions.join(cases, "case_id").withColumn("predicted", F.coalesce("predicted", F.lit("UNKNOWN")))
    e, p = F.col("expected"), F.col("predicted")
    n = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if((e == p) & (e == "VULNERABLE")).alias("tp"), F.count_if((e == p) & (e == "SAFE")).alias("tn"), F.count_if((e == "SAFE") & (p == "VULNERABLE")).alias("fp"), F.count_if((e == "VULNERABLE") & p.isin("SAFE", "UNKNOWN")).alias("fn"), F.count_if((e == p) & e.isin("VULNERABLE", "SAFE", "UNKNOWN", "CONFLICT")).alias("correct"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return n.withColumns({"precision_": rate(tp, tp + fp, 1.0), "recall_": rate(tp, tp + fn, 1.0), "fpr": rate(fp, fp + tn, 0.0), "fnr": rate(fn, fn + tp, 0.0), "specificity": rate(tn, tn + fp, 1.0), "decision_correctness": rate(F.col("correct"), F.col("n"), 0.0)})


def mutation_score(mutants: DataFrame, *by: str) -> DataFrame:
    """Killed mutants of those killed or survived; invalid and inconclusive ones count for nothing."""
    n = mutants.groupBy(*by).agg(*(F.count_if(F.col("status") == x).alias(x.lower()) for x in ("KILLED", "SURVIVED")))
    return n.withColumn("score", rate(F.col("killed"), F.col("killed") + F.col("survived"), 0.0))


def regression(baseline: DataFrame, candidate: DataFrame, key: str, precision_drop: float = 0.0, recall_drop: float = 0.0) -> DataFrame:
    """Changes of measures() between two runs, and whether they are acceptable."""
    names = ("precision_", "recall_", "epistemic_recall", "f1", "uncertainty")
    both = baseline.select(key, *(F.col(c).alias(f"was_{c}") for c in names)).join(candidate.select(key, *names), key)
    out = both.select(key, *((F.col(c) - F.col(f"was_{c}")).alias(f"{c}_delta") for c in names))
    return out.withColumn("acceptable", (F.col("precision__delta") >= -precision_drop) & (F.col("recall__delta") >= -recall_drop))


#: Fixed value: lines that a finding may be away from its case.
WINDOW = 3


def matched_cases(cases: DataFrame, findings: DataFrame, window: int = WINDOW) -> DataFrame:
    """case_id, finding_id of the first finding (by place, then id) that fits each case; null if none does.

    cases: case_id, file, line, rule. findings: finding_id, place, file, line, rule, correlated (an array of rules or null).
    Files are equal; rules are equal, or one is empty or null, or the case's is among the finding's correlated ones; lines are
    at most window apart, or one is null. Files are compared as they are: bring paths to one form first.

    Lines are dealt to buckets of the window's width, and a case looks into three of them. Of the findings of a rule on one
    line, or of a rule in one file where lines don't count, only the first goes on, so no case meets more than some rows.
    """
    any_rule, width = "\x00", window + 1
    text = lambda c: F.coalesce(c, F.lit(""))
    keys = F.array_distinct(F.concat(F.array(text(F.col("rule")), F.lit(any_rule)), F.coalesce("correlated", F.array().cast("array<string>"))))
    own = findings.filter("finding_id IS NOT NULL").select("file", F.col("line").cast("long").alias("line"), F.struct("place", "finding_id").alias("first"), F.explode(keys).alias("key"))
    rows = own.groupBy("file", "key", "line").agg(F.min("first").alias("first"))
    near = rows.filter("line IS NOT NULL").select("file", "key", F.floor(F.col("line") / width).alias("bucket"), "line", "first")
    wild = rows.filter("line IS NULL").select("file", "key", "first")
    every = rows.groupBy("file", "key").agg(F.min("first").alias("first"))
    asked = cases.select("case_id", "file", F.col("line").cast("long").alias("at"), F.explode(F.when(text(F.col("rule")) == "", F.array(F.lit(any_rule))).otherwise(F.array(F.col("rule"), F.lit("")))).alias("key"))
    b = F.floor(F.col("at") / width)
    close = asked.filter("at IS NOT NULL").withColumn("bucket", F.explode(F.array(b - 1, b, b + 1))).join(near, ["file", "key", "bucket"]).filter(F.abs(F.col("line") - F.col("at")) <= window)
    hits = close.select("case_id", "first").unionByName(asked.filter("at IS NOT NULL").join(wild, ["file", "key"]).select("case_id", "first")).unionByName(asked.filter("at IS NULL").join(every, ["file", "key"]).select("case_id", "first"))
    best = hits.groupBy("case_id").agg(F.min("first").alias("first"))
    return cases.select("case_id").join(best, "case_id", "left").select("case_id", F.col("first.finding_id").alias("finding_id"))
