"""Findings as rows: order, duplicates, baselines, correlation into clusters, calibration.

A finding has finding_id, vulnerability_class, rule_key, severity, confidence and
status; correlation also reads flow_id, source_fact_id, sink_fact_id,
source_node_id, sink_node_id and call_context, calibration source_role,
sink_role, path_nodes and barrier. Nulls count as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import paths
from tessera.tables import cut_tidy, discard, tasks, tidy

#: The weight of each severity, and identities that stand for a missing one.
WEIGHTS = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
MISSING = ("missing_flow", "missing_source", "missing_node")
#: Keys are counted in so many buckets; of a bucket with more rows than HEAVY keys are grouped before they are joined.
BUCKETS, HEAVY = 4096, 1_000_000


def weight(severity: Column | str) -> Column:
    """The weight of a severity in any case; 0 for an unknown one or null."""
    s = F.upper(F.col(severity) if isinstance(severity, str) else severity)
    return F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in WEIGHTS.items()], F.lit(0))


def severity_of(w: Column) -> Column:
    return F.coalesce(*[F.when(w == v, F.lit(k)) for k, v in WEIGHTS.items()], F.lit("NONE"))


def by_severity(findings: DataFrame, *ties: str) -> DataFrame:
    """All findings, the most severe first; a sort over ranges of rows, not in one task."""
    return findings.orderBy(F.desc(weight("severity")), *ties)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(weight("severity") >= WEIGHTS[severity])


def strongest(findings: DataFrame, key: list[str]) -> DataFrame:
    """Of findings with equal keys the one of highest severity, confidence and rule, and how many there were."""
    rest = [c for c in findings.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(weight("severity"), "confidence", "rule_key", "finding_id"))
    return findings.groupBy(*key).agg(best.alias("x"), F.count(F.lit(1)).alias("n")).select(*key, "x.*", "n")


def compared(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """fingerprint and NEW, EXISTING, REGRESSED (more severe than it was) or FIXED; both have fingerprint and severity."""
    now = current.groupBy("fingerprint").agg(F.max(weight("severity")).alias("now"))
    was = baseline.groupBy("fingerprint").agg(F.max(weight("severity")).alias("was"))
    status = F.when(F.col("was").isNull(), "NEW").when(F.col("now").isNull(), "FIXED").when(F.col("now") > F.col("was"), "REGRESSED").otherwise("EXISTING")
    return now.join(was, "fingerprint", "full_outer").select("fingerprint", status.alias("status"))


def _evidence(findings: DataFrame) -> list[tuple[DataFrame, list[str]]]:
    """For each kind of evidence the findings that have it, and the columns that two of them must share.

    Kinds: the flow; source and sink fact; source and sink node; source fact and call context. All hold within a class.
    """
    kinds = [(["flow_id"], "flow_id"), (["source_fact_id", "sink_fact_id"], "source_fact_id"), (["source_node_id", "sink_node_id"], "source_node_id"), (["source_fact_id", "call_context"], None)]
    found = []
    for cols, guard in kinds:
        keys = ["vulnerability_class", *cols]
        own = findings.select("finding_id", *keys).dropna()
        found.append((own if guard is None else own.filter(~F.col(guard).isin(*MISSING)), keys))
    return found


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def _linked(own: DataFrame, keys: list[str], sizes: dict[int, int]) -> list[DataFrame]:
    """src, dst: each finding and the least one with the same keys; sizes has the rows of each bucket of keys.

    Rows are dealt by their keys once and sorted; keys of very many findings, which one task would have to sort, are
    grouped before they are joined.
    """
    heavy = [b for b, n in sizes.items() if n > HEAVY]
    light = own.filter(~_bucket(keys).isin(heavy)) if heavy else own
    first = F.first("finding_id").over(Window.partitionBy(*keys).orderBy("finding_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = light.repartition(tasks(own.sparkSession, sum(sizes.values())), *keys)
    parts = [dealt.select(first.alias("src"), F.col("finding_id").alias("dst")).filter("src <> dst")]
    if heavy:
        rest = own.filter(_bucket(keys).isin(heavy))
        least = rest.groupBy(*keys).agg(F.min("finding_id").alias("src"))
        parts.append(rest.join(least, keys).filter("finding_id <> src").select("src", F.col("finding_id").alias("dst")))
    return parts


def links(findings: DataFrame) -> list[DataFrame]:
    """src, dst: each finding and the least one that shares evidence of one kind with it; some tables for each kind.

    Each kind is an equality, so a finding is linked with the least of its group and not with every member.
    """
    kinds = _evidence(findings)
    marks = [own.select(F.lit(i).alias("kind"), _bucket(keys).alias("bucket")) for i, (own, keys) in enumerate(kinds)]
    sizes: list[dict[int, int]] = [{} for _ in kinds]
    with tidy(findings.sparkSession):
        for kind, bucket, n in reduce(DataFrame.unionByName, marks).groupBy("kind", "bucket").count().collect():
            sizes[kind][bucket] = n
    return [part for (own, keys), size in zip(kinds, sizes, strict=True) for part in _linked(own, keys, size)]


def clusters(findings: DataFrame) -> DataFrame:
    """findings with cluster_id, the least finding that links connect each with.

    Each kind of link is written before the next is looked for, so that one shuffle of all findings is on disk at a time.
    """
    kept = [cut_tidy(part) for part in links(findings)]
    near = reduce(DataFrame.unionByName, kept)
    # a finding that hangs on one link and that none hangs on has the cluster of its link and takes no part in the rounds
    ends = near.select(F.col("dst").alias("id"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(near.select(F.col("src").alias("id"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    inner = cut_tidy(ends.groupBy("id").agg(F.sum("ups").alias("ups"), F.sum("downs").alias("downs")).filter("ups > 1 OR (ups = 1 AND downs > 0)").select(F.col("id").alias("dst")))
    core = cut_tidy(near.join(inner, "dst", "left_semi").select("src", "dst").distinct())
    ids = core.select(F.col("src").alias("id")).unionByName(core.select(F.col("dst").alias("id"))).distinct()
    comp = paths.components(ids, core)
    leaves = near.join(inner, "dst", "left_anti").join(comp.withColumnRenamed("id", "src"), "src", "left").select(F.col("dst").alias("finding_id"), F.coalesce("comp", "src").alias("cluster_id"))
    known = cut_tidy(leaves.unionByName(comp.select(F.col("id").alias("finding_id"), F.col("comp").alias("cluster_id"))))
    for table in (*kept, inner, core, comp):
        discard(table)
    # findings without a link, and the least of those without another, are clusters of their own
    with tidy(findings.sparkSession):
        n = tasks(findings.sparkSession, findings.count())
    dealt = findings.filter("finding_id IS NOT NULL").repartition(n, "finding_id")
    return dealt.join(known.repartition(n, "finding_id"), "finding_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "finding_id"))


def _several(*columns: str) -> Column:
    """Whether the columns hold more than one value between them."""
    lo, hi = [F.min(c) for c in columns], [F.max(c) for c in columns]
    return (F.least(*lo) != F.greatest(*hi)) if len(columns) > 1 else lo[0] != hi[0]


def calibrated(findings: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Of each cluster: confidence, status, severity and diversity of its evidence.

    The highest confidence gains .10 for several sources, .10 for several sinks and .05 for several flows or rules;
    copies of a finding add nothing. Call contexts give .05 where several are known.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    is_ = lambda s: F.col("status") == s
    flows = findings.withColumn("_path", F.concat(F.lit("count:"), F.col("path_nodes").cast("string")))
    open_weight = F.max(F.when(~sure(is_("BLOCKED")), weight("severity")))
    grouped = flows.groupBy(key).agg(
        F.max("confidence").alias("base"),
        sure(_several("source_fact_id", "source_role")).alias("sources"), sure(_several("sink_fact_id", "sink_role")).alias("sinks"),
        sure(_several("call_context")).alias("contexts"), (sure(_several("flow_id", "_path")) | sure(_several("rule_key"))).alias("support"),
        F.bool_or(sure(is_("UNKNOWN"))).alias("unknown"), F.bool_or(sure(is_("BLOCKED"))).alias("blocked"), F.bool_and(sure(is_("BLOCKED"))).alias("all_blocked"), F.bool_or(sure(is_("CONFIRMED"))).alias("confirmed"),
        F.coalesce(open_weight, F.max(weight("severity"))).alias("w"),
        sum((F.max(F.col(c).isNotNull().cast("int")) for c in ("source_fact_id", "sink_fact_id", "flow_id", "call_context", "barrier", "rule_key")), F.lit(0)).alias("kinds"),
        F.count(F.lit(1)).alias("n"),
    )
    bonus = 0.10 * F.col("sources").cast("int") + 0.10 * F.col("sinks").cast("int") + 0.05 * F.col("contexts").cast("int") + 0.05 * F.col("support").cast("int")
    scored = grouped.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("base") + bonus, 4))))
    status = (
        F.when(F.col("unknown") & ~F.col("confirmed") & ~F.col("blocked"), "UNKNOWN")
        .when(F.col("all_blocked"), "BLOCKED")
        .when(F.col("confirmed") & (F.col("confidence") >= 0.85), "CONFIRMED")
        .when(F.col("confidence") >= 0.60, "CANDIDATE")
        .otherwise("UNKNOWN")
    )
    return scored.select(key, "confidence", status.alias("status"), severity_of(F.col("w")).alias("severity"), F.round(F.col("kinds") / 8, 4).alias("diversity"), "n")
