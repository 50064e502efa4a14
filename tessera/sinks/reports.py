"""Findings and graphs as documents for other tools: SARIF, JSON lines, Prometheus text, DOT, Mermaid."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of SARIF: the level and the score of each severity.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SCORES = {"CRITICAL": 9.5, "HIGH": 8.0, "MEDIUM": 5.0, "LOW": 3.0, "INFO": 1.0}


def _of(values: dict, other: object) -> Column:
    return F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in values.items()], F.lit(other))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_id, index and rule (JSON): rules in the order in which they first appear; the first finding describes its rule.

    The rules of a scan are few; their numbers come from one sort of them.
    """
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("message", "severity"), "id").alias("x"), F.min("id").alias("first"))
    own = first.select("rule_id", "first", "x.message", "x.severity")
    body = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("message").alias("text")).alias("shortDescription"), F.struct(F.format_number(_of(SCORES, 5.0), 1).alias("security-severity")).alias("properties"))
    numbered = own.selectExpr("*", "CAST(row_number() OVER (ORDER BY first, rule_id) - 1 AS INT) AS index")
    return numbered.select("rule_id", "index", F.to_json(body).alias("rule"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result a row, as JSON; findings: id, rule_id, severity, message, and file_path and line if they have a place.

    Results stay rows, so that a run of any size can be written in parts.
    """
    rules = sarif_rules(findings).select("rule_id", F.col("index").alias("ruleIndex"))
    fields = [F.col("rule_id").alias("ruleId"), F.col("ruleIndex"), _of(LEVELS, "warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message")]
    if {"file_path", "line"} <= set(findings.columns):
        uri = F.struct(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("uri"))
        place = F.struct(F.struct(uri.alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
        fields.append(F.array(place).alias("locations"))
    return findings.join(rules, "rule_id").select("id", F.to_json(F.struct(*fields)).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str, version: str) -> None:
    """A folder with parts that make one document when put one after another in order of name: head, rules, results, tail."""
    spark = findings.sparkSession
    comma = lambda df, order: df.selectExpr(order, "text", f"row_number() OVER (ORDER BY {order}) AS k").selectExpr(order, "IF(k = 1, text, ',' || text) AS value").orderBy(order).select("value")
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"version":' + json.dumps(version) + ',"rules":['
    rules = comma(sarif_rules(findings).select("index", F.col("rule").alias("text")), "index")
    # the first result has no comma before it, which needs its id only
    first = findings.agg(F.min("id")).first()[0]
    results = sarif_results(findings).orderBy("id").select(F.when(F.col("id") == F.lit(first), F.col("result")).otherwise(F.concat(F.lit(","), F.col("result"))).alias("value"))
    one = lambda text: spark.createDataFrame([(text,)], "value string")
    for name, df in (("0-head", one(head)), ("1-rules", rules), ("2-between", one(']}},"results":[')), ("3-results", results), ("4-tail", one("]}]}"))):
        df.write.text(f"{path}/{name}")


def json_lines(findings: DataFrame) -> DataFrame:
    """Each row as JSON with its fields in order of name."""
    return findings.select(F.to_json(F.struct(*sorted(findings.columns)), {"ignoreNullFields": "false"}).alias("value"))


def _label(column: str) -> Column:
    """A value between quotes in Prometheus text, DOT or Mermaid."""
    return F.replace(F.replace(F.replace(F.col(column).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus(samples: DataFrame, kind: str = "histogram", most_labels: int = 1000) -> DataFrame:
    """Lines of each metric and label: count and sum of a histogram, the sum of a counter, the last value of a gauge (by column at).

    samples: metric, label, value. More labels than most_labels for a metric are refused.
    """
    wide = samples.groupBy("metric").agg(F.approx_count_distinct("label").alias("n")).filter(F.col("n") > most_labels * 1.2).limit(1).collect()
    if wide:
        raise ValueError(f"metric {wide[0]['metric']} has some {wide[0]['n']} labels")
    if kind == "gauge":
        last = samples.groupBy("metric", "label").agg(F.max_by("value", "at").alias("s"))
        return last.select(F.format_string('%s{label="%s"} %.2f', F.col("metric"), _label("label"), F.col("s")).alias("line"))
    sums = samples.groupBy("metric", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("s"))
    if kind == "counter":
        return sums.select(F.format_string('%s_total{label="%s"} %.2f', F.col("metric"), _label("label"), F.col("s")).alias("line"))
    count = F.format_string('%s_count{label="%s"} %d', F.col("metric"), _label("label"), F.col("n"))
    return sums.select(F.explode(F.array(count, F.format_string('%s_sum{label="%s"} %.2f', F.col("metric"), _label("label"), F.col("s")))).alias("line"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """A line of DOT for each edge: src, dst, edge_type."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', _label("src"), _label("dst"), _label("edge_type")).alias("line"))


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """A line of Mermaid for each edge; ids keep letters, digits and underscores, the label its text without quotes."""
    safe = lambda c: F.regexp_replace(F.col(c).cast("string"), "[^A-Za-z0-9_]", "_")
    return edges.select(F.format_string('  %s["%s"] -->|%s| %s["%s"]', safe("src"), F.replace("src", F.lit('"'), F.lit("'")), safe("edge_type"), safe("dst"), F.replace("dst", F.lit('"'), F.lit("'"))).alias("line"))
