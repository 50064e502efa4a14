"""Verdicts: whether what is proven of a value is enough for a sink, verdicts that are the same one, and proofs of properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.guards import BIT

#: Facts of type, the strongest first, and words that name kinds of sinks.
TYPES = ("INTEGER", "DIGITS_ONLY", "NUMERIC")
SQL, SHELL, HTML, PATH = ("SQL",), ("COMMAND", "EXEC", "SHELL"), ("XSS", "HTML"), ("FILE", "PATH", "LFI", "TRAVERSAL")
#: Properties whose breach is critical.
CRITICAL = ("ACCOUNT_TAKEOVER", "ROOT_ACCESS", "CLOUD_ADMIN", "TENANT_ESCAPE", "CODE_EXECUTION")


def _names(category: Column, words: tuple[str, ...]) -> Column:
    kind = F.upper(F.trim(F.coalesce(category, F.lit(""))))
    return F.greatest(*(F.contains(kind, F.lit(w)) for w in words), F.lit(False))


def compatibility(bits: Column, category: Column, context: Column) -> Column:
    """decision (COMPATIBLE or NOT_PROVEN) and fact, the one that decides it, or null.

    Facts (bits as in guards) of type are enough for a value in SQL, a shell argument and HTML, an escaped value for its own
    kind of sink and a normalised path for a file's. What is not listed is not proven. Nulls: no facts, no kind of sink,
    an unknown context, which counts as a plain value.
    """
    bits = F.coalesce(bits, F.lit(0))
    has = lambda f: bits.bitwiseAND(BIT[f]) > 0
    context = F.coalesce(context, F.lit("UNKNOWN"))
    kind = F.when(has(TYPES[0]), TYPES[0]).when(has(TYPES[1]), TYPES[1]).when(has(TYPES[2]), TYPES[2])
    answer = lambda fine, fact: F.struct(F.when(fine, "COMPATIBLE").otherwise("NOT_PROVEN").alias("decision"), fact.cast("string").alias("fact"))
    sql, shell, html = _names(category, SQL), _names(category, SHELL), _names(category, HTML)
    return (
        F.when(kind.isNotNull() & sql, answer(context.isin("SQL_VALUE", "UNKNOWN"), kind))
        .when(kind.isNotNull() & shell & context.isin("SHELL_ARGUMENT", "UNKNOWN"), answer(F.lit(True), kind))
        .when(kind.isNotNull() & ~shell & html, answer(F.lit(True), kind))
        .when(has("SHELL_ESCAPED"), answer(shell, F.lit("SHELL_ESCAPED")))
        .when(has("HTML_ESCAPED"), answer(html, F.lit("HTML_ESCAPED")))
        .when(has("PATH_NORMALIZED") & _names(category, PATH), answer(F.lit(True), F.lit("PATH_NORMALIZED")))
        .otherwise(answer(F.lit(False), F.lit(None)))
    )


#: What makes two verdicts the same one, in this order, after the file's path.
IDENTITY = ("function", "line", "sink_category", "var_version", "call_context", "branch")


def path_key(path: Column) -> Column:
    """A path with forward slashes, in lower case, without leading ./ parts."""
    return F.regexp_replace(F.lower(F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))), r"^(\./)+", "")


def correlation_key(sources: Column) -> Column:
    """The key of a verdict from its columns rule, file, those of IDENTITY, and status, and an array of its sources."""
    parts = [F.coalesce("rule", F.lit("")), path_key(F.col("file")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY), F.array_join(F.array_sort(sources), ","), F.coalesce("status", F.lit(""))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def correlated(verdicts: DataFrame) -> DataFrame:
    """correlation_id, primary, n, associated: verdicts with the same key, the one of most confidence, provenance and evidence first.

    verdicts: verdict_id, confidence, n_provenance, n_evidence, sources (array) and the columns of correlation_key(). Of a key
    only its best row and its count are kept on the way, so that a key of any size is one row for each task; ties go to the
    largest id. associated is n - 1. Repeated rows count again.
    """
    best = F.max(F.struct("confidence", "n_provenance", "n_evidence", "verdict_id"))
    groups = verdicts.withColumn("key", correlation_key(F.col("sources"))).groupBy("key").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    return groups.select(F.concat(F.lit("corr_"), F.substring("key", 1, 16)).alias("correlation_id"), F.col("best.verdict_id").alias("primary"), "n", (F.col("n") - 1).alias("associated"))


def proofs(findings: DataFrame) -> DataFrame:
    """property, resolution, severity, confidence of each property that findings (property, resolution, conflict, safe_control, missing) speak of.

    A conflict, or both a breach and a proven control, is CONFLICT; a breach VULNERABLE; a control SAFE; else UNKNOWN. A breach
    that lacks evidence is none. Nulls are false; findings without a property take no part.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    said = F.coalesce("resolution", F.lit("UNKNOWN"))
    clash = flag("conflict") | (said == "CONFLICT")
    safe = ~clash & ((said == "SAFE") | flag("safe_control"))
    breach = ~clash & ~safe & (said == "VULNERABLE") & ~flag("missing")
    by = findings.filter("property IS NOT NULL").groupBy("property").agg(F.bool_or(clash).alias("clash"), F.bool_or(safe).alias("safe"), F.bool_or(breach).alias("breach"))
    resolution = F.when(F.col("clash") | (F.col("breach") & F.col("safe")), "CONFLICT").when(F.col("breach"), "VULNERABLE").when(F.col("safe"), "SAFE").otherwise("UNKNOWN")
    by = by.select("property", resolution.alias("resolution"))
    severity = F.when(F.col("resolution") == "VULNERABLE", F.when(F.col("property").isin(*CRITICAL), "CRITICAL").otherwise("HIGH")).when(F.col("resolution") == "SAFE", "INFO").otherwise("UNKNOWN")
    return by.select("property", "resolution", severity.alias("severity"), F.when(F.col("resolution").isin("VULNERABLE", "SAFE"), "HIGH").otherwise("UNKNOWN").alias("confidence"))
