"""From evidence to release: what evidence is complete, which artifacts may go out, what mends a weakness, who gained rights.

Every rule is a column expression over one row; evidence, differences and dead
rules are one aggregation, combined before the shuffle. Unknown or missing
values never lead to an approval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.decisions import valid

#: The permission that follows from each admission.
PERMISSIONS = {"APPROVED": "PERMITTED", "BLOCKED": "PROHIBITED_BLOCKED", "REVIEW_REQUIRED": "PROHIBITED_REVIEW_REQUIRED", "UNKNOWN": "PROHIBITED_UNKNOWN"}
#: Words of a class that name its sink, in the order in which they are tried.
SINK_WORDS = {"SQL": ("SQL",), "COMMAND": ("COMMAND", "EXEC"), "HTML": ("XSS", "HTML"), "PATH": ("PATH", "TRAVERSAL", "FILE"), "CODE": ("CODE", "EVAL")}
#: Of each sink the pattern, its fix, other fixes and what is no fix.
FIXES = {
    "SQL": ("REM-SQL-01", "parameterized_query", ("prepared_statement", "sanitize_sql", "strict_numeric_conversion"), ("str", "trim", "escape_html")),
    "COMMAND": ("REM-CMD-01", "command_allowlist", ("shlex.quote", "safe_exec"), ("str", "trim", "sanitize_sql")),
    "HTML": ("REM-XSS-01", "context_aware_html_escape", ("framework_auto_escape", "csp_policy"), ("str", "trim", "sanitize_sql")),
    "PATH": ("REM-PATH-01", "safe_join", ("realpath_boundary_check", "basename"), ("string replacement only", "escape_html", "str")),
    "CODE": ("REM-CODE-01", "static_dispatch", ("strict_allowlist", "ast.literal_eval"), ("eval()", "exec()", "compile()", "str")),
}
NEEDS = {"CONFIRMED": "REQUIRED", "CANDIDATE": "RECOMMENDED", "BLOCKED": "BLOCKED"}
#: The rank of each privilege, and triggers that are known to raise it.
RANKS = {"ANONYMOUS": 0, "USER": 1, "VERIFIED_USER": 2, "TENANT_ADMIN": 3, "SERVICE_ACCOUNT": 3, "ORG_ADMIN": 4, "SYSTEM_OPERATOR": 5, "ROOT": 6, "CLOUD_ADMIN": 6}
TRIGGERS = ("IDOR", "AUTHZ", "JWT", "SSRF", "BYPASS", "SUDO", "TARE", "SLIP", "TRAVERSAL")
#: Words that show what a hash is for.
PASSWORDS, CREDENTIALS = ("password", "passwd", "pwd"), ("secret", "token", "auth")
CHECKSUMS, KEY_NAMES, REQUEST_INPUTS = ("filesize", "file_exists", "md5_file", "checksum", "etag"), ("cache", "key", "idx", "hash_id", "temp_id"), ("$_post", "$_get", "$_request", "pass")


def _named(column: Column, values: dict[str, object]) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in values.items()])


def _any_in(column: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words; a null text holds none."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(column, F.lit(w)) for w in words)), F.lit(False))


def evidence(clusters: DataFrame, findings: DataFrame, least: float = 0.75) -> DataFrame:
    """clusters (cluster_id, status) with missing, contradictions, completeness and evidence_valid.

    findings: cluster_id, vulnerability_class, sink_category, source_fact, sink_fact, confidence. A cluster contradicts
    itself by more than one class, more than one sink category, and by each confidence that is not from 0 to 1.
    """
    several = lambda c: (F.min(F.nullif(F.col(c), F.lit(""))) != F.max(F.nullif(F.col(c), F.lit("")))).cast("int")
    own = findings.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("source_fact").alias("_src"), F.count("sink_fact").alias("_snk"),
        (F.coalesce(several("vulnerability_class"), F.lit(0)) + F.coalesce(several("sink_category"), F.lit(0)) + F.count_if(~valid(F.col("confidence")))).alias("_bad"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    unknown = F.upper(F.coalesce("status", F.lit("UNKNOWN"))) == "UNKNOWN"
    lacks = ((unknown, "cluster_status_known"), (none("_n"), "findings"), (none("_src"), "source_fact"), (none("_snk"), "sink_fact"))
    both = clusters.join(own, "cluster_id", "left").withColumn("missing", F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in lacks))))
    both = both.withColumns({"contradictions": F.coalesce("_bad", F.lit(0)), "completeness": (len(lacks) - F.size("missing")) / len(lacks)})
    fine = (F.size("missing") == 0) & (F.col("contradictions") == 0) & (F.col("completeness") >= least)
    return both.withColumn("evidence_valid", fine).drop("_n", "_src", "_snk", "_bad")


def admission(rows: DataFrame, least_confidence: float = 0.80, allow_on: tuple[str, ...] = ("ALLOW",)) -> DataFrame:
    """rows with admission (APPROVED, REVIEW_REQUIRED, BLOCKED, UNKNOWN), the number of the rule that decided, and permission.

    rows: artifact_id, artifact_decision_id, decision_id, decision, confidence, evidence_valid, exploitability_valid,
    regression_status, remediation_status (null: no plan). The first rule that applies decides: 1 something is missing,
    2 the artifact is bound to another decision, 3 the score is none, 4 evidence, 5 and 6 the decision, 7 regression,
    8 remediation, 9 review, 10 the policy's threshold and states, 11 approved.
    """
    state = F.upper(F.coalesce("decision", F.lit("NONE")))
    regression, plan = F.upper("regression_status"), F.upper("remediation_status")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    ladder = [
        (F.col("artifact_id").isNull() | F.col("decision_id").isNull(), "UNKNOWN", 1), (~F.col("artifact_decision_id").eqNullSafe(F.col("decision_id")), "UNKNOWN", 2), (~valid(F.col("confidence")), "UNKNOWN", 3),
        (no("evidence_valid") | no("exploitability_valid"), "UNKNOWN", 4), (state == "UNKNOWN", "UNKNOWN", 5), (state == "BLOCK", "BLOCKED", 6),
        (regression == "FAIL", "BLOCKED", 7), (regression == "UNKNOWN", "UNKNOWN", 7), (plan == "BLOCKED", "BLOCKED", 8), (plan == "UNKNOWN", "UNKNOWN", 8),
        (state == "REVIEW", "REVIEW_REQUIRED", 9), ((F.col("confidence") < least_confidence) | ~state.isin(*allow_on), "BLOCKED", 10), (state == "ALLOW", "APPROVED", 11),
    ]
    made = F.coalesce(*(F.when(when, F.struct(F.lit(out).alias("admission"), F.lit(rule).alias("rule"))) for when, out, rule in ladder), F.struct(F.lit("UNKNOWN").alias("admission"), F.lit(0).alias("rule")))
    return rows.withColumn("_a", made).select(*rows.columns, "_a.admission", "_a.rule", permission(F.col("_a.admission")).alias("permission"))


def permission(admitted: Column) -> Column:
    """What an admission permits; null is no admission at all."""
    return F.when(admitted.isNull(), "PROHIBITED_INVALID_INPUT").otherwise(F.coalesce(_named(F.upper(admitted), PERMISSIONS), F.lit("PROHIBITED_INVALID_STATUS")))


def release_allowed(state: Column, target: Column, admitted: Column, evaluation: Column, last_evaluation: Column) -> Column:
    """Whether a release may go from state to target. An evaluated one goes once, to what its own admission says; the rest are ends.

    A target UNKNOWN is open to any admission; an evaluation id must be that of the evaluation, if it is known.
    """
    same = last_evaluation.isNull() | (last_evaluation == "") | evaluation.eqNullSafe(last_evaluation)
    goes = ~target.isin("APPROVED", "BLOCKED", "REVIEW_REQUIRED") | (F.upper(admitted) == target)
    out = F.when(target == "SECURITY_EVALUATED", state == "CREATED").when(state == "SECURITY_EVALUATED", admitted.isNotNull() & same & goes)
    return F.coalesce(out, F.lit(False))


def sink_category(weakness: Column) -> Column:
    """The sink that a class of weakness is about, by the words in its name, or UNKNOWN."""
    return F.coalesce(*(F.when(_any_in(F.upper(weakness), words), F.lit(k)) for k, words in SINK_WORDS.items()), F.lit("UNKNOWN"))


def remediation(clusters: DataFrame) -> DataFrame:
    """clusters (vulnerability_class, status) with pattern_id, remediation_status, primary_fix and alternative_fixes."""
    sink = sink_category(F.col("vulnerability_class"))
    of = lambda i: _named(sink, {k: v[i] for k, v in FIXES.items()})
    others = F.coalesce(*(F.when(sink == k, F.array(*map(F.lit, v[2]))) for k, v in FIXES.items()), F.array().cast("array<string>"))
    known = sink != "UNKNOWN"
    return clusters.withColumns({
        "pattern_id": F.coalesce(of(0), F.lit("REM-UNKNOWN")), "remediation_status": F.when(known, F.coalesce(_named(F.col("status"), NEEDS), F.lit("UNKNOWN"))).otherwise("UNKNOWN"),
        "primary_fix": F.coalesce(of(1), F.lit("manual_security_audit_required")), "alternative_fixes": others,
    })


def forbidden_fix(sink: Column, fix: Column) -> Column:
    """Whether a fix holds what is known to be no fix for this sink."""
    name = F.lower(F.trim(fix))
    return F.coalesce(*(F.when(F.upper(sink) == k, _any_in(name, v[3])) for k, v in FIXES.items()), F.lit(False))


def privilege_change(rows: DataFrame) -> DataFrame:
    """rows with category and resolution (SAFE, UNKNOWN, VULNERABLE) of a change of identity or privilege.

    rows: old_identity, old_privilege, new_identity, new_privilege, trigger, authorized, tenant_verified (booleans),
    old_tenant, new_tenant, credential. In order: allowed and level; unknown; another tenant; another identity of the
    same rank; a higher rank. What is left is safe.
    """
    before, after = _named(F.col("old_privilege"), RANKS), _named(F.col("new_privilege"), RANKS)
    authorized, scoped = F.coalesce("authorized", F.lit(False)), F.coalesce("tenant_verified", F.lit(True))
    admin = F.coalesce(F.col("credential"), F.lit("UNKNOWN")).eqNullSafe("UNKNOWN") & F.contains("new_privilege", F.lit("ADMIN")) & ~_any_in(F.upper("trigger"), TRIGGERS)
    level = before.eqNullSafe(after)  # two unknown privileges are level
    moved = (F.col("old_tenant") != "") & (F.col("new_tenant") != "") & (F.col("old_tenant") != F.col("new_tenant"))
    higher = F.coalesce(_named(F.col("new_privilege"), {"ROOT": "ROOT_ACCESS", "CLOUD_ADMIN": "CLOUD_ROLE_ESCALATION"}), F.lit("VERTICAL_PRIVILEGE_ESCALATION"))
    made = lambda category, resolution: F.struct(category.alias("category"), F.lit(resolution).alias("resolution"))
    plain = F.lit("VERTICAL_PRIVILEGE_ESCALATION")
    out = (
        F.when(authorized & scoped & level, made(plain, "SAFE")).when(before.isNull() | after.isNull() | admin, made(plain, "UNKNOWN"))
        .when(moved, made(F.lit("TENANT_BOUNDARY_ESCAPE"), "VULNERABLE"))
        .when(level & ~F.col("old_identity").eqNullSafe(F.col("new_identity")) & ~authorized, made(F.lit("HORIZONTAL_PRIVILEGE_ESCALATION"), "VULNERABLE"))
        .when((after > before) & ~authorized, made(higher, "VULNERABLE")).otherwise(made(plain, "SAFE"))
    )
    return rows.withColumn("_p", out).select(*rows.columns, "_p.category", "_p.resolution")


def hash_context(argument: Column, variable: Column, statements: Column) -> Column:
    """What a weak hash is used for: how it is used comes before how its variable is named; what is unclear stays UNKNOWN."""
    text, given, name = (F.lower(F.coalesce(c, F.lit(""))) for c in (statements, argument, variable))
    secret = _any_in(given, PASSWORDS + CREDENTIALS) | _any_in(text, PASSWORDS + CREDENTIALS)
    quoted = F.concat(F.lit(r"\$\w+\s*\[\s*(?:\Q"), F.replace(F.coalesce(variable, F.lit("")), F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E|md5|sha1|hash)\s*\]"))
    return (
        F.when(secret & (_any_in(given, PASSWORDS) | _any_in(text, PASSWORDS[:1])), "PASSWORD_HASH").when(secret, "SECURITY_TOKEN")
        .when(F.rlike(text, quoted) | _any_in(text, ("array_key_exists",)), "NON_SECURITY_IDENTIFIER").when(_any_in(text, CHECKSUMS), "CHECKSUM")
        .when(_any_in(name, KEY_NAMES) & ~_any_in(given, REQUEST_INPUTS), "CACHE_KEY").otherwise("UNKNOWN")
    )


def epistemic_change(before: Column, after: Column, validated: Column) -> Column:
    """Whether a verdict may change so: an open one becomes a settled one by validated evidence only."""
    settles = F.upper(before).isin("UNKNOWN", "CONFLICT") & F.upper(after).isin("SAFE", "VULNERABLE")
    return ~F.coalesce(settles, F.lit(False)) | F.coalesce(validated, F.lit(False))


def detector_difference(baseline: DataFrame, current: DataFrame, key: str = "fixture_id", by: tuple[str, ...] = ("rule_id", "property_name", "knowledge_pack", "severity")) -> DataFrame:
    """key, added, removed and status of each fixture that either detector has findings for; findings alike in all of by are one."""
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in by]
    side = lambda df, new: df.select(key, *named, F.lit(new).alias("_new"))
    each = side(baseline, False).unionByName(side(current, True)).groupBy(key, *by).agg(F.bool_or("_new").alias("_now"), F.bool_or(~F.col("_new")).alias("_was"))
    n = each.groupBy(key).agg(F.count_if(~F.col("_was")).alias("added"), F.count_if(~F.col("_now")).alias("removed"))
    a, r = F.col("added") > 0, F.col("removed") > 0
    return n.withColumn("status", F.when(a & r, "MISMATCH").when(a, "ADDED").when(r, "REMOVED").otherwise("EQUIVALENT"))


def dead_rules(rules: DataFrame) -> DataFrame:
    """rule_id and issues of the rules (rule_id, pattern, symbol_triggers, languages) that can fit nothing."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    idle = (F.coalesce("pattern", F.lit("")) == "") & empty("symbol_triggers")
    issues = F.array_compact(F.array(F.when(idle, F.lit("NO_CONDITION")), F.when(empty("languages"), F.lit("NO_LANGUAGE"))))
    return rules.select("rule_id", issues.alias("issues")).filter(F.size("issues") > 0)
