"""Edge cases of evidence, admission, privileges, SSA, tasks, routing and kept graphs on hand-made rows."""

import json
import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import admission as ad
from tessera.operators import ssa
from tessera.sinks import graphs
from tessera.sources import rules
from tessera.streaming import workers

FINDINGS = "cluster_id string, vulnerability_class string, sink_category string, source_fact string, sink_fact string, confidence double"


def test_evidence(spark):
    clusters = spark.createDataFrame([("ok", "CONFIRMED"), ("bare", "CONFIRMED"), ("odd", None), ("two", "BLOCKED"), ("nan", "CONFIRMED")], "cluster_id string, status string")
    rows = [("ok", "XSS", "HTML", "s", None, 0.5), ("ok", None, "", None, "k", 1.0), ("odd", "XSS", None, "s", "k", 0.0), ("two", "XSS", "HTML", "s", "k", 0.1), ("two", "SQL", "SQL", "s", "k", 1.1), ("nan", "XSS", "HTML", "s", "k", math.nan), ("nan", "XSS", "HTML", "s", "k", None)]
    got = {r["cluster_id"]: (r["missing"], r["contradictions"], r["completeness"], r["evidence_valid"]) for r in ad.evidence(clusters, spark.createDataFrame(rows, FINDINGS)).collect()}
    assert got == {
        "ok": ([], 0, 1.0, True), "bare": (["findings", "source_fact", "sink_fact"], 0, 0.25, False), "odd": (["cluster_status_known"], 0, 0.75, False), "two": ([], 3, 1.0, False), "nan": ([], 2, 1.0, False),
    }
    assert ad.evidence(clusters, spark.createDataFrame([], FINDINGS)).filter("evidence_valid").isEmpty()


def test_admission_fails_closed(spark):
    fine = ("a", "d", "d", "ALLOW", 0.9, True, True, None, None)
    schema = "artifact_id string, artifact_decision_id string, decision_id string, decision string, confidence double, evidence_valid boolean, exploitability_valid boolean, regression_status string, remediation_status string"
    change = {"artifact_id": None, "artifact_decision_id": None, "decision": None, "confidence": math.nan, "evidence_valid": None, "exploitability_valid": None, "regression_status": "unknown", "remediation_status": "REQUIRED"}
    names = [x.split()[0] for x in schema.split(", ")]
    rows = [fine, tuple([None] * 9), *(tuple(v if n == name else x for n, x in zip(names, fine, strict=True)) for name, v in change.items())]
    got = [(r["admission"], r["rule"], r["permission"]) for r in ad.admission(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    no = "PROHIBITED_UNKNOWN"
    assert got[:2] == [("APPROVED", 11, "PERMITTED"), ("UNKNOWN", 1, no)]
    assert [x[:2] for x in got[2:]] == [("UNKNOWN", 1), ("UNKNOWN", 2), ("BLOCKED", 10), ("UNKNOWN", 3), ("UNKNOWN", 4), ("UNKNOWN", 4), ("UNKNOWN", 7), ("APPROVED", 11)]
    odd = spark.range(1).select(ad.permission(F.lit(None).cast("string")).alias("a"), ad.permission(F.lit("maybe")).alias("b")).first()
    assert tuple(odd) == ("PROHIBITED_INVALID_INPUT", "PROHIBITED_INVALID_STATUS")


@pytest.mark.parametrize(
    ("state", "target", "admitted", "evaluation", "last", "want"),
    [
        ("CREATED", "SECURITY_EVALUATED", None, None, None, True), ("BLOCKED", "SECURITY_EVALUATED", "APPROVED", "e", "e", False), ("SECURITY_EVALUATED", "APPROVED", "APPROVED", "e", "e", True),
        ("SECURITY_EVALUATED", "APPROVED", "APPROVED", "old", "e", False), ("SECURITY_EVALUATED", "APPROVED", "BLOCKED", "e", "e", False), ("SECURITY_EVALUATED", "APPROVED", None, "e", "e", False),
        ("BLOCKED", "APPROVED", "APPROVED", "e", "e", False), ("SECURITY_EVALUATED", "UNKNOWN", "BLOCKED", "e", None, True), (None, "APPROVED", "APPROVED", "e", "e", False),
    ],
)
def test_release(spark, state, target, admitted, evaluation, last, want):
    cols = [F.lit(x).cast("string") for x in (state, target, admitted, evaluation, last)]
    assert spark.range(1).select(ad.release_allowed(*cols)).first()[0] is want


def test_fixes_and_dead_rules(spark):
    r = spark.range(1)
    ask = lambda *pairs: list(r.select(*(ad.forbidden_fix(F.lit(a).cast("string"), F.lit(b).cast("string")).alias(str(i)) for i, (a, b) in enumerate(pairs))).first())
    assert ask(("SQL", " STR() "), ("sql", "prepared_statement"), ("CODE", "eval(x)"), ("CODE", "eval()"), ("UNKNOWN", "str"), ("SQL", None), (None, "str")) == [True, False, False, True, False, False, False]
    rules = spark.createDataFrame([("a", "x", None, ["py"]), ("b", "", [], ["py"]), ("c", None, ["f"], None), ("d", None, None, [])], "rule_id string, pattern string, symbol_triggers array<string>, languages array<string>")
    assert {x["rule_id"]: x["issues"] for x in ad.dead_rules(rules).collect()} == {"b": ["NO_CONDITION"], "c": ["NO_LANGUAGE"], "d": ["NO_CONDITION", "NO_LANGUAGE"]}


def test_hash_context_takes_a_name_as_it_is(spark):
    cases = [("x", "a.b", "$t[ a.b ]"), ("x", "a.b", "$t[aXb]"), ("x", "q\\E", "$t[q]"), (None, None, None), ("x", "cache", ""), ("$_POST[k]", "cache", ""), ("x", "y", "secret"), ("pwd", "y", "")]
    df = spark.createDataFrame(cases, "a string, v string, s string").coalesce(1)
    want = ["NON_SECURITY_IDENTIFIER", "UNKNOWN", "UNKNOWN", "UNKNOWN", "CACHE_KEY", "UNKNOWN", "SECURITY_TOKEN", "PASSWORD_HASH"]
    assert [r[0] for r in df.select(ad.hash_context(F.col("a"), F.col("v"), F.col("s"))).collect()] == want


def test_ssa_against_paths(spark):
    """Each use sees one version, and that version stands for every definition which some path leads to it."""
    rng = random.Random(5)
    cfg, defs = [], []
    for fn in range(12):
        n = rng.randint(2, 8)
        cfg += [(fn, a, b) for a in range(n) for b in range(n) if b > 0 and (b == a + 1 or rng.random() < 0.15)]
        defs += [(fn, a, v) for a in range(n) for v in "xy" if rng.random() < 0.4]
    edges, own = spark.createDataFrame(cfg, "fn long, src long, dst long"), spark.createDataFrame(defs, "fn long, node long, var string")
    nodes = edges.selectExpr("fn", "explode(array(src, dst)) AS node").distinct().withColumn("var", F.explode(F.array(F.lit("x"), F.lit("y"))))
    versions, reached = ssa.converted(edges, own)
    uses = {(r["fn"], r["node"], r["var"]): r["version"] for r in ssa.used(versions, reached, nodes).collect()}
    at = {(r["fn"], r["var"], r["version"]): (r["node"], r["phi"]) for r in versions.collect()}
    ins = {}
    for r in reached.collect():
        ins.setdefault((r["fn"], r["node"], r["var"]), set()).add(r["version"])

    def meant(fn, var, version, seen=frozenset()):
        if version == 0 or version in seen:
            return set()
        node, phi = at[fn, var, version]
        return set().union(*(meant(fn, var, v, seen | {version}) for v in ins[fn, node, var])) if phi else {node}

    has, into = set(defs), {}
    for fn, a, b in cfg:
        into.setdefault((fn, b), set()).add(a)
    for (fn, node, var), version in uses.items():
        found, seen, todo = set(), set(), list(into.get((fn, node), ()))
        while todo:
            p = todo.pop()
            if (fn, p, var) in has:
                found.add(p)
            elif p not in seen:
                seen.add(p)
                todo.extend(into.get((fn, p), ()))
        assert meant(fn, var, version) == found


def test_joins_of_abstract_values(spark):
    rows = [(1, "TAINTED", ["INTEGER"]), (1, "SANITIZED", ["INTEGER", "NUMERIC"]), (2, "SANITIZED", []), (2, "UNTAINTED", ["INTEGER"]), (3, "CONSTRAINED", ["NUMERIC"]), (3, "CONSTRAINED", ["NUMERIC"]), (4, None, None), (4, "UNTAINTED", ["NUMERIC"])]
    df = spark.createDataFrame(rows, "k long, s string, f array<string>")
    got = {r["k"]: (r["s"], r["f"]) for r in df.groupBy("k").agg(ssa.joined_taint(F.col("s")).alias("s"), ssa.joined_facts(F.col("f")).alias("f")).collect()}
    assert got == {1: ("TAINTED", ["INTEGER"]), 2: ("UNKNOWN", []), 3: ("CONSTRAINED", ["NUMERIC"]), 4: ("UNKNOWN", [])}
    assert spark.range(1).select(ssa.guarded(F.lit("TAINTED"), F.array(F.lit("INTEGER")))).first()[0] == "CONSTRAINED"


def _fold(fold, rows):
    start = datetime(2024, 1, 1)
    df = pd.DataFrame([(u, start + timedelta(seconds=s), k, v) for u, s, k, v in rows], columns=["user_id", "ts", "event_type", "value"])
    halves = [df.iloc[:3], df.iloc[3:]]  # keys go on from batch to batch
    return list(pd.concat(fold(iter(halves)))["outcome"])


def test_tasks():
    steps = [("QUEUED", 1), ("RUNNING", 1), ("QUEUED", 1), ("COMPLETED", 1), ("RUNNING", 2), ("COMPLETED", 2), ("QUEUED", 2)]
    got = _fold(workers.Tasks(), [(1, i, k, v) for i, (k, v) in enumerate(steps)] + [(2, 0, "RUNNING", 1)])
    assert got == ["APPLIED QUEUED 1 0", "APPLIED RUNNING 1 1", "APPLIED QUEUED 2 1", "STALE_LEASE QUEUED 2 1", "APPLIED RUNNING 2 2", "APPLIED COMPLETED 2 2", "INVALID_STATE COMPLETED 2 2", "INVALID_STATE PENDING 1 0"]


def test_operations():
    fold = workers.Operations(10000, 1, 5, 1)
    assert _fold(fold, [(1, 0, "block", 0), (1, 3601, "block", 0), (1, 3602, "retry", 0), (1, 3700, "x", 0), (1, 3701, "block", 0), (1, 3702, "x", 0)]) == ["ALLOWED"] * 4 + ["BLOCK_BUDGET", "TRIPPED"]
    assert _fold(fold, [(1, 0, "retry", 0), (1, 1, "retry", 0), (2, 0, "x", 0), (2, 10001, "x", 0)]) == ["ALLOWED", "RETRY_BUDGET", "ALLOWED", "TIME_BUDGET"]


def test_routing_without_candidates(spark):
    asked = spark.createDataFrame([(1, None, None, 1, 1, None, None), (2, None, None, -1, 1, None, None)], "id long, excluded array<string>, required array<string>, input_tokens long, output_tokens long, most_cost long, allow_degraded boolean")
    one = {"provider_id": "p", "model_id": "m", "priority": 1, "health": "HEALTHY", "circuit_open": None, "cooling": None, "tokens_left": 2, "capabilities": None, "input_price": 1, "output_price": 2}
    pick = lambda registry: {r["id"]: (r["provider_id"], r["cost"]) for r in workers.routed(asked, registry).collect()}
    assert pick([one]) == {1: ("p", 3), 2: (None, None)} and pick([]) == {1: (None, None), 2: (None, None)}
    assert pick([one | {"tokens_left": 1}])[1] == (None, None)
    with pytest.raises(ValueError, match="at most"):
        workers.routed(asked, [one] * 3, most=2)


@pytest.mark.parametrize("kind", sorted(graphs.KINDS))
def test_graphs_are_kept(spark, tmp_path, kind):
    nodes = spark.createDataFrame([("a", 1, {"k": "v"}, ["x"]), ("b", None, None, [])], "id string, line long, attributes map<string,string>, labels array<string>")
    edges = spark.createDataFrame([("a", "b", "CALL"), ("a", "gone", "CALL"), ("no", "none", None)], "src string, dst string, edge_type string")
    path = f"file://{tmp_path}/g"
    graphs.save(nodes, edges, path, kind)
    n, e = graphs.load(spark, path)
    assert n.schema == nodes.schema and e.schema == edges.schema
    assert sorted(map(str, n.collect())) == sorted(map(str, nodes.collect())) and sorted(map(str, e.collect())) == sorted(map(str, edges.collect()))
    assert sorted((r["src"], r["missing"]) for r in graphs.dangling(n, e).collect()) == [("a", "dst"), ("no", "both")]
    with pytest.raises(Exception, match="exists"):
        graphs.save(nodes, edges, path, kind)


def test_rules_use_predicates(spark, tmp_path):
    texts = {
        "a.json": '{"id": "R1", "uses": {"predicate": "p"}, "metadata": {"name": "", "cwe": 89}, "condition": {"symbol_triggers": ["f"]}, "target": {"languages": ["py"]}}',
        "sub/b.json": '{"id": "R2", "uses": {"predicate": "gone"}, "condition": {"pattern": "x"}}', "c.json": '{"id": "R3"}', "d.json": '{"name": "no rule"}', "e.txt": "id: R9",
    }
    for name, text in texts.items():
        (tmp_path / "rules" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "rules" / name).write_text(text)
    made = {"p": ["q"], "q": [], "c1": ["c2"], "c2": ["c1"], "own": ["own"], "lost": ["nowhere"]}
    (tmp_path / "shared").mkdir()
    for name, needs in made.items():
        (tmp_path / "shared" / f"{name}.json").write_text(json.dumps({"predicate": {"name": name, "metadata": {"name": name, "cwe": "1"}, "condition": {"pattern": "pp", "symbol_triggers": ["f", "g", "g"]}, "dependencies": needs}}))
    own, shared = rules.rules(spark, f"file://{tmp_path}/rules"), rules.predicates(spark, f"file://{tmp_path}/shared")
    got = {r["rule_id"]: (r["metadata"], r["pattern"], r["symbol_triggers"], r["languages"], r["resolved"]) for r in rules.resolved(own, shared).collect()}
    assert got == {"R1": ({"name": "p", "cwe": "89"}, "pp", ["f", "g"], ["py"], True), "R2": ({}, "x", [], [], False), "R3": ({}, None, [], [], True)}
    assert sorted(map(tuple, rules.broken(shared).collect())) == [("c1", "CYCLE"), ("c2", "CYCLE"), ("lost", "MISSING"), ("own", "CYCLE")]


def test_leases():
    got = _fold(workers.Leases(), [(1, 0, "a", 10), (1, 5, "b", 10), (1, 9, "a", 10), (1, 18, "b", 1), (1, 19, "b", 10), (1, 20, "a", 1), (2, 0, "a", 1)])
    assert got == ["HELD 1", "REFUSED", "HELD 1", "REFUSED", "HELD 2", "REFUSED", "HELD 1"]


def test_rule_files_that_cannot_be_read_are_told(spark, tmp_path):
    for name, text in (("a.yaml", "id: A\ncondition:\n  pattern: x\n"), ("b.yaml", "id: [unclosed"), ("c.yml", "just words"), ("d.yaml", ""), ("e.json", '{"id": ')):
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rules.unreadable(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"b.yaml", "c.yml", "e.json"} and all(got.values())
    assert [r["rule_id"] for r in rules.rules(spark, f"file://{tmp_path}").collect()] == ["A"]
