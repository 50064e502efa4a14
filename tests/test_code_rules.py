"""Rules, invariants and provenance on small cases and against plain evaluation."""

import hashlib
import random

from tessera.operators import invariants, provenance, rule_pipeline
from tessera.operators.rule_pipeline import Rule

NODES = "node long, node_type string, language string, text string, symbol string, aliases map<string,string>"


def test_predicates_in_order(spark):
    rules = [
        Rule("exec", "python", ("call",), ("os.system", "exec"), r"exec|system"),
        Rule("arrow", "php", ("*",), ("$db->query",)),
        Rule("quiet", "generic", (), ("eval",), exclusion="eval_result"),
        Rule("any", "generic", ("string",), (), r"pass(word)?="),
        Rule("expanded", "generic", (), ("run",), r"subprocess\.Popen"),
    ]
    rows = [
        (1, "call", "python", "exec(x)", None, None),
        (2, "call", "python", "executor(x)", None, None),
        (3, "CALL", "Python", "s('ls') # system", "os.system", None),
        (4, "call", "javascript", "exec(x)", None, None),
        (5, "expr", "php", "$db  ->  query($q)", None, None),
        (6, "expr", "generic", "eval(y)", None, None),
        (7, "expr", "generic", "eval(EVAL_RESULT)", None, None),
        (8, "string", "go", "a password=1", None, None),
        (9, "call", "python", "run(cmd)", None, {"run": "subprocess.Popen"}),
        (10, "call", "python", "run(cmd)", None, {"cmd": "ls"}),
        (11, None, None, None, None, None),
        (12, "call", "python", "system(z)", "system", None),
        (13, "call", "python", "os.system.x(z)", "os.system.x", None),
    ]
    got = sorted((r["node"], r["rule"], r["trigger"]) for r in rule_pipeline.findings(spark.createDataFrame(rows, NODES), rules).collect())
    assert got == [(1, "exec", "exec"), (3, "exec", "os.system"), (5, "arrow", "$db->query"), (6, "quiet", "eval"), (8, "any", None), (9, "expanded", "run"), (12, "exec", "os.system"), (13, "exec", "os.system")]


def test_many_rules_equal_rule_by_rule():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = [Rule(f"r{i}", rng.choice(["generic", "a", "b"]), rng.choice([(), ("x",), ("x", "y")]), tuple(rng.sample(words, rng.randint(0, 2))) + ((".".join(rng.sample(words, 2)),) if i % 5 == 0 else ()), rng.choice([None, rng.choice(words) + "+"]), rng.choice([None, None, rng.choice(words) * 2])) for i in range(300)]
    all_at_once = rule_pipeline.Matcher(rules)
    alone = [rule_pipeline.Matcher([r]) for r in rules]
    n = 0
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(9)))
        node = (rng.choice(["x", "y", "z"]), rng.choice(["a", "b", "generic"]), text, rng.choice([None, rng.choice(words), ".".join(rng.sample(words, 2))]), rng.choice([None, {rng.choice(words): rng.choice(words)}]))
        got = [(all_at_once.rules[i].rule.rule, all_at_once.matched(all_at_once.rules[i], *node)) for i in all_at_once.candidates(text, node[3])]
        want = [(r.rule, m.matched(m.rules[0], *node)) for r, m in zip(rules, alone, strict=True)]
        assert [x for x in got if x[1]] == [x for x in want if x[1]]
        n += sum(x[1] is not None for x in want)
    assert n > 500


def test_offending_pairs(spark):
    def run(*actions):
        rows = [(1, i, 10 + i, a) for i, a in enumerate(actions)]
        found = invariants.offences(spark.createDataFrame(rows, "key long, seq long, event_id long, action string"))
        return sorted((r["category"], r["resolution"], r["first_event"], r["then_event"]) for r in found.collect())

    assert run("REVOKE", "USE") == [("REVOCATION_DRIFT_VIOLATION", "VULNERABLE", 10, 11)]
    assert run("REVOKE", "CACHE_INVALIDATED", "USE") == []
    assert run("CHECK", "CONCURRENT_MUTATION", "USE") == [("TOCTOU_VIOLATION", "VULNERABLE", 10, 12)]
    assert run("CHECK", "USE") == [("TOCTOU_VIOLATION", "UNKNOWN", 10, 11)]
    assert run("CHECK", "LOCK", "CONCURRENT_MUTATION", "USE") == []
    assert run("MUTATE", "MUTATE", "NONCE", "MUTATE") == [("REPLAY_ATTACK_VIOLATION", "VULNERABLE", 10, 11)]
    assert run("PAY", "REQUEST") == [] and run("PROOF", "REQUEST", "PAY") == [("WORKFLOW_BYPASS_VIOLATION", "VULNERABLE", 11, 12)]
    assert run(None, "DEBIT", "TRANSACTION", "CREDIT_FAIL", "DEBIT", "CREDIT_FAIL") == [("TRANSACTIONAL_INVARIANT_FAILURE", "VULNERABLE", 14, 15)]


def plain_fingerprint(node, meta, preds):
    before = "|".join(f"{p}={plain_fingerprint(p, meta, preds)}" for p in sorted(preds.get(node, ())))
    return hashlib.sha256(f"{node}:k:{meta[node]}:{before}".encode()).hexdigest()


def test_fingerprints_and_a_tampered_step(spark):
    preds = {2: {1}, 3: {1, 2}, 4: {3}, 6: {5}, 7: {4, 6}}
    links = spark.createDataFrame([(n, p) for n, s in preds.items() for p in s] * 2, "id long, pred long")
    meta = {n: f"m{n}" for n in range(1, 8)}
    state = lambda m: spark.createDataFrame([(n, "k", v) for n, v in m.items()], "id long, kind string, meta string")
    old = provenance.fingerprints(state(meta), links)
    assert {r["id"]: r["fingerprint"] for r in old.collect()} == {n: plain_fingerprint(n, meta, preds) for n in meta}
    changed = meta | {3: "other"}
    new = provenance.fingerprints(state(changed), links)
    status = provenance.compared(state(meta).join(old, "id"), state(changed).join(new, "id"))
    assert {r["id"]: r["status"] for r in status.collect()} == {1: "SAME", 2: "SAME", 3: "CHANGED", 4: "DEPENDS", 5: "SAME", 6: "SAME", 7: "DEPENDS"}
    assert {r["id"]: (r["root"], r["terminal"]) for r in provenance.ends(state(meta), links).collect()} == {n: (n in (1, 5), n == 7) for n in meta}
    assert provenance.problems(state(meta), links).count() == 0


def test_problems_of_provenance(spark):
    nodes = spark.createDataFrame([(1, "k", ""), (2, "k", ""), (3, "k", ""), (4, "k", ""), (4, "k", ""), (5, "k", ""), (None, "k", "")], "id long, kind string, meta string")
    links = spark.createDataFrame([(2, 3), (3, 2), (4, 3), (5, 5), (1, 99)], "id long, pred long")
    assert sorted(map(tuple, provenance.problems(nodes, links).collect())) == [(1, "orphan"), (2, "cycle"), (3, "cycle"), (4, "duplicate"), (5, "cycle"), (5, "self-reference")]
    assert {r["id"]: r["fingerprint"] is None for r in provenance.fingerprints(nodes, links).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_sink_compatibility(spark):
    from pyspark.sql import functions as F

    from tessera.operators import verdicts
    from tessera.operators.guards import BIT

    rows = [(BIT["NUMERIC"], "SQL_INJECTION", "SQL_VALUE"), (BIT["NUMERIC"], "SQL_INJECTION", "SQL_IDENTIFIER"), (BIT["HTML_ESCAPED"], "SQL_INJECTION", "SQL_VALUE"), (BIT["SHELL_ESCAPED"] | BIT["INTEGER"], "COMMAND_INJECTION", "FILE_PATH"), (BIT["PATH_NORMALIZED"], "LFI", None), (0, "XSS", None), (None, None, None), (BIT["INTEGER"] | BIT["NUMERIC"], "xss", None)]
    got = spark.createDataFrame(rows, "bits int, category string, context string").select(verdicts.compatibility(F.col("bits"), F.col("category"), F.col("context")).alias("a")).collect()
    assert [tuple(r["a"]) for r in got] == [("COMPATIBLE", "NUMERIC"), ("NOT_PROVEN", "NUMERIC"), ("NOT_PROVEN", "HTML_ESCAPED"), ("COMPATIBLE", "SHELL_ESCAPED"), ("COMPATIBLE", "PATH_NORMALIZED"), ("NOT_PROVEN", None), ("NOT_PROVEN", None), ("COMPATIBLE", "INTEGER")]


def test_correlated_verdicts_and_proofs(spark):
    from tessera.operators import verdicts

    schema = "verdict_id string, rule string, file string, function string, line int, sink_category string, var_version string, call_context string, branch string, sources array<string>, status string, confidence double, n_provenance int, n_evidence int"
    row = lambda i, file, conf, prov, sources=("a", "b"), branch="T": (i, "r", file, "f", 3, "SQL", "x#1", None, branch, list(sources), "CONFIRMED", conf, prov, 1)
    rows = [row("a", "./src/A.php", 0.5, 9), row("b", "SRC\\a.php", 0.9, 1, ("b", "a")), row("c", "src/a.php", 0.9, 2), row("d", "src/a.php", 0.9, 2), row("e", "src/a.php", 0.1, 1, branch="F"), row("f", None, 0.1, 1)]
    got = sorted((r["primary"], r["n"], r["associated"]) for r in verdicts.correlated(spark.createDataFrame(rows, schema)).collect())
    assert got == [("d", 4, 3), ("e", 1, 0), ("f", 1, 0)]
    found = [("P", "VULNERABLE", None, None, None), ("P", "SAFE", None, None, None), ("ROOT_ACCESS", "VULNERABLE", False, False, False), ("Q", "VULNERABLE", None, None, True), ("R", "UNKNOWN", None, True, None), ("S", "SAFE", True, None, None), ("T", "VULNERABLE", None, None, None), (None, "SAFE", None, None, None), ("U", None, None, None, None)]
    got = {r["property"]: (r["resolution"], r["severity"], r["confidence"]) for r in verdicts.proofs(spark.createDataFrame(found, "property string, resolution string, conflict boolean, safe_control boolean, missing boolean")).collect()}
    unknown = ("UNKNOWN", "UNKNOWN", "UNKNOWN")
    assert got == {"P": ("CONFLICT", "UNKNOWN", "UNKNOWN"), "ROOT_ACCESS": ("VULNERABLE", "CRITICAL", "HIGH"), "Q": unknown, "R": ("SAFE", "INFO", "HIGH"), "S": ("CONFLICT", "UNKNOWN", "UNKNOWN"), "T": ("VULNERABLE", "HIGH", "HIGH"), "U": unknown}


def test_matched_cases(spark):
    from tessera.operators import evaluation

    rng = random.Random(7)
    cases = [(i, rng.choice("fg"), rng.choice([None, rng.randrange(30)]), rng.choice(["", "a", "b", None])) for i in range(80)]
    found = [(i, rng.randrange(50), rng.choice("fgh"), rng.choice([None, rng.randrange(30)]), rng.choice(["", "a", "b", "c", None]), rng.choice([None, [], ["a"], ["b", "x"]])) for i in range(60)]
    got = {r["case_id"]: r["finding_id"] for r in evaluation.matched_cases(spark.createDataFrame(cases, "case_id long, file string, line int, rule string"), spark.createDataFrame(found, "finding_id long, place long, file string, line int, rule string, correlated array<string>")).collect()}
    for c, file, line, rule in cases:
        fits = [(p, i) for i, p, f, at, r, co in found if f == file and (not r or not rule or r == rule or rule in (co or ())) and (line is None or at is None or abs(line - at) <= 3)]
        assert got[c] == (min(fits)[1] if fits else None)


def test_graphs_are_compared_in_one_shuffle(spark):
    """Graphs that a task holds and graphs by rounds give the same, circles and predecessors that aren't there among them."""
    rows = [(g, 100 * g + i, "k", f"m{i}", "new" if (g, i) == (1, 2) else f"m{i}", [100 * g + x for x in (i // 2, i // 3) if 0 < x] if i > 1 else None) for g in range(1, 4) for i in range(1, 20)]
    rows += [(9, 901, "k", "a", "b", [902]), (9, 902, "k", "a", "a", [901, 999]), (9, 903, None, None, "x", [999]), (9, 904, "k", "a", "a", [903, 903])]
    steps = spark.createDataFrame(rows, "graph long, id long, kind string, meta string, now string, preds array<long>")
    held, joins = ({r["id"]: (r["fingerprint"], r["status"]) for r in provenance.compared_graphs(steps, large=n).select("id", "fingerprint", "status").collect()} for n in (1000, 2))
    assert held == joins and len(held) == len(rows)
    assert held[102][1] == "CHANGED" and held[104][1] == held[119][1] == "DEPENDS" and held[204][1] == "SAME" and held[901] == (None, "SAME") and held[904][1] == "DEPENDS"
    plan = provenance.compared_graphs(steps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
