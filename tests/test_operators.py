import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import dataflow, decisions, dsl, evaluation, findings, graph, lookup, paths, retrieval, rules, small_graphs
from tessera.operators.predicates import as_text, compile_predicate
from tessera.sinks import reports
from tessera.sources import files
from tessera.streaming.events import chain_hash, chained, verified

NODES = [
    ("n1", "AST", "a", "app.py", 10, [], {"function_name": "main"}),
    ("n2", "SSA", "b", "app.py", 12, ["hot"], {"function_name": "main", "label": "shadow"}),
    ("n3", "DATAFLOW", "c", "", 15, [], {"function_name": "process"}),
    ("n4", "TAINT", "d", "db.py", 20, [], None),
    ("n5", "TAINT", "e", "db.py", 20, None, {}),
]
EDGES = [("n1", "n2", "DATAFLOW"), ("n2", "n3", "CALL"), ("n3", "n4", "TAINT"), ("n3", "n1", "CFG_FLOW"), ("n4", "n4", "LOOP"), ("n4", "gone", "CALL")]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(NODES, "id string, node_type string, label string, file_path string, line_number long, labels array<string>, attributes map<string,string>")
    return nodes, spark.createDataFrame(EDGES, "src string, dst string, edge_type string")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        (("EQUALS", "function_name", "main"), ["n1", "n2"]),
        (("NOT_EQUALS", "function_name", "main"), ["n3", "n4", "n5"]),
        (("EQUALS", "function_name", None), ["n4", "n5"]),
        (("EQUALS", "label", "shadow"), ["n2"]),
        (("NOT_IN", "function_name", ["process"]), ["n1", "n2", "n4", "n5"]),
        (("CONTAINS", "labels", "hot"), ["n2"]),
        (("COUNT", "labels", 0), ["n1", "n3", "n4"]),
        (("NOT", [("EXISTS", "function_name")]), ["n4", "n5"]),
        (("UNHEARD_OF", "label", 1), []),
    ],
)
def test_predicates(g, predicate, want):
    assert ids(g[0].filter(compile_predicate(predicate))) == want


def test_dsl(g):
    q = dsl.node("AST").where(function_name="main").outgoing("DATAFLOW").outgoing()
    assert ids(q.run(*g)) == ["n3"]
    assert dsl.Query.from_json(q.to_json()).fingerprint() == q.fingerprint()
    assert ids(dsl.node().limit(2).run(*g)) == ["n1", "n2"] and len(ids(dsl.node().limit(0).run(*g))) == 5
    assert ids(dsl.node("TAINT").incoming().run(*g)) == ["n3", "n4"]
    assert ids(dsl.node("hot").neighbours().run(*g)) == ["n1", "n3"]


def test_graph(g):
    nodes, edges = g
    assert [r["missing"] for r in graph.broken_edges(nodes, edges).collect()] == ["dst"]
    assert ids(graph.orphans(nodes, edges)) == ["n5"]


def test_paths(g, spark):
    nodes, edges = g
    real = edges.filter("dst <> 'gone'")
    start = nodes.filter("id = 'n1'").select("id")
    assert {(r["id"], r["hops"]) for r in paths.distances(start, real, 9).collect()} == {("n1", 0), ("n2", 1), ("n3", 2), ("n4", 3)}
    assert {r["id"]: r["comp"] for r in paths.strong_components(nodes, real).collect()} == {"n1": "n1", "n2": "n1", "n3": "n1", "n4": "n4", "n5": "n5"}
    assert {r["id"]: r["comp"] for r in paths.components(nodes, real).collect()}["n4"] == "n1"
    assert {r["id"]: r["level"] for r in paths.levels(nodes, real).collect()} == {"n5": 0, "n1": None, "n2": None, "n3": None, "n4": None}
    assert {r["id"] for r in paths.on_cycles(real).collect()} == {"n1", "n2", "n3", "n4"}
    one = small_graphs.as_one(real)
    dom = {(r["id"], r["dom"]) for r in small_graphs.dominators(one, spark.createDataFrame([(0, "n1")], "graph int, id string")).collect()}
    assert ("n4", "n3") in dom and ("n4", "n1") in dom and ("n3", "n4") not in dom


def test_small_graphs(spark):
    rows = [("f", *e) for e in ((1, 2), (1, 3), (2, 4), (3, 4), (4, 2), (4, 5))] + [("g", 1, 1), ("g", 2, 1)]
    edges = spark.createDataFrame(rows, "graph string, src int, dst int")
    starts = spark.createDataFrame([("f", 1), ("g", 2), ("h", 7)], "graph string, id int")
    order = lambda **k: {g: [r["id"] for r in sorted(small_graphs.visits(edges, starts, **k).collect(), key=lambda r: r["place"]) if r["graph"] == g] for g in "fgh"}
    assert order() == {"f": [1, 2, 3, 4, 5], "g": [2, 1], "h": [7]} and order(depth_first=True)["f"] == [1, 2, 4, 5, 3]
    assert order(depth=1)["f"] == [1, 2, 3] and order(depth=-1) == {"f": [], "g": [], "h": []}
    back = spark.createDataFrame([("f", 5)], "graph string, id int")
    assert [r["id"] for r in sorted(small_graphs.visits(edges, back, reverse=True).collect(), key=lambda r: r["place"])] == [5, 4, 2, 3, 1]
    pairs = spark.createDataFrame([("f", 1, 5)], "graph string, src int, dst int")
    assert [r["path"] for r in sorted(small_graphs.bounded_paths(edges, pairs).collect(), key=lambda r: r["number"])] == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert small_graphs.bounded_paths(edges, pairs, most_paths=1).count() == 1 and small_graphs.bounded_paths(edges, pairs, most_nodes=3).count() == 0
    comp = {(r["graph"], r["id"]): (r["comp"], r["place"]) for r in small_graphs.strong_components(edges).collect()}
    assert comp["f", 2][0] == comp["f", 4][0] == 2 and comp["f", 5][1] < comp["f", 4][1] < comp["f", 3][1] < comp["f", 1][1] and comp["g", 1][1] < comp["g", 2][1]


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(14), rng.randrange(14)) for _ in range(22)]
    edges = spark.createDataFrame(rows, "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(14)], "id int")
    reach = {i: {i} for i in range(14)}
    for _ in range(14):
        for a, b in rows:
            for r in reach.values():
                if a in r:
                    r.add(b)
    assert {r["id"]: r["comp"] for r in paths.strong_components(nodes, edges).collect()} == {i: min(j for j in reach[i] if i in reach[j]) for i in reach}


def test_chain(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 1, "a"), (1, "2024-01-02", 2, "b"), (2, "2024-01-01", 3, "a")], "user_id long, ts string, event_id long, event_type string")
    chain = chained(rows)
    got = {r["event_id"]: r for r in chain.collect()}
    assert got[2]["previous_hash"] == got[1]["event_hash"] == chain_hash("", 1, "a") and got[3]["previous_hash"] == ""
    assert all(r["first_break"] is None for r in verified(chain).collect())


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        (("EQUALS", "line_number", 10), ["n1"]),
        (("EQUALS", "line_number", "10"), []),
        (("IN", "function_name", ["main", None]), ["n1", "n2", "n4", "n5"]),
        (("CONTAINS", "file_path", ""), ["n1", "n2", "n4", "n5"]),
        (("REGEX", "file_path", ""), []),
        (("REGEX", "label", "^[ab]$"), ["n1"]),
        (("STARTSWITH", "line_number", 1), ["n1", "n2", "n3"]),
        (("COUNT", "function_name", 4), []),
        (("UNHEARD_OF", "label", "a"), ["n1"]),
    ],
)
def test_predicates_keep_types(g, predicate, want):
    assert ids(g[0].filter(compile_predicate(predicate))) == want


def test_predicates_as_text(g):
    got = lambda p: ids(g[0].filter(as_text(p)))
    assert got(("EQUALS", "line", "10")) == got(("EQUALS", "line_number", 10)) == ["n1"]
    assert got(("NOT_EQUALS", "function_name", "main")) == ["n3", "n4", "n5"] and got(("CONTAINS", "label", "b")) == ["n2"] and got(("REGEX", "label", "b")) == []


def test_lookups(g, spark):
    nodes, edges = g
    assert ids(lookup.by_key(nodes, "line", 12)) == ["n2"] and ids(lookup.by_key(nodes, "fn_name", "process")) == ["n3"] and ids(lookup.by_key(nodes, "odd", 1)) == []
    assert [r["id"] for r in lookup.evaluate(nodes, "*", [("CONTAINS", "file", "py"), ("EQUALS", "type", "TAINT")]).collect()] == ["n4", "n5"]
    named = spark.createDataFrame([("1", "pkg.run"), ("2", "run"), ("3", "pkg.rerun"), ("4", "main")], "id string, label string")
    links = spark.createDataFrame([("4", "1", "CALLS"), ("3", "2", "IMPORTS"), ("4", "3", "CALLS")], "src string, dst string, edge_type string")
    assert ids(lookup.symbols(named, "run")) == ["1", "2", "3"] and ids(lookup.definition(named, "run")) == ["2"] and ids(lookup.definition(named, "rerun")) == ["3"]
    assert [r["dst"] for r in lookup.calls(named, links, "run").collect()] == ["1"] and ids(lookup.references(named, links, "run")) == ["3", "4"]


def test_rules(g):
    nodes, edges = g
    match = lambda c: ids(rules.matching(nodes, edges, c))
    assert match({"node_type_equals": "taint", "incoming_edge": {"type": "TAINT", "source_type": "DATAFLOW"}}) == ["n4"]
    assert match({"not": {"outgoing_edge": {}}}) == ["n5"] and match({"any": [{"has_attribute": "label"}, {"attribute_equals": {"key": "function_name", "value": "process"}}]}) == ["n2", "n3"]
    assert match({"edge_count": {"direction": "both", "min": 3}}) == ["n3", "n4"] and match({"edge_count": {"direction": "outgoing", "min": 1, "max": 1}}) == ["n1", "n2"]
    assert match({"all": [{"attribute_contains": {"key": "function_name", "value": "ai"}}, {"outgoing_edge": {"type": "CALL", "target_type": "DATAFLOW"}}]}) == ["n2"]
    assert {(r["rule_id"], r["id"]) for r in rules.findings(nodes, edges, [{"id": "A", "condition": {"node_type_equals": "AST"}}, {"id": "B", "condition": {"has_attribute": "label"}}]).collect()} == {("A", "n1"), ("B", "n2")}


def test_dataflow(spark):
    cfg = spark.createDataFrame([("f", a, b) for a, b in ((1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 2), (5, 6))], "fn string, src int, dst int")
    defs = spark.createDataFrame([("f", 1, "x"), ("f", 3, "x"), ("f", 4, "y")], "fn string, node int, var string")
    got = {(r["node"], r["var"], r["def"]) for r in dataflow.reaching(cfg, defs).collect()}
    at = {(n, "x", d) for n in (2, 3, 4, 5, 6) for d in (1, 3)} - {(3, "x", 9)}
    assert got == {k for k in at} | {(n, "y", 4) for n in (2, 3, 4, 5, 6)}
    reached = dataflow.reaching(cfg, defs)
    uses = spark.createDataFrame([("f", 6, "x"), ("f", 6, "z")], "fn string, node int, var string")
    assert {r["var"]: r["defs"] for r in dataflow.use_definitions(reached, uses).collect()} == {"x": [1, 3], "z": []}
    values = spark.createDataFrame([("f", 1, "x", "7"), ("f", 3, "x", "7"), ("f", 4, "y", None)], "fn string, node int, var string, value string")
    assert {(r["node"], r["var"]): r["value"] for r in dataflow.constants(reached, values).collect()}[6, "x"] == "7"
    assert {(r["node"], r["var"]): r["value"] for r in dataflow.constants(reached, values).collect()}[6, "y"] is None
    roles = spark.createDataFrame([("f", 1, "source"), ("f", 3, "sanitizer"), ("f", 6, "sink"), ("f", 3, "sink"), ("g", 1, "source"), ("g", 2, "sink")], "fn string, node int, role string")
    assert {(r["fn"], r["sink"]): r["status"] for r in dataflow.taint(cfg, roles).collect()} == {("f", 6): "CORRELATED", ("f", 3): "BLOCKED", ("g", 2): "UNKNOWN"}
    one_way = cfg.filter("dst <> 4 AND src <> 4 AND NOT (src = 5 AND dst = 2)")
    assert {(r["fn"], r["sink"]): r["status"] for r in dataflow.taint(one_way, roles).collect()}["f", 6] == "BLOCKED"
    dom = spark.createDataFrame([(n, d) for n, ds in {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 4], 5: [1, 2, 5], 6: [1, 2, 5, 6]}.items() for d in ds], "id int, dom int")
    assert {r["id"]: r["idom"] for r in dataflow.immediate_dominators(dom).collect()} == {2: 1, 3: 2, 4: 2, 5: 2, 6: 5}
    assert {(r["id"], r["front"]) for r in dataflow.frontier(cfg, dom).collect()} == {(3, 5), (4, 5), (5, 2), (2, 2)}


def test_clusters_and_calibration(spark):
    cols = "finding_id string, vulnerability_class string, rule_key string, severity string, status string, confidence double, flow_id string, source_fact_id string, sink_fact_id string, source_node_id string, sink_node_id string, call_context string, source_role string, sink_role string, path_nodes int, barrier string"
    rows = [
        ("a", "XSS", "r1", "HIGH", "CONFIRMED", 0.8, "f1", "s1", "k1", "n1", "m1", None, None, None, 2, None),
        ("b", "XSS", "r2", "low", "CANDIDATE", 0.6, "f1", "s2", "k2", "n2", "m2", "c", None, None, 2, None),
        ("c", "XSS", "r2", "LOW", "BLOCKED", 0.5, "f3", "s2", "k9", "n3", "m3", "c", None, None, 3, "esc"),
        ("d", "SQL", "r2", "LOW", "BLOCKED", 0.5, "f1", "s2", "k2", "n2", "m2", "c", None, None, 3, "esc"),
        ("e", "SQL", "r2", "INFO", "UNKNOWN", 0.5, "missing_flow", "missing_source", "k", "missing_node", "m", None, None, None, None, None),
        ("g", "SQL", "r2", "INFO", "UNKNOWN", 0.5, "missing_flow", "missing_source", "k", "missing_node", "m", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, cols)
    own = findings.clusters(df)
    assert {r["finding_id"]: r["cluster_id"] for r in own.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "g": "g"}
    got = {r["cluster_id"]: r for r in findings.calibrated(own).collect()}
    assert (got["a"]["confidence"], got["a"]["status"], got["a"]["severity"]) == (1.0, "CONFIRMED", "HIGH") and got["a"]["n"] == 3
    assert (got["d"]["status"], got["d"]["severity"], got["d"]["confidence"]) == ("BLOCKED", "LOW", 0.55) and got["e"]["status"] == "UNKNOWN"
    assert [r["finding_id"] for r in findings.by_severity(df, "finding_id").collect()] == ["a", "b", "c", "d", "e", "g"]


def test_decisions_fail_closed(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("XSS", "HIGH", nan, "CONFIRMED"), ("XSS", "HIGH", 0.9, None), ("CODE_INJECTION", "CRITICAL", 1.0, "CONFIRMED")], "vulnerability_class string, severity string, confidence double, status string")
    assert [(r["priority"], r["priority_score"]) for r in decisions.prioritised(rows).collect()][:2] == [("UNKNOWN", 0.0), ("UNKNOWN", pytest.approx(0.835))]
    assert decisions.prioritised(rows).collect()[2]["priority"] == "CRITICAL"
    none = spark.createDataFrame([(None,) * 11], "policy_valid boolean, evidence_valid boolean, exploitability_valid boolean, priority string, remediation string, regression_status string, regression_change string, cluster_status string, block_unknown boolean, confidence double, minimum_confidence double")
    assert tuple(decisions.gate(none).select("decision", "failed_rule").first()) == ("UNKNOWN", 1)


def test_measures_of_nothing(spark):
    empty = spark.createDataFrame([], "outcome string, engine_verdict string")
    r = evaluation.verdict(evaluation.measures(empty)).first()
    assert (r["precision_"], r["recall_"], r["f1"], r["uncertainty"], r["verdict"]) == (1.0, 1.0, 1.0, 0.0, "PASS_WITH_KNOWN_GAPS")


def test_files(spark, tmp_path):
    wanted = {"a.py": "x = 1\n\n", "src/b.js": "let b", "Dockerfile.dev": "FROM x", ".github/workflows/ci.yml": "on: push", "k/d.yaml": "apiVersion: v1\nkind: Pod", "chart/templates/x.yml": "a: b", "keep/k.log.py": "", "pkg/__init__.py": ""}
    other = {"node_modules/x.js": "", ".hidden/x.py": "", "yarn.lock": "", "m.generated.py": "", "notes.txt": "", "out/z.py": "", "big.log.py": ""}
    for path, text in {**wanted, **other}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    ignore = files.ignore_patterns(["# none", "", "!k.log.py", "*.log.py"])
    got = files.read(spark, f"file://{tmp_path}", skip=["out"], ignore=ignore).collect()
    assert [r["path"] for r in got] == sorted(wanted) and {r["path"]: r["content"] for r in got} == wanted
    own = files.read(spark, f"file://{tmp_path}", skip=["out"], ignore=ignore)
    kinds = {r["path"]: (r["t"]["format"], r["t"]["confidence"]) for r in own.select("path", files.target().alias("t")).collect()}
    assert kinds["Dockerfile.dev"] == ("DOCKERFILE", 1.0) and kinds[".github/workflows/ci.yml"] == ("GITHUB_ACTIONS", 0.95) and kinds["k/d.yaml"] == ("KUBERNETES", 0.9) and kinds["chart/templates/x.yml"] == ("HELM", 0.8) and kinds["a.py"] == ("PYTHON", 0.9)
    assert {r["language"]: (r["files"], r["lines"]) for r in files.profile(own).collect()} == {"Python": (3, 1), "JavaScript": (1, 1)}
    (tmp_path / "truth.csv").write_text("case_id,rule_id,line\nc1,R1,5\n")
    assert tuple(files.ground_truth(spark, f"file://{tmp_path}/truth.csv").first()) == ("c1", "R1", None, 5, None)


def test_reports(spark, tmp_path):
    rows = [("2", "R1", "HIGH", 'a "b"', "x\\y.py", 3), ("1", "R2", "odd", "c", "z.py", 4), ("3", "R2", "LOW", "d", "z.py", 9)]
    df = spark.createDataFrame(rows, "id string, rule_id string, severity string, message string, file_path string, line int")
    reports.write_sarif(df, f"file://{tmp_path}/s", "tool", "1.0")
    text = "".join(p.read_text() for d in sorted((tmp_path / "s").iterdir()) for p in sorted(d.glob("part-*")))
    run = json.loads(text)["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R2", "R1"] and run["tool"]["driver"]["rules"][1]["properties"]["security-severity"] == "8.0"
    assert [(r["ruleId"], r["ruleIndex"], r["level"]) for r in run["results"]] == [("R2", 0, "warning"), ("R1", 1, "error"), ("R2", 0, "note")]
    assert run["results"][1]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "x/y.py"}, "region": {"startLine": 3}}
    samples = spark.createDataFrame([("m", 'a"b', 1.0, 1), ("m", 'a"b', 2.5, 2)], "metric string, label string, value double, at int")
    assert [r["line"] for r in reports.prometheus(samples, "gauge").collect()] == ['m{label="a\\"b"} 2.50'] and [r["line"] for r in reports.prometheus(samples, "counter").collect()] == ['m_total{label="a\\"b"} 3.50']
    with pytest.raises(ValueError, match="labels"):
        reports.prometheus(spark.range(100).selectExpr("'m' AS metric", "id AS label", "1.0D AS value"), most_labels=10)


def test_bm25_counts_documents_without_words(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, ""), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "fox")], "item_id long, text string")
    got = retrieval.bm25(retrieval.postings(docs, "doc_id", "text"), retrieval.lengths_of(docs, "doc_id", "text"), retrieval.postings(asked, "item_id", "text"), "doc_id", "item_id").collect()
    idf, mean = math.log((4 - 1 + 0.5) / 1.5 + 1), 3 / 4
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean)), 6))]


def test_text(spark):
    df = spark.createDataFrame([('a password = "x y" and Token:abc;', {"API_KEY": "k", "note": "jwt=1 ok"})], "t string, m map<string,string>")
    r = df.select(text.redact("t").alias("t"), text.redact_map("m").alias("m")).first()
    assert r["t"] == 'a password=[REDACTED] y" and Token=[REDACTED];' and r["m"] == {"API_KEY": "[REDACTED]", "note": "jwt=[REDACTED] ok"}
    kinds = {"x = os.getenv('A')": "ENV_REFERENCE", "'k' => Vault::get()": "SECRET_PROVIDER_REFERENCE", "p: base_path": "STATIC_CONSTANT", 's = ""': "EMPTY_LITERAL", "s = None": "NULL_LITERAL", "s = 'abc'": "LITERAL_SECRET", "if x = 1": "UNKNOWN", " ": "EMPTY_LITERAL", "s = 5": "UNKNOWN"}
    got = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", text.value_kind(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in got} == kinds


def test_colocated_edges_are_not_shuffled(spark):
    """Every pair of a place once, those of repeated ids and rows too, and no shuffle of edges where ids stand once."""
    kinds = "id string, node_type string, file_path string, line_number long"
    pairs = spark.createDataFrame([("A", "A", "X"), ("A", "B", "X"), ("A", "A", "X"), ("B", "A", "Y")], "from_type string, to_type string, edge_type string")
    rows = [(f"n{i % 9}", "AB"[i % 2], f"f{i % 3}", i % 2) for i in range(40)] + [("n1", "A", "f0", 0), ("p", "A", None, 0), ("q", "A", "", 0), ("s", "A", "f1", 1)]
    want = {(a[0], b[0], e) for a in rows for b in rows for f, t, e in [("A", "A", "X"), ("A", "B", "X"), ("B", "A", "Y")] if a[2] and a[2:] == b[2:] and (a[1], b[1]) == (f, t) and a[0] != b[0]}
    got = [tuple(r) for r in graph.link_colocated(spark.createDataFrame(rows, kinds), pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    single = graph.link_colocated(spark.createDataFrame([(f"n{i}", "A", "f", i % 5) for i in range(50)], kinds), pairs)
    assert single.count() == 50 * 9 and "Aggregate" not in single._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_best_equals_all_pairs_in_blocks_of_queries(spark, monkeypatch):
    """The k best without a shuffle of pairs are those of all pairs: ties, empty texts, several blocks of queries and tasks."""
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(retrieval, "PAIRS", 20)
    rng = random.Random(8)
    text_of = lambda n: " ".join(rng.choice("Red red fox dog K\u212a it's a_b x-y 10 \u0130i").join("ab") if rng.random() < 0.1 else rng.choice(["Red", "fox", "dog", "it's", "x-y", "\u212a9", "\u0130z"]) for _ in range(n))
    docs = spark.createDataFrame([(i, None if i == 3 else text_of(rng.randint(0, 12))) for i in range(120)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, text_of(rng.randint(0, 5))) for i in range(11)], "item_id long, text string")
    index, queries = retrieval.postings(docs, "doc_id", "text"), retrieval.postings(asked, "item_id", "text")
    want = {"bm25": retrieval.bm25(index, retrieval.lengths_of(docs, "doc_id", "text"), queries, "doc_id", "item_id"), "cosine": retrieval.cosine(index, queries, "doc_id", "item_id")}
    got = retrieval.best(docs, queries, 5, "doc_id", "text", "item_id", ("bm25", "cosine"))
    for kind, df in got.items():
        a, b = (sorted(map(tuple, x.collect())) for x in (df, retrieval.top(want[kind], "item_id", "doc_id", 5)))
        assert a == b and a, kind


def test_components_delete_what_rounds_replaced(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from tessera.tables import shared_folder

    tables = lambda: set(Path(urlparse(shared_folder(spark)).path).glob("cut-*"))
    before = tables()
    got = paths.components(spark.range(30), spark.range(19).selectExpr("id AS src", "id + 1 AS dst"))
    assert len(tables() - before) == 1
    assert {r["id"]: r["comp"] for r in got.collect()} == {i: 0 if i < 20 else i for i in range(30)}


def test_clusters_keep_one_shuffle_and_equal_all_pairs(spark, monkeypatch):
    from itertools import combinations
    from random import Random

    rand = Random(4)
    cols = ("flow_id", "source_fact_id", "sink_fact_id", "source_node_id", "sink_node_id", "call_context")
    word = lambda kind, n: rand.choice([None, *findings.MISSING] + 9 * [f"{kind}{rand.randrange(n)}"])
    rows = [(f"i{rand.randrange(250)}" if rand.random() < 0.97 else None, rand.choice(["XSS", "SQL", None]), word("f", 150), word("s", 30), word("k", 15), word("n", 30), word("m", 15), word("c", 20)) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("finding_id", "vulnerability_class", *cols)))
    best = {r[0]: r[0] for r in rows if r[0]}
    root = lambda x: x if best[x] == x else root(best[x])
    for a, b in combinations([r for r in rows if r[0] and r[1]], 2):
        same = lambda *at: all(a[i] is not None and a[i] == b[i] for i in at)  # noqa: E731, B023
        known = lambda i: a[i] not in findings.MISSING  # noqa: E731, B023
        if a[1] == b[1] and (same(2) and known(2) or same(3, 4) and known(3) or same(5, 6) and known(5) or same(3, 7)):
            low, high = sorted((root(a[0]), root(b[0])))
            best[high] = low
    want = sorted((x, root(x)) for x in best)
    assert len({c for _, c in want}) < len(want)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.rsplit("/", 1)[1].split("_")[1] for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    for heavy in (1_000_000, 3):
        monkeypatch.setattr(findings, "HEAVY", heavy)
        before = shuffles()
        got = findings.clusters(df).select("finding_id", "cluster_id").distinct()
        assert not shuffles() - before, heavy
        assert sorted(map(tuple, got.collect())) == want, heavy
