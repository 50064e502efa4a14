"""Control flow, guards, slices, summaries, symbols, containment and constants against plain versions and by hand."""

import random

import pytest

from tessera.operators import containment, control_flow, expressions, guards, slices, summaries, symbols

BITS = guards.BIT


def built(lines):
    """Edges and block of each line by a plain recursive builder over a list of kinds."""
    tree, stack = [], []
    here = tree
    for line, kind in enumerate(lines, 1):
        if kind in ("if", "loop"):
            node = [line, kind, [], None]
            here.append(node)
            stack.append((here, node))
            here = node[2]
        elif kind == "else":
            if stack and stack[-1][1][1] == "if" and stack[-1][1][3] is None:
                stack[-1][1][3] = here = []
        elif kind == "end":
            if stack:
                here, _ = stack.pop()
        else:
            here.append([line, kind, None, None])
    edges, block = set(), {}

    def number(seq):
        now, before = None, None
        for n in seq:
            if before is None or before[1] in ("if", "loop", "exit") or n[1] == "loop":
                now = 2 * before[0] + 1 if before is not None and before[1] == "if" and n[1] != "loop" else 2 * n[0]
            block[n[0]] = now
            before = n
            for part in (n[2], n[3]):
                if part:
                    number(part)

    def first(seq, other):
        return block[seq[0][0]] if seq else other

    def walk(seq, out, how):
        for i, n in enumerate(seq):
            b = block[n[0]]
            after, kind = (block[seq[i + 1][0]], "FALLTHROUGH") if i + 1 < len(seq) else (out, how)
            if n[1] == "exit":
                edges.add((b, -1, "FALLTHROUGH"))
            elif n[1] == "if":
                meet = 2 * n[0] + 1
                edges.update({(b, first(n[2], meet), "TRUE_BRANCH"), (b, first(n[3] or [], meet), "FALSE_BRANCH")})
                if meet != after:
                    edges.add((meet, after, kind))
                for part in (n[2], n[3]):
                    walk(part or [], meet, "FALLTHROUGH")
            elif n[1] == "loop":
                edges.update({(b, first(n[2], b), "TRUE_BRANCH"), (b, after, "FALSE_BRANCH")})
                walk(n[2], b, "LOOP_BACKEDGE")
            elif b != after:
                edges.add((b, after, kind))

    number(tree)
    walk(tree, -1, "FALLTHROUGH")
    if tree:
        edges.add((0, block[tree[0][0]], "FALLTHROUGH"))
    return edges, block


@pytest.fixture(scope="module")
def programs():
    rng = random.Random(21)
    kinds = ["if", "if", "else", "loop", "end", "end", "end", "exit", "plain", "plain", "plain"]
    return [[rng.choice(kinds) for _ in range(rng.randint(1, 30))] for _ in range(80)] + [["if", "exit", "else", "exit", "end", "plain"], ["loop"], ["end", "else"], ["if", "if", "if", "end", "end", "end"], ["plain"] * 5]


def test_graphs_equal_a_plain_builder(spark, programs):
    rows = [(f, i, k) for f, p in enumerate(programs) for i, k in enumerate(p, 1)] + [(None, 1, "if"), (0, None, "end")]
    blocks, edges, placed = control_flow.graphs(spark.createDataFrame(rows, "fn long, line long, kind string"))
    got_edges, got_block, reach = {}, {}, {}
    for r in edges.collect():
        got_edges.setdefault(r["fn"], set()).add((r["src"], r["dst"], r["kind"]))
    for r in placed.collect():
        got_block.setdefault(r["fn"], {})[r["line"]] = r["block"]
    for r in blocks.collect():
        reach.setdefault(r["fn"], {})[r["block"]] = r["reachable"]
    for f, p in enumerate(programs):
        want, block = built(p)
        assert got_edges.get(f, set()) == want and got_block.get(f, {}) == block, p
        seen, front = {0}, [0]
        while front:
            b = front.pop()
            for s, d, _ in want:
                if s == b and d not in seen:
                    seen.add(d)
                    front.append(d)
        assert all(reach[f][b] == (b in seen) for s, d, _ in want for b in (s, d)), p
    assert control_flow.violations(blocks, edges).count() == 0
    broken = spark.createDataFrame([(0, 2, 77, "FALLTHROUGH", None), (0, -1, 2, "FALLTHROUGH", None)], "fn long, src long, dst long, kind string, line long")
    assert {r["problem"] for r in control_flow.violations(blocks.filter("fn = 0"), edges.filter("fn = 0").unionByName(broken)).collect()} >= {"missing block", "way out of exit"}


def joined(states):
    kinds = {t for t, _ in states}
    taint = kinds.pop() if len(kinds) == 1 else "TAINTED" if any(t != "UNKNOWN" for t, _ in states) else "UNKNOWN"
    bits = ~0
    for _, b in states:
        bits &= b
    return taint, bits


def plain_states(edges, lines, held, variables):
    """Rounds over whole blocks, statement by statement."""
    now = {0: dict.fromkeys(variables, ("UNKNOWN", 0))}
    for _ in range(500):
        flow = {}
        for s, d, kind in edges:
            if s not in now:
                continue
            env = dict(now[s])
            for _, var, op, src in sorted(x for b, *x in lines if b == s):
                if op == "source":
                    env[var] = ("TAINTED", 0)
                elif op == "const":
                    env[var] = ("UNKNOWN", 0)
                elif op == "copy":
                    env[var] = env[src]
                else:
                    bits = sum(BITS[f] for f in guards.TRANSFORMATIONS[op])
                    env[var] = ("CONSTRAINED" if env[src][0] == "TAINTED" else env[src][0], bits)
            for b, k, var, bits in held:
                if (b, k) == (s, kind):
                    env[var] = ("CONSTRAINED" if env[var][0] == "TAINTED" else env[var][0], env[var][1] | bits)
            flow.setdefault(d, []).append(env)
        new = {b: {v: joined([e[v] for e in envs]) for v in variables} for b, envs in flow.items()} | {0: now[0]}
        if new == now:
            return now
        now = new
    raise AssertionError("no fixpoint")


def test_guards_equal_plain_rounds(spark, programs):
    rng = random.Random(5)
    variables = ["x", "y", "z"]
    edges, lines, held, want = [], [], [], {}
    for f, p in enumerate(programs[:12]):
        own, block = built(p)
        if not own:
            continue
        mine = [(block[i], i, rng.choice(variables), rng.choice(["source", "const", "copy", "copy", "intval", "basename"]), rng.choice(variables)) for i, k in enumerate(p, 1) if k == "plain"]
        mine += [(block[1], 1, v, "copy", v) for v in variables if p[0] != "plain"] if 1 in block and p[0] != "plain" else []
        known = {(block[i], rng.choice(["TRUE_BRANCH", "FALSE_BRANCH"]), rng.choice(variables), rng.choice([1, 3, 5])) for i, k in enumerate(p, 1) if k == "if"}
        used = sorted({m[2] for m in mine} | {m[4] for m in mine} | {h[2] for h in known})
        if not used:
            continue
        plain = [m for m in mine if p[m[1] - 1] == "plain"]
        want[f] = plain_states(own, plain, known, used)
        edges += [(f, *e) for e in own]
        lines += [(f, b, i, v, o, s) for b, i, v, o, s in plain]
        held += [(f, *h) for h in known]
        want[f] = {b: {v: e[v] for v in used if v in {m[2] for m in plain} | {m[4] for m in plain} | {h[2] for h in known}} for b, e in want[f].items()}
    frame = spark.createDataFrame
    got = {}
    for r in guards.states(frame(edges, "fn long, src long, dst long, kind string"), frame(lines, "fn long, block long, line long, var string, op string, src string"), frame(held, "fn long, block long, kind string, var string, bits int")).collect():
        assert r["settled"]
        got.setdefault(r["fn"], {}).setdefault(r["block"], {})[r["var"]] = (r["taint"], r["bits"])
    assert got == {f: e for f, e in ((f, {b: v for b, v in e.items() if v}) for f, e in want.items()) if e}


def test_guard_scenarios(spark):
    """A guard holds on its branch only, ends with reassignment, and leads past an early exit when negated."""
    code = [(1, "plain", "id", "source", None), (2, "if", "id", None, None), (3, "plain", "id", "source", None), (4, "end", None, None, None), (5, "plain", "q", "copy", "id")]

    def run(code, guard, negated):
        frame = spark.createDataFrame([(1, *r) for r in code], "fn long, line long, kind string, var string, op string, src string")
        place = control_flow.placed(control_flow.nested(frame))
        own = place.select("fn", "line", "block").join(frame, ["fn", "line"])
        cond = own.filter("kind = 'if'").selectExpr("fn", "block", "var", f"'{guard}' AS guard", f"{negated} AS negated")
        found = guards.states(control_flow.edges(place), own.filter("kind = 'plain'"), guards.guards_of(cond))
        return {(r["block"], r["var"]): (r["taint"], r["bits"]) for r in found.collect()}

    got = run(code, "is_numeric", "false")
    assert got[6, "id"] == ("CONSTRAINED", BITS["NUMERIC"]) and got[5, "id"] == ("TAINTED", 0)
    early = [(1, "plain", "id", "source", None), (2, "if", "id", None, None), (3, "exit", None, None, None), (4, "end", None, None, None), (5, "plain", "q", "copy", "id")]
    assert run(early, "ctype_digit", "true")[5, "id"] == ("CONSTRAINED", BITS["DIGITS_ONLY"] | BITS["NUMERIC"])
    assert run(early, "my_check", "true")[5, "id"] == ("TAINTED", 0)


def test_guards_of_large_functions_and_of_loops_that_never_settle(spark):
    """Streamed functions and rounds of joins give the same, and states that go round a loop are told."""
    rng = random.Random(11)
    edges, lines, held = [], [], []
    for f in range(40):
        edges += [(f, 0, 1, "FALLTHROUGH")] + [(f, b, d, k) for b in range(1, 7) for d, k in ((b + 1, "TRUE_BRANCH"), (rng.randint(1, 7), "FALSE_BRANCH"))]
        ops = ["source", "const", "copy", "copy", "intval", "basename", "unheard_of"]
        lines += [(f, rng.randint(1, 7), i, rng.choice("xyz"), rng.choice(ops), rng.choice("xyz")) for i in range(9)]
        held += [(f, rng.randint(1, 6), "TRUE_BRANCH", rng.choice("xyz"), 1) for _ in range(2)]
    # 7 is TAINTED for one round only, and that goes round 8, 9 and 10 for ever
    edges += [(99, a, b, "TRUE_BRANCH") for a, b in ((0, 1), (0, 4), (0, 5), (1, 2), (5, 4), (4, 6), (2, 7), (6, 7), (7, 8), (8, 9), (9, 10), (10, 8))]
    lines += [(99, b, 1, "x", "source", "x") for b in (1, 5)]
    held += [(99, b, "TRUE_BRANCH", "x", 1) for b in (1, 4)]
    frame = spark.createDataFrame
    frames = frame(edges, "fn long, src long, dst long, kind string"), frame(lines, "fn long, block long, line long, var string, op string, src string"), frame(held, "fn long, block long, kind string, var string, bits int")
    streamed, joins = (sorted(map(tuple, guards.states(*frames, limit=5, large=large).collect())) for large in (10**6, 0))
    assert streamed == joins and len({r[:3] for r in joins}) == len(joins) > 100 and {r[5] for r in joins} == {True, False}
    assert {r["fn"] for r in guards.states(*frames, limit=None).filter("NOT settled").collect()} == {99}


SITES = {"defs": "fn long, line long, var string, op string, src string, callee long", "sinks": "fn long, line long, var string", "params": "fn long, pos int, var string", "args": "fn long, line long, callee long, pos int, var string", "returns": "fn long, line long, var string"}


def sliced(spark, **rows):
    tables = {k: spark.createDataFrame(rows.get(k, []), s) for k, s in SITES.items()}
    return {(r["sink_fn"], r["sink_line"]): (r["verdict"], r["n_walks"], r["reasons"], r["hops"]) for r in slices.verdicts(slices.walks(**tables)).collect()}


def test_slices(spark):
    chain = [(1, i, f"v{i}", "copy", f"v{i - 1}", None) for i in range(2, 20)] + [(1, 1, "v1", "source", None, None)]
    got = sliced(spark, defs=[*chain, (2, 1, "a", "copy", "b", None), (2, 2, "b", "copy", "a", None), (3, 1, "x", "call", None, 4), (4, 1, "r", "source", None, None), (4, 3, "r", "sanitizer", None, None), (6, 1, "w", "const", None, None), (7, 5, "p", "copy", "p", None)],
                 sinks=[(1, 8, "v7"), (1, 30, "v19"), (2, 3, "a"), (3, 2, "x"), (5, 9, "p"), (6, 2, "w"), (6, 3, "nothing")], returns=[(4, 2, "r"), (4, 4, "r")], params=[(5, 0, "p")], args=[(6, 9, 5, 0, "w"), *[(8, i, 5, 0, "w") for i in range(3)]])
    assert got[1, 8] == ("TAINTED", 1, "source:1", 6) and got[1, 30] == ("UNKNOWN", 1, "flow:1", 10)
    assert got[2, 3] == ("UNKNOWN", 1, "undefined:1", 1)
    assert got[3, 2] == ("TAINTED", 2, "sanitizer:1 source:1", 1)
    assert got[5, 9] == ("UNKNOWN", 4, "const:1 undefined:3", 1) and got[6, 2] == ("STATIC", 1, "const:1", 0) and got[6, 3] == ("UNKNOWN", 1, "undefined:1", 0)


def test_slice_budgets(spark):
    many = sliced(spark, sinks=[(5, 9, "p")], params=[(5, 0, "p")], args=[(8, i, 5, 0, "w") for i in range(500)])
    assert many[5, 9] == ("UNKNOWN", 1, "nodes:1", 0)
    deep = sliced(spark, sinks=[(9, 1, "p")], params=[(i, 0, "p") for i in range(10)], args=[(i - 1, 1, i, 0, "p") for i in range(1, 10)])
    assert deep[9, 1] == ("UNKNOWN", 1, "call:1", 5)
    again = sliced(spark, sinks=[(1, 5, "p")], params=[(1, 0, "p")], args=[(1, 3, 1, 0, "p")])
    assert again[1, 5] == ("UNKNOWN", 1, "cycle:1", 1)
    assert sliced(spark) == {}


def test_summaries(spark):
    frame = spark.createDataFrame
    functions = frame([(i,) for i in range(1, 8)], "fn long")
    flows = [(1, "P0", "a"), (1, "a", "R"), (2, "P0", "x"), (2, "y", "R"), (3, "P0", "x"), (3, "x", "y"), (3, "y", "R"), (4, "S", "s"), (4, "s", "R"), (5, "P0", "x"), (5, "P1", "z"), (5, "z", "K"), (6, "S", "s"), (6, "t", "R"), (7, "w", "R")]
    calls = [(2, 1, 3, "y"), (3, 1, 2, "y"), (5, 1, 5, "q"), (6, 1, 5, "t"), (6, 2, 4, "t"), (7, 1, 99, "w")]
    args = [(2, 1, 3, 0, None, "x"), (3, 1, 2, 0, None, "x"), (5, 1, 5, 0, None, "z"), (5, 1, 5, 1, None, "x"), (6, 1, 5, 0, None, "none"), (6, 1, 5, None, "second", "s")]
    params = [(i, 0, "first") for i in range(1, 8)] + [(5, 1, "second")]
    bound = summaries.bound_arguments(frame(args, "fn long, line long, callee long, pos int, name string, var string"), frame(params, "fn long, pos int, name string"))
    frames = functions, frame(flows, "fn long, src string, dst string"), frame(calls, "fn long, line long, callee long, dst string"), bound
    facts, status = summaries.solve(*frames)
    assert sorted(map(tuple, facts.collect())) == [(1, "P0", "R"), (2, "P0", "R"), (3, "P0", "R"), (4, "S", "R"), (5, "P0", "K"), (5, "P1", "K"), (6, "S", "K"), (6, "S", "R"), (7, "U", "R")]
    assert {r["fn"]: (r["recursive"], r["status"]) for r in status.collect()} == {f: (f in (2, 3, 5), "PRECISE") for f in range(1, 8)}


def test_recursion_that_does_not_settle_in_time(spark):
    n = 9  # a ring of functions through which a parameter takes n calls to come back
    frame = spark.createDataFrame
    functions = frame([(i,) for i in range(n)], "fn long")
    flows = frame([(i, "P0", "x") for i in range(n)] + [(i, "y", "R") for i in range(n)] + [(0, "x", "R")], "fn long, src string, dst string")
    calls = frame([(i, 1, (i + 1) % n, "y") for i in range(n)], "fn long, line long, callee long, dst string")
    bound = frame([(i, 1, 0, "x") for i in range(n)], "fn long, line long, pos int, var string")
    facts, status = summaries.solve(functions, flows, calls, bound)
    assert facts.count() == n and {r["status"] for r in status.collect()} == {"PRECISE"}
    facts, status = summaries.solve(functions, flows, calls, bound, limit=4)
    assert {r["status"] for r in status.collect()} == {"NON_CONVERGED"} and {tuple(r) for r in facts.collect()} == {(i, "U", "R") for i in range(n)}


def summarised(functions, flows, calls, bound):
    """A plain fixpoint of all functions at once."""
    to = {(fn, line): (callee, dst) for fn, line, callee, dst in calls}
    seen = {(f, a, b) for f, a, b in flows if a in ("S", "P0", "P1")} | {(f, "U", dst) for f, _, callee, dst in calls if callee not in functions}
    while True:
        more = {(f, x, b) for f, x, at in seen for g, a, b in flows if (f, at) == (g, a)}
        for f, line, pos, var in bound:
            callee, dst = to[f, line]
            more |= {(f, x, "K" if end == "K" else dst) for g, x, at in seen if (g, at) == (f, var) for end in ("R", "K") if (callee, f"P{pos}", end) in seen}
        more |= {(f, x, dst) for f, _, callee, dst in calls for x in ("S", "U") if (callee, x, "R") in seen}
        if more <= seen:
            return sorted(x for x in seen if x[2] in ("R", "K"))
        seen |= more


FRAMES = "fn long", "fn long, src string, dst string", "fn long, line long, callee long, dst string", "fn long, line long, pos int, var string"


@pytest.mark.parametrize("large", [10**6, 20])
def test_summaries_of_components_in_tasks_and_by_joins(spark, large):
    rng = random.Random(5)
    functions, names = list(range(12)), ["a", "b", "c"]
    flows = [(f, rng.choice(["S", "P0", "P1", *names]), rng.choice([*names, "R", "K"])) for f in functions for _ in range(4)]
    flows += [(f, p, rng.choice(names)) for f in functions for p in ("P0", "P1")] + [(f, rng.choice(names), "R") for f in functions]
    # circles of three and of two, calls of itself, calls from later functions to earlier ones and to none
    goes = [(f, f - f % 6 + (f + 1) % 3) for f in functions if f % 6 < 3] + [(f, f ^ 1) for f in functions if f % 6 > 3] + [(3, 3), (9, 9), (11, 99), (8, 98)] + [(f, rng.randrange(f)) for f in functions if f > 5]
    calls = [(f, i, g, rng.choice(names)) for i, (f, g) in enumerate(goes)]
    bound = [(f, i, pos, rng.choice(names)) for i, (f, g) in enumerate(goes) for pos in (0, 1) if g in functions]
    want = summarised(functions, flows, calls, bound)
    rows = [(f,) for f in [*functions, 3, None]], [*flows, flows[0], (1, None, "a"), (1, "S", None), (None, "S", "R")], [*calls, calls[0], (None, 1, 2, "a")], [*bound, bound[0]]
    facts, status = summaries.solve(*map(spark.createDataFrame, rows, FRAMES), large=large)
    assert sorted(map(tuple, facts.collect())) == want and len({x[0] for x in want}) > 10
    state = {r["fn"]: r for r in status.collect()}
    assert sorted(state) == functions and {r["status"] for r in state.values()} == {"PRECISE"}
    assert {f for f in state if state[f]["recursive"]} >= {*functions}
    assert all(state[f]["level"] >= state[g]["level"] for f, g in goes if g in functions)


@pytest.mark.parametrize("large", [10**6, 0])
def test_only_components_that_do_not_settle_are_given_up(spark, large):
    n = 5  # a ring that is given up, and a function that calls itself, whose first fact comes later than that
    flows = [(i, "P0", "x") for i in range(n)] + [(i, "y", "R") for i in range(n)] + [(0, "x", "R")]
    flows += [(50, "P0", "x0"), (50, "x7", "R"), (60, "v", "R")] + [(50, f"x{i}", f"x{i + 1}") for i in range(7)]
    calls = [(i, 1, (i + 1) % n, "y") for i in range(n)] + [(50, 1, 50, "y"), (60, 1, 0, "v"), (60, 2, 50, "v")]
    bound = [(i, 1, 0, "x") for i in range(n)] + [(50, 1, 0, "x0")]
    frames = list(map(spark.createDataFrame, ([(i,) for i in [*range(n), 50, 60]], flows, calls, bound), FRAMES))
    facts, status = summaries.solve(*frames, limit=1, large=large)
    assert {tuple(r) for r in facts.collect()} == {(i, "U", "R") for i in [*range(n), 60]} | {(50, "P0", "R")}
    assert {r["fn"]: r["status"] for r in status.collect()} == dict.fromkeys(range(n), "NON_CONVERGED") | {50: "PRECISE", 60: "PRECISE"}


def test_tables_written_for_summaries_do_not_grow_with_functions(spark, monkeypatch):
    written = []
    for module in (summaries, summaries.paths):
        monkeypatch.setattr(module, "cut", lambda df, old=module.cut: written.append(1) or old(df))
    flows = [(f, f"x{i}", f"x{i + 1}") for f in (1, 2) for i in range(60)] + [(f, "P0", "x0") for f in (1, 2)] + [(f, "x60", "R") for f in (1, 2)]
    calls, bound = [(1, 1, 2, "x30"), (2, 1, 1, "x30")], [(1, 1, 0, "x9"), (2, 1, 0, "x9")]
    facts, _ = summaries.solve(*map(spark.createDataFrame, ([(1,), (2,)], flows, calls, bound), FRAMES))
    assert {tuple(r) for r in facts.collect()} == {(1, "P0", "R"), (2, "P0", "R")} and len(written) < 25


def test_symbols(spark):
    frame = spark.createDataFrame
    scopes = frame([("f", 1, 10, 20), ("f", 2, 12, 15), ("f", 3, 30, None), ("g", 1, 5, 6)], "file string, scope long, lo long, hi long")
    chain = [("f", 100 + i, f"a{i}", f"a{i + 1}") for i in range(50)] + [("f", 200, "a50", "os.path")]
    rows = [("f", 1, "x", "mod.x"), ("f", 11, "x", "inner"), ("f", 13, "y", "x.go"), ("f", 31, "c", "d"), ("f", 32, "d", "c"), ("f", 33, "e", "c.z"), ("g", 1, "n", None), ("g", 2, None, "q")]
    uses = [("f", 13, "x"), ("f", 14, "y"), ("f", 18, "y"), ("f", 25, "x"), ("f", 40, "c"), ("f", 41, "e"), ("f", 300, "a0"), ("f", 300, "a49"), ("g", 7, "n"), ("g", 7, "x"), ("g", 7, None)]
    got = {(r["file"], r["line"], r["name"]): (r["scope"], r["symbol"], r["status"]) for r in symbols.resolved(scopes, frame(rows + chain, "file string, line long, name string, target string"), frame(uses, "file string, line long, name string")).collect()}
    assert got == {
        ("f", 13, "x"): (2, "inner", "EXTERNAL"), ("f", 14, "y"): (2, "inner.go", "EXTERNAL"), ("f", 18, "y"): (1, None, "UNBOUND"), ("f", 25, "x"): (0, "mod.x", "EXTERNAL"),
        ("f", 40, "c"): (3, None, "CYCLE"), ("f", 41, "e"): (3, None, "CYCLE"), ("f", 300, "a0"): (3, "os.path", "EXTERNAL"), ("f", 300, "a49"): (3, "os.path", "EXTERNAL"),
        ("g", 7, "n"): (0, None, "EXTERNAL"), ("g", 7, "x"): (0, None, "UNBOUND"),
    }


def test_containment(spark):
    rng = random.Random(8)
    make = lambda n: [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for i in range(n)] + [(n, None), (n + 1, "")]
    left, right = make(80), make(80)
    got = {(r["left_id"], r["right_id"]): r["held"] for r in containment.either_way(spark.createDataFrame(left, "id long, text string"), spark.createDataFrame(right, "id long, text string"), 4).collect()}
    want = {(i, j): "both" if a == b else "left" if a in b else "right" for i, a in left for j, b in right if a and b and (a in b or b in a)}
    assert got == want
    plan = containment.held_in(spark.createDataFrame(left, "id long, text string"), spark.createDataFrame(right, "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_constant_trees(spark):
    rows = [
        (1, 1, None, 0, "concat", None), (1, 2, 1, 0, "const", "a"), (1, 3, 1, 1, "upper", None), (1, 4, 3, 0, "const", "b"),
        (2, 1, None, 0, "concat", None), (2, 2, 1, 0, "dynamic", None), (2, 3, 1, 1, "unknown", None),
        (3, 1, None, 0, "choice", None), (3, 2, 1, 0, "const", "s"), (3, 3, 1, 1, "const", "s"),
        (4, 1, None, 0, "choice", None), (4, 2, 1, 0, "const", "s"), (4, 3, 1, 1, "const", "t"),
        (5, 1, None, 0, "sqrt", None), (5, 2, 1, 0, "const", "4"), (6, 1, None, 0, "concat", None), (7, 1, None, 0, "const", None), (8, 1, 2, 0, "concat", None), (8, 2, 1, 0, "concat", None),
    ]
    rows += [(9, i, i - 1 if i > 1 else None, 0, "trim", None) for i in range(1, 13)] + [(9, 13, 12, 0, "const", " x ")]
    got = {(r["tree"], r["node"]): (r["kind"], r["value"]) for r in expressions.folded(spark.createDataFrame(rows, "tree long, node long, parent long, pos int, op string, value string")).collect()}
    assert [got[t, 1] for t in (1, 2, 3, 4, 5, 6, 7)] == [("CONSTANT", "aB"), ("DYNAMIC", None), ("CONSTANT", "s"), ("UNKNOWN", None), ("UNKNOWN", None), ("UNKNOWN", None), ("UNKNOWN", None)]
    assert (8, 1) not in got and got[9, 1] == ("UNKNOWN", None)
