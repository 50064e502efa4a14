"""Summaries of functions: what flows from parameters and sources to returns and sinks, across calls.

flows: fn, src, dst, value flow inside a function between variables. Names S (any source), P0, P1, ... (parameters), R
(the returned value) and K (any sink) are places of their own. calls: fn, line, callee, dst. bound: fn, line, pos, var, the
variable that each parameter of the callee gets. A summary is a set of facts (fn, src, dst) with src S or a parameter and
dst R or K. At a call, P2 to R of the callee is a flow from the third argument to dst, and so on.

Functions are taken by components of the call graph, callees first: a component's level is the longest way from it to one
that calls none. A level is one pass: what callees below give is joined to its calls, and each component is solved in one
task, its rows sorted and streamed there. Components of more than large (200,000) rows take rounds of joins, with the same
facts. Within a component new facts alone are taken again, until none is left. Rounds that bring a recursive component
facts are counted for each component; one that gets some in more than limit (32) of them is given up: its facts are dropped,
its status is NON_CONVERGED, and callers get a flow from U (unknown).
Calls of functions that are not in functions give U as well. Null keys and places take no part. Repeated rows change
nothing. Empty tables: no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators import paths
from tessera.tables import cut, discard, shared_folder

LIMIT = 32
LARGE = 200_000
#: What a row of a component is. A call inside it waits for facts, one of a lower level has them.
FLOW, START, INNER, OUTER = range(4)
ORIGIN = "S|U|P[0-9]+"


def bound_arguments(args: DataFrame, params: DataFrame) -> DataFrame:
    """fn, line, pos, var from args (fn, line, callee, pos, name, var; pos or name is null) and params (fn, pos, name).

    Arguments go by position, or by the parameter's name, which wins. Others are left out.
    """
    own = params.select(F.col("fn").alias("callee"), F.col("pos").alias("p"), F.col("name").alias("p_name"))
    place = args.filter("name IS NULL").join(own, (args["callee"] == own["callee"]) & (args["pos"] == own["p"]))
    named = args.filter("name IS NOT NULL").join(own, (args["callee"] == own["callee"]) & (args["name"] == own["p_name"]))
    both = place.select("fn", "line", "p", "var", F.lit(0).alias("w")).unionByName(named.select("fn", "line", "p", "var", F.lit(1).alias("w")))
    return both.groupBy("fn", "line", F.col("p").alias("pos")).agg(F.max(F.struct("w", "var")).getField("var").alias("var"))


def ordered(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """fn, comp, recursive, level: components of the call graph, those that call no other at level 0.

    Functions that call each other are put together first. Only what then has no level, being on or above a longer
    circle, is parted by paths.strong_components.
    """
    nodes = cut(functions.filter("fn IS NOT NULL").select(F.col("fn").alias("id")).distinct())
    edges = calls.select(F.col("fn").alias("src"), F.col("callee").alias("dst")).distinct()
    edges = cut(edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
    mutual = cut(edges.filter("src < dst").join(edges.filter("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi"))
    comps = nodes.withColumn("comp", F.col("id"))
    if not mutual.isEmpty():
        comps = _renamed(comps, paths.components(mutual.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), mutual))
    named, level = _levels(comps, edges)
    stuck = level.filter("level IS NULL").select("id")
    if not stuck.isEmpty():
        up = named.filter("ca <> cb").select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct()
        up = up.join(stuck.withColumnRenamed("id", "src"), "src", "left_semi").join(stuck.withColumnRenamed("id", "dst"), "dst", "left_semi")
        comps = _renamed(comps, paths.strong_components(stuck, up))
        named, level = _levels(comps, edges)
    inner = named.filter("ca = cb").select(F.col("ca").alias("comp")).distinct().withColumn("recursive", F.lit(True))
    level = level.withColumnRenamed("id", "comp")
    return cut(comps.join(level, "comp").join(inner, "comp", "left").select(F.col("id").alias("fn"), "comp", F.coalesce("recursive", F.lit(False)).alias("recursive"), "level"))


def _renamed(comps: DataFrame, names: DataFrame) -> DataFrame:
    """Components (id, comp) some of which names (id, comp) puts together; names are least ids, so they stay that."""
    new = names.select(F.col("id").alias("comp"), F.col("comp").alias("new"))
    return cut(comps.join(new, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")))


def _levels(comps: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between components (ca, cb), once each, and the level of each component (id, level)."""
    a, b = comps.select(F.col("id").alias("src"), F.col("comp").alias("ca")), comps.select(F.col("id").alias("dst"), F.col("comp").alias("cb"))
    named = cut(edges.join(a, "src").join(b, "dst").select("ca", "cb").distinct())
    up = named.filter("ca <> cb").select(F.col("cb").alias("src"), F.col("ca").alias("dst"))
    return named, cut(paths.levels(comps.select(F.col("comp").alias("id")).distinct(), up))


def solve(functions: DataFrame, flows: DataFrame, calls: DataFrame, bound: DataFrame, limit: int = LIMIT, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Facts (fn, src, dst), and fn, recursive, level, status (PRECISE or NON_CONVERGED)."""
    order = ordered(functions, calls)
    rows = cut(_rows(order, flows, calls, bound))
    many = cut(rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("comp"))
    some = not many.isEmpty()
    spark = order.sparkSession
    found = spark.createDataFrame([], f"fn {dict(order.dtypes)['fn']}, facts string, late boolean")
    schema, folder = found.schema, f"{shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
    run = _streamed(limit, to_arrow_schema(schema))
    top = order.agg(F.max("level")).first()[0]
    for level in range((-1 if top is None else top) + 1):
        own = rows.filter(F.col("level") == level).drop("level")
        ready, waits = own.filter(F.col("part") != OUTER).withColumn("facts", F.lit(None).cast("string")), own.filter(F.col("part") == OUTER)
        own = ready.unionByName(waits.join(found.select(F.col("fn").alias("callee"), "facts"), "callee")) if level else ready
        small = own.join(many, "comp", "left_anti") if some else own
        small = small.select("comp", "fn", "recursive", "part", "callee", "param", "var", "to", "facts")
        new = small.repartition("comp").sortWithinPartitions("comp").mapInArrow(run, schema)
        new = new.unionByName(_rounds(cut(own.join(many, "comp", "left_semi")), limit)) if some else new
        new.write.mode("append").parquet(folder)
        found = spark.read.schema(schema).parquet(folder)  # the levels written so far
    late = found.filter("late").select("fn").withColumn("status", F.lit("NON_CONVERGED"))
    facts = found.select("fn", F.explode(F.split("facts", " ")).alias("fact")).selectExpr("fn", "left(fact, length(fact) - 1) AS src", "right(fact, 1) AS dst")
    return facts, order.join(late, "fn", "left").select("fn", "recursive", "level", F.coalesce("status", F.lit("PRECISE")).alias("status"))


def _rows(order: DataFrame, flows: DataFrame, calls: DataFrame, bound: DataFrame) -> DataFrame:
    """comp, level, recursive, fn, part, callee, param, var, to: flows and starts from var to to, and calls, those of arguments
    with the parameter and the variable that it gets, those of results without."""
    results = calls.select("fn", "callee", F.lit(None).cast("string").alias("param"), F.lit(None).cast("string").alias("var"), F.col("dst").alias("to"))
    given = bound.select("fn", "line", F.concat(F.lit("P"), "pos").alias("param"), "var").join(calls.select("fn", "line", "callee", F.col("dst").alias("to")), ["fn", "line"])
    sites = results.unionByName(given.select("fn", "callee", "param", "var", "to"))
    sites = sites.join(order.select(F.col("fn").alias("callee"), F.col("comp").alias("of"), F.lit(True).alias("known")), "callee", "left")
    lost = F.col("known").isNull()
    sites = sites.filter(~lost | F.col("param").isNull()).withColumn("var", F.when(lost, "U").otherwise(F.col("var"))).withColumn("part", F.when(lost, START).otherwise(INNER))
    kind, of = dict(order.dtypes)["fn"], dict(order.dtypes)["comp"]
    own = flows.filter("src IS NOT NULL AND dst IS NOT NULL").select("fn", F.lit(FLOW).alias("part"), F.lit(None).cast(kind).alias("callee"), F.lit(None).cast("string").alias("param"), F.col("src").alias("var"), F.col("dst").alias("to"), F.lit(None).cast(of).alias("of"))
    rows = own.unionByName(sites.select("fn", "part", "callee", "param", "var", "to", "of")).join(order, "fn")
    part = F.when((F.col("part") == INNER) & (F.col("of") != F.col("comp")), OUTER).otherwise(F.col("part"))
    return rows.select("comp", "level", "recursive", "fn", part.alias("part"), "callee", "param", "var", "to").sortWithinPartitions("level")


def _given(param: str | None, var: str | None, to: str | None, facts: list[tuple[str, str]]) -> Iterator[tuple[int, str, str]]:
    """What a callee's facts make of an argument, flows, or of a result, starts."""
    for src, dst in facts:
        end = "K" if dst == "K" else to
        if param is None:
            if src in ("S", "U") and dst == "R" and to is not None:
                yield START, src, to
        elif src == param and var is not None and end is not None:
            yield FLOW, var, end


def _component(rows: Iterator[tuple], limit: int) -> tuple[set[tuple], set[tuple], bool]:
    """Functions, facts, and whether they are given up, of a component's rows."""
    origin = re.compile(ORIGIN).fullmatch
    fns, ways, seen, recursive = set(), defaultdict(set), set(), False
    waits, results = defaultdict(set), defaultdict(set)
    for _, fn, recursive, part, callee, param, var, to, facts in rows:
        fns.add(fn)
        if part == INNER:
            if param is None:
                results[callee].add((fn, to))
            else:
                waits[callee, param].add((fn, var, to))
            continue
        for kind, a, b in [(part, var, to)] if part != OUTER else _given(param, var, to, [(f[:-1], f[-1]) for f in facts.split(" ")]):
            if a is None or b is None:
                continue
            if kind == FLOW:
                ways[fn, a].add(b)
            if kind == START or part == FLOW and origin(a):
                seen.add((fn, a, b))
    front, passes = seen, 0
    at = defaultdict(set)  # what has come to a place, if calls may still add ways from there
    while front:
        new = [x for x in front if x[2] in ("R", "K")]
        passes += bool(recursive and new)
        if passes > limit:
            return fns, set(), True
        near = set()
        if recursive:
            for fn, src, place in front:
                at[fn, place].add(src)
        for fn, src, end in new:
            for caller, var, to in waits.get((fn, src), ()):
                for _, a, b in _given(src, var, to, [(src, end)]):
                    ways[caller, a].add(b)
                    near.update((caller, x, b) for x in at.get((caller, a), ()))
            for caller, to in results.get(fn, ()):
                near.update((caller, x, b) for _, x, b in _given(None, None, to, [(src, end)]))
        for fn, src, place in front:
            near.update((fn, src, b) for b in ways.get((fn, place), ()))
        front = near - seen
        seen = seen | front
    return fns, {x for x in seen if x[2] in ("R", "K")}, False


def _streamed(limit: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of components, sorted by them, as a row for each function that has facts: these as one text, such as P0R SK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
        out = []
        for _, own in groupby(rows, key=itemgetter(0)):
            fns, facts, late = _component(own, limit)
            if late:
                out += [(fn, "UR", True) for fn in fns]
            else:
                by = defaultdict(list)
                for fn, src, end in facts:
                    by[fn].append(src + end)
                out += [(fn, " ".join(x), False) for fn, x in by.items()]
            if len(out) > 10_000:
                yield made()
                out = []
        if out:
            yield made()

    return run


def _rounds(own: DataFrame, limit: int) -> DataFrame:
    """What _streamed makes, of components of any size: rounds of joins."""
    fact = F.explode(F.split("facts", " ")).alias("fact")
    outer = own.filter(F.col("part") == OUTER).select("fn", "param", "var", "to", fact).select("fn", "param", "var", "to", F.expr("left(fact, length(fact) - 1)").alias("src"), F.expr("right(fact, 1)").alias("end"))
    flow = own.filter(F.col("part") == FLOW).select("fn", F.col("var").alias("src"), F.col("to").alias("dst"))
    inner = own.filter(F.col("part") == INNER)
    given, results = cut(inner.filter("param IS NOT NULL").select("fn", "callee", "param", "var", "to").distinct()), cut(inner.filter("param IS NULL AND to IS NOT NULL").select("fn", "callee", "to").distinct())
    through = outer.filter("param = src").select("fn", F.col("var").alias("src"), F.when(F.col("end") == "K", "K").otherwise(F.col("to")).alias("dst"))
    ways = cut(flow.unionByName(through.filter("dst IS NOT NULL")).distinct())
    starts = flow.filter(F.col("src").rlike(f"^({ORIGIN})$")).unionByName(own.filter((F.col("part") == START) & F.col("to").isNotNull()).select("fn", F.col("var").alias("src"), F.col("to").alias("dst")))
    starts = starts.unionByName(outer.filter("param IS NULL AND src IN ('S', 'U') AND end = 'R' AND to IS NOT NULL").select("fn", "src", F.col("to").alias("dst")))
    seen = front = cut(starts.select("fn", "src", F.col("dst").alias("at")).distinct())
    members = cut(own.select("fn", "comp", "recursive").distinct())
    counted = cut(members.filter("recursive").select("comp", F.lit(0).alias("n")).distinct())
    while not front.isEmpty():
        hit = front.filter("at IN ('R', 'K')").join(members, "fn").select("comp", F.lit(1).alias("n")).distinct()
        counted = cut(counted.unionByName(hit.join(counted, "comp", "left_semi")).groupBy("comp").agg(F.sum("n").alias("n")))
        # those that are given up leave the rounds, and no others
        front = front.join(members.join(counted.filter(F.col("n") > limit), "comp", "left_semi"), "fn", "left_anti")
        facts = seen.filter("at IN ('R', 'K')").select("fn", "src", F.col("at").alias("dst"))
        new = front.filter("at IN ('R', 'K')").select("fn", "src", F.col("at").alias("dst"))
        along = front.join(ways, (front["fn"] == ways["fn"]) & (front["at"] == ways["src"])).select(front["fn"], front["src"], F.col("dst").alias("at"))
        # calls inside a component: what is new of the callee with all that is known of the caller, and the other way round
        now, old = _through(given, new), _through(given, facts)
        a = seen.join(now, (seen["fn"] == now["fn"]) & (seen["at"] == now["src"])).select(seen["fn"], seen["src"], F.col("dst").alias("at"))
        b = front.join(old, (front["fn"] == old["fn"]) & (front["at"] == old["src"])).select(front["fn"], front["src"], F.col("dst").alias("at"))
        near = reduce(DataFrame.unionByName, [along, a, b, _returned(results, new)]).distinct()
        front = cut(near.join(seen, ["fn", "src", "at"], "left_anti"))
        before, seen = seen, cut(seen.unionByName(front))
        discard(before)
    late = members.join(counted.filter(F.col("n") > limit), "comp", "left_semi").select("fn")
    facts = seen.filter("at IN ('R', 'K')").join(late, "fn", "left_anti").groupBy("fn").agg(F.array_join(F.collect_set(F.concat("src", "at")), " ").alias("facts"))
    return facts.withColumn("late", F.lit(False)).unionByName(late.select("fn", F.lit("UR").alias("facts"), F.lit(True).alias("late")))


def _through(given: DataFrame, facts: DataFrame) -> DataFrame:
    """fn, src, dst: flows that callees' facts make of arguments."""
    f = facts.select(F.col("fn").alias("callee"), F.col("src").alias("param"), F.col("dst").alias("end"))
    return given.join(f, ["callee", "param"]).select("fn", F.col("var").alias("src"), F.when(F.col("end") == "K", "K").otherwise(F.col("to")).alias("dst")).filter("dst IS NOT NULL")


def _returned(results: DataFrame, facts: DataFrame) -> DataFrame:
    """fn, src, at: where callees give a source's or an unknown value."""
    f = facts.filter("src IN ('S', 'U') AND dst = 'R'").select(F.col("fn").alias("callee"), "src")
    return results.join(f, "callee").select("fn", "src", F.col("to").alias("at"))
