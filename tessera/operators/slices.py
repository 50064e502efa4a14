"""Backward slices from sinks, on demand and with budgets.

defs: fn, line, var, op, src, callee. op source, const and sanitizer end a walk; copy goes on with src; call with what callee
returns. uses: fn, line, var, places where a variable is read: sinks, copies' sources, arguments and returns are taken from
their own tables. params: fn, pos, var. args: fn, line, callee, pos, var. returns: fn, line, var.

What a variable holds before a line is what the last line before it that sets it gave it, found once for all places that
can be asked, by one window. A walk then follows pointers. Its step back costs a step of the flow budget, and one of the call
budget if it enters or leaves a function. All walks of a sink share a budget of nodes: a step of theirs is taken only if all
places that it leads to are within it, so no row is made beyond it, however many callers a function has.

Walks end as TAINTED, STATIC, SANITIZED or UNKNOWN, and say why: source, const, sanitizer, flow, call, nodes, cycle (the
same variable of the same function again) or undefined. Null keys take no part. Repeated rows give repeated walks. Empty
tables: no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import cut

FLOW, CALL, NODES = 10, 5, 100
#: What ends a walk by itself, and how it is judged.
ENDS = {"source": "TAINTED", "const": "STATIC", "sanitizer": "SANITIZED"}


def settings(defs: DataFrame, places: DataFrame) -> DataFrame:
    """places (fn, line, var) with at: the last line before that sets the variable, or null."""
    marks = defs.select("fn", "line", "var", F.lit(True).alias("sets")).unionByName(places.select("fn", "line", "var", F.lit(False).alias("sets")).distinct())
    before = Window.partitionBy("fn", "var").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("at", F.max(F.when(F.col("sets"), F.col("line"))).over(before)).filter("NOT sets").select("fn", "line", "var", "at")


def steps(defs: DataFrame, sinks: DataFrame, params: DataFrame, args: DataFrame, returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each place (fn, line, var): how a walk ends there or null, and n, the places it leads to; and those places, with in_call."""
    place = ["fn", "line", "var"]
    places = reduce(DataFrame.unionByName, [x.select(*place) for x in (sinks, defs.filter("op = 'copy'").select("fn", "line", F.col("src").alias("var")), args, returns)]).distinct()
    found = settings(defs, places).join(defs.select("fn", F.col("line").alias("at"), "var", "op", "src", "callee"), ["fn", "at", "var"], "left")
    found = cut(found.join(params.select("fn", "var", "pos"), ["fn", "var"], "left"))
    to = lambda fn, line, var, inner: (F.col(fn).alias("to_fn"), F.col(line).alias("to_line"), F.col(var).alias("to_var"), F.lit(inner).alias("in_call"))
    copies = found.filter("op = 'copy'").select(*place, *to("fn", "at", "src", 0))
    back = returns.select(F.col("fn").alias("callee"), F.col("line").alias("r_line"), F.col("var").alias("r_var"))
    entered = found.filter("op = 'call'").join(back, "callee").select(*place, *to("callee", "r_line", "r_var", 1))
    callers = args.select(F.col("callee").alias("fn"), "pos", F.col("fn").alias("c_fn"), F.col("line").alias("c_line"), F.col("var").alias("c_var"))
    left = found.filter("at IS NULL AND pos IS NOT NULL").join(callers, ["fn", "pos"]).select(*place, *to("c_fn", "c_line", "c_var", 1))
    ways = cut(copies.unionByName(entered).unionByName(left))
    n = ways.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("in_call").alias("crosses"))
    end = F.when(F.col("op").isin(*ENDS), F.col("op")).when(F.coalesce("n", F.lit(0)) == 0, "undefined")
    return cut(found.join(n, place, "left").select(*place, end.alias("end"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crosses", F.lit(0)).alias("crosses"))), ways


def walks(defs: DataFrame, sinks: DataFrame, params: DataFrame, args: DataFrame, returns: DataFrame, flow: int = FLOW, call: int = CALL, nodes: int = NODES) -> DataFrame:
    """sink_fn, sink_line, reason, hops: how each walk back from each sink (fn, line, var) ended."""
    at, ways = steps(defs, sinks, params, args, returns)
    place, sink = ["fn", "line", "var"], ["sink_fn", "sink_line"]
    known = F.concat_ws(":", "fn", "var")
    now = cut(sinks.select(F.col("fn").alias("sink_fn"), F.col("line").alias("sink_line"), *place, F.lit(0).alias("hops"), F.lit(0).alias("calls"), F.lit(1).cast("long").alias("seen"), F.array().cast("array<string>").alias("path")))
    done: list[DataFrame] = []
    for _ in range(flow + 1):
        rows = now.join(at, place)
        stop = F.when(F.col("hops") >= flow, "flow").when(F.col("calls") >= call, "call").when(F.array_contains("path", known), "cycle").otherwise(F.col("end"))
        rows = rows.withColumn("stop", stop)
        more = F.sum(F.when(F.col("stop").isNull(), F.col("n")).otherwise(0)).over(Window.partitionBy(*sink))
        rows = cut(rows.withColumn("seen", F.col("seen") + more).withColumn("stop", F.coalesce("stop", F.when(F.col("seen") > nodes, "nodes"))))
        done.append(rows.filter("stop IS NOT NULL").select(*sink, F.col("stop").alias("reason"), "hops"))
        on = rows.filter("stop IS NULL").join(ways, place)
        now = on.select(*sink, F.col("to_fn").alias("fn"), F.col("to_line").alias("line"), F.col("to_var").alias("var"), (F.col("hops") + 1).alias("hops"), (F.col("calls") + F.col("in_call")).alias("calls"), "seen", F.concat("path", F.array(known)).alias("path"))
        now = cut(now)
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def verdicts(walked: DataFrame) -> DataFrame:
    """sink_fn, sink_line, verdict, n_walks, reasons (name:count in order of names) and hops, the longest walk's.

    TAINTED if any walk finds a source, else UNKNOWN if any did not come to an end, else SANITIZED if any was, else STATIC.
    """
    by = walked.groupBy("sink_fn", "sink_line", "reason").agg(F.count(F.lit(1)).alias("n"), F.max("hops").alias("hops"))
    has = lambda *names: F.bool_or(F.col("reason").isin(*names))
    verdict = F.when(has("source"), "TAINTED").when(F.bool_or(~F.col("reason").isin(*ENDS)), "UNKNOWN").when(has("sanitizer"), "SANITIZED").otherwise("STATIC")
    reasons = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "reason", "n"))), " ")
    return by.groupBy("sink_fn", "sink_line").agg(verdict.alias("verdict"), F.sum("n").alias("n_walks"), reasons.alias("reasons"), F.max("hops").alias("hops"))
