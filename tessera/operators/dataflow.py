"""Fixpoints over control-flow graphs, many functions at once: reaching definitions, taint, constants, dominance.

cfg: fn, src, dst. Statements: fn, node, and what they define or use. All state
is a table keyed by function and node; each round joins the front with the
edges out of it, and rounds end when nothing is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.tables import cut


def reaching(cfg: DataFrame, defs: DataFrame) -> DataFrame:
    """fn, node, var, def: definitions of var that may hold where node begins. A node that defines var kills all others.

    defs: fn, node, var. A definition flows out of its node; it flows on through nodes that don't define its variable.
    """
    edges = cut(cfg.select("fn", "src", "dst").distinct())
    own = cut(defs.select("fn", "node", "var").distinct())
    kills = own.select("fn", F.col("node").alias("src"), "var")
    front = own.select("fn", F.col("node").alias("src"), "var", F.col("node").alias("def")).join(edges, ["fn", "src"]).select("fn", F.col("dst").alias("node"), "var", "def").distinct()
    seen = front = cut(front)
    while not front.isEmpty():
        out = front.withColumnRenamed("node", "src").join(kills, ["fn", "src", "var"], "left_anti")
        near = out.join(edges, ["fn", "src"]).select("fn", F.col("dst").alias("node"), "var", "def").distinct()
        front = cut(near.join(seen, ["fn", "node", "var", "def"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def use_definitions(reached: DataFrame, uses: DataFrame) -> DataFrame:
    """fn, node, var and defs: the definitions that each use (fn, node, var) may see, in order; none: undefined."""
    return uses.join(reached, ["fn", "node", "var"], "left").groupBy("fn", "node", "var").agg(F.array_sort(F.collect_set("def")).alias("defs"))


def meet(values: Column) -> Column:
    """Of the constants that may reach a place: the one constant, or null (any value) if they differ or one is unknown."""
    return F.when(F.count(values) == F.count(F.lit(1)), F.when(F.min(values) == F.max(values), F.min(values)))


def constants(reached: DataFrame, values: DataFrame) -> DataFrame:
    """fn, node, var, value: what var is known to be where node begins; values: fn, node, var, value (null: not constant)."""
    given = values.select("fn", F.col("node").alias("def"), "var", "value")
    return reached.join(given, ["fn", "def", "var"], "left").groupBy("fn", "node", "var").agg(meet(F.col("value")).alias("value"))


def taint(cfg: DataFrame, statements: DataFrame) -> DataFrame:
    """fn, source, sink, status: CORRELATED if some path from source to sink passes no sanitiser, BLOCKED if all do, UNKNOWN if none leads there.

    statements: fn, node, role (source, sink, sanitizer or other). A pair is made for the sinks and sources of a function.
    """
    edges = cut(cfg.select("fn", "src", "dst").distinct())
    own = cut(statements.select("fn", "node", "role"))
    stops = own.filter("role = 'sanitizer'").select("fn", F.col("node").alias("at"), F.lit(True).alias("clean"))
    seen = front = cut(own.filter("role = 'source'").select("fn", F.col("node").alias("source"), F.col("node").alias("at"), F.lit(False).alias("clean")))
    while not front.isEmpty():
        near = front.join(edges, (front["fn"] == edges["fn"]) & (front["at"] == edges["src"])).select(front["fn"], "source", F.col("dst").alias("at"), F.col("clean").alias("was"))
        near = near.join(stops, ["fn", "at"], "left").select("fn", "source", "at", (F.col("was") | F.coalesce("clean", F.lit(False))).alias("clean")).distinct()
        front = cut(near.join(seen, ["fn", "source", "at", "clean"], "left_anti"))
        seen = cut(seen.unionByName(front))
    reached = seen.groupBy("fn", "source", F.col("at").alias("sink")).agg(F.bool_and("clean").alias("clean"))
    pairs = own.filter("role = 'source'").select("fn", F.col("node").alias("source")).join(own.filter("role = 'sink'").select("fn", F.col("node").alias("sink")), "fn")
    status = F.when(F.col("clean").isNull(), "UNKNOWN").when(F.col("clean"), "BLOCKED").otherwise("CORRELATED")
    return pairs.join(reached, ["fn", "source", "sink"], "left").select("fn", "source", "sink", status.alias("status"))


def immediate_dominators(dominators: DataFrame) -> DataFrame:
    """id, idom from pairs (id, dom) with id among its own: the strict dominator that all other strict ones dominate."""
    n = dominators.groupBy(F.col("id").alias("dom")).agg(F.count(F.lit(1)).alias("n"))
    strict = dominators.filter("id <> dom").join(n, "dom")
    return strict.groupBy("id").agg(F.max_by("dom", "n").alias("idom"))


def frontier(edges: DataFrame, dominators: DataFrame) -> DataFrame:
    """id, front: nodes that id does not strictly dominate although it dominates one of their predecessors."""
    above = edges.select("src", "dst").distinct().join(dominators.select(F.col("id").alias("src"), F.col("dom").alias("id")), "src")
    strict = dominators.filter("id <> dom").select(F.col("id").alias("dst"), F.col("dom").alias("id"))
    return above.select("id", "dst").distinct().join(strict, ["id", "dst"], "left_anti").select("id", F.col("dst").alias("front"))
