"""Static single assignment and abstract values, many functions at once, as joins over tables keyed by function and node.

cfg: fn, src, dst. defs: fn, node, var; a node's number is its place, and a node
defines a variable once. All functions are taken in the same rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dataflow import reaching
from tessera.tables import cut

#: What may be known of a value, each a bit in this order.
FACTS = ("NUMERIC", "INTEGER", "DIGITS_ONLY", "SHELL_ESCAPED", "HTML_ESCAPED", "SQL_ESCAPED", "PATH_NORMALIZED")


def converted(cfg: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions with their versions, and which of them holds where each node begins.

    First: fn, node, var, phi, version. A phi stands at each node with several predecessors for every variable of which
    a definition gets there; it comes before the node's own definition. Versions count from 1 by node.
    Second: fn, node, var, version: what reaches a node's beginning; at a phi these are its operands, and elsewhere
    there is one at most. A path on which a variable has no definition gives no operand.
    """
    edges = cut(cfg.select("fn", "src", "dst").distinct())
    own = cut(defs.select("fn", "node", "var").distinct())
    merges = edges.groupBy("fn", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fn", "node")
    phis = cut(reaching(edges, own).join(merges, ["fn", "node"], "left_semi").select("fn", "node", "var").distinct())
    both = own.withColumn("phi", F.lit(False)).unionByName(phis.withColumn("phi", F.lit(True)))
    versions = cut(both.selectExpr("*", "row_number() OVER (PARTITION BY fn, var ORDER BY node, NOT phi) AS version"))
    last = versions.groupBy("fn", F.col("node").alias("def"), "var").agg(F.max("version").alias("version"))
    return versions, reaching(edges, both).join(last, ["fn", "def", "var"]).select("fn", "node", "var", "version")


def used(versions: DataFrame, reached: DataFrame, uses: DataFrame) -> DataFrame:
    """fn, node, var, version of each use (fn, node, var): the node's phi, else what reaches it, else 0."""
    phi = versions.filter("phi").select("fn", "node", "var", F.col("version").alias("own"))
    one = reached.groupBy("fn", "node", "var").agg(F.max("version").alias("from"))
    both = uses.select("fn", "node", "var").distinct().join(phi, ["fn", "node", "var"], "left").join(one, ["fn", "node", "var"], "left")
    return both.select("fn", "node", "var", F.coalesce("own", "from", F.lit(0)).alias("version"))


def joined_taint(state: Column) -> Column:
    """What is known where paths meet, as an aggregate: the one state, else TAINTED if any path may be, else UNKNOWN."""
    s = F.coalesce(state, F.lit("UNKNOWN"))
    return F.when(F.min(s) == F.max(s), F.min(s)).when(F.bool_or(s.isin("TAINTED", "CONSTRAINED")), "TAINTED").otherwise("UNKNOWN")


def fact_bits(facts: Column) -> Column:
    """Facts (an array of names) as a number with a bit for each; unknown names have none."""
    return sum((F.when(F.array_contains(facts, f), 1 << i).otherwise(0) for i, f in enumerate(FACTS)), F.lit(0))


def joined_facts(facts: Column) -> Column:
    """The facts that hold on every path, as an aggregate over one number a row."""
    bits = F.bit_and(fact_bits(facts))
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(1 << i) > 0, F.lit(f)) for i, f in enumerate(FACTS))))


def guarded(state: Column, facts: Column) -> Column:
    """The state behind a guard that proves facts: a tainted value is constrained by them, never clean."""
    return F.when((state == "TAINTED") & (F.size(facts) > 0), "CONSTRAINED").otherwise(state)
