"""Constant evaluation of expression trees kept as rows, from the leaves up, all trees at once.

nodes: tree, node, parent, pos, op, value. Leaves: const has its value as text, dynamic comes from outside, unknown is what
nothing is known of. Inner nodes: concat (parts in order of pos), upper, lower, trim (one part), choice (parts are what may be
taken: constant only if all are the same) and any other operation, of which nothing is known.

A node is DYNAMIC if a part is, else UNKNOWN if a part is or it lies deeper than depth below its root (10), else CONSTANT.
Rounds go by the distance to the deepest leaf: a round folds the nodes whose parts are all done, so a tree of depth d takes d
rounds of one join, and parts never leave the rows of their own tree.

Null ops are unknown, null values of constants too. Nodes without tree or node, and those on a circle of parents, are left
out. Parts that share a pos go by node. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import cut

DEPTH = 10
LEAVES = ("const", "dynamic", "unknown")
CONSTANT, DYNAMIC, UNKNOWN = "CONSTANT", "DYNAMIC", "UNKNOWN"


def depths(nodes: DataFrame) -> DataFrame:
    """tree, node, parent, pos, op, value, depth: the number of edges to the root, from roots down."""
    rows = cut(nodes.filter("tree IS NOT NULL AND node IS NOT NULL").select("tree", "node", "parent", "pos", F.coalesce("op", F.lit("unknown")).alias("op"), "value"))
    front = rows.filter("parent IS NULL").select("tree", "node", F.lit(0).alias("depth"))
    found = None
    while True:
        front = cut(front)
        if front.isEmpty():
            break
        found = front if found is None else found.unionByName(front)
        front = rows.select("tree", "node", "parent").join(front.select("tree", F.col("node").alias("parent"), "depth"), ["tree", "parent"]).select("tree", "node", (F.col("depth") + 1).alias("depth"))
    return rows.join(front if found is None else found, ["tree", "node"])


def folded(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tree, node, kind, value: what each node is; value is null unless it is CONSTANT."""
    rows = cut(depths(nodes))
    leaf = F.col("op").isin(*LEAVES)
    kind = F.when(F.col("depth") > depth, UNKNOWN).when(F.col("op") == "dynamic", DYNAMIC).when((F.col("op") == "const") & F.col("value").isNotNull(), CONSTANT).otherwise(UNKNOWN)
    deepest = rows.agg(F.max("depth")).first()[0]
    done = None
    below = None  # of the level below: tree, parent, and what its parts make
    for d in range(-1 if deepest is None else deepest, -1, -1):
        own = rows.filter(F.col("depth") == d)
        made = own.filter(leaf).select("tree", "node", "parent", "pos", kind.alias("kind"), F.when(kind == CONSTANT, F.col("value")).alias("value"))
        if below is not None:
            own = own.filter(~leaf).join(below, ["tree", "node"], "left")
        else:
            own = own.filter(~leaf).withColumns({"n": F.lit(0), "state": F.lit(UNKNOWN), "parts": F.array().cast("array<string>")})
        parts, op = F.col("parts"), F.col("op")
        one = F.when(F.size(parts) == 1, parts[0])
        text = F.when(op == "concat", F.array_join(parts, "")).when(op == "upper", F.upper(one)).when(op == "lower", F.lower(one)).when(op == "trim", F.trim(one)).when(op == "choice", F.when(F.size(F.array_distinct(parts)) == 1, parts[0]))
        state = F.when(F.coalesce("n", F.lit(0)) == 0, UNKNOWN).when(F.col("state") != CONSTANT, F.col("state")).when(F.col("depth") > depth, UNKNOWN).when(text.isNull(), UNKNOWN).otherwise(CONSTANT)
        made = cut(made.unionByName(own.select("tree", "node", "parent", "pos", state.alias("kind"), F.when(state == CONSTANT, text).alias("value"))))
        done = made if done is None else done.unionByName(made)
        order = F.array_sort(F.collect_list(F.struct("pos", "node", "value")))
        worst = F.when(F.bool_or(F.col("kind") == DYNAMIC), DYNAMIC).when(F.bool_or(F.col("kind") == UNKNOWN), UNKNOWN).otherwise(CONSTANT)
        below = made.filter("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), worst.alias("state"), F.transform(order, lambda x: x["value"]).alias("parts"))
    if done is None:
        return rows.select("tree", "node", F.lit(UNKNOWN).alias("kind"), "value")
    return done.select("tree", "node", "kind", "value")
