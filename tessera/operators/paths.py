"""Reachability, paths, components, cycles and orders as rounds of joins.

Every round is written to the shared folder; rounds end when nothing is new or
the depth is reached. Edges: src, dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import cut, cut_tidy, discard


def distances(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """start, id, hops: the least number of edges from each start (column id), 0 to depth."""
    own = cut(edges.select("src", "dst").distinct())
    seen = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct())
    front = seen
    for hops in range(1, depth + 1):
        near = front.join(own, front["id"] == own["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = cut(near.join(seen, ["start", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def simple_paths(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """path: every path without a repeated node, of 1 to depth edges."""
    front = starts.select(F.array("id").alias("path"))
    out = None
    for _ in range(depth):
        grown = front.join(edges.select("src", "dst").distinct(), F.element_at("path", -1) == F.col("src"))
        front = cut(grown.filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        out = front if out is None else out.unionByName(front)
        if front.isEmpty():
            break
    return out


def shortest_paths(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """start, id and the least path of the fewest edges."""
    own = cut(edges.select("src", "dst").distinct())
    seen = cut(starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path")).distinct())
    front = seen
    for _ in range(depth):
        near = front.join(own, front["id"] == own["src"]).groupBy("start", F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = cut(near.join(seen, ["start", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and the least id it is connected with, edges taken both ways; what a round has replaced is deleted."""
    both = cut_tidy(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut_tidy(nodes.select("id", F.col("id").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), F.col("comp").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        low = labels.join(near, "id", "left").select("id", "comp", F.least("comp", F.coalesce("c", "comp")).alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("up"))
        new = cut_tidy(low.join(jump, "low").select("id", F.col("up").alias("new"), "comp"))
        discard(labels)
        labels = new.select("id", F.col("new").alias("comp"))
        if new.filter("new <> comp").isEmpty():
            discard(both)
            return labels


def _reaching_least(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and the least id that reaches it along edges, itself included; nodes whose label fell go on."""
    labels = cut(nodes.select("id", F.col("id").alias("comp")))
    front = labels
    while not front.isEmpty():
        near = front.join(edges, front["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("comp").alias("c"))
        new = cut(labels.join(near, "id", "left").select("id", F.least("comp", F.coalesce("c", "comp")).alias("comp"), (F.coalesce("c", "comp") < F.col("comp")).alias("moved")))
        labels, front = new.select("id", "comp"), new.filter("moved").select("id", "comp")
    return labels


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and the least id that it reaches and that reaches it.

    By colours: of nodes with the same least node that reaches them, those that lead back to it are its component and
    leave; the others are coloured again. No pairs of nodes are made.
    """
    left, own, done = cut(nodes.select("id").distinct()), cut(edges.select("src", "dst").distinct()), None
    while not left.isEmpty():
        colour = _reaching_least(left, own)
        same = cut(own.join(colour.select(F.col("id").alias("src"), F.col("comp").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("comp").alias("b")), "dst").filter("a = b").select("src", "dst"))
        found = front = cut(colour.filter("id = comp"))
        while not front.isEmpty():
            near = front.join(same, front["id"] == same["dst"]).select(F.col("src").alias("id"), "comp").distinct()
            front = cut(near.join(found, "id", "left_anti"))
            found = cut(found.unionByName(front))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, "id", "left_anti"))
        own = cut(own.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return done if done is not None else nodes.select("id", F.col("id").alias("comp"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes of components of several nodes, and those with an edge to themselves."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    comp = cut(strong_components(ids, edges))
    many = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return comp.join(many, "comp").select("id").unionByName(edges.filter("src = dst").select(F.col("src").alias("id"))).distinct()


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level: the longest path from a root. Nodes on or below a cycle get none (null)."""
    own = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select("id").distinct())
    done = None
    level = 0
    while True:
        held = own.join(left.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(True).alias("held")).distinct()
        parted = cut(left.join(held, "id", "left"))
        free = parted.filter("held IS NULL").select("id", F.lit(level).alias("level"))
        left = parted.filter("held").select("id")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)
