"""Property graphs: building, linking, traversal, validation, statistics and comparison.

nodes: id, node_type, label, file_path, line_number, labels, attributes.
edges: src, dst, edge_type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.tables import cut, table


def node_id(*parts: Column | str) -> Column:
    """A stable id: the first 16 hexadecimal digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def keyed(kind: str, key: str) -> Column:
    return node_id(F.lit(kind), F.col(key).cast("string"))


#: Table, its key, label, place (file and line), labels and attributes of each type of node.
KINDS = {
    "CUSTOMER": ("customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey", ["c_mktsegment"], ["c_mktsegment"]),
    "ORDER": ("orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", ["o_orderstatus"], ["o_orderstatus", "o_orderpriority"]),
    "PART": ("part", "p_partkey", "p_name", "p_brand", "p_size", ["p_brand", "p_type"], ["p_brand", "p_type"]),
    "SUPPLIER": ("supplier", "s_suppkey", "s_name", None, "s_nationkey", [], []),
    "NATION": ("nation", "n_nationkey", "n_name", None, "n_regionkey", [], []),
    "REGION": ("region", "r_regionkey", "r_name", None, None, [], []),
}
#: Edge type, table, and the type and key of both ends.
LINKS = (
    ("PLACES", "orders", "CUSTOMER", "o_custkey", "ORDER", "o_orderkey"),
    ("CONTAINS", "lineitem", "ORDER", "l_orderkey", "PART", "l_partkey"),
    ("SUPPLIED_BY", "lineitem", "PART", "l_partkey", "SUPPLIER", "l_suppkey"),
    ("IN_NATION", "supplier", "SUPPLIER", "s_suppkey", "NATION", "s_nationkey"),
    ("IN_NATION", "customer", "CUSTOMER", "c_custkey", "NATION", "c_nationkey"),
    ("IN_REGION", "nation", "NATION", "n_nationkey", "REGION", "n_regionkey"),
)


def build_nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    def one(kind: str) -> DataFrame:
        name, key, label, file, line, labels, attributes = KINDS[kind]
        pairs = [x for a in attributes for x in (F.lit(a), F.col(a).cast("string"))]
        return table(spark, sf_dir, name).select(
            keyed(kind, key).alias("id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"),
            (F.col(file) if file else F.lit("")).alias("file_path"), (F.col(line) if line else F.lit(0)).cast("long").alias("line_number"),
            F.array(*[F.col(x) for x in labels]).cast("array<string>").alias("labels"),
            (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("attributes"),
        )

    return reduce(DataFrame.unionByName, map(one, kinds))


def key_edges(spark: SparkSession, sf_dir: str, edge_type: str) -> DataFrame:
    """src_type, src, dst_type, dst of the distinct edges of a type, by the keys of their tables: for long ways, whose ends are named last."""
    parts = [table(spark, sf_dir, t).select(F.lit(a).alias("src_type"), F.col(x).cast("long").alias("src"), F.lit(b).alias("dst_type"), F.col(y).cast("long").alias("dst")).distinct() for e, t, a, x, b, y in LINKS if e == edge_type]
    return reduce(DataFrame.unionByName, parts)


def build_edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct edges; several of the same type between two nodes are one. Keys are made distinct before they are hashed."""
    parts = [table(spark, sf_dir, t).select(x, y).distinct().select(keyed(a, x).alias("src"), keyed(b, y).alias("dst"), F.lit(e).alias("edge_type")) for e, t, a, x, b, y in LINKS if types is None or e in types]
    return reduce(DataFrame.unionByName, parts)


def link_colocated(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between nodes of the same place whose types pairs (from_type, to_type, edge_type) joins; nodes without a file link with nothing.

    There are as many edges as pairs of nodes of a place, so they are not shuffled: nodes and pairs are made distinct first,
    and only edges of an id that stands in several places or types can be made twice. Places are parted, and dealt to a set
    number of tasks, as the nodes' size tells nothing of the edges'.
    """
    tasks, parts, place = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8, ["to_type", "file_path", "line_number", "part"]
    placed = nodes.filter(F.coalesce("file_path", F.lit("")) != "").select("id", "node_type", "file_path", "line_number").distinct()
    placed = cut(placed.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("id")) > 1))
    joins = pairs.select("from_type", "to_type", "edge_type").distinct()

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        own = left.select(F.col("id").alias("src"), F.col("node_type").alias("from_type"), "file_path", "line_number", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).join(joins, "from_type")
        other = right.select(F.col("id").alias("dst"), F.col("node_type").alias("to_type"), "file_path", "line_number", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part"))
        return own.repartition(tasks, *place).join(other.repartition(tasks, *place), place).filter("src <> dst").select("src", "dst", "edge_type")

    once, often = placed.filter("NOT often"), placed.filter("often")
    if often.isEmpty():
        return joined(once, once)
    return joined(once, once).unionByName(joined(often, placed).unionByName(joined(once, often)).distinct())


def scan(nodes: DataFrame, target: str | None) -> DataFrame:
    """Nodes of a type or with a label; all without a target."""
    return nodes if target is None else nodes.filter((F.col("node_type") == target) | F.array_contains("labels", target))


def step(current: DataFrame, nodes: DataFrame, edges: DataFrame, forward: bool = True, edge_type: str | None = None, target_type: str | None = None) -> DataFrame:
    """Nodes one edge away, as often as they are reached; ends that are no node drop out."""
    here, there = ("src", "dst") if forward else ("dst", "src")
    own = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    ids = current.select(F.col("id").alias(here)).join(own, here).select(F.col(there).alias("id"))
    out = ids.join(nodes, "id")
    return out if target_type is None else scan(out, target_type)


def neighbours(current: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return step(current, nodes, edges).unionByName(step(current, nodes, edges, forward=False)).dropDuplicates(["id"])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_out and n_in of every node; both ends of an edge are counted in one pass, before joining, so hubs don't skew the join."""
    end = lambda name, out: F.struct(F.col(name).alias("id"), F.lit(out).alias("out"), F.lit(1 - out).alias("in"))
    ends = edges.select(F.explode(F.array(end("src", 1), end("dst", 0))).alias("e"))
    counts = ends.groupBy("e.id").agg(F.sum("e.out").alias("n_out"), F.sum("e.in").alias("n_in"))
    return nodes.select("id", "node_type").join(counts, "id", "left").na.fill(0, ["n_out", "n_in"])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).filter("n_out = 0 AND n_in = 0").select("id", "node_type")


def broken_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    no_src = edges.join(ids, edges["src"] == ids["id"], "left_anti").withColumn("missing", F.lit("src"))
    no_dst = edges.join(ids, edges["dst"] == ids["id"], "left_anti").withColumn("missing", F.lit("dst"))
    return no_src.unionByName(no_dst)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = nodes.agg(F.count(F.lit(1)).alias("n_nodes")), edges.agg(F.count(F.lit(1)).alias("n_edges"))
    one = n.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k")
    many = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return one.select("n_nodes", "n_edges", F.round(F.when(many > 0, F.col("n_edges") / many).otherwise(0.0), 6).alias("density"))


def compare_nodes(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """id and ADDED, REMOVED or MODIFIED."""
    a = old.select("id", F.struct(*columns).alias("was"))
    b = new.select("id", F.struct(*columns).alias("now"))
    kind = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(~F.col("was").eqNullSafe(F.col("now")), "MODIFIED")
    return a.join(b, "id", "full_outer").select("id", kind.alias("change")).filter("change IS NOT NULL")


def compare_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    key = ["src", "dst", "edge_type"]
    return new.join(old, key, "left_anti").select(*key, F.lit("ADDED").alias("change")).unionByName(old.join(new, key, "left_anti").select(*key, F.lit("REMOVED").alias("change")))
