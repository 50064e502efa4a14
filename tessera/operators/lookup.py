"""Finding nodes by key, symbol and call, as filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.predicates import as_text

#: Names under which a key may be asked for. Others are attributes.
KEYS = {"id": "id", "node_id": "id", "label": "label", "node_type": "node_type", "type": "node_type", "file_path": "file_path", "file": "file_path", "line_number": "line_number", "line": "line_number"}
ATTRIBUTES = {"function_name": "function_name", "fn_name": "function_name", "function": "function_name", "ssa_version": "ssa_version", "variable_version": "ssa_version", "variable": "variable", "source_kind": "source_kind", "sink_category": "sink_category", "taint_state": "taint_state"}


def by_key(nodes: DataFrame, key: str, value: object) -> DataFrame:
    """Nodes whose key has the value, compared as text; a key that is not known finds nothing."""
    if key in KEYS:
        return nodes.filter(F.col(KEYS[key]).cast("string") == str(value))
    if key in ATTRIBUTES:
        return nodes.filter(F.try_element_at("attributes", F.lit(ATTRIBUTES[key])) == str(value))
    return nodes.limit(0)


def evaluate(nodes: DataFrame, target: str | None, predicates: list[tuple]) -> DataFrame:
    """Nodes of a label or type (ALL, ANY, * or None: all) for which all predicates hold as text, in order of id.

    Equalities go first, as they prune most; the result is the same in any order.
    """
    own = nodes
    if target and target.upper() not in ("ALL", "ANY", "*"):
        own = own.filter((F.col("label") == target) | (F.col("node_type") == target))
    for p in sorted(predicates, key=lambda p: p[0] != "EQUALS"):
        own = own.filter(as_text(p))
    return own.orderBy("id")


def _named(column: str, name: str) -> Column:
    return (F.col(column) == name) | F.col(column).endswith(f".{name}")


def symbols(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose label is, ends with or holds the name."""
    return nodes.filter(F.contains(F.col("label"), F.lit(name)))


def definition(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that label, else of the least id whose label ends with .name."""
    return nodes.filter(_named("label", name)).orderBy(F.col("label") != name, "id").limit(1)


def calls(nodes: DataFrame, edges: DataFrame, name: str, edge_type: str = "CALLS") -> DataFrame:
    """Edges of calls to nodes of that name."""
    targets = nodes.filter(_named("label", name)).select(F.col("id").alias("dst"))
    return edges.filter(F.col("edge_type") == edge_type).join(targets, "dst", "left_semi")


def references(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes with a call to nodes of that name, or any edge to its definition."""
    into = edges.join(definition(nodes, name).select(F.col("id").alias("dst")), "dst", "left_semi")
    ids = calls(nodes, edges, name).select("src").unionByName(into.select("src")).select(F.col("src").alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def edges_where(edges: DataFrame, edge_type: str | None = None, src: str | None = None, dst: str | None = None) -> DataFrame:
    for name, value in (("edge_type", edge_type), ("src", src), ("dst", dst)):
        edges = edges if value is None else edges.filter(F.col(name) == value)
    return edges
