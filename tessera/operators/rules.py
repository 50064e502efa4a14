"""Graph rules: conditions over a node, its attributes and its edges, compiled to joins on counts.

A condition is a dict; its entries must all hold. Keys: all, any (lists of
conditions), not (one), node_type_equals, has_attribute, attribute_equals and
attribute_contains ({key, value}), source_kind_equals, sink_kind_equals,
flow_taint_state_equals (of the attributes so named), incoming_edge and outgoing_edge ({type,
source_type or target_type}), edge_count ({direction, type, min, max}).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edge_keys(condition: dict) -> set[tuple]:
    """(direction, edge type, type of the other end) of every edge that the condition asks about."""
    found: set[tuple] = set()
    for key, value in condition.items():
        if key in ("all", "any"):
            found |= {k for x in value for k in _edge_keys(x)}
        elif key == "not":
            found |= _edge_keys(value)
        elif key in ("incoming_edge", "outgoing_edge"):
            found.add((key, value.get("type"), value.get("source_type" if key == "incoming_edge" else "target_type")))
        elif key == "edge_count":
            ways = {"incoming": ["incoming_edge"], "outgoing": ["outgoing_edge"]}.get(value.get("direction", "both"), ["incoming_edge", "outgoing_edge"])
            found |= {(w, value.get("type"), None) for w in ways}
    return found


def _compiled(condition: dict, counts: dict[tuple, str]) -> Column:
    out = F.lit(True)
    sure = lambda c: F.coalesce(c, F.lit(False))
    attribute = lambda name: F.try_element_at(F.col("attributes"), F.lit(name))
    for key, value in condition.items():
        if key == "all":
            one = F.lit(True)
            for x in value:
                one = one & _compiled(x, counts)
        elif key == "any":
            one = F.lit(False)
            for x in value:
                one = one | _compiled(x, counts)
        elif key == "not":
            one = ~_compiled(value, counts)
        elif key == "node_type_equals":
            one = sure(F.col("node_type") == str(value).upper())
        elif key == "has_attribute":
            one = sure(F.map_contains_key("attributes", F.lit(value)))
        elif key == "attribute_equals":
            one = attribute(value["key"]).eqNullSafe(F.lit(value["value"]))
        elif key == "attribute_contains":
            one = sure(F.contains(attribute(value["key"]), F.lit(str(value["value"]))))
        elif key == "flow_taint_state_equals":
            one = F.coalesce(attribute("flow_taint_state"), F.lit("UNKNOWN")) == F.lit(str(value).upper())
        elif key in ("source_kind_equals", "sink_kind_equals"):
            one = F.coalesce(attribute(key.removesuffix("_equals")), F.lit("")) == F.lit(str(value))
        elif key in ("incoming_edge", "outgoing_edge"):
            one = F.col(counts[(key, value.get("type"), value.get("source_type" if key == "incoming_edge" else "target_type"))]) > 0
        elif key == "edge_count":
            n = sum((F.col(counts[k]) for k in sorted(_edge_keys({key: value}))), F.lit(0))
            one = n >= value.get("min", 0)
            if value.get("max") is not None:
                one = one & (n <= value["max"])
        else:
            raise ValueError(f"unknown condition {key}")
        out = out & one
    return out


def _counted(nodes: DataFrame, edges: DataFrame, keys: list[tuple]) -> tuple[DataFrame, dict[tuple, str]]:
    """nodes with a count for each key. Edges are counted by node before they are joined, so hubs cost one row."""
    own, names = nodes, {k: f"_n{i}" for i, k in enumerate(keys)}
    for (way, edge_type, other), name in names.items():
        here, there = ("dst", "src") if way == "incoming_edge" else ("src", "dst")
        near = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
        if other is not None:
            near = near.join(nodes.filter(F.col("node_type") == other).select(F.col("id").alias(there)), there, "left_semi")
        own = own.join(near.groupBy(F.col(here).alias("id")).agg(F.count(F.lit(1)).alias(name)), "id", "left").na.fill(0, [name])
    return own, names


def matching(nodes: DataFrame, edges: DataFrame, condition: dict) -> DataFrame:
    """Nodes for which the condition holds."""
    own, names = _counted(nodes, edges, sorted(_edge_keys(condition), key=str))
    return own.filter(_compiled(condition, names)).select(*nodes.columns)


def findings(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """A row for each rule (id, severity, condition) and node that it holds for: rule_id, severity, id, fingerprint.

    All rules look at a node in one pass; an edge count that several ask for is made once.
    """
    own, names = _counted(nodes, edges, sorted(set().union(*(_edge_keys(r["condition"]) for r in rules)), key=str))
    hits = [F.when(_compiled(r["condition"], names), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "MEDIUM")).alias("severity"))) for r in rules]
    kind = "array<struct<rule_id:string,severity:string>>"
    out = own.select("id", F.explode(F.array_compact(F.array(*hits)).cast(kind)).alias("r")).select("r.rule_id", "r.severity", "id")
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", "rule_id", "id"), 256))
