"""A typed graph query: scan, filter, traverse, project and limit, compiled to DataFrames."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.predicates import compile_predicate


@dataclass(frozen=True)
class Query:
    target: str | None = None
    steps: tuple = ()

    def _with(self, *step) -> Query:
        return replace(self, steps=(*self.steps, step))

    def where(self, *predicates, **equals) -> Query:
        every = [*predicates, *(("EQUALS", k, v) for k, v in equals.items())]
        return self._with("FILTER", ("AND", every)) if every else self

    def outgoing(self, edge_type: str | None = None, target_type: str | None = None) -> Query:
        return self._with("TRAVERSE", True, edge_type, target_type)

    def incoming(self, edge_type: str | None = None, target_type: str | None = None) -> Query:
        return self._with("TRAVERSE", False, edge_type, target_type)

    def neighbours(self) -> Query:
        return self._with("NEIGHBOURS")

    def limit(self, n: int) -> Query:
        return self._with("LIMIT", n)

    def select(self, *fields: str) -> Query:
        return self._with("PROJECT", *fields)

    def to_json(self) -> str:
        return json.dumps({"target": self.target, "steps": self.steps}, sort_keys=True, separators=(",", ":"))

    @staticmethod
    def from_json(text: str) -> Query:
        frozen = lambda x: tuple(map(frozen, x)) if isinstance(x, list) else x
        raw = json.loads(text)
        return Query(raw["target"], frozen(raw["steps"]))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def run(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """A filter stays where it stands; a limit takes the smallest ids, and n <= 0 is none."""
        out = graph.scan(nodes, self.target)
        for op, *args in self.steps:
            if op == "FILTER":
                out = out.filter(compile_predicate(args[0]))
            elif op == "TRAVERSE":
                out = graph.step(out, nodes, edges, *args)
            elif op == "NEIGHBOURS":
                out = graph.neighbours(out, nodes, edges)
            elif op == "LIMIT":
                out = out.orderBy("id").limit(args[0]) if args[0] > 0 else out
            else:
                out = out.select(*args)
        return out


def node(target: str | None = None) -> Query:
    return Query(target)


def evidence(matches: DataFrame) -> DataFrame:
    """First and last match by id, and how many there are."""
    return matches.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))
