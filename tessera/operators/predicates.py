"""Two-valued predicates over nodes: a missing value is never null in a result.

A predicate is (op, field, value) or (AND|OR|NOT, [predicates]). A field is
taken from the attributes if they hold its key, else from the column of that
name. Values are compared with their types: the number 10 is not the text "10".
CONTAINS, STARTSWITH, ENDSWITH and REGEX are false for empty, zero and missing
values. An operator that is not known compares for equality.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS, NUMBERS = {"id", "node_type", "label", "file_path"}, {"line_number"}
ALIASES = {"type": "node_type"}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _either(name: str, of_attribute: Callable[[Column], Column], of_column: Callable[[Column, str], Column], missing: bool) -> Column:
    """One condition on the attribute if there is one of that name, another on the column, else a constant."""
    own = F.try_element_at(F.col("attributes"), F.lit(name))
    there = _sure(F.map_contains_key("attributes", F.lit(name)))
    name = ALIASES.get(name, name)
    kind = "text" if name in TEXTS else "number" if name in NUMBERS else "list" if name == "labels" else "map" if name == "attributes" else ""
    other = of_column(F.col(name), kind) if kind else F.lit(missing)
    return F.when(there, of_attribute(own)).otherwise(other)


def _equals(c: Column, kind: str, value: object) -> Column:
    if value is None:
        return c.isNull()
    fits = {"text": isinstance(value, str), "number": isinstance(value, (int, float)) and not isinstance(value, bool), "list": isinstance(value, (list, tuple))}.get(kind, False)
    if not fits:
        return F.lit(False)
    if kind == "list":
        return _sure(c == F.array(*map(F.lit, value)).cast("array<string>"))
    return _sure(c == F.lit(value))


def _text(c: Column, kind: str) -> Column:
    """The value as text, null where it counts as false."""
    if kind == "number":
        return F.when(c != 0, c.cast("string"))
    return F.when(c != "", c)


def compile_predicate(p: Sequence) -> Column:
    op, *rest = p
    op = op.upper()
    if op in ("AND", "OR"):
        parts = [compile_predicate(x) for x in rest[0]]
        out = parts[0] if parts else F.lit(op == "AND")
        for x in parts[1:]:
            out = out & x if op == "AND" else out | x
        return out
    if op == "NOT":  # not all of its arguments
        return ~compile_predicate(("AND", rest[0]))
    name, value = (*rest, None)[:2]
    if op == "EXISTS":
        return _either(name, lambda a: a.isNotNull(), lambda c, _: c.isNotNull(), False)
    if op == "COUNT":
        return _either(name, lambda _: F.lit(False), lambda c, kind: _sure(F.size(c) == F.lit(value)) & c.isNotNull() if kind in ("list", "map") else F.lit(False), False)
    if op in ("IN", "NOT_IN"):
        every = list(value) if isinstance(value, (list, tuple, set)) else [value]

        def among(c: Column, kind: str) -> Column:
            out = F.lit(False)
            for v in every:
                out = out | _equals(c, kind, v)
            return out

        found = _either(name, lambda a: among(a, "text"), among, None in every)
        return found if op == "IN" else ~found
    if op in ("CONTAINS", "STARTSWITH", "ENDSWITH", "REGEX", "MATCHES"):
        want = F.lit(str(value))
        if op in ("REGEX", "MATCHES"):
            if not value:
                return F.lit(False)
            test = lambda t: t.rlike(str(value))
        else:
            test = lambda t: {"CONTAINS": F.contains, "STARTSWITH": F.startswith, "ENDSWITH": F.endswith}[op](t, want)
        of_column = lambda c, kind: _sure(F.exists(c, test)) if kind == "list" else F.lit(False) if kind == "map" else _sure(test(_text(c, kind)))
        return _either(name, lambda a: _sure(test(_text(a, "text"))), of_column, False)
    same = _either(name, lambda a: _equals(a, "text", value), lambda c, kind: _equals(c, kind, value), value is None)
    return ~same if op == "NOT_EQUALS" else same


def as_text(p: Sequence) -> Column:
    """EQUALS, NOT_EQUALS, CONTAINS and IN by the values' text, whatever their types; any other operator is false."""
    op, name, value = p
    own = F.try_element_at(F.col("attributes"), F.lit(name))
    name = {"type": "node_type", "node_id": "id", "node_label": "label", "file": "file_path", "line": "line_number"}.get(name.lower(), name)
    x = F.col(name).cast("string") if name in TEXTS | NUMBERS else own
    if op == "EQUALS":
        return x.isNull() if value is None else _sure(x == F.lit(str(value)))
    if op == "NOT_EQUALS":
        return F.coalesce(x, F.lit("None")) != F.lit(str(value))
    if op == "CONTAINS":
        return _sure(F.contains(x, F.lit(str(value))))
    if op == "IN":
        return _sure(x.isin([str(v) for v in (value if isinstance(value, (list, tuple, set)) else [value])]))
    return F.lit(False)
