"""Rules over code nodes: one automaton of all rules' words finds the candidates, then each rule's predicates in order.

nodes: node, node_type, language, text, symbol (what the node's name resolves to, or null), aliases (map of names to what they
stand for, or null). A rule asks, in this order: its language (generic fits all) and node types (* or none: all); a symbol,
that is one of its triggers as a word of the text or as the resolved symbol; that the text does not match its exclusion; and
that its pattern is found in the text, or in the text with one name replaced by what it stands for. A rule without triggers
is a candidate everywhere.

Rules are part of the plan: a list whose size is checked, sent to the workers, where the automaton is built once. A node is
read once for all rules: its cost goes with its length and the candidates, not with the number of rules. Nodes stay where
they are; nothing is shuffled.

Null texts match only rules that ask nothing of them; null types and languages fit no rule that names some. Repeated nodes give
repeated rows. A trigger counts once however often it stands. Names of other columns don't matter. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rules that a plan may carry.
MOST = 32 << 20
GENERIC = "generic"
SEPARATORS = (".", "->", "::")
NAME = re.compile(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b")
PART = re.compile(r"\w+")
#: Words that are no names.
KEYWORDS = {"if", "else", "for", "func", "return", "var", "const", "let", "import", "package"}


@dataclass(frozen=True)
class Rule:
    rule: str
    language: str = GENERIC
    node_types: tuple[str, ...] = ()
    triggers: tuple[str, ...] = ()
    pattern: str | None = None
    exclusion: str | None = None


@dataclass
class Compiled:
    rule: Rule
    types: frozenset[str]
    words: list[tuple[str, re.Pattern]] = field(default_factory=list)
    pattern: re.Pattern | None = None
    exclusion: re.Pattern | None = None


def _word(trigger: str) -> re.Pattern:
    """A trigger as a word; arrows and colons may have white space around them."""
    if not any(s in trigger for s in SEPARATORS):
        return re.compile(r"(?<!\w)" + re.escape(trigger) + r"(?!\w)")
    parts = re.split(r"(->|::)", trigger)
    return re.compile("".join(rf"\s*{p}\s*" if p in ("->", "::") else re.escape(p) for p in parts))


@lru_cache(maxsize=2)
def _built(rules: tuple[Rule, ...]) -> Matcher:
    return Matcher(rules)


class Matcher:
    """All rules at once, over one node at a time."""

    def __init__(self, rules: Iterable[Rule]):
        import ahocorasick

        self.rules, self.always = [], []
        self.automaton = ahocorasick.Automaton()
        self.symbols: dict[str, list[int]] = {}  # a trigger, or what follows a dot in it
        self.heads: dict[str, list[int]] = {}  # whole triggers
        keys: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            types = frozenset(t.lower() for t in r.node_types)
            self.rules.append(Compiled(r, frozenset() if "*" in types else types, [(t, _word(t)) for t in r.triggers], re.compile(r.pattern) if r.pattern else None, re.compile(r.exclusion, re.IGNORECASE | re.DOTALL) if r.exclusion else None))
            if not r.triggers:
                self.always.append(i)
            for t in r.triggers:
                keys.setdefault(max(PART.findall(t) or [t], key=len), []).append(i)
                self.heads.setdefault(t, []).append(i)
                for at in [m.end() for m in re.finditer(r"\.", t)]:
                    self.symbols.setdefault(t[at:], []).append(i)
        for k, own in keys.items():
            self.automaton.add_word(k, own)
        if keys:
            self.automaton.make_automaton()
        self.some = bool(keys)

    def candidates(self, text: str, symbol: str | None) -> list[int]:
        found = set(self.always)
        if self.some and text:
            for _, own in self.automaton.iter(text):
                found.update(own)
        if symbol:
            dots = [m.start() for m in re.finditer(r"\.", symbol)]
            for part in (symbol, *(symbol[d + 1 :] for d in dots), *(symbol[:d] for d in dots)):
                found.update(self.heads.get(part, ()))
            found.update(self.symbols.get(symbol, ()))
        return sorted(found)

    def matched(self, c: Compiled, node_type: str | None, language: str | None, text: str | None, symbol: str | None, aliases: dict | None) -> tuple[str | None, str | None] | None:
        """The trigger and the text that a rule's predicates found, or None at the first that fails."""
        own = (language or "").lower()
        if c.rule.language.lower() not in (own, GENERIC) and own != GENERIC:
            return None
        if c.types and (node_type or "").lower() not in c.types:
            return None
        trigger = shown = None
        if c.words:
            for t, _ in c.words if symbol else ():
                if t == symbol or symbol.endswith("." + t) or symbol.startswith(t + ".") or t.endswith("." + symbol):
                    trigger, shown = t, symbol
                    break
            else:
                for t, word in c.words:
                    if text and word.search(text):
                        trigger, shown = t, text
                        break
                else:
                    return None
        if c.exclusion and text and c.exclusion.search(text):
            return None
        if c.pattern:
            hit = c.pattern.search(text or "")
            if hit is None and aliases and text:
                for name in sorted(set(NAME.findall(text)) - KEYWORDS):
                    if aliases.get(name):
                        to = aliases[name]
                        hit = c.pattern.search(re.sub(rf"\b{name}\b", lambda _, to=to: to, text))
                        if hit:
                            break
            if hit is None:
                return None
            shown = shown or hit.group(0)
        return trigger, shown


def findings(nodes: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """node, rule, trigger, matched: a row for each node and rule of which all predicates hold."""
    rules = tuple(rules)
    size = sum(len(x or "") for r in rules for x in (r.rule, r.pattern, r.exclusion, *r.triggers, *r.node_types))
    if size > MOST:
        raise ValueError(f"rules of {size} letters are more than a plan may carry")
    own = nodes.select("node", "node_type", "language", F.col("text").cast("string").alias("text"), "symbol", F.col("aliases").cast("map<string,string>").alias("aliases"))
    schema = T.StructType([own.schema["node"], *(T.StructField(c, T.StringType()) for c in ("rule", "trigger", "matched"))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _built(rules)
        for pdf in parts:
            out = []
            for node, kind, language, text, symbol, aliases in pdf[["node", "node_type", "language", "text", "symbol", "aliases"]].itertuples(index=False, name=None):
                text, symbol = (x if isinstance(x, str) else None for x in (text, symbol))
                pairs = dict(aliases) if isinstance(aliases, (dict, list)) else None
                for i in m.candidates(text or "", symbol):
                    got = m.matched(m.rules[i], kind, language, text, symbol, pairs)
                    if got is not None:
                        out.append((node, m.rules[i].rule.rule, *got))
            yield pd.DataFrame(out, columns=["node", "rule", "trigger", "matched"])

    return own.mapInPandas(run, schema)
