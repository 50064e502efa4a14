"""Provenance graphs: fingerprints from the roots down, so that one changed step names all that depend on it.

nodes: id, kind, meta (text). links: id, pred. A node's fingerprint is the SHA-256 of its id, kind and meta and of its
predecessors' ids and fingerprints in order of id. Levels go by the longest way from a root, one round of joins each; nodes
on a circle or below one have no level and no fingerprint. Repeated links count once; a repeated id is told as a problem and
its least row counts. Links to nodes that aren't there are told and left out. Null ids take no part. Empty tables: no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import paths
from tessera.tables import cut

#: Steps of a graph that one task holds.
LARGE = 100_000


def _known(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = cut(nodes.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("kind", "meta")).alias("x")).select("id", "x.kind", "x.meta"))
    pairs = links.filter("id IS NOT NULL AND pred IS NOT NULL").select("id", "pred").distinct()
    return own, cut(pairs.join(own.select("id"), "id", "left_semi").join(own.select(F.col("id").alias("pred")), "pred", "left_semi").select("id", "pred"))


def fingerprints(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, level, fingerprint; both null for nodes that a circle leads to."""
    own, pairs = _known(nodes, links)
    levels = cut(paths.levels(own.select("id"), pairs.select(F.col("pred").alias("src"), F.col("id").alias("dst"))))
    top = levels.agg(F.max("level")).first()[0]
    done: list[DataFrame] = []
    for level in range(-1 if top is None else top + 1):
        here = own.join(levels.filter(F.col("level") == level), "id")
        if level:
            above = reduce(DataFrame.unionByName, done).select(F.col("id").alias("pred"), "fingerprint")
            before = pairs.join(levels.filter(F.col("level") == level).select("id"), "id", "left_semi").join(above, "pred")
            before = before.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pred", "fingerprint"))), lambda x: F.concat_ws("=", x["pred"].cast("string"), x["fingerprint"])), "|").alias("before"))
            here = here.join(before, "id", "left")
        else:
            here = here.withColumn("before", F.lit(""))
        raw = F.concat_ws(":", F.col("id").cast("string"), F.coalesce("kind", F.lit("")), F.coalesce("meta", F.lit("")), F.coalesce("before", F.lit("")))
        done.append(cut(here.select("id", "level", F.sha2(raw, 256).alias("fingerprint"))))
    lost = levels.filter("level IS NULL").select("id", "level", F.lit(None).cast("string").alias("fingerprint"))
    return reduce(DataFrame.unionByName, [*done, lost])


def ends(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, root, terminal: nodes without predecessors, and nodes that are no predecessor."""
    own, pairs = _known(nodes, links)
    has, is_ = pairs.select("id").distinct().withColumn("has", F.lit(True)), pairs.select(F.col("pred").alias("id")).distinct().withColumn("is", F.lit(True))
    return own.join(has, "id", "left").join(is_, "id", "left").select("id", F.col("has").isNull().alias("root"), F.col("is").isNull().alias("terminal"))


def problems(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, problem: duplicate ids, links of a node to itself, predecessors that aren't there, circles."""
    named = nodes.filter("id IS NOT NULL")
    twice = named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate").alias("problem"))
    self_ = links.filter("id = pred").select("id", F.lit("self-reference").alias("problem")).distinct()
    orphan = links.filter("pred IS NOT NULL").join(named.select(F.col("id").alias("pred")), "pred", "left_anti").select("id", F.lit("orphan").alias("problem")).distinct()
    own, pairs = _known(nodes, links)
    # what feeds a circle is none itself: only nodes that lead back to themselves count
    left = paths.levels(own.select("id"), pairs.select(F.col("pred").alias("src"), F.col("id").alias("dst"))).filter("level IS NULL").select("id")
    left = cut(left)
    inner = pairs.join(left, "id", "left_semi").join(left.select(F.col("id").alias("pred")), "pred", "left_semi")
    round_ = paths.on_cycles(inner.select(F.col("pred").alias("src"), F.col("id").alias("dst"))).select("id", F.lit("cycle").alias("problem"))
    return reduce(DataFrame.unionByName, [twice, self_, orphan, round_])


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, status of two states of a graph (id, kind, meta, fingerprint each): ADDED, REMOVED, SAME, CHANGED itself, or DEPENDS on what changed."""
    a, b = (x.select("id", F.struct("kind", "meta").alias(f"own_{n}"), F.col("fingerprint").alias(f"fp_{n}")) for n, x in (("a", old), ("b", new)))
    status = F.when(F.col("own_a").isNull(), "ADDED").when(F.col("own_b").isNull(), "REMOVED").when(F.col("fp_a").eqNullSafe(F.col("fp_b")), "SAME").when(~F.col("own_a").eqNullSafe(F.col("own_b")), "CHANGED").otherwise("DEPENDS")
    return a.join(b, "id", "full").select("id", status.alias("status"))


def _folded(steps: list[dict]) -> Iterator[tuple]:
    """id, fingerprint, status of a graph's steps, taken when all their predecessors have been."""
    own: dict[int, tuple] = {}
    for s in steps:
        if s["id"] is not None:
            row = (s["kind"] or "", s["meta"] or "", s["now"] or "")
            own[s["id"]] = min(row, own.get(s["id"], row))
    before, after = defaultdict(set), defaultdict(list)
    for s in steps:
        before[s["id"]].update(x for x in s["preds"] or () if x in own)
    for x in own:
        for y in before[x]:
            after[y].append(x)
    missing = {x: len(before[x]) for x in own}
    ready, prints = [x for x, n in missing.items() if not n], {}
    while ready:
        x = ready.pop()
        kind, *metas = own[x]
        above = sorted(before[x])
        prints[x] = tuple(sha256(f"{x}:{kind}:{m}:{'|'.join(f'{y}={prints[y][i]}' for y in above)}".encode()).hexdigest() for i, m in enumerate(metas))
        for y in after[x]:
            missing[y] -= 1
            if not missing[y]:
                ready.append(y)
    for x, (_, meta, now) in own.items():
        a, b = prints.get(x, (None, None))
        yield x, b, "SAME" if a == b else "CHANGED" if meta != now else "DEPENDS"


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            rows = [r for steps in batch.column(0).slice(i, 1000).to_pylist() for r in _folded(steps)]
            ids, prints, status = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.string()), pa.array(status, pa.string())], names=["id", "fingerprint", "status"])


def compared_graphs(steps: DataFrame, large: int = LARGE) -> DataFrame:
    """id, fingerprint (of the new state) and status of many graphs' steps: graph, id, kind, meta (old), now (new), preds (ids of the same graph).

    Both states of a graph are folded in one task, so steps are shuffled once, by graph. Graphs of more than large steps
    take rounds of joins.
    """
    many = cut(steps.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("graph"))
    some = not many.isEmpty()
    own = steps.join(F.broadcast(many), "graph", "left_anti") if some else steps  # graphs of that size are few
    rows = own.groupBy("graph").agg(F.collect_list(F.struct("id", "kind", "meta", "now", "preds")).alias("steps")).select("steps")
    found = rows.mapInArrow(_each, "id long, fingerprint string, status string")
    if not some:
        return found
    rest = cut(steps.join(F.broadcast(many), "graph", "left_semi"))
    links = rest.select("id", F.explode("preds").alias("pred"))
    old, new = rest.select("id", "kind", "meta"), rest.select("id", "kind", F.col("now").alias("meta"))
    a, b = fingerprints(old, links), cut(fingerprints(new, links))
    return found.unionByName(compared(old.join(a, "id"), new.join(b, "id")).join(b.select("id", "fingerprint"), "id"))
