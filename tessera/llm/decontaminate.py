"""Op 5. Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if they share a seed of five
words. Tiles are then marked: the longest matches of words not yet marked in
either, again and again, found by running Karp-Rabin hashes of falling length,
until none of five words is left. The share of the item's words under tiles is
its coverage, in whatever order the passages stand. Words are lower-cased runs
of letters and digits, so case and punctuation don't hide a passage.

Items with fewer than five words match as one seed of their whole length.
Null or empty texts and items match nothing. Repeated rows are judged each.
The benchmark is taken in blocks of bounded size, each sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text_kernels as tk
from tessera.llm.repeats import numbered
from tessera.llm.shared import materialise, small_batches

SEED, COVERAGE, BLOCK_ITEMS, BLOCK_BYTES = 5, 0.5, 20_000, 16 << 20
#: ASCII that is no letter or digit parts words; capitals become small.
TO_WORDS = np.array([b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in tk.LOWER.tolist()], np.uint8)


def word_ids(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = TO_WORDS[data]
    starts, ends, first = tk.words(data, bounds)
    return tk.word_hashes(data, starts, ends), first


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of longest unmarked matches, longest first.

    Ties go to the earliest place in the item, then in the document.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    length = len(item)
    hash_d, hash_i = tk.Prefix(doc), tk.Prefix(item)
    while length >= least:
        at_i, at_d = _open(free_i, length), _open(free_d, length)
        if len(at_i) and len(at_d):
            own, other = hash_i.ranges(at_i, at_i + length), hash_d.ranges(at_d, at_d + length)
            for a in np.flatnonzero(np.isin(own, other)):
                i = int(at_i[a])
                if not free_i[i : i + length].all():
                    continue
                for d in at_d[other == own[a]].tolist():
                    if free_d[d : d + length].all() and np.array_equal(doc[d : d + length], item[i : i + length]):
                        free_d[d : d + length] = free_i[i : i + length] = False
                        out.append((d, i, length))
                        break
        length = min(length - 1, _longest(free_i))
    return out


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Places where so many words in a row are free."""
    if len(free) < length:
        return np.empty(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[length:] == taken[:-length])


def _longest(free: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def _item_blocks(items: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for x in items:
        block.append(x)
        size += len(x[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _matcher(block: list[tuple[int, str]], seed: int, coverage: float):
    raw = [t.encode() for _, t in block]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    hashes, first = word_ids(np.frombuffer(b"".join(raw), np.uint8), bounds)
    words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    seeds: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for n in sorted({min(seed, len(w)) for w in words if len(w)}):
        own = [(tk.Prefix(w).window(n), i) for i, w in enumerate(words) if min(seed, len(w)) == n]
        h = np.concatenate([x for x, _ in own])
        of = np.repeat([i for _, i in own], [len(x) for x, _ in own])
        order = np.argsort(h, kind="stable")
        seeds[n] = (h[order], of[order])

    def candidates(prefix: tk.Prefix, first: np.ndarray, n_words: int) -> list[tuple[int, int]]:
        pairs: list[np.ndarray] = []
        for n, (h, of) in seeds.items():
            got = prefix.window(n)
            if not len(got):
                continue
            lo = np.searchsorted(h, got)
            hit = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == got)
            if not len(hit):
                continue
            doc = np.searchsorted(first, hit, "right") - 1
            hit, doc = hit[hit + n <= first[doc + 1]], doc[hit + n <= first[doc + 1]]
            a, b = np.searchsorted(h, got[hit], "left"), np.searchsorted(h, got[hit], "right")
            rep = np.repeat(np.arange(len(hit)), b - a)
            inner = np.arange(len(rep)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            pairs.append(np.stack([doc[rep], of[a[rep] + inner]], 1))
        return np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []

    def match(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, list]]:
        hashes, first = word_ids(data, bounds)
        out = []
        for d, i in candidates(tk.Prefix(hashes), first, len(hashes)):
            item = words[i]
            got = tiles(hashes[first[d] : first[d + 1]], item, min(seed, len(item)))
            share = sum(t[2] for t in got) / len(item)
            if share >= coverage:
                out.append((d, block[i][0], share, [list(t) for t in got]))
        return out

    return match


def _matchers(benchmark: DataFrame, item_id: str, item_text: str, seed: int, coverage: float) -> Iterator:
    """A matcher for each block of items."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    for block in _item_blocks((r["i"], r["t"]) for r in items.toLocalIterator()):
        yield _matcher(block, seed, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item whose words it covers far enough: row (of numbered()), rest, item_id, coverage, tiles."""
    small_batches(docs.sparkSession)
    rows = numbered(docs, text)
    schema = rows.select("row", "rest").schema
    for x in ("item_id long", "coverage double", "tiles array<array<int>>"):
        schema = schema.add(*rows.sparkSession.createDataFrame([], x).schema.fields)
    parts: list[DataFrame] = []
    for match in _matchers(benchmark, item_id, item_text, seed, coverage):
        if parts:  # so that one block at a time is held
            parts[-1] = materialise(parts[-1], "contaminated")

        def run(batches: Iterator[pa.RecordBatch], match=match) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = tk.column_bytes(batch.column("text"))
                for i, j in tk.chunks(bounds):
                    got = match(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    if got:
                        own = batch.take(pa.array([i + x[0] for x in got]))
                        yield pa.RecordBatch.from_arrays([own.column("row"), own.column("rest"), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got]), pa.array([x[3] for x in got], pa.list_(pa.list_(pa.int32())))], schema.names)

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that cover no item far enough; all columns."""
    small_batches(docs.sparkSession)
    rows = numbered(docs, text).select("text", "rest")
    for n, match in enumerate(_matchers(benchmark, item_id, item_text, seed, coverage)):
        if n:
            rows = materialise(rows, "clean")

        def run(batches: Iterator[pa.RecordBatch], match=match) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = tk.column_bytes(batch.column("text"))
                fine = np.ones(len(batch), bool)
                for i, j in tk.chunks(bounds):
                    fine[[i + x[0] for x in match(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])]] = False
                yield batch.filter(pa.array(fine))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*(F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and item; clean documents have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("rest.doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"), "tiles")
