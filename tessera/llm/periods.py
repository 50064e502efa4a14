"""Op 13. Runs of words that repeat with a period, found and collapsed.

Karp-Miller-Rosenberg naming: at level k every stretch of 2**k words has a name, equal names for equal stretches of the
same document. Level 0 numbers the words themselves; a pair of names half a stretch apart is named at the next level by
sorting. A stretch that stands once in its document needs no name that others share and drops out of higher levels.

A run of period q has at least 4 q words, so one of its first 2 q places stands on the grid of step 2 q, and the q words
from there equal the q words after them. Grid places of every period are candidates; they are compared by names of level
floor(log2 q), and those that agree are extended to both sides by names of descending levels. Of candidates with the same
stretch the least period is the run's.

Each document is worked on by itself, so nothing is shuffled. Null and empty texts: no words, no runs. Repeated rows are
documents of their own. A very long text is worked on whole, in memory of some hundred bytes a word. An empty table gives
an empty one. Other columns pass through whatever their names, but for runs and kept, which win over columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text_kernels as tk
from tessera.llm.shared import packed, small_batches

LEAST, TIMES = 6, 4
#: Bytes of text that are named together.
CHUNK = 1 << 20


def named(key: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A name for each of n places: the same, from 0 up, for places of equal keys; -1 - place where no other has the key or none is given."""
    names = -1 - np.arange(n + 1)  # the last place is beyond all texts
    if len(key):
        order = np.argsort(key, kind="stable")
        head = np.concatenate([[True], np.diff(key[order]) != 0])
        run = np.cumsum(head) - 1
        shared = np.bincount(run)[run] > 1
        names[at[order[shared]]] = run[shared]
    return names


def levels_of(symbol: np.ndarray, bounds: np.ndarray, top: int) -> list[np.ndarray]:
    """Names of stretches of 1, 2, 4, ... up to 2**top symbols; fewer levels if no longer stretch recurs."""
    n = len(symbol)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    levels = [named(doc * (int(symbol.max(initial=0)) + 1) + symbol, np.arange(n), n)]
    for k in range(top):
        last, half = levels[-1], 1 << k
        at = np.flatnonzero(last[: max(0, n - half)] >= 0)
        at = at[(last[at + half] >= 0) & (doc[at] == doc[at + half])]
        if not len(at):
            break
        levels.append(named(last[at] * (int(last.max()) + 1) + last[at + half], at, n))
    return levels


def agreed(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols from a and b on are equal, b being further on; or how many before them, going back."""
    n, far = len(levels[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, step, live = levels[k], 1 << k, np.arange(len(a))
        while len(live):
            x, y = (a[live] - far[live] - step, b[live] - far[live] - step) if back else (a[live] + far[live], b[live] + far[live])
            live = live[names[np.where(x < 0, n, x)] == names[np.maximum(y, 0)]]
            far[live] += step
            if k < len(levels) - 1:  # two steps of a lower level would have been one of a higher
                break
    return far


def candidates(levels: list[np.ndarray], bounds: np.ndarray, k: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on the grids of the periods from 2**k up to below 2**(k + 1), with those periods, where names of level k agree."""
    names, size = levels[k], np.diff(bounds)
    held = np.diff(np.concatenate([[0], np.cumsum(names[:-1] >= 0)])[bounds])
    docs = np.flatnonzero((held > 1) & (size >= times << k))
    many = np.minimum((2 << k) - 1, size[docs] // times) - (1 << k) + 1
    of = np.repeat(docs, many)
    q = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + (1 << k)
    grid = size[of] // (2 * q)
    row = np.repeat(np.arange(len(of)), grid)
    at = bounds[of][row] + (np.arange(len(row)) - np.repeat(np.cumsum(grid) - grid, grid)) * 2 * q[row]
    q = q[row]
    hit = names[at] == names[at + q]
    return at[hit], q[hit]


def runs_in(symbol: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of at least least symbols and times its smallest period, by start, then period.

    symbol: numbers of the symbols of all documents end to end; bounds: where each document begins. times must be 4 or
    more, as the grid rests on it.
    """
    longest = int(np.diff(bounds).max(initial=0)) // times
    if longest < 1:
        return (np.empty(0, np.int64),) * 3
    levels = levels_of(symbol, bounds, longest.bit_length() - 1)
    found = [np.empty((3, 0), np.int64)]
    for k in range(len(levels)):
        at, q = candidates(levels, bounds, k, times)
        start = at - agreed(levels, at, at + q, back=True)
        end = at + q + agreed(levels, at, at + q, back=False)
        keep = end - start >= np.maximum(least, times * q)
        found.append(np.stack([start[keep], end[keep], q[keep]]))
    start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort([q, end, start])
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(q), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort([q, start])
    return start[order], (end - start)[order], q[order]


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, by their letters and not by hashes."""
    edge = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = np.ascontiguousarray(data[~tk.IS_SPACE[data]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space, end to end, and where each document's begin; first: each one's first word."""
    at = np.flatnonzero(keep)
    doc = np.searchsorted(first, at, "right") - 1
    last = np.ones(len(at), bool)
    last[:-1] = np.diff(doc) != 0
    mask = tk.in_spans(len(data), starts[at], ends[at])
    gap = ends[at[~last]]
    mask[gap] = True
    flat = data.copy()
    flat[gap] = 32
    size = np.bincount(doc, weights=ends[at] - starts[at] + ~last, minlength=len(first) - 1).astype(np.int64)
    return flat[mask], np.concatenate([[0], np.cumsum(size)])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            for i, j in tk.chunks(bounds, CHUNK):
                chunk, own = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                starts, ends, first = tk.words(chunk, own)
                start, length, period = runs_in(word_numbers(chunk, starts, ends), first, least, times)
                keep = ~tk.in_spans(len(starts), start + period, start + length)
                text, edge = joined(chunk, starts, ends, first, keep)
                doc = np.searchsorted(first, start, "right") - 1
                at = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(length), pa.array(period)], fields=list(RUNS.value_type))
                kept = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(edge), pa.py_buffer(text)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rest")[i:j], pa.ListArray.from_arrays(pa.array(at), parts), kept], ["rest", "runs", "kept"])

    return run


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs without the text, with runs (start, length, period in words, by start, then period) and kept: the words left.

    Of each run the words after the first period go; what is left is joined by one space, as bytes.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not found by a grid of two")
    small_batches(docs.sparkSession)
    rows = packed(docs, text)
    schema = rows.select("rest").schema.add("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))).add("kept", "binary")
    out = rows.mapInArrow(_collapsed(least, times), schema)
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in (text, "runs", "kept")), "runs", "kept")


def rewritten(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; in one document of ten the words from some place on repeat, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    asked = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    asked = asked.withColumn("n", F.coalesce(F.array_size("w"), F.lit(0)).cast("long")).withColumn("g", F.expr("h div 10"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    asked = asked.withColumn("a", a).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    i_th = F.transform(F.expr("sequence(0L, n - 1)"), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return asked.select("doc_id", F.when(F.col("n") > 0, F.array_join(i_th, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = collapse(rewritten(docs))
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    done = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    return done.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
