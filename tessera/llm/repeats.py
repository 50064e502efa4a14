"""Exact repeats of a fixed length across a corpus, found by anchors and resolved in shards.

Every window of ``span`` symbols (bytes or words) chooses one anchor: the
k-gram of least hash in it. Equal windows choose equal anchors, so repeats are
found among places whose anchor k-gram recurs. Places with the same whole
context (all that windows over the anchor cover) are one row with a count.
Anchors that have several contexts are resolved by a function given by the
caller (suffix arrays or suffix trees), group by group. A group too large for
one task is split: windows that reach at least half as far to the left go by
that much longer a prefix, the others by as much more to the right, and what is
equal within the shorter contexts becomes one row again; until groups fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import recurring
from tessera.llm import text_kernels as tk
from tessera.llm.shared import arrow_rows, discard, materialise, plan_bytes, reread, small_batches, tasks_for


@dataclass(frozen=True)
class Scheme:
    unit: str  # "bytes" or "words"
    k: int
    width: int
    hot: int = 4096  # contexts of one anchor that are resolved together, about a shard of them; beyond, its prefix is made longer
    shard: int = 1 << 20  # symbols that are resolved together

    @property
    def span(self) -> int:
        return self.k + self.width - 1

    @property
    def reach(self) -> int:
        return tk.REACH if self.unit == "bytes" else 0

    def symbols(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Hashes of the symbols of a chunk, where each document begins among them, and the words' starts and ends."""
        if self.unit == "bytes":
            return tk.byte_symbols(data), bounds, None, None
        starts, ends, first = tk.words(data, bounds)
        return tk.word_hashes(data, starts, ends), first, starts, ends


    def of(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The symbols of pieces of text: bytes, or hashes of words."""
        if self.unit == "bytes":
            return [np.frombuffer(x, np.uint8) for x in pieces]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        sym, first, _, _ = self.symbols(np.frombuffer(b"".join(pieces), np.uint8), bounds)
        return [sym[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


#: resolve(groups, left, right, scheme) -> for each row a boolean array over its window starts.
Resolver = Callable[[np.ndarray, list[np.ndarray], list[np.ndarray], Scheme], list[np.ndarray]]


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """Rows with a number of their own, their text, and all other columns packed, so that no name can clash.

    The number is that of the row in its partition; rows that may be dealt otherwise when read again are written first.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = reread(docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("rest")))
    return packed.select(F.monotonically_increasing_id().alias("row"), "text", "rest")


def stored(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """numbered() with the numbers written beside the texts, and the bytes of docs.

    The numbers stay when the table is read again in other parts, as happens when executors come or go.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("rest"))
    size = plan_bytes(docs.select(f"`{text}`"))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "text", "rest"), "rows")
    return rows, size if size < UNKNOWN else plan_bytes(rows.select("row", "text"))


#: Bytes that the planner names where it knows nothing.
UNKNOWN = 1 << 60
#: Places that a task sends at once.
HELD = 400_000


def _sent(scheme: Scheme, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All places of each task, and which k-grams stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            gram, context, row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows, of = np.unique(row, return_inverse=True)
            order = np.argsort(gram, kind="stable")
            key, count = recurring.runs(gram[order])
            place = np.array([len(rows), *rows], np.int64).tobytes() + of[order].astype(np.uint32).tobytes()
            own = key.tobytes(), context[order].tobytes(), place, pos[order].astype(np.int32).tobytes(), count.astype(np.uint32).tobytes()
            yield from recurring.sent(int(rows[0]), key, count, own, shards)

        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            ids = batch.column("row").to_numpy()
            for i, j in tk.chunks(bounds):
                own = bounds[i : j + 1] - bounds[i]
                sym, sym_bounds, _, _ = scheme.symbols(data[bounds[i] : bounds[j]], own)
                doc, pos, gram, context = tk.anchors(sym, sym_bounds, scheme.k, scheme.width, scheme.reach)
                if len(doc):
                    held.append((gram, context, ids[i + doc], pos))
                    if sum(len(x[0]) for x in held) >= HELD:
                        yield from flush()
        if held:
            yield from flush()

    return run


def _places(own: dict, key: np.ndarray, token: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The places whose k-gram recurs: h and c, the hashes of k-gram and context, row and pos."""
    gram, context = np.frombuffer(own["a"], np.int64), np.frombuffer(own["b"], np.int64)
    pos, count = np.frombuffer(own["d"], np.int32), np.frombuffer(own["e"], np.uint32)
    rows = np.frombuffer(own["c"], np.int64, int(np.frombuffer(own["c"], np.int64, 1)[0]), 8)
    row = np.frombuffer(own["c"], np.uint32, offset=8 + rows.nbytes)
    of, entry = recurring.occurrences(count.astype(np.int64), key)
    for i in range(0, len(of), 100_000):
        at = entry[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(gram[key[of[i : i + 100_000]]]), pa.array(context[at]), pa.array(rows[row[at]]), pa.array(pos[at])], ["h", "c", "row", "pos"])


def _contexts(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut the asked contexts out of whole texts: what stands left of the anchor's k-gram and right of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            asked = batch.column("asked").to_pylist()
            for i, j in tk.chunks(bounds):
                chunk = data[bounds[i] : bounds[j]]
                raw, first, starts, ends = chunk.tobytes(), bounds[i : j + 1] - bounds[i], None, None
                if scheme.unit == "words":
                    starts, ends, first = tk.words(chunk, first)

                def cut(a: int, b: int) -> bytes:
                    if a >= b:
                        return b""
                    return raw[a:b] if starts is None else b" ".join(raw[starts[a] : ends[b - 1]].split())  # noqa: B023  used within this turn

                out: list[tuple] = []
                for d in range(i, j):
                    lo, hi = int(first[d - i]), int(first[d - i + 1])
                    for x in asked[d]:
                        at = lo + x["pos"]
                        out.append((x["h"], x["c"], cut(max(lo, at - scheme.width + 1), at), cut(at + scheme.k, min(hi, at + scheme.span))))
                if out:
                    h, c, left, right = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["h", "c", "left", "right"])

    return run


def _windows(n_left: int, n_right: int, scheme: Scheme) -> int:
    """How many windows over its anchor a context holds."""
    return max(0, n_left + n_right - (scheme.width - 1) + 1)


def spans_of(starts: np.ndarray, n_left: int, span: int) -> list[int]:
    """Merged spans, relative to the anchor, that windows at the marked starts cover: [lo, hi, lo, hi, ...]."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > span)
    lo, hi = np.concatenate([at[:1], at[cut + 1]]), np.concatenate([at[cut], at[-1:]]) + span
    return np.stack([lo - n_left, hi - n_left], 1).ravel().tolist()


#: A context, or part of one: the group's key, whose context it is (h, c), the symbols left and right of what the group shares, how many windows that leaves, and how far the shared part goes left of the anchor.
PART = "key long, h long, c long, left binary, right binary, width int, off int"


def _resolved(scheme: Scheme, resolve: Resolver) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by width and key: the spans of each part that others of its group repeat."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        own = replace(scheme, width=rows[0][5])
        left, right = (scheme.of([r[i] for r in rows]) for i in (3, 4))
        _, groups = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        marks = resolve(groups, left, right, own)
        spans = [spans_of(m, len(x) + r[6], scheme.span) for m, x, r in zip(marks, left, rows, strict=True)]
        keep = [i for i, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in keep], pa.int64()), pa.array([rows[i][2] for i in keep], pa.int64()), pa.array([spans[i] for i in keep], pa.list_(pa.int32()))], ["h", "c", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:  # groups are whole when the key changes
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "c", "left", "right", "width", "off")), strict=True):
                if held and (held[-1][5] != r[5] or size >= scheme.shard and held[-1][0] != r[0]):
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += 2 * r[5]
        if held:
            yield solve(held)

    return run


def _halves(part: tuple, unit: str) -> Iterator[tuple]:
    """Of a part: the windows that reach further left, and the others, each with what these share moved into the key."""
    key, h, c, left, right, width, off = part
    words = unit == "words"
    x, y = (left.split(b" ") if left else [], right.split(b" ") if right else []) if words else (left, right)
    put = b" ".join if words else bytes
    m = width // 2

    def made(side: bytes, shared, a, b, w: int, o: int) -> Iterator[tuple]:
        if len(a) + len(b) >= w - 1:
            name = hashlib.blake2b(side + key.to_bytes(8, "little", signed=True) + put(shared), digest_size=8).digest()
            yield int.from_bytes(name, "little", signed=True), h, c, put(a), put(b), w, o, len(a), len(b)

    if m and len(x) >= m:
        yield from made(b"<", x[len(x) - m :], x[max(0, len(x) - width + 1) : len(x) - m], y[: width - 1 - m], width - m, off + m)
    if m and len(y) >= width - m:
        yield from made(b">", y[: width - m], x[max(0, len(x) - m + 1) :] if m > 1 else x[:0], y[width - m : width - 1], m, off)


def _split(unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h", "c", "left", "right", "width", "off"]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int32()] * 4
        for batch in batches:
            rows = [p for r in zip(*(batch.column(x).to_pylist() for x in names), strict=True) for p in _halves(r, unit)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*names, "n_left", "n_right"])

    return run


def _shorter(hot: DataFrame, scheme: Scheme) -> tuple[list[DataFrame], list[DataFrame]]:
    """Parts of the contexts of large groups, in groups that fit, and the spans of contexts whose part occurs twice as a whole."""
    parts, whole = [], []
    while True:
        split = materialise(hot.mapInArrow(_split(scheme.unit), PART + ", n_left int, n_right int"), "halves")
        same = ["key", "width", "off", "left", "right"]
        kinds = materialise(split.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.first("h").alias("h"), F.first("c").alias("c")), "kinds")
        far = F.least(F.col("n_left"), F.col("width") - 1) + F.col("off")
        near = F.greatest(F.lit(0), F.col("width") - 1 - F.col("n_right")) + F.col("off")
        twice = split.join(kinds.filter("n > 1").select(*same), same, "left_semi")
        whole.append(materialise(twice.select("h", "c", F.array(-far, F.lit(scheme.span) - near).alias("spans")), "whole"))
        groups = materialise(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "groups")
        sized = materialise(kinds.join(groups, "key"), "sized")
        parts.append(sized.filter(F.col("m") <= scheme.hot).drop("n", "m"))
        hot = sized.filter(F.col("m") > scheme.hot).drop("n", "m")
        discard(split, kinds, groups)
        if not hot.limit(1).count():
            return parts, whole


def repeated_spans(rows: DataFrame, size: int, scheme: Scheme, resolve: Resolver) -> DataFrame:
    """For each row of stored() that has any: spans [lo, hi, ...] of symbols that repeated windows cover, not merged."""
    spark = rows.sparkSession
    text = rows.select("row", "text")
    shards = int(min(1 << 20, max(spark.sparkContext.defaultParallelism, size // 16_000_000)))
    with arrow_rows(spark, 200):
        messages = text.mapInArrow(_sent(scheme, shards), recurring.MESSAGE)
        places = materialise(recurring.exchange(messages, shards, _places, "h long, c long, row long, pos int"), "places")

    kinds = materialise(places.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("pos").alias("pos")), "kinds")
    several = materialise(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n_kinds")).filter("n_kinds > 1"), "several")
    asked = kinds.join(several, "h").groupBy("row").agg(F.collect_list(F.struct("h", "c", "pos")).alias("asked"))
    with arrow_rows(spark, 500):
        cut = text.join(asked, "row").mapInArrow(_contexts(scheme), "h long, c long, left binary, right binary")
        cut = materialise(cut.select(F.col("h").alias("key"), "h", "c", "left", "right", F.lit(scheme.width).alias("width"), F.lit(0).alias("off")), "cut")
    hot = several.filter(F.col("n_kinds") > scheme.hot).select(F.col("h").alias("key"))
    parts, whole = [cut], []
    if hot.limit(1).count():
        longer, whole = _shorter(cut.join(hot, "key", "left_semi"), scheme)
        parts = [cut.join(hot, "key", "left_anti"), *longer]
    many = reduce(DataFrame.unionByName, parts)
    n = tasks_for(spark, cut.count(), 20_000)
    solved = many.repartition(n, "key").sortWithinPartitions("width", "key").mapInArrow(_resolved(scheme, resolve), "h long, c long, spans array<int>")
    # a context that occurs twice is repeated as a whole; of the others only what was resolved
    part = materialise(reduce(DataFrame.unionByName, [solved, *whole]), "solved")
    twice = kinds.filter("n > 1").select("h", "c", F.lit(None).cast("array<int>").alias("spans"))
    marks = materialise(twice.unionByName(part.join(twice, ["h", "c"], "left_anti")), "marks")
    discard(kinds, several, cut, part)
    # one join of places, which Spark may split where a context is common; spans may end beyond the text
    low = F.greatest(F.col("pos") - F.lit(scheme.width - 1), F.lit(0))
    found = F.when(F.col("spans").isNull(), F.array(low, F.col("pos") + scheme.span)).otherwise(F.transform("spans", lambda x: x + F.col("pos")))
    spans = places.join(marks, ["h", "c"]).select("row", found.alias("spans")).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = materialise(spans, "spans")  # so that places are gone when texts are shuffled
    discard(places, marks)
    return spans


def without_repeats(docs: DataFrame, text: str, scheme: Scheme, resolve: Resolver, characters: bool = False) -> DataFrame:
    """All columns but the text, then n_units, n_removed, n_spans, kept (the text left, as bytes).

    Of words, the kept ones are joined by one space. A null text counts as empty. With characters, what is
    left of a UTF-8 character that was cut in two goes from kept as well. The four names win over columns of docs
    with the same name.
    """
    made_here = ("n_units", "n_removed", "n_spans", "kept")
    rows, size = stored(docs, text)
    spans = repeated_spans(rows, size, scheme, resolve)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            column = batch.column("spans")
            made: list[tuple] = []
            for i, j in tk.chunks(bounds):
                chunk, own = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                starts = ends = None
                first = own
                if scheme.unit == "words":
                    starts, ends, first = tk.words(chunk, own)
                raw = chunk.tobytes()
                for d in range(i, j):
                    lo, hi = int(first[d - i]), int(first[d - i + 1])
                    s = column[d].values
                    s = np.empty(0, np.int64) if s is None else s.to_numpy(zero_copy_only=False).astype(np.int64)
                    gone = tk.in_spans(hi - lo, s[::2], s[1::2])
                    n_gone, n_spans = int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum())
                    if scheme.unit == "bytes":
                        kept = raw[lo:hi] if not n_gone else chunk[lo:hi][~gone].tobytes()
                    else:
                        kept = b" ".join([raw[a:b] for a, b, g in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), gone.tolist(), strict=True) if not g])
                    if characters and n_gone:
                        kept = kept.decode("utf-8", "ignore").encode()
                    made.append((hi - lo, n_gone, n_spans, kept))
            cols = list(zip(*made, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["rest", "n_units", "n_removed", "n_spans", "kept"])

    joined = rows.join(spans, "row", "left").select("text", "rest", "spans")
    schema = rows.select("rest").schema.add("n_units", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    out = joined.mapInArrow(run, schema)
    names = [c for c in docs.columns if c != text and c not in made_here]
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in names), "n_units", "n_removed", "n_spans", "kept")
