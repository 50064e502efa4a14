"""Op 4. Interpolated modified Kneser-Ney bigram model.

Words are counted in Spark, then pairs: each task sends its distinct pairs by
shard, as packed arrays; a shard joins them and writes a file of sorted pair
hashes and counts. Histories that make up more than a 4096th of all tokens (at
most 4096 of them) are dealt over 64 shards each by their follower. Word counts,
continuation counts and history counts become files of sorted word hashes. The
workers map these files into memory and score whole texts. Files lie in the
folder named by spark.checkpoint.dir; where that is no local path, a worker
maps a nameless copy of what it needs.

Null or empty text: the end token alone. Rows with null ids are scored and, if
their remainder says so, learned from. Repeated rows count each time. Without
training rows all tokens are unknown and of probability 1.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import learn
from tessera.llm import text_kernels as tk
from tessera.llm.shared import materialise, release, shared_dir, small_batches

#: Hashes that stand for a text's end, its start, and the row of pair statistics.
END, START, STATS = (np.uint64(x) for x in (1, 2, 3))
HOT_SHARE, HOT_SPLIT, SHARD_TOKENS, FLUSH = 4096, 64, 2_500_000, 4_000_000
FIELDS = ("c", "n1", "n2", "n3", "cont")


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk with an end after each document, and where each document begins."""
    data = tk.LOWER[data]
    starts, ends, first = tk.words(data, bounds)
    h = np.insert(tk.word_hashes(data, starts, ends), first[1:], END)
    return h, first + np.arange(len(first))


def histories(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[first[:-1]] = START
    return v


def shard_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, v), max(0, len(hot) - 1))
    salt = np.where(hot[at] == v, w % np.uint64(HOT_SPLIT), np.uint64(0)) if len(hot) else np.zeros(len(v), np.uint64)
    return (tk.mix(v + salt * np.uint64(tk.MIX_1)) % np.uint64(shards)).astype(np.int64)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tk.mix(tk.mix(v) + w)


def summed(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and their summed counts."""
    order = np.lexsort((w, v))
    v, w, c = v[order], w[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.empty(0, np.int64)
    return v[head], w[head], np.add.reduceat(c, head) if len(head) else c


def _write(uri: str, arrays: list[np.ndarray]) -> None:
    """One file, put in place whole: the number of arrays, their lengths in bytes, then their bytes."""
    where, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    where.move(part, path)


def _mapped(uri: str, kinds: list) -> list[np.ndarray] | None:
    """The arrays of a file, mapped; None if there is no such shard."""
    where, path = fs.FileSystem.from_uri(uri)
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if isinstance(where, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        copy = tempfile.TemporaryFile()  # noqa: SIM115  it has no name and goes with the mapping
        with where.open_input_stream(path) as src:
            while block := src.read(1 << 22):
                copy.write(block)
        copy.flush()
        raw = np.memmap(copy, np.uint8, "r")
    n = int(raw[:8].view(np.int64)[0])
    at = np.concatenate([[0], np.cumsum(raw[8 : 8 + 8 * n].view(np.int64))]) + 8 + 8 * n
    return [raw[a:b].view(k) for a, b, k in zip(at[:-1], at[1:], kinds, strict=True)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["key", "c"])

    for batch in batches:
        data, bounds = tk.column_bytes(batch.column("text"))
        for i, j in tk.chunks(bounds):
            held.append(tokens(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[0])
        if sum(map(len, held)) >= FLUSH:
            yield flush()
    if held:
        yield flush()


def _send_pairs(hot: np.ndarray, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            v, w, c = summed(v, w, np.ones(len(v), np.int64))
            s = shard_of(v, w, hot, shards)
            order = np.argsort(s, kind="stable")
            v, w, c, s = v[order], w[order], c[order], s[order]
            at = np.flatnonzero(np.diff(s, prepend=-1))
            rows = []
            for a, b in zip(at, np.append(at[1:], len(s)), strict=True):
                own, run_length = np.unique(v[a:b], return_counts=True)  # v is sorted within its shard
                rows.append((int(s[a]), own.tobytes(), run_length.astype(np.uint32).tobytes(), w[a:b].tobytes(), c[a:b].astype(np.uint32).tobytes()))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["shard", "v", "n", "w", "c"])

        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            for i, j in tk.chunks(bounds):
                h, first = tokens(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                held.append((histories(h, first), h))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return run


def _join_pairs(folder: str):
    """Write each shard's file; give its sums by history and by follower."""

    def done(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        v = np.concatenate([np.repeat(np.frombuffer(r[0], np.uint64), np.frombuffer(r[1], np.uint32)) for r in rows])
        w = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        c = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows]).astype(np.int64)
        v, w, c = summed(v, w, c)
        keys = pair_hash(v, w)
        order = np.argsort(keys, kind="stable")
        many = np.flatnonzero(c[order] > 254)
        _write(f"{folder}/pairs-{shard}", [keys[order], many, c[order][many], np.minimum(c[order], 255).astype(np.uint8)])
        own, at = np.unique(v, return_inverse=True)
        by = [np.bincount(at, weights=np.minimum(c, 3) == i, minlength=len(own)).astype(np.int64) for i in (1, 2, 3)]
        follower, cont = np.unique(w, return_counts=True)
        stats = [[(c == 4).sum(), (c == 1).sum(), (c == 2).sum(), (c == 3).sum(), len(c)]]
        none = lambda n: np.zeros(n, np.int64)
        cols = [np.concatenate([own, follower, [STATS]]).view(np.int64)]
        history = [none(len(own)), *by, none(len(own))]
        word = [*(none(len(follower)) for _ in range(4)), cont]
        cols += [np.concatenate([history[i], word[i], [stats[0][i]]]) for i in range(5)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:  # sorted by shard
            for r in zip(*(batch.column(x).to_pylist() for x in ("shard", "v", "n", "w", "c")), strict=True):
                if held and r[0] != shard:
                    yield done(shard, held)
                    held = []
                shard = r[0]
                held.append(r[1:])
        if held:
            yield done(shard, held)

    return run


def _write_words(folder: str):
    def done(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        m = np.concatenate(parts, axis=1)
        m = m[:, np.argsort(m[0].view(np.uint64), kind="stable")]
        stats = m[1:, m[0] == int(STATS)]
        m = m[:, m[0] != int(STATS)]
        _write(f"{folder}/words-{shard}", list(m))
        counts = [int((m[5] == i).sum()) for i in (1, 2, 3, 4)]
        own = [int(x) for x in stats.sum(1)] if stats.size else [0] * 5
        return pa.RecordBatch.from_pydict({"kind": [0, 1], "values": [[*counts, int((m[1] > 0).sum())], own]}, pa.schema([("kind", pa.int32()), ("values", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            m = np.stack([batch.column(x).to_numpy() for x in ("key", *FIELDS)])
            edge = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else []
            for a, b in zip(edge, [*edge[1:], len(ids)], strict=True):
                if held and ids[a] != shard:
                    yield done(shard, held)
                    held = []
                shard = int(ids[a])
                held.append(m[:, a:b])
        if held:
            yield done(shard, held)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and 3 or more; from small corpora without such counts, a half."""
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0, *(min(max(x, 0.05), i) for i, x in enumerate(d, 1))])


@dataclass
class Model:
    folder: str
    shards: int
    word_shards: int
    hot: np.ndarray
    total: int  # training tokens
    kinds: int  # distinct ones
    pairs: int  # distinct pairs
    d_pair: np.ndarray
    d_word: np.ndarray
    word_kinds: np.ndarray  # words seen after 1, 2, 3 or more others
    n_texts: int
    held: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def arrays(self, name: str, kinds: list) -> list[np.ndarray] | None:
        if name not in self.held:
            self.held[name] = _mapped(f"{self.folder}/{name}", kinds)
        return self.held[name]

    def words(self, keys: np.ndarray) -> np.ndarray:
        """FIELDS of distinct words, in columns."""
        out = np.zeros((5, len(keys)), np.int64)
        of = (tk.mix(keys) % np.uint64(self.word_shards)).astype(np.int64)
        for s in np.unique(of):
            got = self.arrays(f"words-{s}", [np.uint64, *[np.int64] * 5])
            if got is not None and len(got[0]):
                mine = np.flatnonzero(of == s)
                at = np.minimum(np.searchsorted(got[0], keys[mine]), len(got[0]) - 1)
                hit = got[0][at] == keys[mine]
                for i in range(5):
                    out[i, mine[hit]] = got[i + 1][at[hit]]
        return out

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.int64)
        of, keys = shard_of(v, w, self.hot, self.shards), pair_hash(v, w)
        order = np.lexsort((keys, of))
        edge = np.flatnonzero(np.diff(of[order], prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            got = self.arrays(f"pairs-{of[order[a]]}", [np.uint64, np.int64, np.int64, np.uint8])
            if got is None or not len(got[0]):
                continue
            mine = order[a:b]
            at = np.minimum(np.searchsorted(got[0], keys[mine]), len(got[0]) - 1)
            c = np.where(got[0][at] == keys[mine], got[3][at].astype(np.int64), 0)
            big = np.flatnonzero(c == 255)
            if len(big):
                c[big] = got[2][np.searchsorted(got[1], at[big])]
            out[mine] = c
        return out

    def score(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each document: tokens, known ones, base score and score."""
        v = histories(h, first)
        keys, at = np.unique(np.concatenate([h, v]), return_inverse=True)
        c, n1, n2, n3, cont = self.words(keys)
        c_of = c.copy()
        c_of[keys == START] = self.n_texts
        at_w, at_v = at[: len(h)], at[len(h) :]
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.kinds + 1)))
        left = self.d_word[1] * self.word_kinds[0] + self.d_word[2] * self.word_kinds[1] + self.d_word[3] * self.word_kinds[2]
        spread = left / self.pairs if self.pairs else 1.0
        p_word = np.maximum(cont - self.d_word[np.minimum(cont, 3)], 0) / max(1, self.pairs) + spread / (self.kinds + 1)
        gamma = np.where(c_of > 0, (self.d_pair[1] * n1 + self.d_pair[2] * n2 + self.d_pair[3] * n3) / np.maximum(c_of, 1), 1.0)
        pair = at_v * len(keys) + at_w
        distinct, back = np.unique(pair, return_inverse=True)
        i, j = distinct // len(keys), distinct % len(keys)
        n = self.pair_counts(keys[i], keys[j])
        p = np.where(c_of[i] > 0, (n - self.d_pair[np.minimum(n, 3)]) / np.maximum(c_of[i], 1), 0) + gamma[i] * p_word[j]
        p = np.log10(p)[back]
        heads = first[:-1]
        return np.diff(first), np.add.reduceat((c > 0).astype(np.int64)[at_w], heads), np.add.reduceat(base[at_w], heads), np.add.reduceat(p, heads)


def train(texts: DataFrame) -> Model:
    """texts: a column text; every row is learned from."""
    spark = texts.sparkSession
    small_batches(spark)
    texts = texts.select(F.col("text").cast("string").alias("text"))
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    words = materialise(texts.mapInArrow(_count_words, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "words")
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot = words.filter(F.col("c") * HOT_SHARE > total).select("key", "c").collect() if total else []  # at most HOT_SHARE rows
    n_texts = next((r["c"] for r in words.filter(F.col("key") == int(END)).collect()), 0)
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-total // SHARD_TOKENS))
    word_shards = max(spark.sparkContext.defaultParallelism, -(-kinds // 1_000_000))
    own = np.sort(np.array([r["key"] for r in hot] + ([int(START)] if n_texts * HOT_SHARE > max(1, total) else []), np.int64).view(np.uint64))
    sent = texts.mapInArrow(_send_pairs(own, shards), "shard long, v binary, n binary, w binary, c binary")
    schema = "key long, " + ", ".join(f"{x} long" for x in FIELDS)
    joined = sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_join_pairs(folder), schema)
    all_words = words.select("key", "c", *(F.lit(0).cast("long").alias(x) for x in FIELDS[1:])).unionByName(joined)
    sums = all_words.groupBy("key").agg(*(F.sum(x).alias(x) for x in FIELDS))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = (tk.mix(b.column("key").to_numpy().view(np.uint64)) % np.uint64(word_shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(of), *(b.column(x) for x in ("key", *FIELDS))], ["shard", "key", *FIELDS])

    dealt = sums.mapInArrow(shard, f"shard long, {schema}").repartition(word_shards, "shard").sortWithinPartitions("shard")
    got = dealt.mapInArrow(_write_words(folder), "kind int, values array<long>").collect()  # two rows a shard
    release(spark)
    word_stats, pair_stats = (np.array([r["values"] for r in got if r["kind"] == k] or [[0] * 5]).sum(0) for k in (0, 1))
    n4, n1, n2, n3, pairs = pair_stats.tolist()
    m1, m2, m3, m4, known = word_stats.tolist()
    return Model(folder, shards, word_shards, own, int(total), int(kinds), int(pairs), discounts(n1, n2, n3, n4), discounts(m1, m2, m3, m4), np.array([m1, m2, known - m1 - m2]), int(n_texts))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of keep, and n_tokens, n_known, base_score, score, which win over columns with these names; docs has a column text."""
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("rest"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            made = [model.score(*tokens(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])) for i, j in tk.chunks(bounds)]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column("rest"), *(pa.array(np.concatenate(x)) for x in zip(*made, strict=True))], ["rest", "n_tokens", "n_known", "base_score", "score"])

    schema = rows.select("rest").schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    made_here = ("n_tokens", "n_known", "base_score", "score")
    return rows.mapInArrow(run, schema).select(*(F.col(f"rest.`{c}`").alias(c) for c in keep if c not in made_here), *made_here)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.filter(learn.remainder("doc_id", 5) != 1))
    held = (learn.remainder("doc_id", 5) == 1).alias("held_out")
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", (F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).alias("perplexity"))
