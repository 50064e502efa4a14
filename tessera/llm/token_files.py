"""Op 12. Token ids as Parquet lists, and reading them back in part.

Texts are encoded by the tokenizers library. Under the byte-level pattern no token reaches from a character that is not
white space into white space, nor from a letter into punctuation, so texts are cut there, each distinct cut is encoded
once, and texts are put together from the ids of their cuts. Cuts without inner white space are handed over many at a time,
with line ends between them, which are tokens of their own there. Chunks that hold an added token's text, and all texts for a
tokenizer of another make, are encoded text by text.

Documents are sorted by id into range partitions, one file each. A file's columns are id, shard (the partition), first (ids
of the shard's documents before this one), n_tokens, ids and meta (all other columns). The list of ids is dictionary
encoded, or delta encoded where asked for; numbers that only grow are delta encoded. Row groups and pages are small and have
column indexes, so that a reader of some documents skips the pages of others, and a reader of lengths or metadata never
touches ids. Where a document begins among all ids is a sum of shards before its own, found from n_tokens alone, and first.

Null and empty texts: the end id only. Repeated rows and ties of ids: documents of their own, in order of a hash of their
texts; null ids come first. Rows of one id stay in one shard unless their texts differ. A very long text is one row, worked
on whole. Empty table: files without rows. Other columns of any name are kept in meta.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text_kernels as tk
from tessera.llm.shared import materialise, plan_bytes, shared_dir, small_batches

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Bytes of a row group and of a page, and rows of a page.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 8 << 20, 64 << 10, 1000
#: Bytes of input for each file.
SHARD_BYTES = 8 << 20
#: Bytes that the planner names where it knows nothing, as of rows that a driver holds; such input is written before it is dealt out.
UNKNOWN = 1 << 60
#: Files up to which where they begin is sent to all executors.
FILES = 100_000
#: Shards whose sizes are summed in one task.
BLOCK = 1024
#: Distinct cuts that a worker keeps, and how many are handed over at once.
KEPT, TOGETHER = 600_000, 400
#: Bytes of text that are cut together.
CHUNK = 1 << 22
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
IS_POINT = np.zeros(256, bool)
IS_POINT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Second bytes of the two signs among the letters U+00C0 to U+00FF.
SIGNS = 0x97, 0xB7
PLAIN = re.compile(r" ?[^\s\x1c-\x1f\x85]+")


class Store:
    """Distinct cuts, and their ids end to end."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.int32)

    def add(self, cuts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(cuts, range(n, n + len(cuts)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])


@lru_cache(maxsize=2)
def _loaded(raw: str, end: int | None) -> Coder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # other tasks of the executor have its other cores
    return Coder(raw, end)


class Coder:
    """Encodes whole texts of a column to flat ids."""

    def __init__(self, raw: str, end: int | None = END):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.store = Tokenizer.from_str(raw), end, Store()
        spec = json.loads(raw)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if line else None
        self.cuts = len(line) == 1 and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and spec.get("truncation") is None and spec.get("padding") is None

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, cuts: list[str]) -> None:
        """Encode cuts that are not known yet: plain ones together, parted by the token of a line end, and others one by one."""
        plain = [c for c in cuts if PLAIN.fullmatch(c)]
        odd = [c for c in cuts if not PLAIN.fullmatch(c)]
        made = self.encoded(["\n".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)])
        flat = np.array(list(chain.from_iterable(chain.from_iterable((x, (self.line,)) for x in made))), np.int32)
        end = np.flatnonzero(flat == self.line)
        if len(end) != len(plain):
            raise ValueError("a line end is not a token of its own")
        self.store.add(plain, np.delete(flat, end), np.diff(end, prepend=-1) - 1)
        made = self.encoded(odd)
        self.store.add(odd, np.array(list(chain.from_iterable(made)), np.int32), np.array([len(x) for x in made], np.int64))

    def starts_of_cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where texts begin, ASCII white space after a character that is known to be none, and ASCII punctuation after a letter."""
        begins = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            lead = np.zeros(len(data), np.uint8)  # the byte before the one before
            lead[1:] = data[:-1]
            solid = (data > 32) & (data < 127) | (data >= 128) & (data < 192) & (lead >= 0xC3) & (lead < 0xE0)
            letter = IS_LETTER[data] | (lead == 0xC3) & (data != SIGNS[0]) & (data != SIGNS[1])
            begins[1:-1] = tk.IS_SPACE[data[1:]] & solid[:-1] | IS_POINT[data[1:]] & letter[:-1]
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        return np.flatnonzero(begins[:-1])

    def from_cuts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.starts_of_cuts(data, bounds)
        edge = np.concatenate([start, [len(data)]]).astype(np.int64)
        cuts = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        own = cuts.dictionary.to_pylist()
        if len(self.store.known) > KEPT:
            self.store = Store()
        found = np.fromiter(map(self.store.known.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(found < 0)
        if len(new):
            words = [own[i] for i in new.tolist()]
            self.learn(words)
            found[new] = [self.store.known[w] for w in words]
        at = found[cuts.indices.to_numpy()]
        first, size = self.store.first[at], np.diff(self.store.first)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.store.ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends[np.searchsorted(start, bounds)]

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts end to end, each with the end id behind it, and where each text's begin."""
        data, bounds = tk.column_bytes(text)
        parts, edges, total = [], [np.zeros(1, np.int64)], 0
        for i, j in tk.chunks(bounds, CHUNK):
            own = bounds[i : j + 1] - bounds[i]
            raw = data[bounds[i] : bounds[j]].tobytes() if self.added else b""
            if self.cuts and not any(a in raw for a in self.added):
                ids, first = self.from_cuts(data[bounds[i] : bounds[j]], own)
            else:
                made = self.encoded([x or "" for x in text[i:j].to_pylist()])
                ids, first = np.fromiter(chain.from_iterable(made), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int64)
            if self.end is not None:
                ids, first = np.insert(ids, first[1:], self.end), first + np.arange(len(first))
            parts.append(ids.astype(np.int32))
            edges.append(first[1:] + total)
            total += len(ids)
        return np.concatenate(parts or [np.empty(0, np.int32)]), np.concatenate(edges)


def write(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end: int | None = END, delta: bool = False) -> None:
    """Encode docs by the tokenizer whose JSON is given and write the files of the format to path, in order of key."""
    spark = docs.sparkSession
    small_batches(spark)
    if plan_bytes(docs) > UNKNOWN:
        docs = materialise(docs, "documents")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)]
    own = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(own).alias("tie"), own.alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("meta"))
    files = max(2 * spark.sparkContext.defaultParallelism, -(-plan_bytes(docs) // SHARD_BYTES))
    rows = rows.repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie")
    rows = rows.select("id", F.spark_partition_id().alias("shard"), "text", "meta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before = _loaded(tokenizer, end), 0
        for batch in batches:  # batches of a partition come in order
            ids, edge = coder(batch.column("text").cast(pa.large_string()))
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))
            cols = [batch.column("id"), batch.column("shard"), pa.array(before + edge[:-1]), pa.array(np.diff(edge)), lists, batch.column("meta")]
            before += int(edge[-1])
            yield pa.RecordBatch.from_arrays(cols, ["id", "shard", "first", "n_tokens", "ids", "meta"])

    kinds = rows.schema
    schema = T.StructType([kinds["id"], kinds["shard"], T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), kinds["meta"]])
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",  # delta encoding where there is no dictionary
        "parquet.block.size": GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary#ids.list.element": not delta,
        **{f"parquet.enable.dictionary#{c}": False for c in ("id", "first")},
    }
    rows.mapInArrow(run, schema).write.options(**{k: str(v).lower() for k, v in options.items()}).parquet(path)


def read(spark: SparkSession, path: str, columns: Iterable[str] = ("id", "n_tokens", "ids"), ids: list | None = None) -> DataFrame:
    """Columns of the files at path, of all documents or of those with the given ids; the rest is not read.

    start, where a document begins among all ids, can be asked for as well.
    """
    columns = list(columns)
    found = spark.read.parquet(path)
    if ids is not None:
        found = found.filter(F.col("id").isin(ids))
    if "start" not in columns:
        return found.select(*columns)
    held = [c for c in columns if c != "start"]
    starts = shard_starts(spark, path)
    if len(found.inputFiles()) <= FILES:  # a row of two numbers for each, so that ids are not shuffled
        starts = F.broadcast(starts)
    return found.select(*dict.fromkeys(["shard", "first", *held])).join(starts, "shard").withColumn("start", F.col("base") + F.col("first")).select(*columns)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard and base: the ids of all shards before it, a row for each file."""
    total = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("total")).withColumn("block", F.expr(f"shard div {BLOCK}"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = total.groupBy("block").agg(F.sum("total").alias("t")).withColumn("ahead", F.coalesce(F.sum("t").over(before.orderBy("block")), F.lit(0)))
    own = F.coalesce(F.sum("total").over(before.partitionBy("block").orderBy("shard")), F.lit(0))
    return total.withColumn("own", own).join(blocks.select("block", "ahead"), "block").select("shard", (F.col("ahead") + F.col("own")).alias("base"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        edge = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), pa.array(np.diff(edge).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op12_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        raw = f.read()
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, raw, path)
    found = read(spark, path, ("id", "start", "ids"))
    return found.mapInArrow(_crc, T.StructType([T.StructField("doc_id", found.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))]))
