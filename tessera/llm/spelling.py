"""Op 11. Variants of spelling: each word's near words, and the common form that it varies.

Words are near if one inserted, deleted or replaced character parts them. A word without its i-th character has a key of
64 bits, made by NumPy from the polynomial hash of what stands before i and of what stands after it, for all characters of
many words at once; the whole word has one as well. Keys are dealt to partitions by their upper bits and sorted there. A
replaced character shows as two keys of the same i, an inserted one as a key of a shorter word's whole. What shares a key
is then compared as text, so that keys that agree by chance lose nothing and add nothing. Each such cell (a text and a
place) gives every member its number of others and the best of them, so no pairs are made; a cell holds no more words than
the alphabet has characters, times the places of one.

The form of a word is its near word of largest count, if that is large enough; forms are followed to the last by doubling.

Null and empty texts hold no words. Repeated rows count again. A very long text is worked on whole, and so is a very long
word: it has a key of 8 bytes for each character, and its letters travel only with keys that recur. Ties go to the smallest
word in code-point order. An empty table gives no words. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import text_kernels as tk
from tessera.llm.shared import discard, materialise, small_batches, tasks_for

LETTERS, LEAST, RATIO = 6, 5, 5
#: One run of so many loses a character, where a query asks for it.
EVERY = 199
#: Distinct words that a task counts before it sends them.
HELD = 200_000
#: Keys of a partition.
KEYS = 2_000_000
#: Fixed value: the reversed polynomial of the checksum.
CRC_POLYNOMIAL = 0xEDB88320
#: Letters in bytes up to which checksums are put together by table.
SHORT = 64


def _crc_tables() -> np.ndarray:
    """What each byte of a checksum becomes when 0 to SHORT zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(CRC_POLYNOMIAL), step >> 1).astype(np.uint32)
    out = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])]
    for _ in range(SHORT):
        out.append((out[-1] >> 8) ^ step[out[-1] & 255])
    return np.stack(out)


CRC = _crc_tables()


def crc_after(before: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The checksum of two texts put together, from that of each and the bytes of the second, SHORT at most."""
    out = word.copy()
    for j in range(4):
        out ^= CRC[size, j, (before >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in each document, and each document's first run."""
    low = data | 32
    two = data == 0xC3  # the first byte of all of U+00C0 to U+00FF
    inside = (low >= 97) & (low <= 122) | two
    inside[1:] |= two[:-1]
    return tk.words(np.where(inside, np.uint8(97), np.uint8(32)), bounds)


def _counted(letters: int, every: int | None):
    def sent(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            keys = batch.column("key").to_pylist()
            for i, j in tk.chunks(bounds, 1 << 20):
                low = tk.LOWER[data[bounds[i] : bounds[j]]]
                starts, ends, first = letter_runs(low, bounds[i : j + 1] - bounds[i])
                points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
                long = np.flatnonzero(points[ends] - points[starts] >= letters)
                if not len(long):
                    continue
                doc = np.searchsorted(first, long, "right") - 1
                starts, ends = starts[long], ends[long]
                size = ends - starts
                edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                flat = np.ascontiguousarray(low[tk.in_spans(len(low), starts, ends)])
                coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(flat)]).dictionary_encode()
                own, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                less = np.zeros(len(at), bool)
                if every:
                    before = np.array([0 if k is None else zlib.crc32(f"{k}:".encode()) for k in keys[i:j]], np.uint32)
                    known = np.array([k is not None for k in keys[i:j]])[doc]
                    h = crc_after(before[doc], np.array([zlib.crc32(w) for w in own], np.uint32)[at], np.minimum(size, SHORT))
                    for x in np.flatnonzero(size > SHORT).tolist():
                        h[x] = zlib.crc32(own[at[x]], int(before[doc[x]]))
                    less = known & (h % np.uint32(every) == 0)
                    for x in np.flatnonzero(less).tolist():
                        word = own[at[x]].decode()
                        if len(word) > letters:
                            gone = int(h[x]) % len(word)
                            total[(word[:gone] + word[gone + 1 :]).encode()] += 1
                count = np.bincount(at[~less], minlength=len(own))
                for x in np.flatnonzero(count).tolist():
                    total[own[x]] += int(count[x])
                if len(total) >= HELD:
                    yield sent(total)
                    total = Counter()
        if total:
            yield sent(total)

    return run


def counts(docs: DataFrame, text: str = "text", key: str | None = None, letters: int = LETTERS, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word and n: runs of letters with A-Z lower-cased, of so many characters and occurrences at least.

    With a key, a run loses a character if every divides the checksum of the key, a colon and the run; which one is the
    rest of that checksum by the run's length.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), (F.col(f"`{key}`") if key else F.lit(None)).cast("string").alias("key"))
    parts = rows.mapInArrow(_counted(letters, every if key else None), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word whole, then of every character of every word: the key without it; whose it is; which one (-1: whole); whether the next one is another."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = np.concatenate([[0], np.cumsum(size)])
    prefix = tk.Prefix(tk.mix(code + np.uint64(tk.BASE)))
    sums, inv = prefix.sums, tk.powers(len(code) + 2)[1]
    lo, hi = edge[:-1], edge[1:]
    salt = np.uint64(tk.MIX_2)
    whole = tk.mix((sums[hi] - sums[lo]) * inv[lo] + size.astype(np.uint64) * salt)
    of = np.repeat(np.arange(len(words)), size)
    i, start, end = np.arange(len(code)), lo[of], hi[of]
    rest = tk.mix((sums[i] - sums[start]) * inv[start] + (sums[end] - sums[i + 1]) * inv[start + 1] + (size[of] - 1).astype(np.uint64) * salt)
    other = np.ones(len(code), bool)
    other[:-1] = (code[:-1] != code[1:]) | (i[:-1] + 1 == end[:-1])
    return np.concatenate([whole, rest]), np.concatenate([np.arange(len(words)), of]), np.concatenate([np.full(len(words), -1), i - start]), np.concatenate([np.ones(len(words), bool), other])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        for i, j in tk.chunks(bounds, 200_000):
            key, of, at, other = deletion_keys(words[i:j])
            for a in range(0, len(key), 100_000):
                s = slice(a, a + 100_000)
                part = (key[s] >> np.uint64(40)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key[s].view(np.int64)), pa.array(ids[i + of[s]]), pa.array(at[s].astype(np.int32)), pa.array(other[s])], ["part", "key", "id", "at", "other"])


def shared_cells(key: np.ndarray, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: entries that may lie one character from another, and their cell's place (-1: an inserted character).

    An entry comes twice if it may do so by a replaced and by an inserted character.
    """
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    order = np.lexsort([at, group])
    g, a = group[order], at[order]
    head = np.ones(len(g), bool)
    head[1:] = (np.diff(g) != 0) | (np.diff(a) != 0)
    run = np.cumsum(head) - 1
    same = order[(np.bincount(run)[run] > 1) & (a >= 0)] if len(run) else order
    n = int(group[-1]) + 1 if len(group) else 0
    both = (np.bincount(group[at < 0], minlength=n) > 0) & (np.bincount(group[(at >= 0) & other], minlength=n) > 0)
    parted = np.flatnonzero(both[group] & other) if n else np.empty(0, np.int64)
    return np.concatenate([same, parted]), np.concatenate([at[same], np.full(len(parted), -1)])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; groups are whole when the key changes."""
    names, tail = ("key", "id", "at", "other"), None

    def made(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entry, cell = shared_cells(x[0], x[2], x[3])
        if len(entry):
            yield pa.RecordBatch.from_arrays([pa.array(x[1][entry]), pa.array(x[2][entry]), pa.array(cell.astype(np.int32))], ["id", "at", "cell"])

    for batch in batches:
        x = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        x = x if tail is None else [np.concatenate(p) for p in zip(tail, x, strict=True)]
        if not len(x[0]):
            continue
        cut = int(np.searchsorted(x[0], x[0][-1]))
        yield from made([c[:cut] for c in x])
        tail = [c[cut:] for c in x]
    if tail is not None:
        yield from made(tail)


def near(vocabulary: DataFrame) -> DataFrame:
    """For each id of vocabulary (id, word, n) that has near words: n_near, and best, the near word of largest n as (-n, word)."""
    spark = vocabulary.sparkSession
    size = vocabulary.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = tasks_for(spark, size, KEYS)
    keys = vocabulary.select("id", "word").mapInArrow(_keyed, "part int, key long, id long, at int, other boolean")
    cells = keys.repartition(parts, "part").drop("part").sortWithinPartitions("key").mapInArrow(_recurring, "id long, at int, cell int")
    text = F.when(F.col("at") < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")))
    members = cells.join(vocabulary, "id").select("id", "at", "cell", text.alias("rest"), F.struct((-F.col("n")).alias("minus"), "word").alias("own"))
    cell = Window.partitionBy("cell", "rest")
    ranked = cell.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.col("at") < 0
    best, second = F.first("own").over(ranked), F.nth_value("own", 2).over(ranked)
    shorter, n_longer, longer = F.min(F.when(whole, F.col("own"))).over(cell), F.count(F.when(~whole, 1)).over(cell), F.min(F.when(~whole, F.col("own"))).over(cell)
    found = members.select("id", "own", "cell", "at", F.count(F.lit(1)).over(cell).alias("n"), best.alias("b1"), second.alias("b2"), shorter.alias("s"), n_longer.alias("n_l"), longer.alias("l"))
    replaced = F.col("cell") >= 0
    count = F.when(replaced, F.col("n") - 1).when(whole, F.col("n_l")).otherwise(F.when(F.col("s").isNull(), 0).otherwise(1))
    top = F.when(replaced, F.when(F.col("b1") == F.col("own"), F.col("b2")).otherwise(F.col("b1"))).when(whole, F.col("l")).otherwise(F.col("s"))
    return found.select("id", count.cast("long").alias("k"), top.alias("top")).filter("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.min("top").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form), each form followed to the last; forms must not go round."""
    now = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.filter("moved").limit(1).count():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words (word, n; each word once) with form, root, n_near and form_n; a form has ratio times the word's count at least."""
    vocabulary = materialise(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    form_n = -F.col("best.minus")
    form = F.when(form_n >= ratio * F.col("n"), F.col("best.word"))
    found = vocabulary.join(near(vocabulary), "id", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), form_n).alias("form_n"))
    found = materialise(found, "forms")
    roots = last_forms(found.filter(F.col("form").isNotNull()).select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(counts(docs, key="doc_id"))


#: The checksum is made byte by byte with the table of its polynomial.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM o WHERE length(w) >= 6 GROUP BY doc_id, w),
h AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM c, t),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.s
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.s),
b AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM p),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.other END AS form, CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n FROM v LEFT JOIN b ON b.word = v.word AND b.r = 1),
g AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, g.root FROM f JOIN g ON f.form = g.word)
SELECT f.word, f.form, g.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN g ON g.word = f.word
"""
