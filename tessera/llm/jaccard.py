"""Op 2. N-gram Jaccard self-join: documents whose shingle sets share 3/4 or more of their union.

Every text is cut into shingles (tokens) once. Rows of equal words are one
class, and the first row of a class stands for it.

1. Tasks send which tokens they hold to shards, and hear back how many tasks'
   classes hold each of those that recur. The rarest first, a set of n tokens
   needs n - ceil(3n/4) + 1 of them (its prefix) against smaller sets and
   n - ceil(6n/7) + 1 against larger ones, so that no link can be missed. What
   occurs once only fills a prefix, and many prefixes hold nothing else.
2. Rounds: each class goes with its text to the star whose centre it shares most
   prefix tokens with. There, and at last for each token that still spans
   components, the sets form a signature tree whose nodes hold OR- and
   AND-combined token bitmaps and size ranges. Pairs of nodes are followed from
   the root down and dropped when the largest possible overlap is too small, or
   all is in one component. Pairs of sets that are left are held against each
   other, unless links found before join them; so a group of n sets gives n - 1
   links at most.

Tokens that are told apart by part of their hash only add candidates. Null or
empty texts have empty sets and link with nothing. Repeated rows and equal sets
share a component. A null id never names a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import recurring
from tessera.llm import text_kernels as tk
from tessera.llm.repeats import stored
from tessera.llm.shared import arrow_rows, discard, materialise, tasks_for

#: Words of a shingle; tokens and rows that a task sends at once; rows of a part of a star, and of a group of the last trees.
WORDS, HELD, HELD_ROWS, STAR_ROWS, GROUP = 5, 500_000, 60_000, 500, 1024
#: Children of a node; rounds of stars at most; size of a list beyond which it is parted by set size.
LEAF, FAN, ROUNDS, SMALL = 16, 8, 4, 32


def sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, where each document's begin; the same of its words, unsorted."""
    data = tk.LOWER[data]
    starts, ends, first = tk.words(data, bounds)
    h = tk.word_hashes(data, starts, ends)
    n = np.diff(first)
    prefix = tk.Prefix(h)
    lo, hi = first[:-1], np.maximum(first[:-1], first[1:] - WORDS + 1)
    count = np.where(n == 0, 0, np.maximum(1, hi - lo))
    edge = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - edge[doc] + lo[doc]
    g = prefix.ranges(at, np.minimum(at + WORDS, first[doc + 1]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.concatenate([[0], np.cumsum(new)])[edge], h, first


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share 3/4 or more of their union."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def signature(g: np.ndarray) -> np.ndarray:
    """A bitmap of four to eight bits for each token, at least 64."""
    bits = max(64, 4 << (len(g) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(g % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def _sent(shards: int):
    """Tokens of each task, by shard; and their documents, which go along to any shard and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of each chunk: rows, classes, sizes and tokens
        n_tokens = n_rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            row, n, g = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3))
            cls = [c for x in held for c in x[1]]
            held.clear()
            seen: dict[bytes, int] = {}
            own = np.fromiter((seen.setdefault(c, i) == i for i, c in enumerate(cls)), bool, len(cls))
            doc = np.repeat(np.arange(len(row)), n)
            if not own.all():
                g, doc = g[own[doc]], doc[own[doc]]
            order = np.argsort(g, kind="stable")
            key, count = recurring.runs(g[order])
            mine = row.tobytes(), b"".join(cls), n.astype(np.int64).tobytes(), doc[order].astype(np.uint16).tobytes(), count.astype(np.uint32).tobytes()
            yield from recurring.sent(int(row[0]), key, count, mine, shards)

        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            ids = batch.column("row").to_numpy()
            for i, j in tk.chunks(bounds):
                g, first, h, word = sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                cls = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(word[:-1].tolist(), word[1:].tolist(), strict=True)]
                if n_rows and n_rows + j - i > HELD_ROWS:
                    yield from flush()
                    n_tokens = n_rows = 0
                held.append((ids[i:j], cls, np.diff(first), g))
                n_tokens, n_rows = n_tokens + len(g), n_rows + j - i
                if n_tokens >= HELD:
                    yield from flush()
                    n_tokens = n_rows = 0
        if held:
            yield from flush()

    return run


def _listed(own: dict, key: np.ndarray, token: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each document its class, size, the recurring tokens of its prefix, and how many of them are in the shorter one."""
    row, cls, n = np.frombuffer(own["a"], np.int64), own["b"], np.frombuffer(own["c"], np.int64)
    doc, count = np.frombuffer(own["d"], np.uint16).astype(np.int64), np.frombuffer(own["e"], np.uint32).astype(np.int64)
    of, entry = recurring.occurrences(count, key)
    held = doc[entry]
    order = np.lexsort((token[of], code[of], held))
    held, token = held[order], token[of][order]
    recur = np.bincount(held, minlength=len(row))
    first = np.cumsum(recur) - recur
    place = n[held] - recur[held] + np.arange(len(held)) - first[held]
    wide, narrow = n - -(-3 * n // 4) + 1, n - -(-6 * n // 7) + 1
    keep = place < wide[held]
    kept = np.bincount(held[keep], minlength=len(row))
    short = np.bincount(held[place < narrow[held]], minlength=len(row))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(token[keep]))
    names = pa.array([cls[16 * i : 16 * i + 16] for i in range(len(row))], pa.binary())
    made = pa.RecordBatch.from_arrays([pa.array(row), names, pa.array(n), lists, pa.array(short.astype(np.int64))], ["row", "cls", "n", "tokens", "short"])
    for i in range(0, len(row), 5000):
        yield made.slice(i, 5000)


class Tree:
    """A signature tree over sets in order of size; node 0 of the last level is the root."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, sign: np.ndarray):
        self.levels = [(sign, sign, n, n, comp)]
        while len(self.levels[-1][2]) > 1:
            join, meet, low, high, own = self.levels[-1]
            cut = np.arange(0, len(low), LEAF if len(self.levels) == 1 else FAN)
            same = np.where(np.minimum.reduceat(own, cut) == np.maximum.reduceat(own, cut), own[cut], -1)
            self.levels.append((np.bitwise_or.reduceat(join, cut), np.bitwise_and.reduceat(meet, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), same))

    def children(self, level: int, i: np.ndarray) -> np.ndarray:
        fan = LEAF if level == 1 else FAN
        kids = i[:, None] * fan + np.arange(fan)
        return np.where(kids < len(self.levels[level - 1][2]), kids, -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets that may link and are not in one component: node pairs, level by level, from the root against itself."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            x, y = self.children(level, a), self.children(level, b)
            left, right = np.repeat(x, x.shape[1], 1).ravel(), np.tile(y, (1, y.shape[1])).ravel()
            fine = (left >= 0) & (right >= left)
            a, b = left[fine], right[fine]
            parts = [self.may(level - 1, a[i : i + 20_000], b[i : i + 20_000]) for i in range(0, len(a), 20_000)]
            ok = np.concatenate(parts) if parts else np.empty(0, bool)
            a, b = a[ok], b[ok]
        return a[a != b], b[a != b]

    def may(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        join, meet, low, high, own = self.levels[level]
        ok = (own[a] < 0) | (own[a] != own[b])
        lone_a = np.bitwise_count(meet[a] & ~join[b]).sum(1).astype(np.int64)
        lone_b = np.bitwise_count(meet[b] & ~join[a]).sum(1).astype(np.int64)
        # an overlap of 3/7 of both sizes together is needed, and x has at least so many tokens that y lacks
        return ok & (4 * high[a] - 3 * low[b] >= 7 * lone_a) & (4 * high[b] - 3 * low[a] >= 7 * lone_b)


def folded(signs: list[np.ndarray]) -> np.ndarray:
    """Bitmaps brought to the least width among them."""
    raw = [s.view(np.uint64) for s in signs]
    width = min(map(len, raw))
    return np.stack([np.bitwise_or.reduce(r.reshape(-1, width), axis=0) for r in raw])


def may_link(n: np.ndarray, comp: np.ndarray, signs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that a signature tree over sets of sizes n leaves; sets of one component are no pair."""
    order = np.argsort(n, kind="stable")
    a, b = Tree(n[order], comp[order], folded([signs[i] for i in order])).pairs()
    return order[a], order[b]


def links_among(own: list[np.ndarray], comp: list[int], centre: int | None = None) -> list[tuple[int, int]]:
    """Links between sets that join their components to those that links among all of them give; the centre is tried first."""
    _, comp = np.unique(np.array(comp), return_inverse=True)
    up = list(range(int(comp.max()) + 1))

    def root(i: int) -> int:
        x = int(comp[i])
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    found: list[tuple[int, int]] = []

    def tried(i: int, j: int) -> None:
        if (x := root(i)) != (y := root(j)) and linked(own[i], own[j]):
            up[max(x, y)] = min(x, y)
            found.append((i, j))

    if centre is not None:
        for i in range(len(own)):
            tried(i, centre)
    if len({root(i) for i in range(len(own))}) > 1:
        now = np.array([root(i) for i in range(len(own))])
        for i, j in zip(*may_link(np.array([len(g) for g in own]), now, [signature(g) for g in own]), strict=True):
            tried(int(i), int(j))
    return found


def _held_sets(batches: Iterator[pa.RecordBatch], keys: list[str], also: list[str]) -> Iterator[tuple[list[np.ndarray], list[tuple]]]:
    """The sets of each run of rows with equal keys, and the further columns of these rows."""
    key, own, rest = None, [], []
    for batch in batches:
        data, bounds = tk.column_bytes(batch.column("text"))
        cols = list(zip(*(batch.column(x).to_pylist() for x in keys), strict=True))
        more = list(zip(*(batch.column(x).to_pylist() for x in also), strict=True))
        for i, j in tk.chunks(bounds):
            g, first, _, _ = sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            for d in range(i, j):
                if own and cols[d] != key:
                    yield own, rest
                    own, rest = [], []
                key = cols[d]
                own.append(g[first[d - i] : first[d - i + 1]].copy())
                rest.append(more[d])
    if own:
        yield own, rest


def _pairs_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by star and part, the centre first: links among them."""
    for own, rest in _held_sets(batches, ["centre", "salt"], ["row", "comp"]):
        if found := links_among(own, [r[1] for r in rest], 0):
            yield _pairs_out([(rest[i][0], rest[j][0]) for i, j in found])


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own, rest in _held_sets(batches, ["group"], ["row", "comp"]):
        if found := links_among(own, [r[1] for r in rest]):
            yield _pairs_out([(rest[i][0], rest[j][0]) for i, j in found])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = tk.column_bytes(batch.column("text"))
        for i, j in tk.chunks(bounds):
            g, first, _, _ = sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            signs = [signature(g[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(signs, pa.binary())], ["row", "sign"])


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: those that are in some pair that the group's signature tree leaves."""

    def done(rows: list[tuple]) -> pa.RecordBatch | None:
        _, comp = np.unique(np.array([r[3] for r in rows]), return_inverse=True)
        a, b = may_link(np.array([r[2] for r in rows]), comp, [np.frombuffer(r[4], np.uint8) for r in rows])
        left = np.unique(np.concatenate([a, b]))
        if not len(left):
            return None
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in left]), pa.array([rows[i][1] for i in left]), pa.array([rows[i][3] for i in left])], ["group", "row", "comp"])

    group, held = None, []
    for batch in batches:
        for r in zip(*(batch.column(x).to_pylist() for x in ("group", "row", "n", "comp", "sign")), strict=True):
            if held and r[0] != group:
                if len(held) > 1 and (made := done(held)) is not None:
                    yield made
                held = []
            group = r[0]
            held.append(r)
    if len(held) > 1 and (made := done(held)) is not None:
        yield made


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node that edges (a, b) connect it with; by smallest neighbours and jumps along them."""
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "edges").toDF("node", "other")
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        low = labels.join(near, "node").select("node", F.least("comp", "c").alias("low"), "comp")
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = materialise(low.join(jump, "low").select("node", F.least("low", "up").alias("comp"), (F.least("low", "up") < F.col("comp")).alias("moved")), "labels")
        discard(labels)
        labels = new.select("node", "comp")
        if not new.filter("moved").limit(1).count():
            discard(both)
            return labels


def _still_open(listed: DataFrame, comps: DataFrame | None) -> DataFrame:
    """listed and the component of each row, for tokens that span several only; m and members tell which rows list a token."""
    if comps is None:
        own = listed.withColumn("comp", F.col("row"))
    else:
        own = listed.join(comps.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    open_ = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("row")).alias("members")).filter("lo < hi").select("token", "m", "members")
    return materialise(own.join(open_, "token"), "open")


def _stars(still: DataFrame, turn: int) -> DataFrame:
    """centre, salt, row, comp and head: each row with the centre that it shares most tokens with, centres with each part of their star."""
    weight = still.groupBy("row").agg(F.sum(F.log2("m")).alias("weight"))
    order = F.xxhash64(F.lit(turn), "row")
    # rows that share most tokens are at the middle of a group of copies; every other round goes by chance
    best = F.struct(F.lit(0.0).alias("weight") if turn % 2 else F.col("weight"), order.alias("o"), F.col("row"), F.col("n"), F.col("comp"))
    centre = still.join(weight, "row").groupBy("token").agg(F.max(best).alias("at")).select("token", F.col("at.row").alias("a"), F.col("at.n").alias("na"), F.col("at.comp").alias("ca"))
    votes = still.join(centre, "token").filter((F.col("ca") != F.col("comp")) & (4 * F.least("n", "na") >= 3 * F.greatest("n", "na")))
    chosen = votes.groupBy("row", "comp", "a", "ca").agg(F.count(F.lit(1)).alias("votes")).groupBy("row", "comp").agg(F.max(F.struct("votes", "a", "ca")).alias("at"))
    chosen = materialise(chosen.select("row", "comp", F.col("at.a").alias("centre"), F.col("at.ca").alias("ca")), "stars")
    many = chosen.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("salts"), F.min("ca").alias("ca"))
    members = chosen.join(many.select("centre", "salts"), "centre").select("centre", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), "row", "comp", F.lit(1).alias("head"))
    heads = many.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("centre").alias("row"), F.col("ca").alias("comp"), F.lit(0).alias("head"))
    return members.unionByName(heads)


def groups_of(still: DataFrame) -> DataFrame:
    """Rows dealt to groups: by tokens, if more than a few also by size band and the next band; larger groups by pairs of blocks."""
    # tokens that the same rows list make one group
    still = still.groupBy("members", "m", "row").agg(F.max("n").alias("n"), F.max("comp").alias("comp"))
    band = F.floor(F.log("n") / F.log(F.lit(4.0 / 3)) + 1e-9)
    rows = still.withColumn("band", F.explode(F.when(F.col("m") <= SMALL, F.array(F.lit(0).cast("long"))).otherwise(F.array(band, band + 1))))
    blocks = F.ceil(F.col("m") / GROUP).cast("int")
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("members", "m", "band", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), "row", "n", "comp")


def link(docs: DataFrame, id_col: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of stored(docs), and for each of its rows: row, id, n_shingles, component_id, and whether it stays as its component's one row."""
    spark = docs.sparkSession
    rows, size = stored(docs, text)
    only = rows.select("row", "text")
    shards = int(min(1 << 20, max(spark.sparkContext.defaultParallelism, size // 3_000_000)))
    with arrow_rows(spark, 200):
        sent = only.mapInArrow(_sent(shards), recurring.MESSAGE)
        found = materialise(recurring.exchange(sent, shards, _listed, "row long, cls binary, n long, tokens array<long>, short long"), "listed")
    homes = materialise(found.filter("n > 0").groupBy("cls").agg(F.min("row").alias("home")), "homes")
    firsts = found.filter(F.size("tokens") > 0).join(homes, found["row"] == homes["home"], "left_semi")
    listed = firsts.select("row", "n", F.explode("tokens").alias("token"))
    still = _still_open(materialise(listed, "tokens"), None)

    edges, comps, texts = None, None, None
    left = still.count()
    for turn in range(ROUNDS):
        if not left:
            break
        if texts is None:
            texts = materialise(only.join(still.select("row").distinct(), "row", "left_semi"), "texts")
        stars = materialise(_stars(still, turn), "stars")
        n = tasks_for(spark, stars.count(), 2000)
        with arrow_rows(spark, 500):
            dealt = texts.join(stars, "row").repartition(n, "centre", "salt").sortWithinPartitions("centre", "salt", "head")
            made = materialise(dealt.mapInArrow(_star_links, "a long, b long"), "links")
        edges = made if edges is None else edges.union(made)
        comps = components(edges)
        before, still = left, _still_open(still.select("token", "row", "n"), comps)
        left = still.count()
        if 4 * left > 3 * before and turn:
            break
    if left:
        with arrow_rows(spark, 500):
            signs = materialise(texts.join(still.select("row").distinct(), "row", "left_semi").mapInArrow(_signed, "row long, sign binary"), "signs")
            grouped = groups_of(still).join(signs, "row")
            dealt = grouped.repartition(tasks_for(spark, left, 20_000), "group").sortWithinPartitions("group")
            kept = materialise(dealt.mapInArrow(_group_rows, "group long, row long, comp long"), "groups")
            dealt = texts.join(kept, "row").repartition(tasks_for(spark, kept.count(), 2000), "group").sortWithinPartitions("group")
            made = materialise(dealt.mapInArrow(_group_links, "a long, b long"), "links")
        edges = made if edges is None else edges.union(made)
        comps = components(edges)

    ids = rows.select("row", F.col(f"rest.`{id_col}`").alias("id"))
    named = found.select("row", "cls", "n").join(ids, "row").join(homes, "cls", "left")
    if comps is None:
        named = named.withColumn("comp", F.col("home"))
    else:
        named = named.join(comps.withColumnRenamed("node", "home"), "home", "left").withColumn("comp", F.coalesce("comp", "home"))
    named = materialise(named.select("row", "id", "n", "comp"), "named")
    least = materialise(named.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")), "least")
    alone = F.col("n") == 0
    out = named.join(least, "comp", "left").select("row", "id", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component_id"), (alone | (F.col("row") == F.col("first.row"))).alias("stays"))
    return rows, out


def deduplicated(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (the first such row if it repeats); all columns of docs."""
    rows, found = link(docs, id_col, text)
    kept = rows.join(found.filter("stays").select("row"), "row")
    return kept.select(*(F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link(docs, "doc_id")[1].select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.v = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
