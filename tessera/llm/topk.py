"""Op 3. Exact top-k by inner product with MaxScore over sharded postings.

Components x become floor(256 * x). Each dimension is a term; its posting of a
vector is how far the component is from the one that contributes least for the
query's sign, so every contribution is at least 0 and a constant is added back.
For a query, terms go by falling bound. A few vectors scored in full give a
first threshold; the essential terms are the first ones up to where all further
bounds together stay below it, so that no vector can compete by those alone.
Their postings are traversed for the whole shard (dense vectors stand in every
posting); the other terms are probed, some at a time, for the vectors that still
compete, while the threshold rises. Shards give their k best, which are merged.

Vectors that are null, or hold null or non-finite components, take no part. A
query is held against vectors of its own length; empty vectors score 0 with each
other. Vectors with a component of more than 56 bits make shards of their own,
which are scored by integers of any size. Null ids take no part. Ties go to the
smaller id. Fewer than k candidates: all of them. Rows that repeat an id are
candidates each; a query passes over rows of its own id. Scores beyond 64 bits
are ranked exactly and given as the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_rows, materialise

SHARD, QUERY_BLOCK, STEP, FIRST = 8192, 1024, 16, 64
#: A score is carried in two numbers, of which the lower has 62 bits.
LOW = (1 << 62) - 1
SCALE = 256


def integers(x: np.ndarray, big: bool) -> np.ndarray:
    """floor(SCALE * x); as Python's integers if some are large."""
    if not big:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [int(c) * SCALE if abs(c) >= 2.0**53 else int(np.floor(c * SCALE)) for c in x.ravel().tolist()]
    return np.array([*whole, None], object)[:-1].reshape(x.shape)


def sortable(score: int) -> bytes:
    """Bytes whose order is that of the scores, of any size."""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + raw if score >= 0 else b"\x00" + bytes(255 - b for b in raw)


def exact(q: np.ndarray, m: np.ndarray) -> list[int]:
    """Scores by integers of any size."""
    return [sum(a * b for a, b in zip(q.tolist(), col, strict=True)) for col in m.T.tolist()]


def best_in_shard(ids: np.ndarray, m: np.ndarray, q_id: int, q: np.ndarray, k: int, top: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one shard; m has a row for each dimension, top and low its extremes."""
    live = np.flatnonzero(ids != q_id)
    if q.dtype == object or m.dtype == object or (np.abs(q.astype(float)) * np.maximum(np.abs(top.astype(float)), np.abs(low.astype(float)))).sum() * 4 >= 2.0**63:
        total = exact(q, m[:, live])
        first = sorted(range(len(live)), key=lambda i: (-total[i], ids[live[i]]))[:k]
        return ids[live][first], np.array([total[i] for i in first], object)
    edge = np.where(q >= 0, low, top)  # the component that gives least
    bound = q * (np.where(q >= 0, top, low) - edge)
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
    least = 0
    if len(live) > k:
        some = q @ (m[:, live[: max(FIRST, k)]] - edge[:, None])
        least = int(np.partition(some, len(some) - k)[len(some) - k])
    # rest falls, so the essential terms end where it first lies below the threshold
    essential = int(np.argmax(rest < least)) if (rest < least).any() else len(q)
    part = np.zeros(len(live), np.int64)
    at = 0
    while at < len(q) and len(live):
        to = max(essential, STEP) if at == 0 else at + STEP
        terms = order[at:to]
        own = m[terms] if len(live) == m.shape[1] else m[np.ix_(terms, live)]
        part += q[terms] @ (own - edge[terms, None])
        at = min(to, len(q))
        if len(live) > k:
            least = max(least, int(np.partition(part, len(part) - k)[len(part) - k]))
            keep = part + rest[at] >= least
            live, part = live[keep], part[keep]
    total = part + int(q @ edge)
    first = np.lexsort((ids[live], -total))[:k]
    return ids[live][first], total[first]


def _packed(df: DataFrame, group: str) -> DataFrame:
    """One row for each length, size and group of at most some thousand vectors: ids and components as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        dims, big = int(pdf["dims"].iloc[0]), bool(pdf["big"].iloc[0])
        m = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), dims)
        return pd.DataFrame({"dims": [dims], "big": [big], group: [pdf[group].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "m": [np.ascontiguousarray(m.T).tobytes()]})

    return df.groupBy("dims", "big", group).applyInPandas(pack, f"dims int, big boolean, {group} long, ids binary, m binary")


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dims, big (a component of more than 56 bits once scaled) and v, the components' bytes; only whole, finite vectors."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    fine = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))

    @F.pandas_udf("binary")
    def to_bytes(v: pd.Series) -> pd.Series:
        return v.map(lambda a: np.asarray(a, np.float64).tobytes())

    return fine.select("id", F.size("x").alias("dims"), F.exists("x", lambda c: F.abs(c) >= F.lit(2.0**56 / SCALE)).alias("big"), to_bytes("x").alias("v"))


def top_k(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of df with the highest scores for each row of queries."""
    spark = df.sparkSession
    vectors = materialise(finite_vectors(df, id_col, vector_col), "vectors")
    asked = materialise(finite_vectors(queries, id_col, vector_col), "asked")
    kinds = ["dims", "big"]

    def parts_of(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
        """How many parts of about so many rows each length and size makes; and all of them."""
        found = materialise(rows.groupBy(*kinds).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")), "parts")
        return found, found.agg(F.sum("parts")).first()[0] or 1

    def parted(rows: DataFrame, parts: DataFrame, name: str) -> DataFrame:
        return rows.join(parts, kinds).withColumn(name, F.pmod(F.xxhash64("id", "v"), F.col("parts"))).select(*kinds, name, "id", "v")

    (n_shards, some_shards), (n_blocks, some_blocks) = parts_of(vectors, SHARD), parts_of(asked, QUERY_BLOCK)
    shards = materialise(_packed(parted(vectors, n_shards, "shard"), "shard"), "shards")
    blocks = materialise(_packed(parted(asked, n_blocks, "block"), "block"), "blocks")
    # every block of queries is held against all shards of its length, as an exact answer asks
    pairs = blocks.withColumnsRenamed({"ids": "q_ids", "m": "q_m", "big": "q_big"}).join(n_shards, "dims")
    pairs = pairs.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(shards, [*kinds, "shard"])

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for x in pdf.itertuples():
                ids, q_ids = np.frombuffer(x.ids, np.int64), np.frombuffer(x.q_ids, np.int64)
                m = integers(np.frombuffer(x.m, np.float64).reshape(x.dims, len(ids)), x.big)
                q = integers(np.frombuffer(x.q_m, np.float64).reshape(x.dims, len(q_ids)), x.q_big)
                top, low = (m.max(1), m.min(1)) if x.dims else (np.zeros(0, np.int64),) * 2
                found = [(q_id, *best_in_shard(ids, m, q_id, q[:, i], k, top, low)) for i, q_id in enumerate(q_ids)]
                score = [int(s) for f in found for s in f[2].tolist()]
                far = [not -(1 << 124) <= s < 1 << 124 for s in score]
                high = [(1 << 62) * (1 if s > 0 else -1) if o else s >> 62 for s, o in zip(score, far, strict=True)]
                yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "high": high, "low": [0 if o else s & LOW for s, o in zip(score, far, strict=True)], "far": [sortable(s) if o else None for s, o in zip(score, far, strict=True)]})

    with arrow_rows(spark, 16):
        dealt = pairs.repartition(max(1, some_shards * some_blocks), "dims", "big", "shard", "q_big", "block")
        found = materialise(dealt.mapInPandas(search, "query_id long, vec_id long, high long, low long, far binary"), "found")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), F.desc("far"), "vec_id")))
    fits = F.shiftleft("high", 62) + F.col("low")
    score = F.when(F.col("high") > 1, F.lit(2**63 - 1)).when(F.col("high") < -2, F.lit(-(2**63))).otherwise(fits)
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "embedding")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
