"""Bounded samples of labelled rows, and hashed count vectors of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text_kernels as tk


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; of a null id as of an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def hashed(docs: DataFrame) -> DataFrame:
    """docs (with a column text) and a hash of the text, to be taken before a join, so that counting texts needn't move them."""
    return docs.withColumn(HASH, F.xxhash64(F.lit(7), F.coalesce(F.col("text").cast("string"), F.lit(""))))


HASH = "_text_hash"


def sample(rows: DataFrame, label: str, per_label: int, max_labels: int = 1000, id_col: str | None = None) -> pd.DataFrame:
    """At most per_label texts of each label, chosen by their hash; columns text, label and id (0 without id_col).

    The counts are of the distinct texts of all rows; a share of each label's hash range is then read, about twice
    what is kept. A text counts once for each label it has; its id is the least of its rows'.
    """
    rows = rows if HASH in rows.columns else hashed(rows)
    own = F.col(id_col).cast("long") if id_col else F.lit(0).cast("long")
    rows = rows.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col(label).alias("label"), own.alias("id"), F.col(HASH).alias("h"))
    counts = {r["label"]: max(1, r["n"]) for r in rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    share = F.lit(False)
    for value, n in counts.items():
        most = -(2**63) + min(2**64 - 1, int(2**64 * min(1.0, 2.0 * per_label / n)))
        share = share | ((F.col("label") == F.lit(value)) & (F.col("h") <= F.lit(most)))
    # the count is near, not exact, so the number of rows is bounded by a limit as well
    got = rows.filter(share).groupBy("h", "label").agg(F.min("text").alias("text"), F.min("id").alias("id")).orderBy("h", "label").limit(4 * per_label * max(1, len(counts))).toPandas()
    return got.groupby("label", sort=True).head(per_label).sort_values(["label", "h"]).reset_index(drop=True)[["text", "label", "id"]]


def doc_chunks(bounds: np.ndarray, docs: int) -> Iterator[tuple[int, int]]:
    """Chunks of about a megabyte, and of so many documents at most."""
    for i, j in tk.chunks(bounds):
        for k in range(i, j, docs):
            yield k, min(j, k + docs)


def gram_counts(data: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], buckets: int, words: bool = False) -> np.ndarray:
    """For each document, how many of its byte n-grams fall in each bucket; with words, also its words and word pairs."""
    docs, n = len(bounds) - 1, int(bounds[-1])
    out = np.zeros(docs * buckets, np.int64)
    doc_of = np.repeat(np.arange(docs, dtype=np.int64), np.diff(bounds))
    prefix = tk.Prefix(tk.BYTE_HASH[data])
    for k in orders:
        if n >= k:
            h = prefix.window(k)
            same = doc_of[: n - k + 1] == doc_of[k - 1 :]
            key = doc_of[: n - k + 1] * buckets + (h % np.uint64(buckets)).astype(np.int64)
            out += np.bincount(key[same], minlength=len(out))
    if words:
        starts, ends, first = tk.words(data, bounds)
        if len(starts):
            h, of = prefix.ranges(starts, ends), np.repeat(np.arange(docs, dtype=np.int64), np.diff(first))
            out += np.bincount(of * buckets + (tk.mix(h) % np.uint64(buckets)).astype(np.int64), minlength=len(out))
            pair = tk.mix(h[1:] - h[:-1])  # the same for every word that is said twice
            same = of[1:] == of[:-1]
            out += np.bincount((of[1:] * buckets + (pair % np.uint64(buckets)).astype(np.int64))[same], minlength=len(out))
    return out.reshape(docs, buckets)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
