"""Op 9. Quality classifier: supervised subword embeddings.

Words, word pairs and byte n-grams are hashed to buckets, each with a learned
vector; a text is the average of its vectors, and a softmax over it gives the
score. Vectors and weights are learned together by stochastic gradient descent
with per-parameter steps, on a bounded sample of labelled rows.

Null or empty text: the average is the zero vector and the score that of the
bias. Without labelled rows every score is 0.5. A text labelled more than once
is an example for each label it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import learn
from tessera.llm import text_kernels as tk
from tessera.llm.shared import small_batches

BUCKETS, ORDERS, DIM, PER_CLASS = 8192, (3, 4), 12, 1500


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.vectors) @ self.weights + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shares of the buckets in each text's features."""
    c = learn.gram_counts(data, bounds, ORDERS, BUCKETS, words=True).astype(np.float32)
    return c / np.maximum(c.sum(1, keepdims=True), 1)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.5, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    sums = [np.full_like(p, 1e-6) for p in (e, w, b)]
    goal = np.eye(2, dtype=np.float32)[y]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            xb = x[at]
            h = xb @ e
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - goal[at]) / len(at)
            for param, grad, total in zip((e, w, b), (xb.T @ (d @ w.T), h.T @ d, d.sum(0)), sums, strict=True):
                total += grad * grad
                param -= step * grad / np.sqrt(total)
    return Model(e, w, b)


def fit(rows: DataFrame, label: str, per_class: int = PER_CLASS) -> Model:
    got = learn.sample(rows.filter(F.col(label).isin(0, 1)), label, per_class)
    if got["label"].nunique() < 2:
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    x = np.concatenate([features(*learn.joined(list(got["text"][i : i + 128]))) for i in range(0, len(got), 128)])
    return train(x, got["label"].to_numpy().astype(int))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of keep, and score, which wins over a column of keep with this name; docs has a column text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("rest"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            made = [model.score(features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])) for i, j in learn.doc_chunks(bounds, 256)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(np.concatenate([*made, np.empty(0)]).astype(float))], ["rest", "score"])

    out = rows.mapInArrow(run, rows.select("rest").schema.add("score", "double"))
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in keep if c != "score"), "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter("quality IS NOT NULL")
    model = fit(learn.hashed(docs).join(labels, "doc_id").filter(learn.remainder("doc_id", 3) != 1), "quality")
    held = (learn.remainder("doc_id", 3) == 1).alias("held_out")
    return score(docs, model, ["doc_id"]).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
