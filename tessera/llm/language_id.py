"""Op 8. Language ID by nearest centroid.

Texts are TF-IDF vectors of hashed byte n-grams of their lower-cased letters.
Each language has several centroids, by spherical k-means on a bounded sample
of its labelled rows; a text takes the language of the centroid of highest
cosine. It is rejected if that cosine is below what the centroid's own texts
of that length reach, or if it has no letter.

Null, empty or letterless text: ``und``, score 0, rejected. A table without
labelled rows: every text is ``und``. Ties go to the language that sorts first.
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
from tessera.llm.repeats import numbered
from tessera.llm.shared import small_batches

BUCKETS, ORDERS, CENTROIDS, PER_LANGUAGE, SHARPNESS = 4096, (1, 2, 3), 4, 400, 25.0
#: Share of its own language's lowest cosine, by length, under which a text is rejected.
SLACK = 0.5
#: Everything in ASCII that is no small letter parts words.
TO_LETTERS = np.where((np.arange(256) < 128) & ~((np.arange(256) >= 97) & (np.arange(256) <= 122)), 32, np.arange(256)).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # by column
    owner: np.ndarray  # language of each centroid
    floor: np.ndarray  # least cosine by power of two of the length


def vectors(data: np.ndarray, bounds: np.ndarray, idf: np.ndarray | None) -> np.ndarray:
    counts = learn.gram_counts(TO_LETTERS[data], bounds, ORDERS, BUCKETS)
    v = np.log1p(counts).astype(np.float32)
    if idf is None:
        return v
    v *= idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def clusters(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the vector least like those so far."""
    centres = [v.mean(0)]
    while len(centres) < min(k, len(v)):
        c = np.stack(centres)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        centres.append(v[int((v @ c.T).max(1).argmin())])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = (v @ c.T).argmax(1)
        c = np.stack([v[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(rows: DataFrame, lang: str, per_language: int = PER_LANGUAGE) -> Model:
    """rows: text and lang, to learn from; at most per_language rows of each language are used."""
    got = learn.sample(rows.select(F.lower("text").alias("text"), lang).filter(F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}")), lang, per_language)
    langs = sorted(got["label"].unique())
    if not langs:
        return Model([], np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, int), np.zeros(64))
    raw = np.concatenate([vectors(*learn.joined(list(got["text"][i : i + 128])), None) for i in range(0, len(got), 128)])
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
    v = raw * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    label = got["label"].to_numpy()
    cs = [clusters(v[label == x], CENTROIDS) for x in langs]
    owner = np.repeat(np.arange(len(langs)), [len(c) for c in cs])
    centroids = np.concatenate(cs).T.astype(np.float32)
    cos = v @ centroids
    own = np.array([cos[i][owner == langs.index(x)].max() for i, x in enumerate(label)])
    length = np.array([len(t.encode()).bit_length() for t in got["text"]])
    floor = np.full(64, np.nan)
    for b in np.unique(length):
        floor[b] = np.quantile(own[length == b], 0.01) * SLACK
    known = np.flatnonzero(~np.isnan(floor))
    floor = np.interp(np.arange(64), known, floor[known])
    floor[: known[0]] = 0  # shorter than any example: no ground to reject
    return Model(langs, idf, centroids, owner, floor)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected, which win over columns of docs with these names."""
    made_here = ("lang_pred", "score", "rejected")
    small_batches(docs.sparkSession)
    rows = numbered(docs, text).select(F.lower("text").alias("low"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_langs = len(model.langs)
        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("low"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best, score, cosine = np.full(len(letters), -1), np.zeros(len(letters)), np.zeros(len(letters))
            for i, j in learn.doc_chunks(bounds, 256) if n_langs else ():
                cos = vectors(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], model.idf) @ model.centroids
                by_lang = np.stack([cos[:, model.owner == x].max(1) for x in range(n_langs)], 1)
                best[i:j] = by_lang.argmax(1)
                cosine[i:j] = by_lang.max(1)
                score[i:j] = 1 / np.exp(SHARPNESS * (by_lang - by_lang.max(1, keepdims=True))).sum(1)
            known = letters & (best >= 0)
            size = np.array([int(x).bit_length() for x in np.diff(bounds)])
            rejected = ~known | (cosine < model.floor[size])
            names = np.array([*model.langs, "und"], object)
            made = names[np.where(known, best, n_langs)]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("rest"), pa.array(made, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(rejected)], ["text", "rest", "lang_pred", "score", "rejected"])

    out = rows.mapInArrow(run, rows.select("text", "rest").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
    return out.select(*(F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in made_here), *made_here)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(learn.remainder("doc_id", 4) != 2), "lang")
    held = (learn.remainder("doc_id", 4) == 2).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score", "rejected")
