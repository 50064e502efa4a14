"""Op 7. Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The examples are a bounded, balanced sample of labelled rows. Every word of an
example is a term, so the cosine is that of whole texts. A term's idf is times
the absolute log odds of its shares in toxic and clean examples: with plain idf
the words that both classes use alike outweigh the few that differ. Postings lie in blocks of examples with the largest weight of each
term in each block; a query visits blocks by falling bound, four times as many
each time, and stops when none can still reach its k-th best cosine, so the
neighbours are exact (ties: the smaller example).
Votes weighted by cosine are turned into a score by a monotone fit on the
examples themselves, each left out in turn.

Null or empty texts and texts with no word of an example have no neighbour:
their score is the share of toxic ones among examples without one. Without
labelled rows every score is 0. A text labelled more than once is an example
for each label it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import learn
from tessera.llm import text_kernels as tk
from tessera.llm.shared import small_batches

PER_CLASS, NEIGHBOURS, BLOCK = 1500, 15, 64


@dataclass(frozen=True)
class Index:
    vocab: np.ndarray  # sorted word hashes
    idf: np.ndarray
    n: int  # examples
    toxic: np.ndarray
    first: np.ndarray  # where the blocks of each term begin
    block: np.ndarray  # by term: the blocks with examples that hold it
    most: np.ndarray  # largest weight of the term in the block
    cut: np.ndarray  # where the postings of (term, block) begin
    example: np.ndarray  # postings by term and block
    weight: np.ndarray

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the k highest positive cosines with the query, and the cosines."""
        own, of = spans(self.first[terms], self.first[terms + 1])
        block, w = self.block[own], weights[of]
        bound = np.bincount(block, w * self.most[own], max(1, -(-self.n // BLOCK)))
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        found, best = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 4
        while at < len(order):
            now = np.zeros(len(bound), bool)
            now[order[at : at + step]] = True
            if len(best) == k:
                now &= bound >= best[-1] - 1e-9
                if not now.any():
                    break
            mine = now[block]
            posting, of = spans(self.cut[own[mine]], self.cut[own[mine] + 1])
            got = np.bincount(self.example[posting], w[mine][of] * self.weight[posting], self.n)
            if leave >= 0:
                got[leave] = 0
            new = np.flatnonzero(got > 0)
            found, best = np.concatenate([found, new]), np.concatenate([best, got[new]])
            kept = np.lexsort((found, -np.round(best, 12)))[:k]
            found, best = found[kept], best[kept]
            at, step = at + step, 4 * step
        return found, best


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all [lo, hi), one after the other, and which of the spans each is of."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (lo - np.cumsum(n) + n)[of], of


def word_terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of letters of a chunk, and each document's first one."""
    data = TO_WORDS[data]
    starts, ends, first = tk.words(data, bounds)
    return tk.word_hashes(data, starts, ends), first


#: ASCII capitals become small, other ASCII but letters parts words.
TO_WORDS = np.where((np.arange(256) < 128) & ~((tk.LOWER >= 97) & (tk.LOWER <= 122)), 32, tk.LOWER).astype(np.uint8)


def queries_of(hashes: np.ndarray, first: np.ndarray, vocab: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and unit TF-IDF weights of each document."""
    at = np.minimum(np.searchsorted(vocab, hashes), max(0, len(vocab) - 1))
    hit = np.flatnonzero(vocab[at] == hashes) if len(vocab) else np.empty(0, np.int64)
    doc = np.searchsorted(first, hit, "right") - 1
    key, count = np.unique(doc * max(1, len(vocab)) + at[hit], return_counts=True)
    doc, term = key // max(1, len(vocab)), key % max(1, len(vocab))
    edge = np.searchsorted(doc, np.arange(len(first)))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        w = (1 + np.log(count[a:b])) * idf[term[a:b]]
        out.append((term[a:b], w / max(np.sqrt((w * w).sum()), 1e-12)))
    return out


def build(texts: list[str], toxic: np.ndarray) -> Index:
    """The index over examples; toxic holds 0 or 1."""
    n = len(texts)
    sets = [np.unique(word_terms(*learn.joined([t]))[0]) for t in texts]
    vocab, inv = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    df = np.bincount(inv, minlength=len(vocab))
    df1 = np.bincount(inv[np.repeat(toxic, [len(s) for s in sets]) == 1], minlength=len(vocab))
    n1 = int(toxic.sum())
    odds = np.log((df1 + 0.5) / (n1 + 1)) - np.log((df - df1 + 0.5) / (n - n1 + 1))
    idf = (np.log((1 + n) / (1 + df)) + 0.01) * (np.abs(odds) + 0.01)
    vectors = [q for t in texts for q in queries_of(*word_terms(*learn.joined([t])), vocab, idf)]
    term = np.concatenate([*(q[0] for q in vectors), np.empty(0, np.int64)]).astype(np.int64)
    weight = np.concatenate([*(q[1] for q in vectors), np.empty(0)])
    example = np.repeat(np.arange(n), [len(q[0]) for q in vectors])
    order = np.lexsort((example, term))
    term, weight, example = term[order], weight[order], example[order]
    block = example // BLOCK
    head = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    most = np.maximum.reduceat(weight, head) if len(head) else np.empty(0)
    first = np.searchsorted(term[head], np.arange(len(vocab) + 1))
    return Index(vocab, idf, n, toxic.astype(float), first, block[head], most, np.append(head, len(term)), example, weight)


@dataclass(frozen=True)
class Model:
    index: Index
    votes: np.ndarray  # rising votes and the score of each, to interpolate
    scores: np.ndarray
    alone: float  # score of a text without neighbours
    ids: np.ndarray  # of the examples

    def of(self, terms: np.ndarray, weights: np.ndarray) -> tuple[float, list[int]]:
        found, cosine = self.index.nearest(terms, weights, NEIGHBOURS) if len(terms) else (np.empty(0, int), np.empty(0))
        if not len(found):
            return self.alone, []
        return float(np.interp((cosine * self.index.toxic[found]).sum() / cosine.sum(), self.votes, self.scores)), self.ids[found[:5]].tolist()


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising values of x and the fitted share of y at each."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
            pools[-1][0] = a
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(rows: DataFrame, label: str, per_class: int = PER_CLASS, id_col: str = "doc_id") -> Model:
    got = learn.sample(rows.filter(F.col(label).isin(0, 1)), label, per_class, id_col=id_col)
    toxic = got["label"].to_numpy().astype(int)
    index = build(list(got["text"]), toxic)
    votes, truth, alone = [], [], []
    for i, t in enumerate(got["text"]):
        terms, weights = queries_of(*word_terms(*learn.joined([t])), index.vocab, index.idf)[0]
        found, cosine = index.nearest(terms, weights, NEIGHBOURS, leave=i) if len(terms) else (np.empty(0, int), np.empty(0))
        if len(found):
            votes.append((cosine * index.toxic[found]).sum() / cosine.sum())
            truth.append(toxic[i])
        else:
            alone.append(toxic[i])
    x, y = monotone(np.array(votes), np.array(truth, float)) if votes else (np.zeros(1), np.zeros(1))
    return Model(index, x, y, float(np.mean(alone)) if alone else 0.0, got["id"].fillna(-1).to_numpy(np.int64))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of keep, score and evidence (the ids of the nearest examples); docs has a column text.

    score and evidence win over columns of keep with these names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("rest"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.column_bytes(batch.column("text"))
            made = []
            for i, j in tk.chunks(bounds):
                found = word_terms(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                made += [model.of(*q) for q in queries_of(*found, model.index.vocab, model.index.idf)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(pa.int64()))], ["rest", "score", "evidence"])

    out = rows.mapInArrow(run, rows.select("rest").schema.add("score", "double").add("evidence", T.ArrayType(T.LongType())))
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in keep if c not in ("score", "evidence")), "score", "evidence")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter("toxic IS NOT NULL")
    model = fit(learn.hashed(docs).join(labels, "doc_id").filter(learn.remainder("doc_id", 3) != 1), "toxic")
    held = (learn.remainder("doc_id", 3) == 1).alias("held_out")
    return score(docs, model, ["doc_id"]).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
