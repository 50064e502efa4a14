"""A corpus pipeline over documents, in stages; counted as part of tessera.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents. Null and empty texts:
language ID rejects them. Ties and repeated rows: the row of the smallest id,
and of those the first, stays for its component. Extra columns pass through,
whatever their names, but for text, n_chars and lang, which have their meaning.
A document of a null id is kept or dropped as any other; an empty table gives
an empty one. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, language_id, pieces, suffix_array
from tessera.llm.shared import materialise
from tessera.session import ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: documents whose language is rejected go."""
    ship_package(spark)
    model = language_id.fit(docs.select("text", "lang"), "lang")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = language_id.predict(docs.select("text", F.struct(F.lit(0).alias("_"), *others).alias("own")), model)
    return found.filter(~F.col("rejected")).select(*(F.col("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: one document of each component of linked documents stays."""
    ship_package(spark)
    return jaccard.deduplicated(docs, "doc_id")


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: repeated 200-byte strings go; a character cut in two goes as a whole."""
    ship_package(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    done = suffix_array.dedup(docs.select("text", F.struct(F.lit(0).alias("_"), *others).alias("own")), characters=True)
    text = F.col("kept").cast("string")
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*(made.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: documents that hold a benchmark item go."""
    ship_package(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: ids of each text, decoded again and held against the text."""
    ship_package(spark)
    with open(pieces.MODEL, "rb") as f:
        done = pieces.encode(docs.select("doc_id", "lang", "source", "text"), f.read())
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded", "round_trip", "parity")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", near_duplicates),
    ("suffix_array_dedup", repeated_bytes),
    ("decontamination", no_benchmark),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
