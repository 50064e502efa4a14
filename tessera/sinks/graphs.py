"""Graphs kept in folders: nodes and edges as JSON lines, compressed or not, or as Parquet, with their schemas beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = {"json": ("json", "none"), "json.gz": ("json", "gzip"), "parquet": ("parquet", "zstd")}


def save(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes the tables nodes and edges below path, each in parts; the manifest is written last, so that a folder without one is not whole.

    A folder that holds a graph is not written over.
    """
    form, codec = KINDS[kind]
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.option("ignoreNullFields", "false").option("compression", codec).format(form).save(f"{path}/{name}")
    manifest = json.dumps({"kind": kind, "nodes": nodes.schema.jsonValue(), "edges": edges.schema.jsonValue()}, sort_keys=True)
    nodes.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges as they were saved, with their types; a node id that edges name and nodes lack is left as it is."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    form, _ = KINDS[manifest["kind"]]
    nodes, edges = (spark.read.schema(StructType.fromJson(manifest[name])).format(form).load(f"{path}/{name}") for name in ("nodes", "edges"))
    return nodes, edges


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which end: src, dst or both."""
    ids = nodes.select("id").distinct()
    src = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left")
    both = src.join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    lacks = F.when(F.col("_s").isNull() & F.col("_d").isNull(), "both").when(F.col("_s").isNull(), "src").when(F.col("_d").isNull(), "dst")
    return both.withColumn("missing", lacks).filter("missing IS NOT NULL").select(*edges.columns, "missing")
