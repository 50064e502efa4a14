"""Rule files: rules and the predicates that they share, read by executors and joined as tables.

Rules: rule_id, uses (a predicate's name or null), metadata, pattern, symbol_triggers, languages. Predicates: name,
metadata, pattern, symbol_triggers, dependencies. Files are YAML where a YAML library is there, else JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.small_graphs import as_one, strong_components

RULES = "rule_id string, uses string, metadata map<string,string>, pattern string, symbol_triggers array<string>, languages array<string>"
PREDICATES = "name string, metadata map<string,string>, pattern string, symbol_triggers array<string>, dependencies array<string>"


def _parsed(text: str) -> list[dict]:
    """The documents of a file; what can't be read, or is no mapping, is none."""
    try:
        import yaml
    except ImportError:
        load, unreadable = (lambda t: [json.loads(t)]), ValueError
    else:
        load, unreadable = yaml.safe_load_all, yaml.YAMLError
    try:
        found = list(load(text))
    except unreadable:
        return []
    return [x for d in found for x in (d if isinstance(d, list) else [d]) if isinstance(x, dict)]


def _fault(text: str) -> str:
    """What is wrong with a file that _parsed() finds nothing in."""
    try:
        import yaml
    except ImportError:
        try:
            json.loads(text)
        except ValueError as e:
            return str(e).splitlines()[0]
    else:
        try:
            list(yaml.safe_load_all(text))
        except yaml.YAMLError as e:
            return str(e).splitlines()[0]
    return "no mapping"


def _plain(values: object) -> dict[str, str]:
    return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in values.items() if v is not None} if isinstance(values, dict) else {}


def _words(values: object) -> list[str]:
    return [str(x) for x in values] if isinstance(values, list) else []


def _rule(d: dict) -> tuple | None:
    when, uses, aim = (x if isinstance(x, dict) else {} for x in (d.get("condition"), d.get("uses"), d.get("target")))
    return (str(d["id"]), uses.get("predicate"), _plain(d.get("metadata")), when.get("pattern"), _words(when.get("symbol_triggers")), _words(aim.get("languages"))) if d.get("id") else None


def _predicate(d: dict) -> tuple | None:
    own = d.get("predicate")
    if not isinstance(own, dict) or not own.get("name"):
        return None
    when = own.get("condition") if isinstance(own.get("condition"), dict) else {}
    return str(own["name"]), _plain(own.get("metadata")), when.get("pattern"), _words(when.get("symbol_triggers")), _words(own.get("dependencies"))


def _read(spark: SparkSession, folder: str, pick: Callable[[dict], tuple | None], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for text in pdf["value"] for d in _parsed(text) if (r := pick(d))]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yaml,yml,json}").text(folder, wholetext=True)
    return files.mapInPandas(parse, schema)


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """path and error of each rule file below folder that can't be read, or holds nothing that is a mapping."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                if text.strip() and not _parsed(text):
                    rows.append((path, _fault(text)))
            yield pd.DataFrame(rows, columns=["path", "error"])

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yaml,yml,json}").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(parse, "path string, error string")


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of all files below folder; a document without an id is none."""
    return _read(spark, folder, _rule, RULES)


def predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Shared predicates of all files below folder."""
    return _read(spark, folder, _predicate, PREDICATES)


def resolved(own: DataFrame, shared: DataFrame) -> DataFrame:
    """Rules with what the predicate that they use adds: metadata and pattern that they lack, triggers after their own.

    A rule that uses an unknown predicate has resolved = false and stays as it is. Names are to be unique.
    """
    given = shared.select(F.col("name").alias("uses"), F.col("metadata").alias("_m"), F.col("pattern").alias("_p"), F.col("symbol_triggers").alias("_t"), F.lit(True).alias("_found"))
    none, words = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"), F.array().cast("array<string>")
    mine, theirs = F.coalesce("metadata", none), F.coalesce("_m", none)
    filled = F.map_filter(mine, lambda k, v: F.coalesce(v != "", F.lit(False)) | ~F.coalesce(F.map_contains_key(theirs, k), F.lit(False)))
    triggers = F.concat(F.coalesce("symbol_triggers", words), F.array_except(F.coalesce("_t", words), F.coalesce("symbol_triggers", words)))
    return own.join(given, "uses", "left").withColumns({
        "metadata": F.map_concat(filled, F.map_filter(theirs, lambda k, v: ~F.map_contains_key(filled, k))), "pattern": F.coalesce(F.nullif("pattern", F.lit("")), "_p"), "symbol_triggers": triggers,
        "resolved": F.col("uses").isNull() | F.coalesce("_found", F.lit(False)),
    }).select(*own.columns, "resolved")


def broken(shared: DataFrame) -> DataFrame:
    """name and problem of predicates that depend on an unknown one (MISSING) or, by others or not, on themselves (CYCLE)."""
    edges = shared.select(F.col("name").alias("src"), F.explode("dependencies").alias("dst")).distinct()
    missing = edges.join(shared.select(F.col("name").alias("dst")), "dst", "left_anti").select(F.col("src").alias("name"), F.lit("MISSING").alias("problem"))
    parts = strong_components(as_one(edges))
    large = parts.join(parts.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "comp").select(F.col("id").alias("name"))
    loops = large.unionByName(edges.filter("src = dst").select(F.col("src").alias("name")))
    return missing.unionByName(loops.withColumn("problem", F.lit("CYCLE"))).distinct()
