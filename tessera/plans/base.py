"""Registering queries: as functions, or as SQL that Spark and the oracle share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def shared(name: str, text: str) -> None:
    """text names tables in braces; <<a|||b>> is a for Spark and b for the oracle."""
    names = sorted(set(re.findall(r"\{([a-z]+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(re.sub(r"<<(.*?)\|\|\|.*?>>", r"\1", text, flags=re.S), **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[name] = run
    ORACLE_SQL[name] = re.sub(r"<<.*?\|\|\|(.*?)>>", r"\1", text, flags=re.S).replace("{", "").replace("}", "")
