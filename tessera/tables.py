"""Reading the driver's tables, and cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside have their shuffle files deleted when they end, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that executors share and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_tidy(df: DataFrame) -> DataFrame:
    """cut(), with the shuffle files of the writing deleted at once."""
    with tidy(df.sparkSession):
        return cut(df)


def tasks(spark: SparkSession, rows: int) -> int:
    """So many tasks that each sorts half a million rows or so, and every core has one."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // 500_000))


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that cut() wrote and that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
