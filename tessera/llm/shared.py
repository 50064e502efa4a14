"""Tables in the folder that the driver and all executors share, and session settings of Python stages."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only for a local master without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: what follows neither recomputes it nor depends on an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialise() once all that was read from them is itself written."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished jobs left: their shuffle files go when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, an Arrow batch has so many rows at most; for what is run at once, as the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plan_bytes(df: DataFrame) -> int:
    """Bytes that df reads, as far as the planner knows; it decides the number of parts only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def reread(df: DataFrame) -> DataFrame:
    """df itself if each read of it gives the same rows in the same partitions, as a table's files do; else a copy that does."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    fixed = not any(x in plan for x in ("Exchange", "Sample", "Python", "Arrow", "Pandas", "Union", "ExistingRDD", "Coalesce"))
    return df if fixed else materialise(df, "rows")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, as long texts would otherwise make batches of gigabytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def packed(docs: DataFrame, text: str) -> DataFrame:
    """The text as text, and all other columns packed as rest, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"))


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for so many rows; at least two for each core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))
