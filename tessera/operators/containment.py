"""Pairs of texts of which one holds the other, by an index of rare pieces in place of comparing all with all.

Each text picks the rarest of its pieces of width characters, by counts over the other side; texts shorter than that are a
piece themselves, of their own length. The other side lists its pieces of all lengths that are asked for, and only those
that some text has picked are joined and compared whole. A text whose rarest piece stands nowhere meets nothing.

Null and empty texts take no part (an empty one would be held by all). Repeated rows give repeated pairs. Letters count as
they are; lower-case them first if case is not to count. Other columns pass by. Empty tables: no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import cut

WIDTH = 6


def _pieces(rows: DataFrame, size) -> DataFrame:
    """rows with piece, each distinct piece of size characters of text."""
    at = F.sequence(F.lit(1), F.length("text") - size + 1)
    return rows.filter(F.length("text") >= size).withColumn("piece", F.explode(F.array_distinct(F.transform(at, lambda i: F.col("text").substr(i, size)))))


def held_in(needles: DataFrame, hay: DataFrame, width: int = WIDTH) -> DataFrame:
    """needle, holder: ids of needles (id, text) whose text stands in a text of hay (id, text)."""
    known = "text IS NOT NULL AND text <> ''"
    small, large = cut(needles.filter(known).select("id", "text")), cut(hay.filter(known).select("id", "text"))
    own = small.select(F.col("id").alias("needle"), "text", F.least(F.length("text"), F.lit(width)).alias("size"))
    sizes = [r["size"] for r in own.select("size").distinct().collect()]  # width numbers at most
    if not sizes:
        return small.select(F.col("id").alias("needle"), F.col("id").alias("holder")).limit(0)
    listed = large.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sorted(sizes)))))
    listed = cut(_pieces(listed, F.col("size")).select(F.col("id").alias("holder"), "piece"))
    counts = listed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    pieces = _pieces(own, F.col("size")).join(counts, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = Window.partitionBy("needle", "text").orderBy("n", "piece")
    picked = pieces.withColumn("r", F.row_number().over(rarest)).filter("r = 1 AND n > 0").select("needle", "piece").join(small.withColumnRenamed("id", "needle"), "needle")
    may = picked.join(listed, "piece").select("needle", "text", "holder")
    return may.join(large.select(F.col("id").alias("holder"), F.col("text").alias("whole")), "holder").filter(F.contains("whole", "text")).select("needle", "holder")


def either_way(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """left_id, right_id, held (left, right or both): pairs of which one text holds the other. Ids are unique on each side."""
    a = held_in(left, right, width).select(F.col("needle").alias("left_id"), F.col("holder").alias("right_id"), F.lit(1).alias("way"))
    b = held_in(right, left, width).select(F.col("holder").alias("left_id"), F.col("needle").alias("right_id"), F.lit(2).alias("way"))
    ways = a.unionByName(b).groupBy("left_id", "right_id").agg(F.bit_or("way").alias("way"))
    return ways.select("left_id", "right_id", F.when(F.col("way") == 1, "left").when(F.col("way") == 2, "right").otherwise("both").alias("held"))
