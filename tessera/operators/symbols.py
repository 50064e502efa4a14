"""Scopes, imports and aliases: what a name means where it stands.

scopes: file, scope, lo, hi; they nest, hi null is the file's end, and scope 0 is the file itself. bindings: file, line,
name, target; the last one of a name in a scope counts. A target is a dotted name: its first part is looked up where the
binding stands, from the innermost scope that binds it outwards, and the rest is kept. uses: file, line, name.

The scope around a line is the last one opened of its depth, by windows. Names climb one scope a round, all at once. Chains
of aliases are followed by pointer jumping, in rounds of the logarithm of the longest; what is left when a round ends none
goes round in a circle.

Null keys and names take no part; a null target is unknown and ends a chain as EXTERNAL with a null symbol. Repeated rows
change nothing. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import cut

FILE = 0


def enclosing(scopes: DataFrame, places: DataFrame) -> DataFrame:
    """file, line, scope of each place: the innermost scope with lo < line < hi, FILE if none."""
    opened = scopes.filter("scope <> 0").select("file", F.col("lo").alias("line"), F.lit(1).alias("step"), "scope")
    closed = scopes.filter("scope <> 0 AND hi IS NOT NULL").select("file", F.col("hi").alias("line"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("scope"))
    asked = places.filter("file IS NOT NULL AND line IS NOT NULL").select("file", "line").distinct().select("file", "line", F.lit(0).alias("step"), F.lit(None).cast("long").alias("scope"))
    order = Window.partitionBy("file").orderBy("line", "step")  # at one line: closed, asked, opened
    rows = opened.unionByName(closed).unionByName(asked).filter("file IS NOT NULL").withColumn("level", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("file", "level").orderBy("line", "step").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("step") == 1, F.col("scope")), ignorenulls=True).over(inner)
    return rows.filter("step >= 0").withColumn("last", last).filter("step = 0").select("file", "line", F.when(F.col("level") > 0, F.col("last")).otherwise(FILE).alias("scope"))


def parents(scopes: DataFrame) -> DataFrame:
    """file, scope, up: the scope around each scope; none for FILE."""
    inner = scopes.filter("scope <> 0")
    around = enclosing(scopes, inner.select("file", F.col("lo").alias("line")))
    return inner.join(around.select("file", F.col("line").alias("lo"), F.col("scope").alias("up")), ["file", "lo"]).select("file", "scope", "up")


def looked_up(asked: DataFrame, bound: DataFrame, above: DataFrame) -> DataFrame:
    """file, scope, name, home of asked (file, scope, name): the innermost scope outwards that binds the name; none: no row."""
    known = bound.select("file", F.col("scope").alias("home"), "name").distinct()
    up = above.select("file", F.col("scope").alias("home"), "up")
    now = cut(asked.filter("name IS NOT NULL").select("file", "scope", "name").distinct().withColumn("home", F.col("scope")))
    found = None
    while not now.isEmpty():
        hit = cut(now.join(known, ["file", "home", "name"], "left_semi").select("file", "scope", "name", "home"))
        found = hit if found is None else found.unionByName(hit)
        now = cut(now.join(known, ["file", "home", "name"], "left_anti").join(up, ["file", "home"]).select("file", "scope", "name", F.col("up").alias("home")))
    return found if found is not None else now


def chained(links: DataFrame) -> DataFrame:
    """key, symbol, status of links (key, next, symbol, rest): the end of each chain with all rests behind it.

    next is the key that a link goes on to, null at an end, whose symbol is given. rest is text to put behind. status is
    EXTERNAL, or CYCLE with a null symbol for what runs into a circle.
    """
    now = cut(links.select("key", "next", "symbol", "rest"))
    while True:
        to = now.select(F.col("key").alias("next"), F.col("next").alias("further"), F.col("symbol").alias("end"), F.col("rest").alias("more"), F.lit(True).alias("hit"))
        step = now.join(to, "next", "left")
        going = F.col("next").isNotNull()
        ends = going & F.col("hit").isNotNull() & F.col("further").isNull()
        new = cut(step.select("key", F.when(going, F.col("further")).alias("next"), F.when(ends, F.col("end")).when(going, F.lit(None)).otherwise(F.col("symbol")).alias("symbol"), F.when(going, F.concat(F.coalesce("more", F.lit("")), "rest")).otherwise(F.col("rest")).alias("rest"), ends.alias("ended")))
        now = new.drop("ended")
        if new.filter("ended").isEmpty():
            break
    circle = F.col("next").isNotNull()
    return now.select("key", F.when(~circle, F.concat("symbol", "rest")).alias("symbol"), F.when(circle, "CYCLE").otherwise("EXTERNAL").alias("status"))


def resolved(scopes: DataFrame, bindings: DataFrame, uses: DataFrame) -> DataFrame:
    """file, line, name, scope, symbol, status of each use; status UNBOUND where no scope around binds the name."""
    above = cut(parents(scopes))
    rows = bindings.filter("name IS NOT NULL")
    at = enclosing(scopes, rows.select("file", "line"))
    bound = cut(rows.join(at, ["file", "line"]).groupBy("file", "scope", "name").agg(F.max(F.struct("line", "target")).getField("target").alias("target")))
    key = lambda scope, name: F.concat_ws("\x00", "file", F.col(scope), F.col(name))
    parts = bound.select("*", F.substring_index("target", ".", 1).alias("base"), F.expr("substring(target, locate('.', target))").alias("tail"))
    parts = parts.withColumn("rest", F.when(F.col("target").contains("."), F.col("tail")).otherwise(F.lit("")))
    homes = looked_up(parts.select("file", "scope", F.col("base").alias("name")), bound, above).withColumnRenamed("name", "base")
    links = parts.join(homes, ["file", "scope", "base"], "left")
    links = links.select(key("scope", "name").alias("key"), F.when(F.col("home").isNotNull(), key("home", "base")).alias("next"), F.when(F.col("home").isNull(), F.col("base")).alias("symbol"), "rest")
    ends = cut(chained(links))
    own = uses.filter("name IS NOT NULL").select("file", "line", "name").distinct()
    own = cut(own.join(enclosing(scopes, own), ["file", "line"]))
    found = own.join(looked_up(own, bound, above), ["file", "scope", "name"], "left").withColumn("key", F.when(F.col("home").isNotNull(), key("home", "name")))
    return found.join(ends, "key", "left").select("file", "line", "name", "scope", "symbol", F.when(F.col("home").isNull(), "UNBOUND").otherwise(F.col("status")).alias("status"))
