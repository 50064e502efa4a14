"""Control-flow graphs from nested statements, all functions at once.

statements: fn, line, kind. Kinds: if, else, loop and end open, part and close blocks; exit leaves the function; any other
is a plain statement. An end with nothing open, and an else whose innermost open block is no if (or has its else), do
nothing. Blocks still open at the last line end there.

Blocks are matched by windows in place of a stack: the depth is the running sum of +1 and -1 less its least value so far,
and what encloses a line is the last opening line of its level, as no other block of that level can be open between the
two. Only sums and last values are kept, so a long function is sorted and streamed, never held.

A block's number is twice its first line; that of the place where the branches of an if meet is twice the if's line plus
one. Entry is 0 and exit -1. Null kinds are plain; rows without fn or line are left out; a line that stands twice in a
function is taken once, in the order of kinds. Other columns are not read. Empty table: no blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import cut

ENTRY, EXIT = 0, -1
#: The kinds of edges.
FALLTHROUGH, TRUE, FALSE, BACK = "FALLTHROUGH", "TRUE_BRANCH", "FALSE_BRANCH", "LOOP_BACKEDGE"
OPENS = ("if", "loop")


def nested(statements: DataFrame) -> DataFrame:
    """fn, line, kind, depth, parent, branch: each statement (no end, no else) with the line that opens the block around it.

    branch is then, else or body; parent and branch are null in the outermost block, whose depth is 0.
    """
    rows = statements.filter("fn IS NOT NULL AND line IS NOT NULL").groupBy("fn", "line").agg(F.min(F.coalesce("kind", F.lit("plain"))).alias("kind"))
    kind, opens = F.col("kind"), F.col("kind").isin(*OPENS)
    order = Window.partitionBy("fn").orderBy("line")
    rows = rows.withColumn("s", F.sum(F.when(opens, 1).when(kind == "end", -1).otherwise(0)).over(order))
    rows = rows.withColumn("after", F.col("s") - F.least(F.lit(0), F.min("s").over(order))).withColumn("depth", F.lag("after", 1, 0).over(order))
    acts = rows.filter((kind != "end") & ((kind != "else") | (F.col("depth") > 0)))
    level = F.when(opens, F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("mark")), F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("mark"))))
    acts = acts.select("fn", "line", "kind", "depth", F.explode(F.coalesce(level, F.array(F.struct(F.col("depth").alias("level"), (kind == "else").alias("mark"))))).alias("at")).select("fn", "line", "kind", "depth", "at.level", "at.mark")
    level_order = Window.partitionBy("fn", "level").orderBy("line")
    before = level_order.rowsBetween(Window.unboundedPreceding, -1)
    acts = acts.withColumn("last", F.last(F.when(F.col("mark"), F.col("kind")), ignorenulls=True).over(before))
    branch = F.when(F.col("mark"), F.when(kind == "if", "then").when(kind == "loop", "body").when(F.col("last") == "if", "else"))
    acts = acts.withColumn("opened", F.when(F.col("mark") & opens, F.col("line"))).withColumn("branch", branch)
    acts = acts.select("fn", "line", "kind", "depth", "level", "mark", F.last("opened", ignorenulls=True).over(before).alias("parent"), F.last("branch", ignorenulls=True).over(before).alias("branch"))
    inside = F.col("level") > 0
    return acts.filter(~F.col("mark")).select("fn", "line", "kind", F.col("depth").cast("int").alias("depth"), F.when(inside, F.col("parent")).alias("parent"), F.when(inside, F.col("branch")).alias("branch"))


def placed(nest: DataFrame) -> DataFrame:
    """nested() with block, the block that holds each statement, and next_block, that of the next one beside it (null: none)."""
    beside = Window.partitionBy("fn", "parent", "branch").orderBy("line")
    rows = nest.withColumn("before", F.lag("kind").over(beside)).withColumn("line_before", F.lag("line").over(beside))
    begins = F.col("before").isNull() | F.col("before").isin("if", "loop", "exit") | (F.col("kind") == "loop")
    number = F.when((F.col("before") == "if") & (F.col("kind") != "loop"), 2 * F.col("line_before") + 1).otherwise(2 * F.col("line"))
    rows = rows.withColumn("block", F.last(F.when(begins, number), ignorenulls=True).over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("next_block", F.lead("block").over(beside)).drop("line_before")


def edges(place: DataFrame) -> DataFrame:
    """fn, src, dst, kind, line: edges between blocks, and for branches the line of the condition."""
    line, kind, parent = F.col("line"), F.col("kind"), F.col("parent")
    leaves = F.when(parent.isNull(), F.lit(EXIT)).when(F.col("branch") == "body", 2 * parent).otherwise(2 * parent + 1)
    how = F.when(F.col("next_block").isNull() & (F.col("branch") == "body"), BACK).otherwise(FALLTHROUGH)
    rows = place.withColumn("after", F.coalesce("next_block", leaves)).withColumn("how", how)
    first = place.filter(F.col("before").isNull())
    inner = first.filter(parent.isNotNull()).groupBy("fn", F.col("parent").alias("line")).agg(*(F.max(F.when(F.col("branch") == b, F.col("block"))).alias(b) for b in ("then", "else", "body")))
    heads = rows.filter(kind.isin(*OPENS)).join(inner, ["fn", "line"], "left")
    meet = 2 * line + 1
    true = F.when(kind == "if", F.coalesce("then", meet)).otherwise(F.coalesce("body", "block"))
    false = F.when(kind == "if", F.coalesce("else", meet)).otherwise(F.col("after"))
    some = [
        rows.filter((kind == "exit")).select("fn", F.col("block").alias("src"), F.lit(EXIT).alias("dst"), F.lit(FALLTHROUGH).alias("kind"), F.lit(None).alias("line")),
        rows.filter(~kind.isin("exit", *OPENS) & (F.col("block") != F.col("after"))).select("fn", F.col("block").alias("src"), F.col("after").alias("dst"), F.col("how").alias("kind"), F.lit(None).alias("line")),
        rows.filter((kind == "if") & (meet != F.col("after"))).select("fn", meet.alias("src"), F.col("after").alias("dst"), F.col("how").alias("kind"), F.lit(None).alias("line")),
        heads.select("fn", F.col("block").alias("src"), true.alias("dst"), F.lit(TRUE).alias("kind"), "line"),
        heads.select("fn", F.col("block").alias("src"), false.alias("dst"), F.lit(FALSE).alias("kind"), "line"),
        first.filter(parent.isNull()).select("fn", F.lit(ENTRY).alias("src"), F.col("block").alias("dst"), F.lit(FALLTHROUGH).alias("kind"), F.lit(None).alias("line")),
    ]
    return reduce(DataFrame.unionByName, [x.select("fn", *(F.col(c).cast("long").alias(c) for c in ("src", "dst")), "kind", F.col("line").cast("long").alias("line")) for x in some])


def completing(nest: DataFrame) -> DataFrame:
    """fn, line, live: whether control reaches each statement.

    From the innermost blocks out: an if is passed if one of its branches is passed, a loop always, an exit never, and a
    block if all its statements are. From the outermost in: a statement is reached if its block is and all before it are
    passed. Two rounds of joins for each level of depth.
    """
    rows = cut(nest)
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.select("fn", "line", F.lit(True).alias("live"))
    stops: list[DataFrame] = []  # statements that are not passed, by depth
    below = None
    for d in range(deepest, -1, -1):
        own = rows.filter(F.col("depth") == d)
        exits = own.filter("kind = 'exit'").select("fn", "line", "parent", "branch")
        if below is not None:  # an if that has both branches, neither of which is passed
            shut = below.filter("branch IN ('then', 'else')").groupBy("fn", F.col("parent").alias("line")).agg(F.count_distinct("branch").alias("n")).filter("n = 2").select("fn", "line")
            exits = exits.unionByName(own.filter("kind = 'if'").join(shut, ["fn", "line"]).select("fn", "line", "parent", "branch"))
        below = cut(exits)
        stops.append(below)
    first_stop = reduce(DataFrame.unionByName, stops).groupBy("fn", "parent", "branch").agg(F.min("line").alias("stop"))
    found = rows.alias("r").join(first_stop.alias("s"), (F.col("r.fn") == F.col("s.fn")) & F.col("r.parent").eqNullSafe(F.col("s.parent")) & F.col("r.branch").eqNullSafe(F.col("s.branch")), "left")
    found = cut(found.select("r.fn", "r.line", "r.depth", "r.parent", (F.col("stop").isNull() | (F.col("r.line") <= F.col("stop"))).alias("own")))
    levels = [found.filter("depth = 0").select("fn", "line", F.col("own").alias("live"))]
    for d in range(1, deepest + 1):
        above = levels[-1].select("fn", F.col("line").alias("parent"), F.col("live").alias("above"))
        levels.append(cut(found.filter(F.col("depth") == d).join(above, ["fn", "parent"]).select("fn", "line", (F.col("own") & F.col("above")).alias("live"))))
    return reduce(DataFrame.unionByName, levels)


def graphs(statements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks (fn, block, first_line, last_line, n, reachable), edges (fn, src, dst, kind, line), statements (fn, line, kind, block).

    Blocks without statements, such as entry, exit and some meetings of branches, have null lines and n = 0.
    """
    place = cut(placed(nested(statements)))
    found = cut(edges(place))
    live = completing(place.select("fn", "line", "kind", "depth", "parent", "branch"))
    held = place.select("fn", "line", "block").join(live, ["fn", "line"])
    full = held.groupBy("fn", "block").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n"), F.bool_or("live").alias("live"))
    ends = found.select("fn", F.explode(F.array("src", "dst")).alias("block")).distinct().join(full, ["fn", "block"], "left")
    # blocks without statements are reached if control comes to them from a block that is, past all its statements
    last = held.join(full.select("fn", "block", F.col("last_line").alias("line")), ["fn", "block", "line"]).select("fn", F.col("block").alias("src"), F.col("live").alias("passed"))
    empty = ends.filter("n IS NULL").select("fn", "block")
    into = found.select("fn", "src", F.col("dst").alias("block")).join(last, ["fn", "src"], "left").join(empty, ["fn", "block"])
    direct = into.groupBy("fn", "block").agg(F.coalesce(F.bool_or("passed"), F.lit(False)).alias("from_full"))
    reached = cut(empty.join(direct, ["fn", "block"], "left").select("fn", "block", ((F.col("block") == ENTRY) | F.coalesce("from_full", F.lit(False))).alias("live")))
    chain = cut(found.select("fn", "src", F.col("dst").alias("block")).join(empty, ["fn", "block"]).join(empty.withColumnRenamed("block", "src"), ["fn", "src"]))
    while not chain.isEmpty():  # a meeting place right behind another one
        new = chain.join(reached.filter("live").select("fn", F.col("block").alias("src")), ["fn", "src"]).select("fn", "block").distinct().join(reached.filter("NOT live"), ["fn", "block"])
        new = cut(new.select("fn", "block"))
        if new.isEmpty():
            break
        reached = cut(reached.join(new.withColumn("more", F.lit(True)), ["fn", "block"], "left").select("fn", "block", (F.col("live") | F.coalesce("more", F.lit(False))).alias("live")))
    blocks = ends.drop("live").join(reached, ["fn", "block"], "left").join(full.select("fn", "block", F.col("live").alias("own")), ["fn", "block"], "left")
    blocks = blocks.select("fn", "block", "first_line", "last_line", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("live", "own").alias("reachable"))
    return blocks, found, place.select("fn", "line", "kind", "block")


def violations(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """fn, block, problem: graphs without one entry and one exit, edges whose ends are no blocks, blocks that lead nowhere."""
    ends = found.select("fn", F.explode(F.array("src", "dst")).alias("block")).distinct()
    lost = ends.join(blocks, ["fn", "block"], "left_anti").select("fn", "block", F.lit("missing block").alias("problem"))
    stuck = blocks.filter(F.col("block") != EXIT).join(found.select("fn", F.col("src").alias("block")), ["fn", "block"], "left_anti").select("fn", "block", F.lit("no way on").alias("problem"))
    back = found.filter(F.col("src") == EXIT).select("fn", F.col("src").alias("block"), F.lit("way out of exit").alias("problem"))
    into = found.filter(F.col("dst") == ENTRY).select("fn", F.col("dst").alias("block"), F.lit("way into entry").alias("problem"))
    count = blocks.groupBy("fn").agg(F.count_if(F.col("block") == ENTRY).alias("a"), F.count_if(F.col("block") == EXIT).alias("b"))
    ends = count.filter("a <> 1 OR b > 1").select("fn", F.lit(None).cast("long").alias("block"), F.lit("not one entry and at most one exit").alias("problem"))
    return reduce(DataFrame.unionByName, [lost, stuck, back, into, ends])


def extents(statements: DataFrame) -> DataFrame:
    """fn, line, kind, end: the opening lines, and where what they open ends (null: never)."""
    kind, opens = F.col("kind"), F.col("kind").isin(*OPENS)
    order = Window.partitionBy("fn").orderBy("line")
    rows = statements.filter("fn IS NOT NULL AND line IS NOT NULL").groupBy("fn", "line").agg(F.min(F.coalesce("kind", F.lit("plain"))).alias("kind")).filter(kind.isin("end", *OPENS))
    rows = rows.withColumn("s", F.sum(F.when(opens, 1).otherwise(-1)).over(order))
    rows = rows.withColumn("after", F.col("s") - F.least(F.lit(0), F.min("s").over(order))).withColumn("before", F.lag("after", 1, 0).over(order))
    level = F.when(opens, F.col("after")).otherwise(F.col("before"))
    following = Window.partitionBy("fn", "level").orderBy("line")
    return rows.withColumn("level", level).filter("level > 0").withColumn("end", F.lead("line").over(following)).filter(opens).select("fn", "line", "kind", "end")
