"""What is known of each variable where each block begins: forward abstract interpretation with guards, all functions at once.

A value is a state (TAINTED, CONSTRAINED or UNKNOWN) and the facts proven of it, a bit each as in ssa.FACTS. Statements:
fn, line, block, var, op, src. op source gives a tainted value, const an unknown one, copy the value of src, and the name
of a transformation that of src with its facts alone, a tainted one constrained. A reassignment thus ends all that guards
have proven. Guards: fn, block, kind, var, bits: on edges of that kind out of the block the facts hold of var as well, and a
tainted value is constrained there, nowhere else.

Where edges meet, facts hold that hold on all of them, and the state is the one state, else TAINTED if any may be, else
UNKNOWN. Each block's assignments are first brought to one for each variable: the last one's chain of copies is followed
back to the block's beginning by pointer jumping. Then rounds: all blocks of a function that is still changing take what
flows along the edges from blocks that the round before has reached. Functions that stay as they are leave the rounds;
after limit rounds (1000) the others stay as they are and are told by settled.

Null blocks, variables and ops: rows left out. Dead blocks get no state. Empty tables: no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.ssa import FACTS
from tessera.tables import cut, shared_folder

BIT = {f: 1 << i for i, f in enumerate(FACTS)}
#: Facts that predicates prove where they hold, and that transformations give.
PREDICATES = {
    "is_numeric": ("NUMERIC",),
    "ctype_digit": ("DIGITS_ONLY", "NUMERIC"),
    "is_int": ("INTEGER", "NUMERIC"),
    "is_integer": ("INTEGER", "NUMERIC"),
    "is_long": ("INTEGER", "NUMERIC"),
}
TRANSFORMATIONS = {
    "intval": ("INTEGER", "NUMERIC"),
    "(int)": ("INTEGER", "NUMERIC"),
    "floatval": ("NUMERIC",),
    "escapeshellarg": ("SHELL_ESCAPED",),
    "escapeshellcmd": ("SHELL_ESCAPED",),
    "htmlspecialchars": ("HTML_ESCAPED",),
    "htmlentities": ("HTML_ESCAPED",),
    "basename": ("PATH_NORMALIZED",),
    "realpath": ("PATH_NORMALIZED",),
}
ROUNDS = 1000
LARGE = 200_000
KINDS = ("UNKNOWN", "CONSTRAINED", "TAINTED")


def _bits(name, table: dict[str, tuple[str, ...]]):
    """A column's names as bits; 0 for others."""
    return reduce(lambda x, k: F.when(name == k, sum(BIT[f] for f in table[k])).otherwise(x), table, F.lit(0))


def fact_names(bits):
    """Bits as an array of names."""
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(b) > 0, F.lit(f)) for f, b in BIT.items())))


def guards_of(conditions: DataFrame, true: str = "TRUE_BRANCH", false: str = "FALSE_BRANCH") -> DataFrame:
    """fn, block, kind, var, bits from conditions (fn, block, var, guard, negated): a negated predicate holds on the false branch."""
    kind = F.when(F.col("negated"), false).otherwise(true)
    return conditions.select("fn", "block", kind.alias("kind"), "var", _bits(F.lower("guard"), PREDICATES).alias("bits")).filter("bits > 0")


def transfers(statements: DataFrame) -> DataFrame:
    """fn, block, var, root, taint, bits, tight: what each block makes of each variable that it assigns.

    root is the variable whose value at the block's beginning it is (null: taint and bits are its value), bits its facts
    instead of its own (null: its own); tight tells whether a tainted value was constrained on the way.
    """
    known = statements.filter("fn IS NOT NULL AND block IS NOT NULL AND var IS NOT NULL AND op IS NOT NULL")
    given = F.when(F.col("op") == "source", "TAINTED").when(F.col("op") == "const", "UNKNOWN")
    bits = F.when(F.col("op") != "copy", _bits(F.lower("op"), TRANSFORMATIONS))
    own = known.select("fn", "block", "line", "var", F.when(given.isNull(), F.col("src")).alias("src"), given.alias("taint"), F.when(given.isNotNull(), 0).otherwise(bits).alias("bits"), F.coalesce(given.isNull() & (bits > 0), F.lit(False)).alias("tight"))
    # the line of the block, before this one, that last assigns what this one reads
    marks = own.select("fn", "block", F.col("var").alias("v"), "line", F.lit(True).alias("sets")).unionByName(own.filter("src IS NOT NULL").select("fn", "block", F.col("src").alias("v"), "line", F.lit(False).alias("sets")))
    before = Window.partitionBy("fn", "block", "v").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    reads = marks.withColumn("at", F.max(F.when(F.col("sets"), F.col("line"))).over(before)).filter("NOT sets").select("fn", "block", "line", "at")
    chain = cut(own.join(reads, ["fn", "block", "line"], "left"))
    while not chain.filter("at IS NOT NULL").isEmpty():
        to = chain.select("fn", "block", F.col("line").alias("at"), F.col("src").alias("src2"), F.col("taint").alias("taint2"), F.col("bits").alias("bits2"), F.col("tight").alias("tight2"), F.col("at").alias("at2"), F.lit(True).alias("hit"))
        step = chain.join(to, ["fn", "block", "at"], "left")
        hit = F.col("hit").isNotNull()
        # the facts of a transformation stand for those of what it reads; a tainted value is constrained by them
        taint = F.when((F.col("taint2") == "TAINTED") & F.col("tight"), "CONSTRAINED").otherwise(F.col("taint2"))
        chain = cut(step.select("fn", "block", "line", "var", F.when(hit, F.col("src2")).otherwise(F.col("src")).alias("src"), F.when(hit, taint).otherwise(F.col("taint")).alias("taint"), F.when(hit, F.coalesce("bits", "bits2")).otherwise(F.col("bits")).alias("bits"), (F.col("tight") | F.coalesce("tight2", F.lit(False))).alias("tight"), F.col("at2").alias("at")))
    last = Window.partitionBy("fn", "block", "var").orderBy(F.desc("line"))
    return chain.withColumn("r", F.row_number().over(last)).filter("r = 1").select("fn", "block", "var", F.col("src").alias("root"), "taint", "bits", "tight")


def _joined(rows: DataFrame) -> DataFrame:
    """One value for each fn, block and var of rows (fn, block, var, taint, bits)."""
    state = F.when(F.min("taint") == F.max("taint"), F.min("taint")).when(F.bool_or(F.col("taint") != "UNKNOWN"), "TAINTED").otherwise("UNKNOWN")
    return rows.groupBy("fn", "block", "var").agg(state.alias("taint"), F.bit_and("bits").alias("bits"))


def _flows(lines: list[tuple], spot: dict[str, int]) -> list[tuple]:
    """Statements of a block, (line, var, op, src), as lists of (place, op's code or bits, place read), one for each line."""
    code = {"source": "S", "const": "K", "copy": None}
    steps = [(line, spot[var], code[op] if op in code else sum(BIT[f] for f in TRANSFORMATIONS.get(op.lower(), ())), spot.get(src)) for line, var, op, src in lines]
    return [[s[1:] for s in same] for _, same in groupby(steps, key=lambda s: s[0])]


def _after(env: tuple, flows: list) -> list:
    """A block's values, pairs of a state's number and bits, after its statements; those of one line read what was before it."""
    own = list(env)
    for same in flows:
        made = []
        for to, op, read in same:
            t, b = own[read] if read is not None else (0, 0)
            made.append((to, (2, 0) if op == "S" else (0, 0) if op == "K" else (t, b) if op is None else (1 if t == 2 and op else t, op)))
        for to, value in made:
            own[to] = value
    return own


def _settled(edges: list[tuple], lines: list[tuple], held: list[tuple], entry: int, limit: int | None) -> tuple[list[str], dict, bool]:
    """Names, values of each block by name, and whether the rounds came to an end; only blocks that moved are taken again."""
    names = sorted({x for _, _, var, _, src in lines for x in (var, src) if x is not None} | {var for _, _, var, _ in held})
    spot, by, ways, proven = {v: i for i, v in enumerate(names)}, defaultdict(list), defaultdict(list), defaultdict(list)
    for block, line, var, op, src in lines:
        if block is not None and var is not None and op is not None:
            by[block].append((line, var, op, src))
    for n, (src, dst, kind) in enumerate(edges):
        ways[src].append((n, dst, kind))
    for block, kind, var, bits in held:
        proven[block, kind].append((spot[var], bits))
    flows = {b: _flows(x, spot) for b, x in by.items()}
    now = {entry: tuple((0, 0) for _ in names)}
    into, moved = defaultdict(dict, {entry: {-1: now[entry]}}), [entry]
    for _ in range(3 * len({dst for _, dst, _ in edges} | {entry}) + 10 if limit is None else limit):
        touched = set()
        for block in moved:
            after = _after(now[block], flows.get(block, ()))
            for n, dst, kind in ways[block]:
                along = list(after)
                for i, bits in proven.get((block, kind), ()):
                    t, b = along[i]
                    along[i] = (1 if t == 2 else t, b | bits)
                into[dst][n] = along
                touched.add(dst)
        moved = []
        for dst in touched:
            new = []
            for own in zip(*into[dst].values()):
                t, b = own[0]
                for u, c in own[1:]:
                    t, b = t if t == u else 2, b & c  # states that differ: one of them may be tainted
                new.append((t, b))
            if now.get(dst) != tuple(new):
                moved.append((dst, tuple(new)))
        now.update(moved)
        moved = [dst for dst, _ in moved]
        if not moved:
            return names, now, True
    return names, now, False


def _streamed(entry: int, limit: int | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of functions, sorted by them, as states of their variables at their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for fn, own in groupby(rows, key=lambda r: r[0]):
            parts = {"edge": [], "line": [], "guard": []}
            for _, part, a, b, kind, var, op, src, bits in own:
                parts[part].append((a, b, kind) if part == "edge" else (a, b, var, op, src) if part == "line" else (a, kind, var, bits))
            if parts["edge"]:
                names, now, settled = _settled(*parts.values(), entry, limit)
                out += [(fn, block, v, KINDS[t], bits, settled) for block, env in now.items() for v, (t, bits) in zip(names, env, strict=True)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return run


def by_statement(edges: DataFrame, statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and statements of blocks of one statement each, so that a round moves by a statement.

    The first one keeps its block's number, and the others get numbers below those of blocks (of -1 and more).
    """
    own = Window.partitionBy("fn", "block").orderBy("line")
    single = statements.withColumn("node", F.when(F.row_number().over(own) == 1, F.col("block")).otherwise(-2 - F.col("line"))).withColumn("then", F.lead("node").over(own))
    single = cut(single)
    inner = single.filter("then IS NOT NULL").select("fn", F.col("node").alias("src"), F.col("then").alias("dst"), F.lit("").alias("kind"))
    last = single.filter("then IS NULL AND node <> block").select("fn", F.col("block").alias("src"), "node")
    outer = edges.join(last, ["fn", "src"], "left").select("fn", F.coalesce("node", "src").alias("src"), "dst", "kind")
    return inner.unionByName(outer), single.withColumn("block", F.col("node")).drop("node", "then")


def states(edges: DataFrame, statements: DataFrame, guards: DataFrame, entry: int = 0, limit: int | None = ROUNDS, large: int = LARGE) -> DataFrame:
    """fn, block, var, taint, bits, settled: what is known of each of a function's variables where each block begins.

    edges: fn, src, dst, kind, with kinds that guards name. A block with several edges from one other takes each of them.
    """
    none = lambda kind: F.lit(None).cast(kind)
    edges = edges.filter("fn IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select("fn", "src", "dst", "kind")
    held = guards.filter("fn IS NOT NULL AND block IS NOT NULL AND kind IS NOT NULL AND var IS NOT NULL").select("fn", "block", "kind", "var", F.col("bits").cast("int").alias("bits"))
    lines = statements.filter("fn IS NOT NULL").select("fn", "block", "line", "var", "op", "src")
    rows = edges.select("fn", F.lit("edge").alias("part"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), "kind", none("string").alias("var"), none("string").alias("op"), none("string").alias("from"), none("int").alias("bits"))
    rows = rows.unionByName(lines.select("fn", F.lit("line").alias("part"), F.col("block").cast("long").alias("a"), F.col("line").cast("long").alias("b"), none("string").alias("kind"), "var", "op", F.col("src").alias("from"), none("int").alias("bits")))
    rows = cut(rows.unionByName(held.select("fn", F.lit("guard").alias("part"), F.col("block").cast("long").alias("a"), none("long").alias("b"), "kind", "var", none("string").alias("op"), none("string").alias("from"), "bits")))
    many = cut(rows.groupBy("fn").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("fn"))
    some = not many.isEmpty()
    own = rows.join(many, "fn", "left_anti") if some else rows
    fn = dict(edges.dtypes)["fn"]
    empty = edges.sparkSession.createDataFrame([], f"fn {fn}, block long, var string, taint string, bits int, settled boolean")
    found = own.repartition("fn").sortWithinPartitions("fn", "part", "a", "b").mapInArrow(_streamed(entry, limit, to_arrow_schema(empty.schema)), empty.schema)
    if not some:
        return found
    pick = lambda part: rows.filter(F.col("part") == part).join(many, "fn", "left_semi")
    e = pick("edge").select("fn", F.col("a").alias("src"), F.col("b").alias("dst"), "kind")
    s = pick("line").select("fn", F.col("a").alias("block"), F.col("b").alias("line"), "var", "op", F.col("from").alias("src"))
    g = pick("guard").select("fn", F.col("a").alias("block"), "kind", "var", "bits")
    return found.unionByName(_joins(e, s, g, entry, limit))


def _joins(edges: DataFrame, statements: DataFrame, guards: DataFrame, entry: int, limit: int | None) -> DataFrame:
    """The states of functions of any size, by rounds of joins; what has settled is put into one folder, not into a plan of all rounds."""
    spark = edges.sparkSession
    edges = cut(edges)
    made = cut(transfers(statements))
    held = cut(guards.groupBy("fn", F.col("block").alias("src"), "kind", "var").agg(F.bit_or("bits").alias("more")))
    names = statements.filter("var IS NOT NULL").select("fn", "var").union(statements.filter("src IS NOT NULL").select("fn", F.col("src").alias("var"))).union(held.select("fn", "var")).distinct()
    begin = cut(edges.select("fn").distinct().join(names, "fn").select("fn", F.lit(entry).cast("long").alias("block"), "var", F.lit("UNKNOWN").alias("taint"), F.lit(0).alias("bits")))
    folder = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    put = lambda df, settled: df.withColumn("settled", F.lit(settled)).write.mode("append").parquet(folder)
    into = F.countDistinct("dst") + F.when(F.bool_or(F.col("dst") == entry), 0).otherwise(1)
    ends = cut(edges.groupBy("fn").agg((3 * into + 10 if limit is None else F.lit(limit)).alias("limit")))
    now = begin
    for n in count(1):
        # after each block: a variable's value there, or what the block assigns
        read = now.select("fn", "block", F.col("var").alias("root"), F.col("taint").alias("taint1"), F.col("bits").alias("bits1"))
        given = made.select("fn", "block", "var", "root", F.col("taint").alias("taint2"), F.col("bits").alias("bits2"), "tight", F.lit(True).alias("sets"))
        after = now.join(given, ["fn", "block", "var"], "left").join(read, ["fn", "block", "root"], "left")
        sets, root = F.col("sets").isNotNull(), F.col("root").isNotNull()
        moved = F.when((F.col("taint1") == "TAINTED") & F.col("tight"), "CONSTRAINED").otherwise(F.col("taint1"))
        taint = F.when(sets & root, moved).when(sets, F.col("taint2")).otherwise(F.col("taint"))
        bits = F.when(sets & root, F.coalesce("bits2", "bits1")).when(sets, F.col("bits2")).otherwise(F.col("bits"))
        after = after.select("fn", F.col("block").alias("src"), "var", taint.alias("taint"), bits.alias("bits"))
        along = after.join(edges, ["fn", "src"]).join(held, ["fn", "src", "kind", "var"], "left")
        more = F.coalesce("more", F.lit(0))
        along = along.select("fn", F.col("dst").alias("block"), "var", F.when((more > 0) & (F.col("taint") == "TAINTED"), "CONSTRAINED").otherwise(F.col("taint")).alias("taint"), F.col("bits").bitwiseOR(more).alias("bits"))
        first = begin.join(now.select("fn").distinct(), "fn", "left_semi")
        before = now.select("fn", "block", "var", F.col("taint").alias("was"), F.col("bits").alias("had"))
        new = _joined(along.unionByName(first)).join(before, ["fn", "block", "var"], "left")
        new = cut(new.select("fn", "block", "var", "taint", "bits", (F.col("was").isNull() | (F.col("was") != F.col("taint")) | (F.col("had") != F.col("bits"))).alias("moved")))
        moving = cut(new.filter("moved").select("fn").distinct().join(ends, "fn"))
        put(new.join(moving, "fn", "left_anti").drop("moved"), True)
        put(new.join(moving.filter(F.col("limit") <= n), "fn", "left_semi").drop("moved"), False)
        moving = moving.filter(F.col("limit") > n)
        now = new.join(moving, "fn", "left_semi").drop("moved")
        if moving.isEmpty():
            break
    return spark.read.schema(begin.withColumn("settled", F.lit(True)).schema).parquet(folder)
