"""Hashes, lookups, run lengths and integer lists.

Hash values are Spark's 64-bit ones; what an index of hashes answers is asked with joins.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession, Window, functions as F

from rowloom.operators.position import index_view
from rowloom.plans.registry import operator
from rowloom.plans.view import View, equal

#: Numbers in a block of rows that one task compares with their neighbours.
BLOCK_ROWS = 1 << 16


@operator
def hashcol(v: View, column: str | int) -> View:
    """A 64-bit hash of each value of a column."""
    return v.with_columns([("hash", F.xxhash64(v.col(column)))])


@operator
def hashview(v: View) -> View:
    """A 64-bit hash of each row."""
    return v.with_columns([("hash", F.xxhash64(*(c for _, c in v.columns())))])


@operator
def rowhash(v: View, row: int) -> int:
    """The hash of one row."""
    from rowloom.operators.sorting import row_at

    return hashview(row_at(v, row)).rows()[0][0]


@operator
def hashfind(v: View, row: int, w: View) -> int:
    """The first position in w of the row of v, or -1."""
    from rowloom.operators.sorting import row_at

    wanted, held = row_at(v, row), w.numbered()
    right, columns, _ = wanted.as_right()
    found = held.df.join(F.broadcast(right), equal((F.col(f"c{i}"), c) for i, (_, c) in enumerate(columns)))  # one row
    out = found.agg(F.min("_o0")).first()[0]
    return -1 if out is None else out


@operator
def getinfo(v: View, w: View | None = None) -> View:
    """For each row its position, its group (by first occurrence, from 0) and its place within the group.

    Groups are those of equal rows of v; with w, of w's rows by equal rows of v, and rows without one are left out.
    Places are numbers in the order of groups less that of the group's first row, so that a large group is not one task's.
    """
    a = v.numbered()
    cells = [F.col(f"c{i}") for i in range(a.width)]
    firsts = View.build(a.df.groupBy(*cells).agg(F.min("_o0").alias("_first")), a.columns(), [(F.col("_first"), True)]).numbered()
    rows = a if w is None else w.numbered()
    right, columns, _ = firsts.as_right()
    joined = rows.df.join(right, equal((F.col(f"c{i}"), c) for i, (_, c) in enumerate(columns)))
    ranked = View.build(joined, [("position", F.col("_o0")), ("group", F.col("r_o0"))], [(F.col("r_o0"), True), (F.col("_o0"), True)]).numbered()
    starts = ranked.df.groupBy(F.col("c1").alias("_group")).agg(F.min("_o0").alias("_start"))
    placed = ranked.df.join(starts, F.col("c1") == F.col("_group"))
    return View.build(placed, [("position", F.col("c0")), ("group", F.col("c1")), ("place", F.col("_o0") - F.col("_start"))], [(F.col("c0"), True)])


def strlookup(spark: SparkSession, key: str, items: list[str]) -> int:
    """The first place of a text in a list, or -1."""
    return items.index(key) if key in items else -1


@operator
def lookup(v: View, column: str | int, value: Any) -> int:
    """The first position of a value in a column, or -1."""
    w = v.onecol(column).numbered()
    out = w.df.filter(F.col("c0") == F.lit(value)).agg(F.min("_o0")).first()[0]
    return -1 if out is None else out


@operator
def bitruns(v: View, column: str | int) -> View:
    """Run lengths of a 0/1 column: the first bit, then the lengths of the runs in turn.

    A run starts where the bit differs from the one before. Rows are compared within blocks of
    numbers, and a block's first row with the last one of the block before, so no window runs
    over the whole view. A run's length is the distance to the next start.
    """
    w = v.onecol(column).numbered()
    bits = w.df.select(w.rid().alias("at"), (F.col("c0") != 0).cast("int").alias("bit")).withColumn("block", F.floor(F.col("at") / BLOCK_ROWS))
    ends = bits.filter(F.col("at") % BLOCK_ROWS == BLOCK_ROWS - 1).select((F.col("block") + 1).alias("_next"), F.col("bit").alias("_end"))
    within = bits.withColumn("_was", F.lag("bit").over(Window.partitionBy("block").orderBy("at")))
    joined = within.join(ends, F.col("block") == F.col("_next"), "left").withColumn("_was", F.when(F.col("at") % BLOCK_ROWS == 0, F.col("_end")).otherwise(F.col("_was")))
    starts = joined.filter("_was is null or _was <> bit").select("at", "bit")
    numbered = View.build(starts, [("at", F.col("at")), ("bit", F.col("bit"))], [(F.col("at"), True)]).numbered()
    end = numbered.df.select((F.col("_o0") - 1).alias("_k"), F.col("c0").alias("_end"))
    runs = numbered.df.join(end, F.col("_o0") == F.col("_k"), "left").crossJoin(F.broadcast(bits.agg(F.count(F.lit(1)).alias("_n"))))
    lengths = runs.select((F.col("_o0") + 1).alias("at"), (F.coalesce("_end", "_n") - F.col("c0")).alias("x"))
    lead = numbered.df.filter("_o0 = 0").select(F.col("_o0").alias("at"), F.col("c1").cast("long").alias("x"))
    return View.build(lead.union(lengths), [("run", F.col("x"))], [(F.col("at"), True)], dense=True)


@operator
def resizecol(v: View, at: int, count: int) -> View:
    """A view of one integer column with count zeros put in at a position, or -count entries taken out there."""
    w = v.numbered()
    if count < 0:
        return View(w.df.filter((w.rid() < at) | (w.rid() >= at - count)), w.names, w.order)
    zeros = v.spark.range(count).select(F.lit(0).cast(w.kind(0)).alias("c0"), (F.col("id") + at).alias("_o0"))
    moved = w.df.select("c0", F.when(w.rid() < at, w.rid()).otherwise(w.rid() + count).alias("_o0"))
    return View(moved.union(zeros), w.names, (True,), dense=True)


__all__ = ["bitruns", "getinfo", "hashcol", "hashfind", "hashview", "index_view", "lookup", "resizecol", "rowhash", "strlookup"]
