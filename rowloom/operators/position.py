"""Operators on row positions.

``step`` is the general one: rows are picked by a computed source position and joined to the
numbered view. Where a simpler plan gives the same rows it is used: a turned order, a filter on
numbers, an explode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowloom.plans.registry import operator
from rowloom.plans.storage import settle
from rowloom.plans.view import View

#: Up to so many rows ``first`` and ``last`` use Spark's top-n; beyond it rows are numbered and filtered.
TOP_ROWS = 10_000


def gather(v: View, picked: DataFrame, at: Column, source: Column) -> View:
    """Rows of the view at the source positions, at the new positions."""
    w = v.numbered()
    wanted = picked.select(at.cast("long").alias("_at"), source.cast("long").alias("_from"))
    joined = wanted.join(w.df, F.col("_from") == w.rid())
    return View.build(joined, w.columns(), [(F.col("_at"), True)], dense=True)


@operator
def step(v: View, count: int, offset: int = 0, rate: int = 1, step: int = 1) -> View:
    """count * rate rows; row r comes from (offset + r div rate * step) modulo the size. An empty view stays as it is."""
    w = v.numbered()
    n = w.df.count()
    if not n:
        return w
    source = F.pmod(F.lit(offset) + F.floor(F.col("id") / rate) * step, F.lit(n))
    return gather(w, v.spark.range(max(0, count * rate)), F.col("id"), source)


@operator
def first(v: View, n: int) -> View:
    """The first n rows, or all."""
    if n < 0:
        raise ValueError("count must not be negative")
    if n > TOP_ROWS or v.dense:
        w = v.numbered()
        return View(w.df.filter(w.rid() < n), w.names, w.order, True)
    return View(v.df.orderBy(*v.sort_keys()).limit(n), v.names, v.order, v.dense)


@operator
def last(v: View, n: int) -> View:
    """The last n rows, or all, in their order."""
    if n < 0:
        raise ValueError("count must not be negative")
    if n > TOP_ROWS:
        return reverse(first(reverse(v), n))
    return View(v.df.orderBy(*v.sort_keys(backwards=True)).limit(n), v.names, v.order)


@operator
def take(v: View, n: int) -> View:
    """n > 0: n rows from the start, over and over if there are fewer; n < 0: -n rows back from the end."""
    return step(v, n, 0, 1, 1) if n >= 0 else step(v, -n, -1, 1, -1)


@operator
def slice(v: View, start: int, by: int, count: int) -> View:  # noqa: A001
    """count rows from start on, moving by ``by``, round and round."""
    return step(v, count, start, 1, by)


@operator
def reverse(v: View) -> View:
    """Rows in the opposite order: no data move."""
    return View(v.df, v.names, tuple(not up for up in v.order))


@operator
def repeat(v: View, n: int) -> View:
    """The whole view n times."""
    if n <= 0:
        return View(v.df.limit(0), v.names, v.order)
    df = v.df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return View.build(df, v.columns(), [(F.col("_rep"), True), *v.ordering()])


@operator
def spread(v: View, n: int) -> View:
    """Every row n times in a row."""
    if n <= 0:
        return View(v.df.limit(0), v.names, v.order)
    df = v.df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return View.build(df, v.columns(), [*v.ordering(), (F.col("_rep"), True)])


def resolve(indexes: Sequence[int]) -> list[int]:
    """A negative entry -k at place p stands for the entry at p - k."""
    out: list[int] = []
    for p, x in enumerate(indexes):
        if x < 0 and p + x < 0:
            raise IndexError(f"no entry before {p}")
        out.append(x if x >= 0 else out[p + x])
    return out


def positions(spark: SparkSession, indexes: Sequence[int] | View) -> DataFrame:
    """(_at, _from) of an index list, or of a view of one column of indexes. Back-references of a view are followed by joins."""
    if not isinstance(indexes, View):
        return spark.createDataFrame(list(enumerate(resolve(indexes))), "_at long, _from long")
    w = indexes.numbered()
    rows = settle(w.df.select(w.rid().alias("_at"), F.col("c0").cast("long").alias("_from")))
    if rows.filter("_at + _from < 0 and _from < 0").limit(1).count():
        raise IndexError("an entry refers to one before the first")
    while rows.filter("_from < 0").limit(1).count():  # every round follows each open reference to what its target holds
        target = rows.select(F.col("_at").alias("_t"), F.col("_from").alias("_x"))
        joined = rows.join(target, F.when(F.col("_from") < 0, F.col("_at") + F.col("_from")) == F.col("_t"), "left")
        rows = settle(joined.select("_at", F.when(F.col("_from") >= 0, F.col("_from")).when(F.col("_x") >= 0, F.col("_x")).otherwise(F.col("_t") + F.col("_x") - F.col("_at")).alias("_from")))
    return rows


@operator
def remap(v: View, indexes: Sequence[int] | View) -> View:
    """Rows by an index list: any order, repeats and back-references allowed."""
    return gather(v, positions(v.spark, indexes), F.col("_at"), F.col("_from"))


@operator
def remapsub(v: View, indexes: Sequence[int] | View, start: int, count: int) -> View:
    """``remap`` over a part of the list; a negative count means all of it."""
    if count < 0:
        return remap(v, indexes)
    if not isinstance(indexes, View):
        return remap(v, list(indexes)[start : start + count])
    w = indexes.numbered()
    part = w.df.filter((w.rid() >= start) & (w.rid() < start + count)).withColumn("_o0", w.rid() - start)
    return remap(v, View(part, w.names, w.order, dense=True))


def index_view(spark: SparkSession, df: DataFrame, at: Column) -> View:
    """Ascending positions as a view of one column."""
    return View.build(df, [("index", at.cast("long"))], [(at.cast("long"), True)])


def omitmap(spark: SparkSession, indexes: Sequence[int] | View, n: int) -> View:
    """The positions 0..n-1 that are not in the list, or in a view of one column."""
    out = indexes.df.select(F.col("c0").cast("long").alias("_x")).distinct() if isinstance(indexes, View) else spark.createDataFrame([(i,) for i in indexes], "_x long")
    return index_view(spark, spark.range(n).join(out, F.col("id") == F.col("_x"), "left_anti"), F.col("id"))
