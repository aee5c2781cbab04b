"""Conditions and expressions over rows.

They are Spark SQL expressions, as text or as columns, over the view's column names; ``#`` (in
text as `` `#` ``) is the row number, and rows are numbered only if it is used. Filters reach the
source. A name that stands twice means its first column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.operators.position import index_view, positions
from rowloom.plans.registry import operator
from rowloom.plans.view import View

Expression = str | Column


def _numbers(expression: Expression) -> bool:
    return "#" in (expression if isinstance(expression, str) else str(expression))


def _named(v: View) -> DataFrame:
    """The view's frame with its logical names beside the physical ones."""
    return v.df.select("*", *(F.col(f"c{i}").alias(n) for i, n in enumerate(v.names) if v.names.index(n) == i), *([F.col("_o0").alias("#")] if v.dense else []))


def _ready(v: View, expression: Expression) -> tuple[View, DataFrame, Column]:
    w = v.numbered() if _numbers(expression) else v
    return w, _named(w), F.expr(expression) if isinstance(expression, str) else expression


@operator
def where(v: View, condition: Expression) -> View:
    """Rows that satisfy the condition."""
    w, df, cond = _ready(v, condition)
    return View(df.filter(cond).select(*w.df.columns), w.names, w.order)


@operator
def index(v: View, condition: Expression) -> View:
    """Positions of the rows that satisfy the condition."""
    w, df, cond = _ready(v, condition)
    kept = View.build(df, [("kept", cond)], w.ordering(), w.dense).numbered()  # only the answer is numbered, not the columns
    return index_view(v.spark, kept.df.filter("c0").select("_o0"), F.col("_o0"))


@operator
def compute(v: View, name: str, expression: Expression) -> View:
    """The expression's value for each row, as a view of one column."""
    w, df, e = _ready(v, expression)
    return View.build(df, [(name, e)], w.ordering(), w.dense)


@operator
def collect(v: View, expression: Expression) -> list[Any]:
    """The expression's values in row order, on the driver."""
    return [r[0] for r in compute(v, "value", expression).rows()]


@operator
def pick(v: View, mask: Sequence[int] | View) -> View:
    """Rows whose entry in the mask is not 0; rows beyond the mask stay."""
    w = v.numbered()
    if isinstance(mask, View):
        m = mask.numbered()
        marks = m.df.select(m.rid().alias("_at"), F.col("c0").cast("long").alias("_from"))
    else:
        marks = v.spark.createDataFrame([(i, int(x)) for i, x in enumerate(mask)], "_at long, _from long")
    zero = marks.filter("_from = 0").select("_at")
    return View(w.df.join(zero, w.rid() == F.col("_at"), "left_anti"), w.names, w.order)


@operator
def loop(v: View, body: Callable[[dict[str, Any]], Any], where: Expression | None = None, first: int = 0, limit: int | None = None, step: int = 1) -> list[Any]:
    """Runs a Python function on each row, in order, on the driver: a dict by name, with the row number as ``#``.

    Only rows from ``first`` on and before ``limit`` are taken, every ``step``-th of them. Rows stream through the driver, one partition at a time. StopIteration ends the loop. For work
    on all rows of a large view use ``compute`` or ``where``.
    """
    w = v.numbered()
    df = _named(w)
    if where is not None:
        df = df.filter(where)
    df = df.filter((w.rid() >= first) & (F.pmod(w.rid() - first, F.lit(step)) == 0))
    if limit is not None:
        df = df.filter(w.rid() < limit)
    names = [n for i, n in enumerate(w.names) if w.names.index(n) == i]
    out = []
    for row in df.orderBy("_o0").select("#", *names).toLocalIterator():
        try:
            out.append(body(row.asDict()))
        except StopIteration:
            break
    return out


__all__ = ["collect", "compute", "index", "loop", "pick", "positions", "where"]
