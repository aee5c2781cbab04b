"""Whole-column aggregates and frequencies; for groups see ``nesting.group_aggregate``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from rowloom.plans.registry import operator
from rowloom.plans.view import View


def _extreme(v: View, column: str | int, pick) -> Any:
    n, out = v.df.agg(F.count(F.lit(1)), pick(v.col(column))).first()
    if not n:
        raise ValueError("need at least one row")
    return out


@operator(name="max")
def max_(v: View, column: str | int) -> Any:
    """The largest value of a column of any type; a view without rows raises."""
    return _extreme(v, column, F.max)


@operator(name="min")
def min_(v: View, column: str | int) -> Any:
    """The smallest value of a column of any type; a view without rows raises."""
    return _extreme(v, column, F.min)


@operator(name="sum")
def sum_(v: View, column: str | int) -> int | float:
    """The sum of a number column, 0 for no rows: 64-bit integer for integers, double for others."""
    kind = v.kind(column).simpleString()
    if kind not in ("int", "bigint", "float", "double", "smallint", "tinyint") and not kind.startswith("decimal"):
        raise TypeError(f"cannot sum a {kind} column")
    return v.df.agg(F.coalesce(F.sum(v.col(column)), F.lit(0))).first()[0]


@operator
def freq(v: View, name: str) -> View:
    """Different rows in the order of first occurrence, each with its count."""
    w = v.upward()
    found = w.df.groupBy(*(f"c{i}" for i in range(w.width))).agg(F.min(w.rank()).alias("_first"), F.count(F.lit(1)).alias("_n"))
    if not w.width:
        found = found.filter("_n > 0")
    return View.build(found, [*w.columns(), (name, F.col("_n"))], [(F.col("_first")[f"_o{i}"], True) for i in range(len(w.order))])
