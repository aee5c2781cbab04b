"""Sorting and comparing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rowloom.functions.schema import fields_of, meta_of
from rowloom.plans.registry import operator
from rowloom.plans.view import View


def _sorted(v: View, keys: list[tuple[int, bool]]) -> View:
    """New order columns before the old ones: stable, and no data move until rows are taken out."""
    return View.build(v.df, v.columns(), [*((F.col(f"c{i}"), up) for i, up in keys), *v.ordering()])


@operator
def sort(v: View) -> View:
    """Ascending by all columns from left to right, stable."""
    return _sorted(v, [(i, True) for i in range(v.width)])


@operator
def sorton(v: View, *spec: str | int) -> View:
    """By the columns named; ``+`` or ``-`` holds for all that follow it. A repeated column counts once, where it stands first."""
    up, keys = True, []
    for x in spec:
        if x in ("+", "-"):
            up = x == "+"
        elif v.at(x) not in [i for i, _ in keys]:
            keys.append((v.at(x), up))
    return _sorted(v, keys)


@operator
def sortmap(v: View) -> View:
    """Positions in the order that sorts the view."""
    w = v.numbered()
    return View.build(w.df, [("index", w.rid())], [*((F.col(f"c{i}"), True) for i in range(w.width)), (w.rid(), True)])


def sign(pairs: list[tuple[Column, Column]]) -> Column:
    """-1, 0 or 1 by the first pair that differs."""
    return reduce(lambda rest, p: F.when(p[0] < p[1], -1).when(p[0] > p[1], 1).otherwise(rest), reversed(pairs), F.lit(0))


@operator
def compare(v: View, w: View) -> int:
    """-1, 0 or 1: by structure with names, then by the first row that differs, then by length. Rows are joined by position."""
    a, b = meta_of(fields_of(v)), meta_of(fields_of(w))
    if a != b:
        return -1 if a < b else 1
    x, y = v.numbered(), w.numbered()
    right, columns, _ = y.as_right()
    both = x.df.join(right, F.col("_o0") == F.col("r_o0"), "full")
    row = F.when(F.col("_o0").isNull(), -1).when(F.col("r_o0").isNull(), 1).otherwise(sign([(F.col(f"c{i}"), c) for i, (_, c) in enumerate(columns)]))
    found = both.select(F.coalesce("_o0", "r_o0").alias("at"), row.alias("s")).filter("s <> 0").agg(F.min_by("s", "at")).first()[0]
    return found or 0


def row_at(v: View, row: int) -> View:
    """One row of a numbered view; negative positions count from the end."""
    w = v.numbered()
    if row < 0:
        row += w.df.count()
    return View(w.df.filter(w.rid() == row), w.names, w.order)


@operator
def rowcmp(v: View, row: int, w: View, other: int) -> int:
    """-1, 0 or 1 for two rows, column by column."""
    a, b = row_at(v, row), row_at(w, other)
    right, columns, _ = b.as_right()
    found = a.df.crossJoin(F.broadcast(right)).select(sign([(F.col(f"c{i}"), c) for i, (_, c) in enumerate(columns)])).first()  # one row each
    if found is None:
        raise IndexError("row out of range")
    return found[0]


@operator
def roweq(v: View, row: int, w: View, other: int) -> bool:
    return v.width == w.width and rowcmp(v, row, w, other) == 0
