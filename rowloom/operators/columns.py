"""Choosing, renaming and pairing columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import functions as F

from rowloom.plans.registry import operator
from rowloom.plans.view import View


@operator
def colmap(v: View, columns: Sequence[str | int]) -> View:
    """The columns in the order given, repeats allowed; none leaves a view of as many rows without columns."""
    at = [v.at(c) for c in columns]
    return v.with_columns((v.names[i], F.col(f"c{i}")) for i in at)


@operator
def colomit(v: View, columns: Sequence[str | int]) -> View:
    """All columns but these; naming one twice does no harm."""
    out = {v.at(c) for c in columns}
    return v.with_columns((n, F.col(f"c{i}")) for i, n in enumerate(v.names) if i not in out)


@operator
def onecol(v: View, column: str | int) -> View:
    return colmap(v, [column])


@operator
def getcol(v: View, column: str | int) -> list[Any]:
    """A column's values in order, on the driver."""
    return [r[0] for r in onecol(v, column).rows()]


@operator
def colconv(v: View) -> View:
    """A view of one column as it is; any other view raises."""
    if v.width != 1:
        raise ValueError("not a column")
    return v


@operator
def viewascol(v: View) -> list[list[Any]]:
    """All columns as lists, from one pass."""
    rows = v.rows()
    return [[r[i] for r in rows] for i in range(v.width)]


@operator
def rename(v: View, *pairs: str | int) -> View:
    """Old and new names in turn. Old ones are looked up before any change, so names can be swapped."""
    if len(pairs) % 2:
        raise ValueError("rename needs pairs of an old and a new name")
    names = list(v.names)
    for old, new in zip(pairs[::2], pairs[1::2]):
        names[v.at(old)] = str(new)
    return View(v.df, tuple(names), v.order, v.dense, v.nest)


@operator
def tag(v: View, name: str) -> View:
    """A last column with the row numbers from 0."""
    w = v.numbered()
    return w.with_columns([*w.columns(), (name, w.rid())])


@operator
def pair(v: View, w: View) -> View:
    """Rows of two views side by side by position, as many as the shorter has."""
    a, b = v.numbered(), w.numbered()
    right, columns, _ = b.as_right()
    joined = a.df.join(right, F.col("_o0") == F.col("r_o0"))
    return View.build(joined, [*a.columns(), *columns], [(F.col("_o0"), True)], dense=True)


@operator
def transpose(v: View, prefix: str = "x", kind: str = "string") -> View:
    """Rows become columns prefix0, prefix1, ... of one type, columns become rows in their order.

    The result has a column for each row, so it is for small views; the turn itself is a grouped pivot.
    """
    w = v.numbered()
    n = w.df.count()
    cells = w.df.select(w.rid().alias("r"), F.posexplode(F.array(*(F.col(f"c{i}").cast(kind) for i in range(w.width)))).alias("p", "x"))
    turned = cells.groupBy("p").pivot("r", list(range(n))).agg(F.first("x")) if n else cells.select("p").distinct()
    return View.build(turned, [(f"{prefix}{i}", F.col(f"`{i}`")) for i in range(n)], [(F.col("p").cast("long"), True)], dense=bool(n))
