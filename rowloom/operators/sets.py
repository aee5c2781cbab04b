"""Set operators that keep duplicates and order.

Operands need columns of the same types, place by place; names come from the left. They are
semi and anti joins on all columns, which Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.schema import need_compat
from rowloom.operators.position import index_view
from rowloom.plans.registry import operator
from rowloom.plans.view import View, equal


def _present(v: View, w: View, how: str) -> View:
    need_compat(v, w)
    right, columns, _ = w.as_right()
    on = equal((F.col(f"c{i}"), c) for i, (_, c) in enumerate(columns))
    return View(v.df.join(right.select(*(c for _, c in columns)).distinct(), on, how), v.names, v.order)


@operator
def intersect(v: View, w: View) -> View:
    """Rows of the left that the right has."""
    return _present(v, w, "left_semi")


@operator(name="except")
def except_(v: View, w: View) -> View:
    """Rows of the left that the right has not; neither EXCEPT nor EXCEPT ALL."""
    return _present(v, w, "left_anti")


@operator
def concat(v: View, w: View) -> View:
    """The rows of the left, then those of the right, under the left's names."""
    need_compat(v, w)
    schema = v.df.schema
    none = lambda df, up: [(F.lit(None).cast(df.schema[f"_o{i}"].dataType), u) for i, u in enumerate(up)]
    left = View.build(v.df, v.columns(), [(F.lit(0), True), *v.ordering(), *none(w.df, w.order)])
    right = View.build(w.df, [(n, F.col(f"c{i}").cast(schema[f"c{i}"].dataType)) for i, n in enumerate(v.names)], [(F.lit(1), True), *none(v.df, v.order), *w.ordering()])
    return View(left.df.union(right.df), v.names, left.order)


@operator
def union(v: View, w: View) -> View:
    """The left, then the rows of the right that the left has not; duplicates within either stay."""
    return concat(v, except_(w, v))


@operator
def unique(v: View) -> View:
    """Different rows, in the order of their first occurrence. Combined before the shuffle."""
    w = v.upward()
    keys = [f"c{i}" for i in range(w.width)]
    found = w.df.groupBy(*keys).agg(F.min(w.rank()).alias("_first"))
    if not keys:
        found = found.filter(F.col("_first").isNotNull())
    return View.build(found, w.columns(), [(F.col("_first")[f"_o{i}"], True) for i in range(len(w.order))])


@operator
def project(v: View, columns: list[str | int]) -> View:
    """Chosen columns, then different rows only."""
    from rowloom.operators.columns import colmap

    return unique(colmap(v, columns))


@operator
def isectmap(v: View, w: View) -> View:
    """Positions of the left's rows that the right has."""
    found = _present(v.numbered(), w, "left_semi")
    return index_view(v.spark, found.df, F.col("_o0"))


@operator
def exceptmap(v: View, w: View) -> View:
    """Positions of the left's rows that the right has not."""
    found = _present(v.numbered(), w, "left_anti")
    return index_view(v.spark, found.df, F.col("_o0"))


@operator
def unionmap(v: View, w: View) -> View:
    """Positions of the right's rows that the left has not."""
    return exceptmap(w, v)


@operator
def uniquemap(v: View) -> View:
    """Positions of first occurrences."""
    found = unique(v.numbered())
    return index_view(v.spark, found.df, F.col("_o0"))
