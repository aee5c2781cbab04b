"""Changing rows and cells by position, and change sets.

Changes never touch their input. An edited view carries two hidden facts for each row, the
position it had in the base (null for new rows) and whether cells of it were set, so the
difference to the base is a projection of it, whatever changes were made in between.

A change set is a frame with kind (delete, adjust, insert), at, and the columns c0, c1, ...:
at is the base position of a deleted or adjusted row, the final position of an inserted one. It
is applied in this order: delete, adjust, insert. Like every frame it can be written as Parquet.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from rowloom.functions.schema import need_compat
from rowloom.plans.registry import operator
from rowloom.plans.view import View

_BASE, _SET = "\0base", "\0set"  # hidden last columns of an edited view


def _edited(v: View) -> View:
    """Numbered, with the two facts as last columns."""
    if v.names[-2:] == (_BASE, _SET):
        return v.numbered()
    w = v.numbered()
    return w.with_columns([*w.columns(), (_BASE, w.rid()), (_SET, F.lit(False))])


def _shown(e: View) -> View:
    return Edited(e.df, e.names[:-2], e.order, e.dense)


class Edited(View):
    """A view that knows its changes; every operator sees its plain columns only."""

    def full(self) -> View:
        return View(self.df, (*self.names, _BASE, _SET), self.order, self.dense)


def _full(v: View) -> View:
    return _edited(v.full() if isinstance(v, Edited) else v)


def _place(e: View, row: int) -> int:
    """A row number, negative ones from the end."""
    n = e.df.count() if row < 0 else None
    at = row if n is None else row + n
    if at < 0:
        raise IndexError("row out of range")
    return at


@operator
def set(v: View, row: int, *pairs: Any) -> Edited:  # noqa: A001
    """Cells of one row, from names and values in turn."""
    if len(pairs) % 2:
        raise ValueError("set needs pairs of a name and a value")
    e = _full(v)
    at, plain = _place(e, row), _shown(e)
    new = {plain.at(n): x for n, x in zip(pairs[::2], pairs[1::2])}
    here = e.rid() == at
    columns = [(n, F.when(here, F.lit(new[i]).cast(e.kind(i))).otherwise(c) if i in new else c) for i, (n, c) in enumerate(e.columns())]
    columns[-1] = (_SET, F.when(here, F.lit(True)).otherwise(columns[-1][1]))
    return _shown(e.with_columns(columns))


@operator
def replace(v: View, offset: int, count: int, w: View) -> Edited:
    """count rows from offset on replaced by the rows of another view of the same types."""
    need_compat(v, w)
    e, new = _full(v), w.numbered()
    at = _place(e, offset)
    left = View.build(e.df.filter((e.rid() < at) | (e.rid() >= at + count)), e.columns(), [(F.when(e.rid() < at, 0).otherwise(2), True), (e.rid(), True)])
    values = [(n, F.col(f"c{i}").cast(e.kind(i))) for i, n in enumerate(e.names[:-2])]
    right = View.build(new.df, [*values, (_BASE, F.lit(None).cast("long")), (_SET, F.lit(False))], [(F.lit(1), True), (new.rid(), True)])
    return _shown(View(left.df.union(right.df), e.names, left.order))


@operator
def insert(v: View, offset: int, w: View) -> Edited:
    """Rows put in at a position."""
    return replace(v, offset, 0, w)


@operator
def append(v: View, w: View) -> Edited:
    """Rows put at the end."""
    e = _full(v)
    return replace(_shown(e), e.df.count(), 0, w)


@operator
def delete(v: View, offset: int, count: int) -> Edited:
    """count rows from offset on taken out."""
    e = _full(v)
    at = _place(e, offset)
    return _shown(View(e.df.filter((e.rid() < at) | (e.rid() >= at + count)), e.names, e.order))


@operator
def emitmods(v: View, base: View) -> DataFrame:
    """The change set that makes the view from the base it was edited from; empty for a view without changes."""
    e, b = _full(v), base.numbered()
    n = e.width - 2
    cells = [f"c{i}" for i in range(n)]
    was, changed = F.col(f"c{n}"), F.col(f"c{n + 1}")
    gone = b.df.join(e.df.select(was.alias("_was")), b.rid() == F.col("_was"), "left_anti").select(F.lit("delete").alias("kind"), b.rid().alias("at"), *(F.lit(None).cast(b.kind(i)).alias(c) for i, c in enumerate(cells)))
    adjusted = e.df.filter(was.isNotNull() & changed).select(F.lit("adjust").alias("kind"), was.alias("at"), *cells)
    inserted = e.df.filter(was.isNull()).select(F.lit("insert").alias("kind"), e.rid().alias("at"), *cells)
    return gone.union(adjusted).union(inserted)


@operator
def loadmods(base: View, changes: DataFrame) -> View:
    """The base with a change set applied. Joins by position; rows that stay keep their order around the inserted ones."""
    b = base.numbered()
    cells = [f"c{i}" for i in range(b.width)]
    of = lambda kind: changes.filter(F.col("kind") == kind)
    gone = of("delete").select(F.col("at").alias("_at"))
    adjusted = of("adjust").select(F.col("at").alias("_at"), F.lit(True).alias("_set"), *(F.col(c).alias(f"n{c}") for c in cells))
    kept = b.df.join(gone, b.rid() == F.col("_at"), "left_anti").join(adjusted, b.rid() == F.col("_at"), "left")
    kept_view = View.build(kept, [(n, F.when(F.col("_set"), F.col(f"nc{i}")).otherwise(F.col(f"c{i}"))) for i, n in enumerate(b.names)], [(F.col("_o0"), True)]).numbered()
    inserted = of("insert")
    total = kept_view.df.count() + inserted.count()
    free = base.spark.range(total).join(inserted.select(F.col("at").alias("_at")), F.col("id") == F.col("_at"), "left_anti")
    slots = View.build(free, [("slot", F.col("id"))], [(F.col("id"), True)]).numbered()
    placed = kept_view.df.join(slots.df.select(F.col("c0").alias("_slot"), F.col("_o0").alias("_k")), F.col("_o0") == F.col("_k"))
    rows = placed.select(*cells, F.col("_slot").alias("_o0")).union(inserted.select(*cells, F.col("at").alias("_o0")))
    return View(rows, b.names, (True,), dense=True)


@operator
def mutinfo(v: View, base: View) -> dict[str, View]:
    """The difference to the base in seven views: inserted and adjusted rows, which cells differ, flags of deleted and adjusted base rows and of inserted rows, and each row's base position (-1: new)."""
    e, b = _full(v), base.numbered()
    n = e.width - 2
    was, changed = F.col(f"c{n}"), F.col(f"c{n + 1}")
    plain = [(m, F.col(f"c{i}")) for i, m in enumerate(e.names[:-2])]
    right, old, _ = b.as_right()
    both = e.df.filter(was.isNotNull() & changed).join(right, F.col(f"c{n}") == F.col("r_o0"))
    state = b.df.join(e.df.select(was.alias("_was"), changed.alias("_changed")), b.rid() == F.col("_was"), "left")
    flag = lambda df, cond, order: View.build(df, [("flag", cond.cast("int"))], [(order, True)], dense=True)
    return {
        "inserted": View.build(e.df.filter(was.isNull()), plain, e.ordering()),
        "adjusted": View.build(e.df.filter(was.isNotNull() & changed), plain, [(was, True)]),
        "used": View.build(both, [(m, (~F.col(f"c{i}").eqNullSafe(old[i][1])).cast("int")) for i, m in enumerate(e.names[:-2])], [(F.col(f"c{n}"), True)]),
        "deleted": flag(state, F.col("_was").isNull(), F.col("_o0")),
        "changed": flag(state, F.coalesce("_changed", F.lit(False)), F.col("_o0")),
        "new": flag(e.df, was.isNull(), e.rid()),
        "reverse": View.build(e.df, [("base", F.coalesce(was, F.lit(-1).cast("long")))], e.ordering(), dense=True),
    }
