"""The view: a DataFrame with logical column names and an explicit row order.

Columns are stored under the names ``c0``, ``c1``, ... so that logical names may repeat or differ
in case only. Order is metadata: hidden columns ``_o0``, ``_o1``, ... with a direction each.
Sorting a view only changes these, without a shuffle; rows are put in order when they are taken
out, cut off or numbered. Most operators need no more than this. Those that work on positions
number the rows 0..n-1 first (``View.numbered``): one range-partitioned sort, whose partitions
are counted and given offsets, so no task ever holds more than its partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rowloom.plans.storage import settle

#: One-letter types. Timestamps, dates, booleans and decimals are extensions.
LETTERS = {T.IntegerType: "I", T.LongType: "L", T.FloatType: "F", T.DoubleType: "D", T.StringType: "S", T.BinaryType: "B"}
EXTENSIONS = {T.TimestampType: "T", T.DateType: "T", T.BooleanType: "I", T.DecimalType: "D", T.ShortType: "I", T.ByteType: "I"}


def letter(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return "V"
    return LETTERS.get(type(kind)) or EXTENSIONS.get(type(kind)) or "S"


@dataclass(frozen=True)
class Nest:
    """How the last column was made: group (source, key positions) or join (left, right, key pairs). Lets later operators skip the nesting."""

    kind: str
    source: View
    keys: tuple
    other: View | None = None


@dataclass(frozen=True)
class View:
    df: DataFrame
    names: tuple[str, ...]
    order: tuple[bool, ...]  # for each hidden column whether it ascends
    dense: bool = False  # the only order column is 0..n-1
    nest: Nest | None = field(default=None, compare=False)

    # -- making views

    @staticmethod
    def build(df: DataFrame, columns: Iterable[tuple[str, Column]], order: Iterable[tuple[Column, bool]], dense: bool = False, nest: Nest | None = None) -> View:
        columns, order = list(columns), list(order)
        picked = [c.alias(f"c{i}") for i, (_, c) in enumerate(columns)] + [o.alias(f"_o{i}") for i, (o, _) in enumerate(order)]
        return View(df.select(*picked), tuple(n for n, _ in columns), tuple(up for _, up in order), dense, nest)

    @staticmethod
    def of(df: DataFrame, order: Sequence[str] = (), columns: Sequence[str] | None = None) -> View:
        """A frame as a view, in the order of the named columns. Without them rows keep the order they are read in, which Spark promises within a file only."""
        keys = [(F.col(c), True) for c in order] or [(F.monotonically_increasing_id(), True)]
        return View.build(df, [(c, F.col(c)) for c in columns or df.columns], keys)

    # -- looking at them

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def width(self) -> int:
        return len(self.names)

    def at(self, column: str | int) -> int:
        """The position of a column: by name (the first one), by number, or by negative number from the end."""
        if isinstance(column, str):
            if column in self.names:
                return self.names.index(column)
            if not column.lstrip("-").isdigit():
                raise KeyError(f"unknown column: {column}")
            column = int(column)
        if not -self.width <= column < self.width:
            raise IndexError(f"column out of range: {column}")
        return column % self.width

    def col(self, column: str | int) -> Column:
        return F.col(f"c{self.at(column)}")

    def kind(self, column: str | int) -> T.DataType:
        return self.df.schema[f"c{self.at(column)}"].dataType

    def columns(self) -> list[tuple[str, Column]]:
        return [(n, F.col(f"c{i}")) for i, n in enumerate(self.names)]

    def ordering(self) -> list[tuple[Column, bool]]:
        return [(F.col(f"_o{i}"), up) for i, up in enumerate(self.order)]

    def sort_keys(self, backwards: bool = False) -> list[Column]:
        return [c.asc() if up != backwards else c.desc() for c, up in self.ordering()]

    def rank(self) -> Column:
        """The order columns as one value that ascends; only for views without descending ones (see ``upward``)."""
        return F.struct(*(c for c, _ in self.ordering()))

    def rid(self) -> Column:
        return F.col("_o0")

    # -- changing form

    def with_columns(self, columns: Iterable[tuple[str, Column]]) -> View:
        return View.build(self.df, columns, self.ordering(), self.dense)

    def upward(self) -> View:
        """Itself, numbered anew if an order column descends."""
        return self if all(self.order) else self.numbered()

    def numbered(self) -> View:
        """The same rows with the numbers 0..n-1 as their order."""
        if self.dense:
            return self
        cols = [f"c{i}" for i in range(self.width)]
        rows = settle(self.df.orderBy(*self.sort_keys()).select(*cols, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
        sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))  # a row for each partition
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
        return View.build(rows.join(F.broadcast(offsets), "_p"), self.columns(), [(F.col("_m") + F.col("_shift"), True)], dense=True)

    def as_right(self) -> tuple[DataFrame, list[tuple[str, Column]], list[tuple[Column, bool]]]:
        """The frame under names that do not clash with another view's, for joins."""
        df = self.df.toDF(*(f"r{c}" for c in self.df.columns))
        return df, [(n, F.col(f"rc{i}")) for i, n in enumerate(self.names)], [(F.col(f"r_o{i}"), up) for i, up in enumerate(self.order)]

    # -- taking rows out

    def frame(self) -> DataFrame:
        """The columns under their logical names, without the order."""
        return self.df.select(*(c.alias(n) for n, c in self.columns()))

    def sorted_frame(self) -> DataFrame:
        return self.df.orderBy(*self.sort_keys()).select(*(c.alias(n) for n, c in self.columns()))

    def rows(self) -> list[tuple[Any, ...]]:
        """All rows, in order, on the driver."""
        return [tuple(r) for r in self.df.orderBy(*self.sort_keys()).select(*(f"c{i}" for i in range(self.width))).collect()]

    def __getattr__(self, name: str):
        from rowloom.plans.registry import OPERATORS

        if name.startswith("_") or name not in OPERATORS:
            raise AttributeError(name)
        return lambda *args, **options: OPERATORS[name](self, *args, **options)


def equal(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Equality of all pairs; nulls, which views need not have, equal each other."""
    out = None
    for a, b in pairs:
        out = a.eqNullSafe(b) if out is None else out & a.eqNullSafe(b)
    return F.lit(True) if out is None else out
