"""Joins, products and nested views.

A nested view is an array of structs whose elements keep the order of their rows; one without
columns is stored as its row count. ``group`` and ``join`` remember what they were made from:
``counts``, ``ungroup`` and ``group_aggregate`` then run as a grouped aggregate or a flat join,
and no group is gathered unless its rows are asked for as one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowloom.plans.registry import operator
from rowloom.plans.view import Nest, View, equal

#: Rows of a right side that are broadcast as one nested value, at most.
BROADCAST_ROWS = 10_000


def shared_keys(v: View, w: View) -> list[tuple[int, int]]:
    """Places of the columns that both views have by name and type, nested types included."""
    out = []
    for i, n in enumerate(v.names):
        for j, m in enumerate(w.names):
            if n == m and v.kind(i) == w.kind(j) and all(j != b for _, b in out) and all(v.names[a] != n or v.kind(a) != v.kind(i) for a, _ in out):
                out.append((i, j))
                break
    return out


def _nested(order: list[Column], rest: list[tuple[str, Column]]) -> Column:
    """The rows of a group as an array in their order, or their count if they have no columns."""
    if not rest:
        return F.count(F.lit(1))
    row = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *(c.alias(f"v{i}") for i, (_, c) in enumerate(rest)))
    return F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(*(x[f"v{i}"].alias(n) for i, (n, _) in enumerate(rest))))


@operator
def ijoin(v: View, w: View) -> View:
    """Natural inner join: left order, then right order; without shared columns the product."""
    keys = shared_keys(v, w)
    right, columns, order = w.as_right()
    joined = v.df.join(right, equal((F.col(f"c{i}"), columns[j][1]) for i, j in keys)) if keys else v.df.crossJoin(right)
    taken = {j for _, j in keys}
    return View.build(joined, [*v.columns(), *(c for j, c in enumerate(columns) if j not in taken)], [*v.ordering(), *order])


@operator
def product(v: View, w: View) -> View:
    """Every row of the left with every row of the right: for this operator only, Spark's cross join."""
    right, columns, order = w.as_right()
    return View.build(v.df.crossJoin(right), [*v.columns(), *columns], [*v.ordering(), *order])


@operator
def join(v: View, w: View, name: str) -> View:
    """Every row of the left with a nested view of the right's matching rows, less the shared columns; empty if none match."""
    keys = shared_keys(v, w)
    up = w.upward()
    right, columns, order = up.as_right()
    taken = {j for _, j in keys}
    rest = [c for j, c in enumerate(columns) if j not in taken]
    nested = _nested([c for c, _ in order], rest).alias("_nest")
    if keys:
        groups = right.groupBy(*(columns[j][1] for _, j in keys)).agg(nested)
        joined = v.df.join(groups, equal((F.col(f"c{i}"), columns[j][1]) for i, j in keys), "left")
    else:
        few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        whole = right.agg(nested)  # one row that holds all of the right: it is what each row of the result holds
        joined = v.df.crossJoin(F.broadcast(whole) if few else whole)
    kind = joined.schema["_nest"].dataType
    empty = F.array().cast(kind) if rest else F.lit(0).cast("long")
    return View.build(joined, [*v.columns(), (name, F.coalesce("_nest", empty))], v.ordering(), v.dense, Nest("join", v, tuple(keys), w))


@operator
def group(v: View, columns: Sequence[str | int], name: str) -> View:
    """One row for each different key, in the order of first occurrence, with the other columns nested."""
    w = v.upward()
    at = list(dict.fromkeys(w.at(c) for c in columns))
    rest = [(n, F.col(f"c{i}")) for i, n in enumerate(w.names) if i not in at]
    found = w.df.groupBy(*(f"c{i}" for i in at)).agg(F.min(w.rank()).alias("_first"), _nested([c for c, _ in w.ordering()], rest).alias("_nest"))
    if not at:
        found = found.filter(F.col("_first").isNotNull())
    return View.build(found, [*((w.names[i], F.col(f"c{i}")) for i in at), (name, F.col("_nest"))], [(F.col("_first")[f"_o{i}"], True) for i in range(len(w.order))], nest=Nest("group", w, tuple(at)))


@operator
def group_aggregate(v: View, columns: Sequence[str | int], **aggregates: Column) -> View:
    """What ``group`` followed by an aggregate of each nested view gives, as one grouped aggregate with map-side combination.

    The aggregates are Spark columns over the view's column names.
    """
    w = v.upward()
    at = list(dict.fromkeys(w.at(c) for c in columns))
    named = w.df.select(*(F.col(f"c{i}").alias(f"k{i}") for i in at), *(F.col(f"c{i}").alias(n) for i, n in enumerate(w.names) if w.names.index(n) == i), w.rank().alias("_rank"))
    found = named.groupBy(*(f"k{i}" for i in at)).agg(F.min("_rank").alias("_first"), *(c.alias(n) for n, c in aggregates.items()))
    if not at:
        found = found.filter(F.col("_first").isNotNull())
    return View.build(found, [*((w.names[i], F.col(f"k{i}")) for i in at), *((n, F.col(n)) for n in aggregates)], [(F.col("_first")[f"_o{i}"], True) for i in range(len(w.order))])


@operator
def grouped(v: View, ends: Sequence[int] | View, permutation: Sequence[int] | View, name: str) -> View:
    """Nested views from cumulative ends and a permutation of positions: row g holds the rows between its end and the one before. Both may be lists or views of one column."""
    from rowloom.operators.position import positions

    w = v.numbered()
    if isinstance(ends, View):
        e = ends.numbered()
        before = e.df.select((e.rid() + 1).alias("_next"), F.col("c0").cast("long").alias("_lo"))
        bounds = e.df.join(before, e.rid() == F.col("_next"), "left").select(e.rid().alias("_g"), F.coalesce("_lo", F.lit(0)).alias("_lo"), F.col("c0").cast("long").alias("_hi"))
    else:
        bounds = v.spark.createDataFrame([(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends))], "_g long, _lo long, _hi long")
    places = bounds.filter("_hi > _lo").select("_g", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_p"))
    rows = places.join(positions(v.spark, permutation), F.col("_p") == F.col("_at")).join(w.df, F.col("_from") == w.rid())
    nests = rows.groupBy("_g").agg(_nested([F.col("_p")], w.columns()).alias("_nest"))
    out = bounds.join(nests, "_g", "left")
    kind = out.schema["_nest"].dataType
    return View.build(out, [(name, F.coalesce("_nest", F.array().cast(kind) if w.width else F.lit(0).cast("long")))], [(F.col("_g"), True)], dense=True)


def _elements(df: DataFrame, at: Column, kind: T.DataType) -> DataFrame:
    """Adds _pos and _row for each row of a nested column; rows whose nested view is empty vanish."""
    if isinstance(kind, T.LongType):
        return df.withColumn("_pos", F.explode(F.when(at > 0, F.sequence(F.lit(1).cast("long"), at)).otherwise(F.array().cast("array<bigint>")))).withColumn("_row", F.struct())
    return df.select("*", F.posexplode(at).alias("_pos", "_row"))


@operator
def ungroup(v: View, column: str | int) -> View:
    """A nested column replaced by its columns, a row for each nested row; rows with an empty one vanish."""
    at = v.at(column)
    if v.nest and at == v.width - 1:  # the flat form of what made it
        if v.nest.kind == "join":
            return View(*_plain(ijoin(v.nest.source, v.nest.other)))
        source = v.nest.source
        first = View.build(v.df, [(n, c) for n, c in v.columns()[:-1]], v.ordering())
        right, columns, order = source.as_right()
        flat = first.df.join(right, equal((F.col(f"c{k}"), columns[i][1]) for k, i in enumerate(v.nest.keys))) if v.nest.keys else first.df.crossJoin(right)
        return View.build(flat, [*first.columns(), *(c for j, c in enumerate(columns) if j not in v.nest.keys)], [*first.ordering(), *order])
    kind = v.kind(at)
    fields = kind.elementType.names if isinstance(kind, T.ArrayType) else []
    flat = _elements(v.df, F.col(f"c{at}"), kind)
    columns = v.columns()
    inner = [(f, F.col("_row")[f]) for f in fields]
    return View.build(flat, [*columns[:at], *inner, *columns[at + 1 :]], [*v.ordering(), (F.col("_pos"), True)])


def _plain(v: View) -> tuple:
    return v.df, v.names, v.order, v.dense


@operator
def blocked(v: View) -> View:
    """A view of blocks as one: the last block's rows stand between the others, one after each."""
    w = v.numbered()
    fields = w.kind(0).elementType.names
    last = w.df.agg(F.max("_o0").alias("_last"))
    rows = _elements(w.df.crossJoin(F.broadcast(last)), F.col("c0"), w.kind(0))  # last is one row
    is_separator = F.col("_o0") == F.col("_last")
    order = [F.when(is_separator, F.col("_pos")).otherwise(F.col("_o0")), is_separator, F.when(is_separator, F.lit(0)).otherwise(F.col("_pos"))]
    return View.build(rows, [(f, F.col("_row")[f]) for f in fields], [(o, True) for o in order])


@operator
def counts(v: View, column: str | int) -> View:
    """Row counts of a nested column, as a view of one column."""
    at = v.at(column)
    if v.nest and at == v.width - 1:
        return with_counts(v, "count").onecol("count")
    return v.with_columns([("count", countscol(F.col(f"c{at}"), v.kind(at)))])


def countscol(nested: Column, kind: T.DataType) -> Column:
    return nested if isinstance(kind, T.LongType) else F.size(nested).cast("long")


@operator
def with_counts(v: View, name: str) -> View:
    """The view with its last, nested column replaced by row counts, without nesting the rows."""
    if v.nest is None:
        return v.with_columns([*v.columns()[:-1], (name, countscol(F.col(f"c{v.width - 1}"), v.kind(-1)))])
    source, keys = v.nest.source, v.nest.keys
    if v.nest.kind == "group":
        return group_aggregate(source, list(keys), **{name: F.count(F.lit(1))})
    right, columns, _ = v.nest.other.as_right()
    sizes = right.groupBy(*(columns[j][1] for _, j in keys)).agg(F.count(F.lit(1)).alias("_n"))
    joined = source.df.join(sizes, equal((F.col(f"c{i}"), columns[j][1]) for i, j in keys), "left") if keys else source.df.crossJoin(F.broadcast(sizes))
    return View.build(joined, [*source.columns(), (name, F.coalesce("_n", F.lit(0).cast("long")))], source.ordering(), source.dense)
