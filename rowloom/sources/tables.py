"""Making views from values, and reading and writing them as Parquet.

Nested views are arrays of structs. Column names that Parquet cannot hold twice are told apart
by a number; the order is stored in columns ``_order0``, ..., names and directions in the text
file ``_view`` beside the rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F, types as T

from rowloom.functions.schema import Meta, fields_of, mdef, mdesc, struct_of
from rowloom.plans.registry import operator
from rowloom.plans.view import View

CASTS = {T.IntegerType: int, T.LongType: int, T.FloatType: float, T.DoubleType: float, T.StringType: str}


def _meta(definition: Any) -> Meta:
    return mdesc(definition) if isinstance(definition, str) else mdef(definition)


def _cell(value: Any, kind: T.DataType) -> Any:
    """A value of the kind, or an error: integers are not cut, texts not padded."""
    if isinstance(kind, T.ArrayType):
        fields = kind.elementType.fields
        return [tuple(_cell(x, f.dataType) for x, f in zip(row, fields, strict=True)) for row in value]
    if isinstance(kind, T.BinaryType):
        return bytes(value) if not isinstance(value, str) else value.encode()
    out = CASTS[type(kind)](value)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        if isinstance(value, float) and value != out:
            raise ValueError(f"expected integer but got {value!r}")
        if not -(1 << (31 if isinstance(kind, T.IntegerType) else 63)) <= out < 1 << (31 if isinstance(kind, T.IntegerType) else 63):
            raise ValueError(f"integer too large: {value!r}")
    return out


def _from_rows(spark: SparkSession, schema: T.StructType, rows: Sequence[tuple]) -> View:
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("_o0", T.LongType()), *fields]))
    return View(df.select(*(f.name for f in fields), "_o0"), tuple(f.name for f in schema), (True,), dense=True)


def define(spark: SparkSession, definition: Any, items: Sequence[Any]) -> View:
    """A view from a flat list of items, row by row. The definition is a descriptor or a nested list."""
    schema = struct_of(_meta(definition))
    n = len(schema)
    if n == 0 and len(items) or n and len(items) % n:
        raise ValueError("item count is not a multiple of the column count")
    rows = [tuple(_cell(x, f.dataType) for x, f in zip(items[i : i + n], schema)) for i in range(0, len(items), n)] if n else []
    return _from_rows(spark, schema, rows)


def data(spark: SparkSession, definition: Any, *columns: Sequence[Any]) -> View:
    """A view from one list for each column."""
    schema = struct_of(_meta(definition))
    if len(columns) != len(schema) or len({len(c) for c in columns}) > 1:
        raise ValueError("wrong number of columns or unequal lengths")
    return _from_rows(spark, schema, [tuple(_cell(x, f.dataType) for x, f in zip(r, schema)) for r in zip(*columns)])


def asview(spark: SparkSession, items: Sequence[Any], *columns: str) -> View:
    """A list as a view; without column definitions one column A."""
    return define(spark, list(columns) or ["A"], items)


def coerce(spark: SparkSession, items: Sequence[Any], kind: str) -> View:
    """A list as one typed column; what does not fit raises."""
    return define(spark, [f"A:{kind}"], items)


def countview(spark: SparkSession, n: int) -> View:
    """n rows without columns."""
    return View(spark.range(n).select(F.col("id").alias("_o0")), (), (True,), dense=True)


def iota(spark: SparkSession, n: int, name: str = "A") -> View:
    """The integers 0..n-1."""
    return View.build(spark.range(n), [(name, F.col("id"))], [(F.col("id"), True)], dense=True)


@operator
def clone(v: View) -> View:
    """The same columns, no rows."""
    return View(v.df.limit(0), v.names, v.order, v.dense)


@operator
def freeze(v: View) -> View:
    """The view computed once, kept in the shared checkpoint folder."""
    from rowloom.plans.storage import settle

    return View(settle(v.df), v.names, v.order, v.dense)


@operator
def viewconv(v: View) -> View:
    """The view itself."""
    return v


def _stored(v: View) -> tuple[Any, list[str]]:
    stored = [f"{n}~{i}" if v.names.index(n) != i or n.lower() in [m.lower() for m in v.names[:i]] else n for i, n in enumerate(v.names)]
    return v.df.select(*(F.col(f"c{i}").alias(s) for i, s in enumerate(stored)), *(F.col(f"_o{i}").alias(f"_order{i}") for i in range(len(v.order)))), stored


@operator
def save(v: View, path: str, mode: str = "overwrite") -> int:
    """Writes the view as Parquet and returns its row count. Order columns are kept, rows are not sorted for it."""
    df, stored = _stored(v)
    df.write.mode(mode).parquet(f"{path}/rows")
    header = json.dumps({"names": v.names, "stored": stored, "order": v.order, "dense": v.dense})
    v.spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/_view")
    return v.spark.read.parquet(f"{path}/rows").count()


def load(spark: SparkSession, path: str) -> View:
    """A saved view; column pruning and filters reach the files."""
    header = json.loads(spark.read.text(f"{path}/_view").first()[0])
    df = spark.read.parquet(f"{path}/rows")
    picked = [F.col(f"`{s}`").alias(f"c{i}") for i, s in enumerate(header["stored"])] + [F.col(f"_order{i}").alias(f"_o{i}") for i in range(len(header["order"]))]
    return View(df.select(*picked), tuple(header["names"]), tuple(header["order"]), header["dense"])


def open_views(spark: SparkSession, root: str, tables: Sequence[str]) -> dict[str, View]:
    """Saved views of one folder, by name; nothing is read yet."""
    return {t: load(spark, f"{root}/{t}") for t in tables}


def read_table(spark: SparkSession, path: str, order: Sequence[str], fmt: str = "parquet", **options: str) -> View:
    """A file or folder in any of Spark's formats, ordered by the named columns."""
    return View.of(spark.read.format(fmt).options(**options).load(path), order)


@operator
def write(v: View, path: str, fmt: str = "parquet", mode: str = "overwrite", **options: str) -> int:
    """The rows in order, without the view's metadata, in any of Spark's formats; returns the row count."""
    v.sorted_frame().write.format(fmt).mode(mode).options(**options).save(path)
    return v.df.count()


@operator
def emit(v: View) -> bytes:
    """A small view as bytes: an Arrow stream of its rows in order, with its names. For views of any size use ``save``."""
    table = v.df.orderBy(*v.sort_keys()).select(*(f"c{i}" for i in range(v.width))).toArrow()
    table = table.replace_schema_metadata({"names": json.dumps(v.names), "rows": str(table.num_rows if v.width else v.df.count())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def receive(spark: SparkSession, emitted: bytes) -> View:
    """The view that ``emit`` wrote."""
    table = pa.ipc.open_stream(emitted).read_all()
    names = json.loads(table.schema.metadata[b"names"])
    if not names:
        return countview(spark, int(table.schema.metadata[b"rows"]))
    df = spark.createDataFrame(table.append_column("_o0", pa.array(range(table.num_rows), pa.int64())))
    return View(df, tuple(names), (True,), dense=True)


def same_rows(v: View, w: View) -> bool:
    """Whether a saved and loaded view is the original: columns and rows in order."""
    from rowloom.operators.sorting import compare

    return fields_of(v) == fields_of(w) and compare(v, w) == 0
