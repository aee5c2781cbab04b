"""Directory trees stored as a table: dirs[name, parent, files[name, size, date, contents]].

Directories point to their parent by row position (-1: the root). Paths come from a join
repeated once for each level of the tree; contents shorter than the size are inflated.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from rowloom.plans.registry import operator
from rowloom.plans.storage import settle
from rowloom.plans.view import View


@F.pandas_udf(T.BinaryType())
def inflate(contents: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([x if x is None or len(x) == n else zlib.decompress(x) for x, n in zip(contents, size)])


@operator
def directories(dirs: View) -> DataFrame:
    """(dir, path) for each directory; those whose parents form a loop are left out."""
    w = dirs.numbered()
    rows = settle(w.df.select(w.rid().alias("dir"), w.col("name").alias("name"), w.col("parent").cast("long").alias("parent")))
    level = rows.filter("parent < 0").select("dir", F.col("name").alias("path"))
    found = level
    while level.limit(1).count():
        up = level.select(F.col("dir").alias("_up"), F.col("path").alias("_path"))
        level = settle(rows.join(up, F.col("parent") == F.col("_up")).select("dir", F.when(F.col("_path") == "", F.col("name")).otherwise(F.concat_ws("/", "_path", "name")).alias("path")))
        found = found.union(level)
    return found


@operator
def files(dirs: View) -> DataFrame:
    """(path, size, date, contents) of all files, contents inflated."""
    w = dirs.numbered()
    each = w.df.select(w.rid().alias("dir"), F.explode(w.col("files")).alias("f")).select("dir", "f.*")
    path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
    return each.join(directories(w), "dir").select(path.alias("path"), "size", "date", inflate("contents", "size").alias("contents"))


def tree(found: DataFrame) -> View:
    """The table of a tree from (path, size, date, contents); directories are numbered by path, the root first."""
    spark = found.sparkSession
    parent = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))
    rows = found.withColumn("dir", parent(F.col("path"))).withColumn("name", F.substring_index("path", "/", -1))
    parts = F.split("dir", "/")
    all_dirs = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))).alias("d")).union(spark.createDataFrame([("",)], "d string")).distinct()
    named = View.of(all_dirs, ["d"]).numbered()
    numbers = named.df.select(F.col("c0").alias("d"), F.col("_o0").alias("n"))
    up = numbers.select(F.col("d").alias("_d"), F.col("n").alias("_n"))
    nest = rows.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("name", F.col("size").cast("int").alias("size"), F.col("date").cast("int").alias("date"), "contents"))).alias("files"))
    out = numbers.join(up, F.when(F.col("d") != "", parent(F.col("d"))) == F.col("_d"), "left").join(nest, F.col("d") == F.col("dir"), "left")
    empty = F.array().cast(nest.schema["files"].dataType)
    return View.build(out, [("name", F.substring_index("d", "/", -1)), ("parent", F.coalesce("_n", F.lit(-1)).cast("int")), ("files", F.coalesce("files", empty))], [(F.col("n"), True)], dense=True)
