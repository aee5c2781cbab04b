"""Helpers shared by the operators: reading rows, slicing Arrow batches, hashing words."""

from __future__ import annotations

import gc
import re
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a task holds as Python or numpy objects at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): only these columns are read; a null text is empty.

    Text travels as UTF-8 bytes, so a byte sequence that is not UTF-8 cannot stop a task.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of the column, in order."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32 if col.type in (pa.binary(), pa.string()) else np.int64)[col.offset : col.offset + len(col) + 1].astype(np.int64)) if len(col) else np.empty(0, np.int64)
    lo = 0
    while lo < len(col):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column without nulls, and the n + 1 offsets of its values in them."""
    kind = np.int32 if col.type in (pa.binary(), pa.string()) else np.int64
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
GRAM_STEP = np.uint64(0xD1342543DE82EF95)


@dataclass
class WordClass:
    """Which bytes belong to words, and the byte each one counts as."""

    member: np.ndarray
    lower: np.ndarray

    @staticmethod
    def build(excluded: list[tuple[int, int]]) -> WordClass:
        lower = np.arange(256, dtype=np.uint8)
        lower[ord("A") : ord("Z") + 1] += 32
        member = np.ones(256, bool)
        for a, b in excluded:
            member[a : b + 1] = False
        return WordClass(member[lower], lower)


@dataclass
class Words:
    """Words of some texts: the text of each, its first and last-plus-one byte, its hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray  # lower-cased bytes of all texts
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def _words(low: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = cuts[(cuts > 0) & (cuts < len(w))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    size = end - start
    at = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    within = np.arange(int(size.sum())) - np.repeat(at, size)
    power = np.cumprod(np.full(int(size.max()), STEP))
    return start, end, mix(np.add.reduceat(BYTE_HASH[low[w]] * power[within], at))


def words(data: np.ndarray, offsets: np.ndarray, kind: WordClass, piece: int = 4 * SLICE_BYTES) -> Words:
    """Splits and hashes by whole-array steps. Texts longer than ``piece`` go through in pieces cut between words."""
    low, w = kind.lower[data], kind.member[data]
    parts, lo, n = [], 0, len(data)
    while lo < n:
        hi = min(n, lo + piece)
        if hi < n:  # a word that reaches over the cut stays whole
            gap = np.flatnonzero(~w[lo:hi])
            if len(gap):
                hi = lo + int(gap[-1]) + 1
            else:
                later = np.flatnonzero(~w[hi:])
                hi = hi + int(later[0]) + 1 if len(later) else n
        s, e, h = _words(low[lo:hi], w[lo:hi], offsets[(offsets > lo) & (offsets < hi)] - lo)
        parts.append((s + lo, e + lo, h))
        lo = hi
    start, end, h = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, h, low, offsets)


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each k consecutive words and whether they lie in one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g *= GRAM_STEP
        g += h[j : j + n]
    return mix(g + np.uint64(k)), doc[:n] == doc[k - 1 :]


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def winnow(g: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest hash of some window of w grams; equal minima are all kept.

    Every w consecutive valid grams hold at least one kept position. Invalid grams are never kept.
    """
    if not len(g):
        return np.empty(0, np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    x = np.concatenate([np.full(w - 1, top), np.where(valid, g, top), np.full(w - 1, top)])
    least = _slide(x, w, np.minimum)
    return np.flatnonzero((_slide(least, w, np.maximum) == g) & valid)


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the cluster's shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests) a folder of its own is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession, rounds: int = 4) -> None:
    """Lets Spark delete the shuffle files of lineage that has been cut.

    It does so once the driver's garbage is collected, which takes a few rounds: Python's handles
    go first, then the plans they held, then what these held.
    """
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def same(a: DataFrame, b: DataFrame, *columns: str) -> F.Column:
    """Equality of the named columns of two frames, nulls equal."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link the smallest node it is connected with.

    Every round points each node to its smallest neighbour, follows these pointers to their ends,
    and contracts the links to those between different ends; at most half of the nodes are ends,
    so few rounds are left and each is smaller. Nothing is gathered on the driver.
    """
    edges = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").union(links.select(F.col(b), F.col(a)).filter(f"{a} <> {b}")).distinct())
    out = None
    while True:
        ends = cut(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
        while True:
            up = ends.select(F.col("x").alias("via"), F.col("l").alias("to"))
            step = cut(ends.join(up, ends["l"] == up["via"]).select("x", F.col("to").alias("l"), (F.col("to") != F.col("l")).alias("moved")))
            ends = step.select("x", "l")
            if not step.filter("moved").limit(1).count():
                break
        if out is None:
            out = ends.select(F.col("x").alias("node"), F.col("l").alias("component"))
        else:
            out = cut(out.join(ends, out["component"] == ends["x"], "left").select("node", F.coalesce("l", "component").alias("component")))
        to = ends.select(F.col("x").alias("was"), F.col("l").alias("now"))
        half = edges.join(to, edges["x"] == to["was"]).select(F.col("now").alias("x"), "y")
        edges = cut(half.join(ends.withColumnRenamed("x", "last"), F.col("y") == F.col("last")).select("x", F.col("l").alias("y")).filter("x <> y").distinct())
        if not edges.limit(1).count():
            return out


def grown(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after more links (a, b): only links between components are gone through."""
    if found is None:
        return components(links)
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    base = cut(found.union(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))))
    of = lambda c: base.select(F.col("node").alias(f"of_{c}"), F.col("component").alias(f"to_{c}"))
    between = links.join(of("a"), F.col("a") == F.col("of_a")).join(of("b"), F.col("b") == F.col("of_b")).select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    merged = components(between).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    return cut(base.join(merged, base["component"] == merged["part"], "left").select("node", F.coalesce("whole", "component").alias("component")))
