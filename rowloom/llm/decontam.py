"""Benchmark decontamination by winnowing.

Training and test texts are cut into words; every run of ``k`` words is hashed, and of every
window of ``w`` such runs the smallest hash is kept as a fingerprint. A shared span of
``span = k + w - 1`` words or more therefore always shares a fingerprint. Fingerprints of
documents and benchmark items are joined, hits are extended to the windows of ``span`` words
around them, and windows are joined on their exact words, so that no hash decides a result.
An item of fewer words than ``span`` is one window; runs of its length are fingerprints too.

The benchmark's fingerprints and windows are broadcast only if a count shows that they are at
most ``broadcast_limit``; beyond that both joins shuffle, and give the same result.

Defined results: null or empty texts have no words, are never hit and hit nothing; repeated
document rows give repeated results; a repeated item counts once; equal texts under one id are
kept apart from other texts under it; other columns are not read; an empty benchmark hits
nothing. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rowloom.llm.common import WordClass, Words, bytes_of, cut, grams, slices, winnow, words

#: Fixed value: bytes outside 0-9, a-z (after lower-casing) and non-ASCII end a word.
WORDS = WordClass.build([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Most fingerprints and windows of a benchmark that are broadcast (16 bytes each).
BROADCAST_LIMIT = 1_000_000


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


def _probes(found: Words, k: int, w: int, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, positions, hashes): winnowed runs of k words have kind 0, runs of a short length that length."""
    g, valid = grams(found.hash, found.doc, k)
    at = winnow(g, valid, w)
    yield 0, at, g[at]
    for n in lengths:
        g, valid = grams(found.hash, found.doc, n)
        at = np.flatnonzero(valid)
        yield n, at, g[at]


def _starts(found: Words, at: np.ndarray, k: int, span: int) -> np.ndarray:
    """First words of all windows of span words, each within its text, that cover a run of k words at one of the positions."""
    near = np.unique((at[:, None] - np.arange(span - k + 1)[None, :]).ravel())
    near = near[(near >= 0) & (near + span <= len(found.doc))]
    return near[found.doc[near] == found.doc[near + span - 1]]


def _text(found: Words, at: int, n: int) -> bytes:
    return b" ".join(found.data[found.start[i] : found.end[i]].tobytes() for i in range(at, at + n))


WINDOW = "id long, key long, start long, n long, window binary"
_NAMES = ["id", "key", "start", "n", "window"]


def _emit(part: pa.RecordBatch, found: Words, starts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    first = np.searchsorted(found.doc, np.arange(part.num_rows))
    doc = np.concatenate([found.doc[s] for _, s in starts]) if starts else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([
        part.column(0).take(pa.array(doc, pa.int64())), part.column(1).take(pa.array(doc, pa.int64())),
        pa.array(np.concatenate([s - first[found.doc[s]] for _, s in starts]) if starts else doc, pa.int64()),
        pa.array([n for n, s in starts for _ in s], pa.int64()), pa.array([_text(found, int(i), n) for n, s in starts for i in s], pa.binary()),
    ], names=_NAMES)


def benchmark_windows(benchmark: DataFrame, span: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, n, items): each different window of the items, with the ids of the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = words(*bytes_of(part.column(2)), WORDS)
                counts = found.counts()
                ok = np.arange(max(0, len(found.doc) - span + 1))
                ok = ok[found.doc[ok] == found.doc[ok + span - 1]] if len(ok) else ok
                first = np.searchsorted(found.doc, np.arange(part.num_rows))
                short = [(int(counts[i]), np.array([first[i]])) for i in np.flatnonzero((counts > 0) & (counts < span))]
                yield _emit(part, found, [(span, ok), *short])

    rows = _rows(benchmark, id_col, text_col).mapInArrow(run, WINDOW)
    return rows.groupBy("window", "n").agg(F.collect_set("id").alias("items"))


def _bench_probes(windows: DataFrame, k: int, w: int, span: int) -> DataFrame:
    """(kind, h): fingerprints of the benchmark's windows, and (kind -1) the hashes of whole windows of span words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(*bytes_of(batch.column(0)), WORDS)
            n = batch.column(1).to_numpy()
            g, valid = grams(found.hash, found.doc, k)
            at = winnow(g, valid, w)
            at = at[n[found.doc[at]] == span]
            kinds, hashes = [np.zeros(len(at), np.int64)], [g[at]]
            for size in np.unique(n):
                g, valid = grams(found.hash, found.doc, int(size))
                at = np.flatnonzero(valid)
                at = at[n[found.doc[at]] == size]
                kinds.append(np.full(len(at), -1 if size == span else size, np.int64))
                hashes.append(g[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes).view(np.int64))], names=["kind", "h"])

    return windows.select("window", "n").mapInArrow(run, "kind long, h long").distinct()


def _inside(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x if len(known) else np.zeros(len(x), bool)


def contamination(documents: DataFrame, benchmark: DataFrame, k: int = 7, w: int = 7, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT, with_key: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit (words inside an occurrence of a window), items (ids whose windows occur, sorted as strings). with_key adds the hash of the text."""
    span = k + w - 1
    docs = _rows(documents, id_col, text_col)
    windows = benchmark_windows(benchmark, span, item_id_col, item_text_col)
    probes = _bench_probes(windows, k, w, span)
    few = probes.limit(broadcast_limit + 1).count() <= broadcast_limit
    lengths = sorted(r[0] for r in probes.filter("kind > 0").select("kind").distinct().collect())  # below span
    if few:
        known = documents.sparkSession.sparkContext.broadcast({kind: np.sort(x["h"].to_numpy().astype(np.int64).view(np.uint64)) for kind, x in probes.toPandas().groupby("kind")})
        none = np.empty(0, np.uint64)

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    found = words(*bytes_of(part.column(2)), WORDS)
                    starts = []
                    for kind, at, h in _probes(found, k, w, lengths):
                        at = at[_inside(h, known.value.get(kind, none))]
                        if kind == 0 and len(at):
                            at = _starts(found, at, k, span)
                            g, _ = grams(found.hash, found.doc, span)
                            at = at[_inside(g[at], known.value.get(-1, none))]
                        if len(at):
                            starts.append((kind or span, at))
                    yield _emit(part, found, starts)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(part.num_rows, -1)), pa.array(found.counts().astype(np.int64)), pa.nulls(part.num_rows, pa.binary())], names=_NAMES)

        rows = docs.mapInArrow(hits, WINDOW).join(F.broadcast(windows), ["window", "n"], "left")
        rows = rows.filter("start < 0 or items is not null")
    else:
        rows = _shuffled(docs, windows, probes, k, w, span, lengths)
    return _summary(rows, with_key)


def _shuffled(docs: DataFrame, windows: DataFrame, probes: DataFrame, k: int, w: int, span: int, lengths: list[int]) -> DataFrame:
    """The same rows for a benchmark of any size: fingerprints join by shuffle, and texts with hits are read again."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = words(*bytes_of(part.column(2)), WORDS)
                first = np.searchsorted(found.doc, np.arange(part.num_rows))
                for kind, at, h in _probes(found, k, w, lengths):
                    doc = pa.array(found.doc[at], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(at - first[found.doc[at]], pa.int64()), pa.array(np.full(len(at), kind)), pa.array(h.view(np.int64))], names=["id", "key", "start", "kind", "h"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(part.num_rows, -1)), pa.array(found.counts().astype(np.int64)), pa.nulls(part.num_rows, pa.int64())], names=["id", "key", "start", "kind", "h"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = words(*bytes_of(part.column(2)), WORDS)
                first = np.searchsorted(found.doc, np.arange(part.num_rows))
                at: dict[int, list[int]] = {}
                for i, hit in enumerate(part.column(3).to_pylist()):
                    for x in hit:
                        at.setdefault(x["kind"], []).append(x["start"] + int(first[i]))
                yield _emit(part, found, [(kind or span, _starts(found, np.array(v), k, span) if kind == 0 else np.unique(v)) for kind, v in at.items()])

    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])
    marks = docs.mapInArrow(fingerprints, "id long, key long, start long, kind long, h long")
    base = marks.filter("start < 0").select("id", "key", "start", F.col("kind").alias("n"), F.lit(None).cast("binary").alias("window"), F.lit(None).cast("array<long>").alias("items"))
    hits = marks.filter("start >= 0").join(probes, ["kind", "h"], "left_semi").groupBy("id", "key").agg(F.collect_set(F.struct("kind", "start")).alias("hits"))
    texts = docs.dropDuplicates(["id", "key"])
    found = texts.join(hits, same(texts, hits)).select(texts["id"], texts["key"], texts["text"], hits["hits"]).mapInArrow(extend, WINDOW)
    return found.join(windows, ["window", "n"]).select("id", "key", "start", "n", "window", "items").unionByName(base)


def keep_clean(documents: DataFrame, benchmark: DataFrame, limit: int = 1_000_000, **options) -> DataFrame:
    """The rows, with all their columns, that are not contaminated. The rows to drop are broadcast only if a count shows that they are at most ``limit``."""
    found = contamination(documents, benchmark, with_key=True, **options)
    bad = cut(found.filter(is_contaminated()).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct())
    few = bad.limit(limit + 1).count() <= limit
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    at = documents[id_col].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce(documents[text_col], F.lit(""))) == bad["bad_key"])
    return documents.join(F.broadcast(bad) if few else bad, at, "left_anti")


def is_contaminated() -> F.Column:
    """A twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _summary(rows: DataFrame, with_key: bool = False) -> DataFrame:
    """Lengths of the union of the windows in each text, in one shuffle by text. Repeated rows are merged before it and told out again at the end."""
    rows = rows.groupBy("id", "key", "start", "n").agg(F.any_value("items").alias("items"), F.count(F.lit(1)).alias("copies"))
    by = Window.partitionBy("id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    is_hit = F.col("start") >= 0
    reach = F.coalesce(F.max(F.when(is_hit, end)).over(by), F.lit(0))
    per = rows.withColumn("fresh", F.when(is_hit, F.greatest(F.lit(0), end - F.greatest("start", reach))).otherwise(F.lit(0)))
    out = per.groupBy("id", "key").agg(
        F.max(F.when(~is_hit, F.col("n"))).alias("n_words"), F.max(F.when(~is_hit, F.col("copies"))).alias("copies"), F.sum("fresh").alias("n_hit"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("items"),
    )
    piece = 10_000  # numbers of copies are told out in two steps, so that no array is long
    out = out.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / piece))))
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(piece), F.col("copies") - F.col("of") * piece).cast("int"))))
    return out.select(F.col("id").alias("doc_id"), *["key"] * with_key, "n_words", "n_hit", "items")


def judged(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a twentieth of the words is hit."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))
