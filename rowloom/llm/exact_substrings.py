"""Exact substring dedup: bytes covered by strings of ``span`` bytes that also start in an earlier document.

A shared string may lie in any two documents, so suffixes are brought together before they are
sorted. Every window of span bytes is named by the least hash of the k-grams in it; neighbouring
windows of one name form a piece of text. Equal windows have equal names, so:

1. ``names``: each document's names are joined over the corpus; those of one document only drop out.
2. ``pieces``: the texts of the pieces whose name is shared go to the task of their name.
3. ``sorted_pieces``: a task concatenates the different pieces of many names, sorts their suffixes in
   two stages (see ``suffix``), computes adjacent common prefixes, and in each run of suffixes
   that share span bytes marks those of later documents.
4. Marks go back to the documents, where they are joined to spans.

Hot groups: equal texts are one text to begin with; names and pieces that repeat within a batch
of documents are sent once; a name of more than ``HOT`` documents is dealt by a hash of the piece's text into parts, a
name with more pieces than fit a block is sorted block by block, and the windows that are left
(one for each different string and part or block) are compared in one more step. So a task holds
a block at a time and no name is left to one task, whatever is common.

Defined results: a null text is empty; a row without an id has no earlier document and is none,
so nothing is removed from it; rows of one id are one document, none earlier than the other, and
equal rows give equal results; texts shorter than span keep all; an empty table gives no rows;
other columns are not read. Strings are judged on the input and never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import BYTE_HASH, STEP, _slide, bytes_of, cut, release, shuffle_partitions, slices, texts_of
from rowloom.llm.suffix import common_prefixes, sort_suffixes

SPAN, GRAM = 50, 16
#: Windows in a piece at most; bytes of text whose names are merged; bytes of pieces sorted at once.
PIECE, BATCH_BYTES, BLOCK_BYTES = 64, 8 << 20, 2 << 20
#: Documents whose pieces of one name go to one part of that name (64 bytes a piece: two blocks).
HOT = 2 * BLOCK_BYTES // 64
#: Copies, and hot names, that are broadcast, at most (about 50 bytes each).
BROADCAST_LIMIT = 500_000
_AT = 31  # positions take 31 bits, all that a Spark value can hold; above them 32 bits of the text's hash tell texts of one id apart


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag (bits of the text's hash, at their place in a position), text."""
    tag = F.shiftleft(F.xxhash64("text").bitwiseAND(F.lit((1 << 63 - _AT) - 1).cast("long")), _AT)
    return texts_of(docs, id_col, text_col).select("doc_id", tag.alias("tag"), "text")


def dealt_texts(texts: DataFrame) -> DataFrame:
    """The rows with an id, dealt by it: joins by id then move only their other side."""
    return texts.filter("doc_id is not null").repartition(shuffle_partitions(texts), "doc_id")


def copies(texts: DataFrame) -> DataFrame:
    """(copy_id, sources: array of tag and rep): the texts of an id that also stand under a smaller id, the smallest of which is rep.

    Computed once. The result is marked to be broadcast only if a count shows that it is small.
    """
    sums = texts.filter("doc_id is not null").select("doc_id", "tag", F.sha2("text", 256).alias("sum"))
    first = sums.groupBy("sum").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).filter("rep < most").select("sum", "rep")
    found = cut(sums.join(first, "sum").filter("doc_id > rep").groupBy(F.col("doc_id").alias("copy_id")).agg(F.collect_set(F.struct("tag", "rep")).alias("sources")))
    few = found.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT
    return found.hint("broadcast" if few else "shuffle_hash")


def with_source(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds rep: the smallest id of the same text if that is smaller than the row's id, else null."""
    rep = F.get(F.filter("sources", lambda s: s["tag"] == F.col("tag")), F.lit(0))["rep"]
    return texts.join(repeated, texts["doc_id"] == repeated["copy_id"], "left").select("doc_id", "tag", "text", rep.alias("rep"))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k bytes from each position on (k a power of two)."""
    h, power, size = BYTE_HASH[data], int(STEP), 1
    while size < k:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % 2**64, 2 * size
    h ^= h >> np.uint64(29)
    h *= STEP
    return h


def runs(data: np.ndarray, offsets: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of some texts: the text of each, its first window's place in data, its number of windows, its name."""
    n = len(data) - span + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    least = _slide(gram_hashes(data, k), span - k + 1, np.minimum)
    ok = np.ones(n, bool)
    for end in offsets[1:-1]:
        ok[max(0, end - span + 1) : end] = False
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
    if len(start) and int((stop - start).max()) > PIECE:
        many = -(-(stop - start) // PIECE)
        part = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        last = np.repeat(stop, many)
        start = np.repeat(start, many) + part * PIECE
        stop = np.minimum(start + PIECE, last)
    return np.searchsorted(offsets, start, "right") - 1, start, stop - start, least[start]


def _merge(fp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, fp))
    fp, doc = fp[order], doc[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
    return fp[new], doc[new]


def names(texts: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(name, doc, kind): 0 asks whether other documents have the name, 1 knows that they do, 2 or more only says that the document, and as many documents in all, have it.

    find gives the texts and the names found in some texts. Within a batch of texts a name of
    several documents is sent twice only, for the smallest and the largest of them; all of them
    know already.
    """

    def pack(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        fp, doc = _merge(*(np.concatenate(x) for x in zip(*found)))
        first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(fp)])
        kind = np.repeat((size > 1).astype(np.int32), size)
        ends = np.r_[first[size > 1], (first + size - 1)[size > 1]]
        says = np.r_[size[size > 1], np.full(len(ends) // 2, 2)].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.r_[fp, fp[ends]].view(np.int64)), pa.array(np.r_[doc, doc[ends]]), pa.array(np.r_[kind, says])], names=["name", "doc", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, limit=1 << 17):
                data, offsets = bytes_of(part.column(1))
                text, fp = find(data, offsets)
                held.append((fp, part.column(0).to_numpy()[text]))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return texts.select("doc_id", "text").mapInArrow(run, "name long, doc long, kind int")


def shared_names(found: DataFrame, hot: int) -> DataFrame:
    """(doc, name, parts): every name that stands in more than one document; and once without a document, with parts, each name of more than ``hot`` documents."""

    def rows(doc: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name), pa.nulls(len(doc), pa.int32())], names=["doc", "name", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of a name that one document has, so far
        shared = None  # the last name, if it is known to be shared
        large: list[tuple[int, int]] = []
        last_name, weight = None, 0  # the last name and the documents that have it, so far

        def weigh(fp: np.ndarray, kind: np.ndarray) -> None:
            nonlocal last_name, weight
            first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
            sums = np.add.reduceat(np.maximum(kind, 1).astype(np.int64), first)
            if last_name is not None and fp[0] == last_name:
                sums[0] += weight
            elif weight > hot:
                large.append((int(last_name), weight))
            large.extend((int(fp[first[i]]), int(sums[i])) for i in np.flatnonzero(sums[:-1] > hot))
            last_name, weight = fp[-1], int(sums[-1])
        for batch in batches:
            fp, doc, kind = (batch.column(i).to_numpy() for i in range(3))
            know = kind == 1
            yield rows(doc[know], fp[know])
            fp, doc, kind = fp[~know], doc[~know], kind[~know]
            if len(fp):
                weigh(fp, kind)
            if held is not None:
                fp, doc, kind = np.r_[held[0], fp], np.r_[held[1], doc], np.r_[held[2], kind]
            if not len(fp):
                continue
            first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
            last = np.r_[first[1:], len(fp)] - 1
            several = doc[first] != doc[last]
            if shared is not None:
                several[0] |= fp[0] == shared
            out = np.repeat(several, last - first + 1)
            ask = out & (kind == 0)
            yield rows(doc[ask], fp[ask])
            shared = fp[-1] if several[-1] else None
            held = None if several[-1] else (fp[first[-1] : first[-1] + 1], doc[first[-1] : first[-1] + 1], kind[first[-1] :].min(keepdims=True))
        if weight > hot:
            large.append((int(last_name), weight))
        if large:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(large), pa.int64()), pa.array([n for n, _ in large], pa.int64()), pa.array([-(-w // hot) for _, w in large], pa.int32())], names=["doc", "name", "parts"])

    dealt = found.repartition(shuffle_partitions(found), F.when(F.col("kind") == 1, F.xxhash64("doc")).otherwise(F.col("name")))
    return dealt.sortWithinPartitions("name", "doc").mapInArrow(run, "doc long, name long, parts int")


def shared_lists(texts: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(named, names): for each document its names that other documents have, too. Computed once; the lineage is cut."""
    return lists_and_hot(texts, find)[0]


def lists_and_hot(texts: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same, and (hot, parts): the names of more than ``hot`` documents, marked to be broadcast only if a count shows that they are few."""
    found = shared_names(names(texts, find), HOT if hot is None else hot)
    large = F.when(F.col("doc").isNull(), F.col("name"))  # each hot name has a row of its own
    out = cut(found.groupBy(F.col("doc").alias("named"), large.alias("hot")).agg(F.collect_list("name").alias("names"), F.max("parts").alias("parts")))
    release(texts.sparkSession)
    names_of_many = out.filter("named is null").select("hot", "parts")
    few = names_of_many.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT
    return out.filter("named is not null").select("named", "names").hint("shuffle_hash"), F.broadcast(names_of_many) if few else names_of_many


def listed(fp: np.ndarray, text: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which of the names are in their own text's list. (Two texts' names may be confused with a chance of 2**-64.)"""
    salt = lambda t: t.astype(np.uint64) * STEP
    known = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return np.isin(fp ^ salt(text), known ^ salt(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))))


PIECES = "name long, doc long, pos long, n int, text binary"


def pieces(texts: DataFrame, span: int, k: int) -> DataFrame:
    """(name, doc, pos, n, text): the pieces whose name is in the row's ``names``.

    pos is the first window with the text's tag, n the number of windows. A piece that stands in
    an earlier document of the same batch is settled: its text is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            out: list[list] = [[], [], [], [], []]
            order = pa.compute.sort_indices(batch.column(0))
            batch = batch.take(order)  # by id, so that the first holder of a piece is the earliest
            for part in slices(batch, "text", 1 << 17):
                data, offsets = bytes_of(part.column(2))
                text, start, n, fp = runs(data, offsets, span, k)
                pick = np.flatnonzero(listed(fp, text, part.column(3)))
                raw, ids, tags = data.tobytes(), part.column(0).to_numpy(), part.column(1).to_numpy()
                for i in pick.tolist():
                    a, m, t = int(start[i]), int(n[i]), int(text[i])
                    doc = int(ids[t])
                    piece = raw[a : a + m + span - 1]
                    first = seen.setdefault(piece, doc)
                    for column, x in zip(out, (int(fp[i]) - (1 << 64 if fp[i] >> np.uint64(63) else 0), doc, int(tags[t]) | (a - int(offsets[t])), m, piece if first == doc else None)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["name", "doc", "pos", "n", "text"])

    return texts.select("doc_id", "tag", "text", "names").mapInArrow(run, PIECES)


def repeated_windows(texts: list[bytes], docs: list[int], span: int) -> list[np.ndarray]:
    """For different pieces with the earliest document of each: which windows an earlier document has, too."""
    sizes = np.array([len(t) + 1 for t in texts])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    at = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(joined)) - at[owner]
    wanted = inside <= sizes[owner] - 1 - span
    order = sort_suffixes(joined, wanted, span)
    new = common_prefixes(joined, order, span) < span
    doc = np.array(docs)[owner[order]]
    least = np.minimum.reduceat(doc, np.flatnonzero(new)) if len(doc) else doc
    later = np.zeros(len(joined), bool)
    later[order] = doc > least[np.cumsum(new) - 1] if len(doc) else False
    return [later[a : a + s - span] for a, s in zip(at.tolist(), sizes.tolist())]


def stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


MARKS = "doc long, pos long, n int, win binary"


def parted(found: DataFrame, hot: DataFrame) -> DataFrame:
    """The pieces with part: of a hot name's pieces a hash of their text, so that equal ones stay together; null for the others."""
    joined = found.join(hot, found["name"] == hot["hot"], "left")
    return joined.withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")).select(*found.columns, "part")


def sorted_pieces(found: DataFrame, span: int) -> DataFrame:
    """(doc, pos, n, win): windows to remove, and (win not null) windows of names in several parts or blocks, to be compared once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]

        def put(doc: int, pos: int, n: int, win: bytes | None = None) -> None:
            for column, x in zip(out, (doc, pos, n, win)):
                column.append(x)

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc", "pos", "n", "win"])
            for column in out:
                column.clear()
            return done

        def settle(held: dict[bytes, list[tuple[int, int]]], alone: set[bytes], left_over: bool) -> None:
            """held: piece -> its holders, by document. alone: pieces whose name no other piece has."""
            todo = [t for t in held if t not in alone]
            masks = dict(zip(todo, repeated_windows(todo, [held[t][0][0] for t in todo], span))) if todo else {}
            for text, holders in held.items():
                first, mask = holders[0][0], masks.get(text)
                for doc, pos in holders:
                    if doc > first:
                        put(doc, pos, len(text) - span + 1)
                        continue
                    if mask is not None:
                        for a, m in stretches(mask):
                            put(doc, pos + a, m)
                    if left_over:
                        for i in range(len(text) - span + 1):
                            if mask is None or not mask[i]:
                                put(doc, pos + i, 1, text[i : i + span])

        held: dict[bytes, list[tuple[int, int]]] = {}
        alone: set[bytes] = set()
        size, name, mine, parted = 0, None, [], False
        for batch in batches:
            for fp, doc, pos, n, text, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if text is None:
                    put(doc, pos, n)
                    continue
                if (fp, part) != name:
                    if len(mine) == 1:
                        alone.add(mine[0])
                    if parted or part is not None or size >= BLOCK_BYTES:
                        settle(held, alone, parted)
                        held, alone, size = {}, set(), 0
                    name, mine, parted = (fp, part), [], part is not None
                elif size >= 4 * BLOCK_BYTES:  # the name goes on: its own block, with what is left of it compared later
                    settle(held, alone, True)
                    held, alone, size, parted, mine = {}, set(), 0, True, []
                holders = held.get(text)
                if holders is None:
                    held[text] = [(doc, pos)]
                    mine.append(text)
                    size += len(text)
                else:
                    holders.append((doc, pos))
                    size += 16
            if len(out[0]) >= 20_000:
                yield flush()
        if len(mine) == 1 and not parted:
            alone.add(mine[0])
        settle(held, alone, parted)
        yield flush()

    dealt = found.repartition(shuffle_partitions(found), F.when(F.col("text").isNull(), F.xxhash64("doc", "pos")).otherwise(F.when(F.col("part").isNull(), F.col("name")).otherwise(F.xxhash64("name", "part"))))
    return dealt.sortWithinPartitions("name", "part", "doc").mapInArrow(run, MARKS)


def compare_left_over(marks: DataFrame) -> DataFrame:
    """(doc, pos, n): the marks, and of equal windows left over those that an earlier document has, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, first = None, None
        for batch in batches:
            later = []
            for doc, w in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if w is not None and w != win:
                    win, first = w, doc
                later.append(w is None or doc > first)
            yield batch.select([0, 1, 2]).filter(pa.array(later, pa.bool_()))

    dealt = marks.repartition(shuffle_partitions(marks), F.when(F.col("win").isNull(), F.xxhash64("doc")).otherwise(F.xxhash64("win")))
    return dealt.sortWithinPartitions("win", "doc").mapInArrow(run, "doc long, pos long, n int")


def removed_spans(documents: DataFrame, span: int = SPAN, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, text (binary), rep (the earlier document of the same text, or null), marks (array of pos, n: windows to remove; see ``_union``)."""
    texts = keyed_texts(documents, id_col, text_col)
    repeated = copies(texts)
    own = with_source(texts.filter("doc_id is not null"), repeated).filter("rep is null")

    def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, _, _, fp = runs(data, offsets, span, k)
        return text, fp

    lists, hot = lists_and_hot(own, find)
    dealt = dealt_texts(texts)
    shared = dealt.join(lists, dealt["doc_id"] == lists["named"]).select("doc_id", "tag", "text", "names")
    marks = compare_left_over(sorted_pieces(parted(pieces(shared, span, k), hot), span))
    spans = cut(marks.groupBy(F.col("doc").alias("marked")).agg(F.collect_list(F.struct("pos", "n")).alias("marks")))
    del shared, marks
    release(documents.sparkSession)
    marked = with_source(dealt_texts(texts), repeated).join(spans.hint("shuffle_hash"), F.col("doc_id") == spans["marked"], "left").select("doc_id", "tag", "text", "rep", "marks")
    rest = texts.filter("doc_id is null").select("doc_id", "tag", "text", F.lit(None).cast("long").alias("rep"), F.lit(None).cast(marked.schema["marks"].dataType).alias("marks"))
    return marked.union(rest)


def _union(tag: int, size: int, marks: list[dict] | None, span: int, whole: bool) -> list[tuple[int, int]]:
    """Maximal covered runs of bytes of one text."""
    if whole:
        return [(0, size)] if size >= span else []
    here = sorted((m["pos"] & ((1 << _AT) - 1), m["n"]) for m in marks or () if m["pos"] >> _AT << _AT == tag)
    out: list[tuple[int, int]] = []
    for a, n in here:
        b = a + n + span - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(documents: DataFrame, span: int = SPAN, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, spans (array of first, last: bytes removed) and kept (binary).

    With ``digests`` the last two are replaced by kept_sha256, so that only a digest leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), *([pa.string()] if digests else [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary()])]
        for batch in batches:
            for part in slices(batch):
                rows = []
                for tag, raw, rep, marks in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                    spans = _union(tag, len(raw), marks, span, rep is not None)
                    ends = [0, *(x for s in spans for x in s), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                    rows.append((len(raw), len(raw) - len(kept), len(spans), *([hashlib.sha256(kept).hexdigest()] if digests else [[{"first": a, "last": b} for a, b in spans], kept])))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digests else ["spans", "kept"])])

    more = "kept_sha256 string" if digests else "spans array<struct<first:long,last:long>>, kept binary"
    return removed_spans(documents, span, k, id_col, text_col).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {more}")
