"""Near-duplicates by an inverted join of MinHash signature coordinates.

Documents with equal sets of shingles form one class and are represented by their smallest id.
Each representative is posted under its coordinate-value pairs. Two sets of similarity s agree
in each coordinate with chance s, so a pair at the threshold collides in at least ``needed``
coordinates but for a chance of a few in a thousand million; pairs below that are not retained.

* Prefix: of its pairs, ordered from the rarest to the commonest over the whole corpus, a
  document needs to be posted only under the first ``coordinates - needed + 1``: two documents
  that share ``needed`` pairs share one of these. Pairs that nobody else has are not posted.
* Skip merging: the common lists that are left are never walked; once a short list has brought
  two documents together, their collisions are counted on their signatures, over ``FINE`` more
  coordinates of two bits each, whose threshold (``matches_needed``) leaves out the same share.

Retained pairs are confirmed on the full sets, in two steps, neither of which writes all pairs of
a group. First, every document names its two closest partners in blocks of its commonest lists;
confirmed links join components. Then lists that still hold
several components are compared block by block. A pair is looked at in one of its shared lists
only, and a block hands on no pairs but the documents that take part in one: their sets are sent
to the block and counted against each other there, and it returns links that join components, at
most one for each of its documents. Links inside a component change nothing, so the components
are those of all links. A list longer than a block is split by a hash; the documents outside the
list's largest component (guests), dealt into blocks too, meet each block of it, so no task holds
more than one block and one block of guests.

Defined results: a text without words has an empty set and is its own component; with fewer
words than a shingle the whole sequence is one shingle; repeated rows and equal texts fall in
one class; a row without an id takes no part in links and is its own component (null); other
columns are not read. If one id stands on rows of different texts, a link of any of them counts
for all rows of that text. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rowloom.llm.common import WordClass, bytes_of, components, cut, grams, grown, mix, release, same, shuffle_partitions, slices, texts_of, words

#: Fixed value: bytes that end a word.
WORDS = WordClass.build([(0x20, 0x20), (0x09, 0x0D)])
COORDINATES = 96
#: Documents of one list that are compared in one block, in the first and the second step, and shingles of a block.
BLOCKS = (256, 1024)
BLOCK_SHINGLES = 2_000_000
#: Standard deviations that thresholds on collisions stand under the expected number.
DEVIATIONS = 6.0
#: Coordinates of two bits that collisions are counted on.
FINE = 1024
#: Ids of documents to read again that are broadcast, at most (8 bytes each).
BROADCAST_LIMIT = 1_000_000
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_FINE_MUL = _RNG.integers(1, 2**63, FINE, dtype=np.uint64) | np.uint64(1)
_FINE_ADD = _RNG.integers(0, 2**63, FINE, dtype=np.uint64)
_EVEN_BITS = np.uint64(0x5555555555555555)


def shingle_sets(part: pa.RecordBatch, size: int, column: int = 1) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    found = words(*bytes_of(part.column(column)), WORDS)
    g, _ = grams(found.hash, found.doc, size)
    ends = np.searchsorted(found.doc, np.arange(part.num_rows + 1))
    out = []
    for a, b in zip(ends, ends[1:]):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        else:
            out.append(grams(found.hash[a:b], found.doc[a:b], b - a)[0] if b > a else np.empty(0, np.uint64))
    return out


def _least(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray, piece: int) -> np.ndarray:
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(shingles), piece):
        np.minimum(out, ((shingles[lo : lo + piece, None] * mul + add) >> np.uint64(32)).astype(np.uint32).min(0), out=out)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    return _least(shingles, _MUL, _ADD, 512)


def fine_signature(shingles: np.ndarray) -> np.ndarray:
    """Two bits of each of FINE further coordinates, four to a byte."""
    low = (_least(shingles, _FINE_MUL, _FINE_ADD, 64) & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
    return low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6


def _least_count(n: int, p: float) -> int:
    return max(1, floor(n * p - DEVIATIONS * sqrt(n * p * (1 - p))))


def coordinates_needed(s: float) -> int:
    """Coordinates of the signature that agree at similarity s, less what chance takes off a few times in a thousand million."""
    return _least_count(COORDINATES, s)


def matches_needed(s: float) -> int:
    """The same for the coordinates of two bits, which also agree by chance."""
    return _least_count(FINE, s + (1 - s) / 4)


def sketch(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (128 bits that name the set), sig (the signature's coordinates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part, size)
                f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def post(reps: DataFrame) -> DataFrame:
    """(rep, key): a posting for each coordinate-value pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            key = (sig.astype(np.uint64) << np.uint64(16)) | np.arange(COORDINATES, dtype=np.uint64)
            for lo in range(0, len(sig), 2000):
                part = key[lo : lo + 2000]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)).take(pa.array(np.repeat(np.arange(len(part)), COORDINATES))), pa.array(part.ravel().view(np.int64))], names=["rep", "key"])

    return reps.select("rep", "sig").mapInArrow(run, "rep long, key long")


def prefixes(postings: DataFrame, needed: int) -> DataFrame:
    """(rep, key, left): the postings that can bring a pair together, left of which each document has after this one.

    Pairs that occur once come first in every document's order and are dropped, so of its m other
    postings a document keeps all but the last needed - 1. Lengths of lists are counted before the
    shuffle and joined, so that no list has to be in one task.
    """
    lengths = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    by = Window.partitionBy("rep")
    ranked = postings.join(lengths, "key").withColumn("m", F.count(F.lit(1)).over(by)).filter(F.col("m") >= needed)
    return ranked.withColumn("r", F.row_number().over(by.orderBy("n", "key"))).withColumn("left", F.col("m") - needed + 1 - F.col("r")).filter("left >= 0").select("rep", "key", "left")


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Whole groups from a sorted partition, some thousand rows or ``size`` bytes at a time; the first two columns name the group."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table.num_rows < rows and table.nbytes < size:
            held = table
            continue
        key, block = table.column(0).to_numpy(), table.column(1).to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))
        if not len(change):
            held = table
            continue
        n = int(change[-1]) + 1
        yield table.slice(0, n).combine_chunks()
        held = table.slice(n)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _packed(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, FINE // 32)


def _collisions(sig: np.ndarray, i: np.ndarray, j: np.ndarray, piece: int = 20_000) -> np.ndarray:
    out = [np.empty(0, np.int64)]
    for lo in range(0, len(i), piece):
        x = sig[i[lo : lo + piece]] ^ sig[j[lo : lo + piece]]
        out.append(FINE - np.bitwise_count((x | x >> np.uint64(1)) & _EVEN_BITS).sum(1, dtype=np.int64))
    return np.concatenate(out)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def closest_pairs(lists: DataFrame, needed: int, per_document: int) -> DataFrame:
    """(a, b): in each block of a list every document with its closest partners in other components, and the first of the block, if they collide often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            key, block, rep, sig, comp = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy(), _packed(table.column(3)), table.column(4).to_numpy()
            n = len(key)
            group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            first = np.searchsorted(group, group)
            best = np.full((n, per_document), -1, np.int64)  # collisions * n + partner
            for d in range(1, int(np.bincount(group).max())):
                inside = group[:-d] == group[d:]
                if not inside.any():
                    break
                i = np.flatnonzero(inside & (comp[:-d] != comp[d:]))
                c = _collisions(sig, i, i + d)
                ok = c >= needed
                i, c = i[ok], c[ok]
                for x, y in ((i, i + d), (i + d, i)):
                    value = c * n + y
                    for slot in range(per_document):
                        old = best[x, slot]
                        best[x, slot] = np.maximum(old, value)
                        value = np.minimum(old, value)
            x, slot = np.nonzero(best >= 0)
            y = best[x, slot] % n
            h = np.flatnonzero(comp[first] != comp)
            h = h[_collisions(sig, h, first[h]) >= needed]
            yield _pair_batch(np.r_[rep[x], rep[h]], np.r_[rep[y], rep[first[h]]])

    return lists.mapInArrow(run, "a long, b long").distinct()


#: Parts that a document has in a block: at home there, in the list's largest component or not (both also with further blocks of guests), or as a guest.
HOME, OUTSIDE, AGAIN, GUEST = 0, 1, 2, 4


def _shared_least(keys: pa.ChunkedArray) -> np.ndarray:
    """A row for each document, a hash at the coordinate of each of its keys, 0 at others."""
    lists = keys.combine_chunks()
    flat, ends = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), COORDINATES), np.uint32)
    out[np.repeat(np.arange(len(lists)), ends), (flat & np.uint64(0xFFFF)).astype(np.int64)] = (mix(flat) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def partners(visits: DataFrame, needed: int) -> DataFrame:
    """(key, block, rep): the documents of a block that have a partner there: in another component, with enough collisions, and with no shared list of a smaller hash.

    visits: key, block, rep, sig, component, part, keys (the lists that the document visits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            key, block, rep, sig = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy(), _packed(table.column(3))
            comp, part, lists = table.column(4).to_numpy(), table.column(5).to_numpy(), _shared_least(table.column(6))
            own = (mix(key.view(np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            taken = np.zeros(len(key), bool)
            for d in range(1, int(np.bincount(group).max())):
                inside = group[:-d] == group[d:]
                if not inside.any():
                    break
                i = np.flatnonzero(inside & (comp[:-d] != comp[d:]))
                p, q = part[i], part[i + d]
                home, rep_home, rep_guest = np.where(q == GUEST, p, q), np.where(q == GUEST, rep[i], rep[i + d]), np.where(q == GUEST, rep[i + d], rep[i])
                i = i[(p < AGAIN) & (q < AGAIN) | ((p == GUEST) != (q == GUEST)) & ((home & 1 == 0) | (rep_home < rep_guest))]
                i = i[_collisions(sig, i, i + d) >= needed]
                for lo in range(0, len(i), 20_000):
                    x = i[lo : lo + 20_000]
                    a, b = lists[x], lists[x + d]
                    x = x[np.where((a == b) & (a > 0), a, np.uint32(0xFFFFFFFF)).min(1) == own[x]]
                    taken[x] = taken[x + d] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[taken]) for x in (key, block, rep)], names=["key", "block", "rep"])

    return visits.mapInArrow(run, "key long, block long, rep long").distinct()


def _common(s: np.ndarray, t: np.ndarray) -> int:
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def common_counts(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """The sizes of the intersections of all sets with each other: products of 0-1 matrices, ``width`` shared elements at a time."""
    sizes = [len(s) for s in sets]
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count > 1
    at = np.cumsum(shared) - 1
    keep = shared[of]
    column, owner = at[of[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        piece = np.zeros((len(sets), width), np.float32)
        piece[owner[a:b], column[a:b] - lo] = 1
        out += piece @ piece.T
    return out


def joining_links(sets: list[np.ndarray], component: np.ndarray, numerator: int, denominator: int, few: int = 6) -> list[tuple[int, int]]:
    """Pairs of sets, similar enough, that join the components which all such pairs join; at most one less than there are components."""
    n, of, out = len(sets), component.copy(), []
    size = np.array([len(s) for s in sets], np.int64)
    enough = lambda common, i, j: denominator * common >= numerator * (size[i] + size[j] - common)
    counts = common_counts(sets) if n > few else None
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(of[j] != of[i]) & (denominator * np.minimum(size[i], size[j]) >= numerator * np.maximum(size[i], size[j]))]
        if counts is not None:
            j = j[enough(counts[i, j], i, j)]
        for k in j:
            if of[k] != of[i] and (counts is not None or enough(_common(sets[i], sets[k]), i, k)):
                out.append((i, int(k)))
                of[of == of[k]] = of[i]
    return out


def block_links(taking_part: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(a, b): confirmed links that join the components of each block, counted on full sets. taking_part: key, block, rep, component, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            key, block, rep, comp = (table.column(i).to_numpy() for i in range(4))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(4)]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(key)]
            found = [(a + i, a + j) for a, b in zip(cuts, cuts[1:]) for i, j in joining_links(sets[a:b], comp[a:b], numerator, denominator)]
            x, y = np.array(found, np.int64).reshape(-1, 2).T
            yield _pair_batch(rep[x], rep[y])

    return taking_part.mapInArrow(run, "a long, b long").distinct()


def _blocks(lists: DataFrame, size: int, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Adds blocks and block: each list is dealt by a hash into blocks of about ``size`` documents and ``shingles`` shingles."""
    lengths = lists.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.ceil(F.sum("n_shingles") / shingles)).alias("blocks"))
    return lists.join(lengths, "key").withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")))


def open_blocks(known: DataFrame, size: int) -> DataFrame:
    """(rep, key, component, block, part): the blocks of lists that hold several components, with guests. known: rep, key, n_shingles, component."""
    sizes = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks_of = lambda n, s: F.greatest(F.ceil(n / size), F.ceil(s / BLOCK_SHINGLES), F.lit(1))
    lists = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all_n"), F.sum("s").alias("all_s"),
        F.max(F.struct("n", "component", "s")).alias("most"),
    ).filter("kinds > 1")
    lists = lists.select("key", "largest", blocks_of(F.col("all_n"), F.col("all_s")).alias("blocks"), blocks_of(F.col("all_n") - F.col("most.n"), F.col("all_s") - F.col("most.s")).alias("guest_blocks"))
    rows = known.join(lists, "key").withColumn("home", F.pmod(F.xxhash64("rep", "key"), F.col("blocks"))).withColumn("outside", (F.col("component") != F.col("largest")).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    at_home = rows.withColumn("turn", each(F.when(F.col("blocks") > 1, F.col("guest_blocks")).otherwise(F.lit(1).cast("long"))))
    at_home = at_home.withColumn("block", F.col("home") * F.col("guest_blocks") + F.col("turn")).withColumn("part", F.col("outside") + F.when(F.col("turn") > 0, AGAIN).otherwise(0))
    guests = rows.filter("blocks > 1 and outside = 1").withColumn("turn", F.pmod(F.xxhash64("key", "rep"), F.col("guest_blocks"))).withColumn("of", each(F.col("blocks")))
    guests = guests.withColumn("block", F.col("of") * F.col("guest_blocks") + F.col("turn")).withColumn("part", F.lit(GUEST))
    return at_home.select("rep", "key", "component", "block", "part").union(guests.select("rep", "key", "component", "block", "part"))


def _dealt(lists: DataFrame, *columns: str) -> DataFrame:
    return lists.select("key", "block", *columns).repartition(shuffle_partitions(lists), "key", "block").sortWithinPartitions("key", "block", "rep")


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs with denominator * |intersection| >= numerator * |union|, counted on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if denominator * min(len(s), len(t)) < numerator * max(len(s), len(t)):
                    keep.append(False)
                    continue
                common = _common(s, t)
                keep.append(denominator * common >= numerator * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles, sig) of the wanted documents; their ids are broadcast only if they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([fine_signature(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles", "sig"])

    few = wanted.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT
    return docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles binary, sig binary")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest id it is linked with, itself included), kept."""
    s = numerator / denominator
    sketches = cut(sketch(documents, size, id_col, text_col))
    named = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")))
    lists = prefixes(post(classes), coordinates_needed(s))
    lists = cut(lists.join(classes.select("rep", "n_shingles"), "rep"))
    release(documents.sparkSession)
    wanted = cut(lists.select("rep").distinct())
    sets = cut(_sets(texts_of(documents, id_col, text_col), wanted.withColumnRenamed("rep", "doc_id"), size))
    packed = sets.select(F.col("doc_id").alias("rep"), "sig")
    enough = matches_needed(s)

    commonest = _blocks(lists.filter("left < 6"), BLOCKS[0])
    near = closest_pairs(_dealt(commonest.join(packed, "rep").withColumn("component", F.col("rep")), "rep", "sig", "component"), enough, 2)
    found = components(cut(confirm(near, sets, numerator, denominator)))
    release(documents.sparkSession)

    def with_components(rows: DataFrame) -> DataFrame:
        return rows.join(found, rows["rep"] == found["node"], "left").withColumn("component", F.coalesce("component", "rep")).drop("node")

    visits = cut(open_blocks(with_components(lists.select("rep", "key", "n_shingles")), BLOCKS[1]))
    keys = visits.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    taking_part = partners(_dealt(visits.join(packed, "rep").join(keys, "rep"), "rep", "sig", "component", "part", "keys"), enough)
    of_sets = sets.select(F.col("doc_id").alias("rep"), "shingles")
    last = cut(block_links(_dealt(with_components(taking_part).join(of_sets, "rep"), "rep", "component", "shingles"), numerator, denominator))
    release(documents.sparkSession)
    joined = grown(found, last)

    class_of = classes.select("f1", "f2", "n_shingles", "rep")
    class_of = class_of.join(joined, class_of["rep"] == joined["node"], "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = sketches.join(class_of, same(sketches, class_of, "f1", "f2", "n_shingles"), "left")
    of = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce(class_of["component"], sketches["doc_id"]))
    return out.select("doc_id", sketches["n_shingles"], of.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The rows, with all their columns, of one document of each component; rows that repeat a kept id stay with it."""
    kept = near_duplicates(documents, **options).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return documents.join(kept, documents["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
