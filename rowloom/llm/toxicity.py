"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy inside Spark tasks.

A word is embedded as the sum of the rows of one hashed table for the word itself, for its
first four and five characters and for its last four. Filters of several widths run over the
words of a text; each filter's largest value goes into a logistic layer. All parameters start
at random numbers and are trained in mini-batches by gradient steps of adaptive size, which
reach only the words that a maximum came from.

The raw score is calibrated by language: on rows left out of the training, the threshold
between the classes is set for each language that the text itself looks like (its function
words are counted; a language column is never read), and the score is shifted so that 0.5 is
that threshold.

Every labelled row is learnt from, whatever its length: rows are dealt to parts, each part goes
through its rows from the common model on, and the parts' models are averaged (see ``fit``). Of
them, a fifth by hash is kept for the calibration. Repeated rows are learnt from once.

Defined results: a null or empty text has no words and gets the score of no evidence; texts
are scored whole, whatever their length; repeated rows get equal scores, but for last digits; a label whose id is
in no document, or that is null, is not learnt from; with no labels of one kind all texts get
the share of positive labels (0 without labels); other columns are not read.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import STEP, BYTE_HASH, WordClass, bytes_of, cut, mix, release, slices, texts_of, words

#: Labelled rows for which there is a second part (parts grow as the root of the rows, so that the models sent about grow less than the rows); rounds after which the models of several parts are averaged.
PART_ROWS, ROUNDS = 6000, 6
#: Numbers are added up in units of 2**-36, so that their order does not matter; the bins of a logit, by which thresholds are set.
UNIT, BINS = 2.0**36, 64
#: Labels that are broadcast, at most (12 bytes each).
BROADCAST_LIMIT = 500_000
#: Words that are multiplied at once.
BLOCK = 1024
BITS, DIM, FILTERS, WIDTHS = 18, 12, 12, (1, 2, 3)
WORDS = WordClass.build([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with be at this have from or",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les de des et un une du en est que qui dans pour pas au sur par avec",
    "es": "el la los las de que y en un una por con no se del para es al lo como",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    power = np.cumprod(np.full(len(raw), STEP))
    return mix(np.array([(BYTE_HASH[raw] * power).sum()], np.uint64))[0]


_LANG_HASH = {lang: np.sort(np.array([word_hash(w) for w in ws.split()], np.uint64)) for lang, ws in FUNCTION_WORDS.items()}


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words of some texts: the text of each, its four rows of the table; for each text its language's number."""
    found = words(data, offsets, WORDS)
    n, size = len(offsets) - 1, found.end - found.start
    padded = np.concatenate([found.data, np.zeros(8, np.uint8)])
    ids = np.empty((len(size), 4), np.int32)
    mask = np.uint64((1 << BITS) - 1)
    ids[:, 0] = found.hash & mask
    for column, (at, width, salt) in enumerate([(found.start, 4, 1), (found.start, 5, 2), (np.maximum(found.end - 4, 0), 4, 3)], 1):
        h = np.full(len(size), salt, np.uint64)
        for j in range(width):
            byte = padded[at + j].astype(np.uint64)
            byte[(at + j >= found.end) | (at + j < found.start)] = 0
            h = h * np.uint64(257) + byte
        ids[:, column] = mix(h * STEP) & mask
    hits = np.zeros((n, len(LANGUAGES)))
    for i, lang in enumerate(FUNCTION_WORDS):
        known = _LANG_HASH[lang]
        at = np.minimum(np.searchsorted(known, found.hash), len(known) - 1)
        hits[:, i] = np.bincount(found.doc[known[at] == found.hash], minlength=n)
    hits[:, -1] = 0.5  # no function word at all
    return found.doc, ids, hits.argmax(1)


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    constant: float | None = None

    def pooled(self, doc: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, filters) largest rectified value of each filter in each text, and where it came from (-1: nowhere)."""
        best = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        where = np.full(best.shape, -1, np.int64)
        if not len(doc):
            return best, where
        # Products of one shape: those of other sizes are added up in other orders.
        x = np.zeros((-(-len(doc) // BLOCK) * BLOCK, DIM), np.float32)
        x[: len(doc)] = sum(self.table[ids[:, c]] for c in range(ids.shape[1]))
        x = x.reshape(-1, BLOCK, DIM)
        for i, width in enumerate(WIDTHS):
            m = len(doc) - width + 1
            if m <= 0:
                continue
            y = sum((x @ self.kernels[i][j]).reshape(-1, FILTERS)[j : j + m] for j in range(width)) + self.biases[i]
            ok = doc[:m] == doc[width - 1 :]
            if width > 1:
                y[~ok] = 0
            y = np.maximum(y, 0)
            first = np.flatnonzero(np.r_[True, doc[1:m] != doc[: m - 1]])
            top = np.maximum.reduceat(y, first, axis=0)
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            best[doc[first], cols] = top
            hit = (y == np.repeat(top, np.diff(np.r_[first, m]), axis=0)) & (y > 0)
            r, c = np.nonzero(hit)
            where[doc[r], c + i * FILTERS] = r
        return best, where

    def pooled_by_pieces(self, doc: np.ndarray, ids: np.ndarray, n: int, piece: int = 60_000) -> tuple[np.ndarray, np.ndarray]:
        """The same; words are taken in overlapping pieces, so that memory does not grow with the texts."""
        best = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        where = np.full(best.shape, -1, np.int64)
        for lo in range(0, len(doc), piece):
            hi = min(len(doc), lo + piece + max(WIDTHS) - 1)
            d0 = doc[lo]
            part, at = self.pooled(doc[lo:hi] - d0, ids[lo:hi], int(doc[hi - 1] - d0) + 1)
            rows = slice(d0, d0 + len(part))
            more = part > best[rows]
            where[rows][more] = at[more] + lo
            best[rows][more] = part[more]
        return best, where

    def logits(self, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Sums of one order, so that equal texts get equal logits in almost all batches (in a trial of 400, 3 differed in the last digits)."""
        return (self.pooled_by_pieces(doc, ids, n)[0].astype(np.float64) * self.out).sum(1) + self.out_bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        doc, ids, lang = features(data, offsets)
        # Rounded, as last digits depend on the size of the batch.
        z = np.round(self.logits(doc, ids, n).astype(np.float64), 4) - self.shift[lang]
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 12)


@dataclass
class Steps:
    """Gradient steps, each divided by the root of the sum of squares so far of its parameter (of its row, in the table)."""

    rate: float
    sums: dict[str, np.ndarray] = field(default_factory=dict)

    def take(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        seen = self.sums.setdefault(name, np.full(value.shape, 1e-8, np.float32))
        seen += gradient**2
        value -= self.rate * gradient / np.sqrt(seen)

    def take_rows(self, table: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        seen = self.sums.setdefault("table", np.full(len(table), 1e-8, np.float32))
        order = np.argsort(rows, kind="stable")
        rows, first = np.unique(rows[order], return_index=True)
        total = np.add.reduceat(gradient[order], first, axis=0)
        seen[rows] += (total**2).mean(1)
        table[rows] -= self.rate * total / np.sqrt(seen[rows])[:, None]


def _step(model: Model, steps: Steps, doc: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """One mini-batch: gradients go back through the logistic layer to the words that each maximum came from."""
    best, where = model.pooled_by_pieces(doc, ids, len(y))
    p = 1 / (1 + np.exp(-np.clip(best @ model.out + model.out_bias, -30, 30)))
    g = ((p - y) * weight / len(y)).astype(np.float32)
    back = g[:, None] * model.out[None, :]
    rows, moves = [], []
    for i, width in enumerate(WIDTHS):
        d, f = np.nonzero(where[:, i * FILTERS : (i + 1) * FILTERS] >= 0)
        if not len(d):
            continue
        at, gv = where[d, f + i * FILTERS], back[d, f + i * FILTERS]
        of_filter = np.zeros((FILTERS, len(f)), np.float32)
        of_filter[f, np.arange(len(f))] = gv
        change = np.empty_like(model.kernels[i])
        for j in range(width):
            change[j] = (of_filter @ model.table[ids[at + j]].sum(1)).T
            rows.append(ids[at + j].ravel())
            moves.append(np.repeat(gv[:, None] * model.kernels[i][j][:, f].T, ids.shape[1], axis=0))
        steps.take(f"kernel{width}", model.kernels[i], change)
        steps.take(f"bias{width}", model.biases[i], of_filter.sum(1))
    steps.take("out", model.out, best.T @ g + 1e-4 * model.out)
    steps.take("out_bias", model.out_bias, g.sum(keepdims=True))
    if rows:
        steps.take_rows(model.table, np.concatenate(rows), np.concatenate(moves))


def started(seed: int = 7) -> tuple[Model, Steps]:
    """The model all parts start from, of random numbers, and its steps."""
    rng = np.random.default_rng(seed)
    k = FILTERS * len(WIDTHS)
    model = Model(rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32), [rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, k).astype(np.float32), np.zeros(1, np.float32))
    steps = Steps(0.0, {name: np.full(x.shape, 1e-8, np.float32) for name, x in dense(model).items()} | {"table": np.full(1 << BITS, 1e-8, np.float32)})
    return model, steps


def dense(model: Model) -> dict[str, np.ndarray]:
    """All parameters but the table, by the names of their steps."""
    return {f"kernel{w}": x for w, x in zip(WIDTHS, model.kernels)} | {f"bias{w}": x for w, x in zip(WIDTHS, model.biases)} | {"out": model.out, "out_bias": model.out_bias}


def gone_through(model: Model, steps: Steps, words_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, passes: int, first: int, of: int, seed: int, batch: int = 64, rate: float = 0.05) -> None:
    """Takes all rows ``passes`` times in random order; these are passes ``first`` and following of ``of``. words_of gives the texts and the table rows of the words of some rows."""
    rng = np.random.default_rng(seed)
    for i in range(passes):
        steps.rate = rate * (1 - 0.9 * (first + i) / of)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            _step(model, steps, *words_of(pick), y[pick], weight[pick])


def passes_of(n: int, epochs: int = 6, least_steps: int = 600, batch: int = 64) -> int:
    """Few rows are gone through more often, until there are least_steps steps."""
    return max(epochs, -(-least_steps // max(1, -(-n // batch))))


def class_weights(ones: int, n: int) -> tuple[float, float]:
    """Weights of a row of class 0 and 1: both classes weigh the same."""
    return 0.5 / (1 - ones / n), 0.5 / (ones / n)


def train(texts: list[np.ndarray], langs: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """One part without Spark. texts: for each text the (words, 4) rows of its words. A fifth of the rows is left for the calibration."""
    y = labels.astype(np.int64)
    model, steps = started(seed)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    order = np.random.default_rng(seed).permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    if len(np.unique(y[used])) < 2:
        used = order

    def words_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(texts[i]) for i in rows]), np.concatenate([texts[i] for i in rows])

    weight = np.array(class_weights(int(y.sum()), len(y)))[y]
    passes = passes_of(len(used))
    gone_through(model, steps, lambda pick: words_of(used[pick]), y[used], weight[used], passes, 0, passes, seed)
    if len(held):
        z = binned(model.logits(*words_of(held), len(held)))
        cells, counts = np.unique(np.column_stack([langs[held], z, y[held]]), axis=0, return_counts=True)
        model.shift[:] = thresholds(cells, counts)
    return model


def binned(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z.astype(np.float64), -40, 40) * BINS).astype(np.int64)


def thresholds(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By language: the logit that parts the classes with the fewest errors, the middle of the widest gap of equals. cells: language, bin of the logit, label; counts: rows of each."""

    def threshold(mine: np.ndarray) -> float:
        z, at = np.unique(cells[mine, 1], return_inverse=True)
        zero, one = (np.bincount(at, counts[mine] * (cells[mine, 2] == y), len(z)) for y in (0, 1))
        errors = np.r_[0, np.cumsum(one)] + zero.sum() - np.r_[0, np.cumsum(zero)]
        ends = np.r_[z[0] - 2 * BINS, z, z[-1] + 2 * BINS]
        least = np.flatnonzero(errors == errors.min())
        i = least[np.diff(ends)[least].argmax()]
        return float((ends[i] + ends[i + 1] + 1) / 2 / BINS)

    def fewer(mine: np.ndarray) -> int:
        ones = int(counts[mine & (cells[:, 2] == 1)].sum())
        return min(ones, int(counts[mine].sum()) - ones)

    every = np.ones(len(cells), bool)
    overall = threshold(every) if fewer(every) >= 3 else 0.0
    of = [cells[:, 0] == i for i in range(len(LANGUAGES))]
    return np.array([threshold(mine) if fewer(mine) >= 15 else overall for mine in of])


def is_held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(doc_id, y, held, text) of every labelled row that may be learnt from, dealt to parts, and the number of parts. held: kept for the calibration."""
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col(label).cast("int").alias("y")).filter(F.col("of").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out("of"))
    known = cut(known.groupBy("of").agg(F.max("y").alias("y")))
    size = known.count()
    parts = max(1, math.ceil(math.sqrt(size / PART_ROWS)))
    texts = texts_of(documents)
    rows = texts.join(known.hint("broadcast" if size <= BROADCAST_LIMIT else "shuffle_hash"), texts["doc_id"] == known["of"]).select("doc_id", "y", "text")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    dealt = cut(rows.dropDuplicates(["doc_id", "text"]).select("doc_id", "y", held.alias("held"), "text").coalesce(parts))
    release(documents.sparkSession)
    return dealt, parts


def averaged(rows: DataFrame, model: Model, steps: Steps, weights: tuple[float, float], passes: int, first: int, of: int) -> None:
    """One round: every part goes through its rows, and the mean of what the parts came to is put in place. A row of the table counts for the parts that moved it."""
    sent = rows.sparkSession.sparkContext.broadcast((model, steps))
    names = [f"c{i}" for i in range(DIM + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        own, taken = copy.deepcopy(sent.value)
        part = pa.Table.from_batches(batches).sort_by("doc_id")
        y, texts = part.column("y").to_numpy().astype(np.int64), part.column("text").to_pylist()

        def words_of(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = [texts[i] for i in pick]
            return features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[:2]

        gone_through(own, taken, words_of, y, np.array(weights)[y], passes, first, of, first)
        moved = np.flatnonzero(taken.sums["table"] != sent.value[1].sums["table"])
        flat = np.concatenate([x.ravel() for d in (dense(own), {n: taken.sums[n] for n in dense(own)}) for x in d.values()])
        flat = np.pad(flat, (0, -len(flat) % (DIM + 1))).reshape(-1, DIM + 1)
        out = np.concatenate([flat, np.column_stack([own.table[moved], taken.sums["table"][moved]])])
        number = np.r_[-1 - np.arange(len(flat)), moved].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(number), *(pa.array(c) for c in np.round(out.astype(np.float64) * UNIT).astype(np.int64).T)], names=["number", *names])

    found = rows.mapInArrow(run, "number int, " + ", ".join(f"{c} long" for c in names))
    sums = found.groupBy("number").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names)).toArrow()
    number = sums.column("number").to_numpy()
    mean = np.column_stack([sums.column(c).to_numpy() for c in names]) / UNIT / sums.column("n").to_numpy()[:, None]
    moved = number >= 0
    model.table[number[moved]], steps.sums["table"][number[moved]] = mean[moved, :DIM], mean[moved, DIM]
    flat = mean[~moved][np.argsort(-number[~moved])].ravel()
    for d in (dense(model), {n: steps.sums[n] for n in dense(model)}):
        for x in d.values():
            x[...], flat = flat[: x.size].reshape(x.shape), flat[x.size :]
    sent.unpersist()
    del found
    release(rows.sparkSession, 1)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Trained on all labelled rows; of two labels of one id the larger counts. The driver receives means of the model's numbers and counts by bins of the logit only, whose sizes are fixed."""
    rows, parts = labelled(documents, labels, label)
    n = {(r.held, r.y): r["count"] for r in rows.groupBy("held", "y").count().collect()}
    size = lambda held, y: sum(n.get((h, y), 0) for h in held)
    model, steps = started()
    ones, both = size((False, True), 1), sum(n.values())
    if not 0 < ones < both:
        model.constant = ones / both if both else 0.0
        return model
    # Both classes are needed: where one is among the rows for the calibration only, these are learnt from, too.
    kinds = (False,) if size((False,), 0) and size((False,), 1) else (False, True)
    used = rows.filter(F.col("held").isin(*kinds))
    rounds = ROUNDS if parts > 1 else 1
    each = -(-passes_of(size(kinds, 0) + size(kinds, 1)) // rounds)
    for i in range(rounds):
        averaged(used, model, steps, class_weights(ones, both), each, i * each, rounds * each)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, ids, lang = features(*bytes_of(part.column(1)))
                z = binned(sent.value.logits(doc, ids, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.astype(np.int64)), pa.array(z)], names=["y", "lang", "bin"])

    judged = rows.filter("held").select("y", "text").mapInArrow(run, "y int, lang long, bin long").groupBy("lang", "bin", "y").count().collect()
    if judged:
        cells = np.array([(r.lang, r.bin, r.y, r["count"]) for r in judged])
        model.shift[:] = thresholds(cells[:, :3], cells[:, 3])
    return model


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, score. No shuffle takes place; the model is broadcast (its size is fixed)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(*bytes_of(part.column(1))))], names=["doc_id", "score"])

    return texts_of(documents).mapInArrow(run, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = scores(documents, fit(documents, labels, label))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores under 0.5."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                data, offsets = bytes_of(part.column(at).fill_null(""))
                yield part.filter(pa.array(sent.value.score(data, offsets) < 0.5))

    return documents.mapInArrow(run, documents.schema)
