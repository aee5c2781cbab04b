"""Secret scan: sliding-window entropy per character class beside fixed kinds of secrets.

Candidates are maximal runs of key characters. A run is classed as hex, alphanumeric or
base64 by the characters it holds. The Shannon entropy of every window of ``window``
characters is kept by incremental counts: one character enters, one leaves, and the sum of
c * log2(c) changes by two terms. A run with a window at or above the threshold of its
class is a span, whole, so that no rest of a secret is left. An allow list suppresses runs that are known not to be secrets.

Defined results: a null or empty text has no spans; repeated rows give repeated results;
other columns are not read; spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import slices, texts_of

KINDS = ("assign", "access", "hex", "entropy")
# The patterns of the three base kinds. ASCII mode: only A-Z and a-z fold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Least entropy in bits of a window, by class of the run. Of 200,000 random strings of 20 characters
#: of each class 1.0 %, 0.8 % and 0.7 % lie below; longer ones have more windows and are missed less.
#: The allow list adds to it: runs of letters only are words (3 % of 20 random letters and digits).
THRESHOLDS = {"hex": 2.9, "alnum": 3.64, "base64": 3.64}
#: Runs that are not secrets: words, identifiers in words, paths, rulers, numbers, UUIDs.
ALLOWED = (
    re.compile(r"[A-Za-z]+"),
    re.compile(r"[A-Za-z]*(?:[_/-][A-Za-z]*)+"),
    re.compile(r"[0-9_/+=-]+"),
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:[A-Za-z]{1,24}|[0-9]{1,8})?(?:[/_-](?:[A-Za-z]{1,24}|[0-9]{1,8})?)+"),
)  # after each separator only one way goes on, so a run of any length is matched in linear time


@lru_cache(8)
def _xlog(window: int) -> list[float]:
    """c * log2(c) for the counts that a window can hold."""
    return [0.0, *(c * log2(c) for c in range(1, window + 2))]


def run_class(run: str) -> str:
    if not re.search(r"[^0-9a-fA-F]", run):
        return "hex"
    return "base64" if re.search(r"[+/_=-]", run) else "alnum"


def entropy_spans(run: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Maximal stretches of the run that lie under windows whose entropy reaches the threshold."""
    counts: dict[str, int] = {}
    xlog, total, spans = _xlog(window), 0.0, []
    need = (log2(window) - threshold) * window  # entropy >= threshold: sum of c * log2(c) is at most this
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += xlog[n + 1] - xlog[n]
        if i >= window:
            out = run[i - window]
            n = counts[out]
            counts[out] = n - 1
            total += xlog[n - 1] - xlog[n]
        if i >= window - 1 and total <= need + 1e-9:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def scan(text: str, window: int = 20, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then by kind as listed in KINDS."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not any(a.fullmatch(run) for a in ALLOWED):
            out += [(m.start(), m.end(), 3)] if entropy_spans(run, window, thresholds[run_class(run)]) else []
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """One row for each document: doc_id, spans (array of kind, first, last; code points). No shuffle takes place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                found = [[{"kind": k, "first": a, "last": b} for a, b, k in scan(raw.decode("utf-8", errors="replace"), window, thresholds)] for raw in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,first:long,last:long>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: spans written as kind:start:end, joined by commas."""
    write = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))))
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(write(F.filter("spans", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"), write("spans").alias("spans"))


def redact_text(text: str, spans: list[tuple[int, int]], mask: str = "[SECRET]") -> str:
    """The text with every maximal covered stretch replaced by the mask."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret masked in the text and the text's length counted anew; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                new = []
                for text in part.column(at).to_pylist():
                    spans = [(a, b) for a, b, _ in scan(text)] if text else []
                    new.append(redact_text(text, spans, mask) if spans else text)
                yield part.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in docs.columns else out
