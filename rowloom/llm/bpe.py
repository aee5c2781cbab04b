"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut into matches of the vocabulary's pattern. A match is written in the byte
alphabet (one printable character for each of the 256 bytes) and goes through the library's
BPE model; a token's length in that alphabet is its length in bytes, which gives the offsets.
Decoding maps every token back to its bytes, joins the bytes,
and only then reads them as UTF-8, so a character that is split over tokens comes out whole.

Defined results: a null or empty text has no tokens; bytes that are not UTF-8 are read as
U+FFFD; repeated rows give repeated results; other columns are not read. Texts of any length
are encoded whole: matches are found one after another and only ids are kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rowloom.llm.common import slices, texts_of

#: Different matches whose tokens a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000


def byte_alphabet() -> list[str]:
    """The character for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts that each token of more than one byte is merged from, by rank."""

    def parts(token: bytes, rank: int) -> list[bytes]:
        out = [token[i : i + 1] for i in range(len(token))]
        while len(out) > 2:
            best = min(((ranks.get(out[i] + out[i + 1], rank), i) for i in range(len(out) - 1)))
            if best[0] >= rank:
                break
            out[best[1] : best[1] + 2] = [out[best[1]] + out[best[1] + 1]]
        return out

    found = ((rank, parts(token, rank)) for token, rank in ranks.items() if len(token) > 1)
    return [tuple(p) for _, p in sorted(found) if len(p) == 2]


class ByteBPE:
    """Encoder and decoder for one file of ranks; built once in each Python worker."""

    _built: dict[tuple[str, str], ByteBPE] = {}

    def __init__(self, path: str, pattern: str):
        from tokenizers import models

        ranks = read_ranks(path)
        self.alphabet = byte_alphabet()
        write = lambda b: "".join(map(self.alphabet.__getitem__, b))
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet)})
        self.model = models.BPE(vocab={write(t): r for t, r in ranks.items()}, merges=[(write(a), write(b)) for a, b in merges_of(ranks)])
        self.whole = ranks
        back = {c: b for b, c in enumerate(self.alphabet)}
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for t, r in ranks.items():
            self.bytes_of[r] = bytes(map(back.__getitem__, write(t)))
        self.decimal = list(map(str, range(size)))
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...] | None] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBPE:
        if (path, pattern) not in cls._built:
            cls._built[path, pattern] = cls(path, pattern)
        return cls._built[path, pattern]

    def piece(self, match: str) -> tuple[int, ...]:
        raw = match.encode("utf-8")
        if raw in self.whole:
            return (self.whole[raw],)
        return tuple(t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.table)))

    def run(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece, self.find(text))))

    def encode(self, text: str) -> list[int]:
        """Cuts before single spaces, where a match always ends, so that most stretches are remembered.

        A stretch that is empty or has white space at an end shows a longer gap: then the pattern runs over the whole text.
        """
        first, *rest = text.split(" ")
        known = self.known
        if new := set(rest).difference(known):
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(rest)
            for x in new:
                known[x] = self.run(f" {x}") if x and not (x[0].isspace() or x[-1].isspace()) else None
        try:
            out = list(chain.from_iterable(map(known.__getitem__, rest)))
        except TypeError:
            return list(self.run(text))
        if first[-1:].isspace() or not first and rest:
            return list(self.run(text))
        return [*self.run(first), *out]

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first, last plus one) of each token, in bytes of the text."""
        ids = self.encode(text)
        ends = list(accumulate(len(self.bytes_of[i]) for i in ids))
        return list(zip(ids, [0, *ends], ends))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids (array of int), decoded (the bytes that the ids decode to).

    With ``digests`` the last two are replaced by ids_sha256 (of the decimal ids joined by one
    space) and decoded_sha256, so that only digests leave the task. No shuffle takes place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(path, pattern)
        for batch in batches:
            for part in slices(batch):
                n, left, right = [], [], []
                for raw in part.column(1).to_pylist():
                    ids = bpe.encode(raw.decode("utf-8", errors="replace"))
                    decoded = bpe.decode_bytes(ids)
                    n.append(len(ids))
                    left.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest() if digests else ids)
                    right.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(left, kinds[0]), pa.array(right, kinds[1])], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")


def character_offsets(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens that end at these bytes: the first code point that each touches, and the last one plus one. Parts of one character share it."""
    begins = np.r_[0, np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)]
    firsts = np.r_[0, ends[:-1]] if len(ends) else ends
    return begins[firsts + 1] - 1 if len(ends) else ends, begins[ends]


def token_offsets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (array of id, first, last in bytes, first_char, last_char in code points; ends exclusive), in order."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("id", "first", "last", "first_char", "last_char")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(path, pattern)
        for batch in batches:
            for part in slices(batch):
                out = []
                for raw in part.column(1).to_pylist():
                    text = raw.decode("utf-8", errors="replace")
                    found = bpe.offsets(text)
                    a, b = character_offsets(text.encode("utf-8"), np.array([x[2] for x in found], np.int64))
                    out.append([{"id": i, "first": x, "last": y, "first_char": p, "last_char": q} for (i, x, y), p, q in zip(found, a.tolist(), b.tolist())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["doc_id", "tokens"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, tokens array<struct<id:long,first:long,last:long,first_char:long,last_char:long>>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
