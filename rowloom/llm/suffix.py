"""Two-stage suffix sorting on numpy arrays, bounded to a number of leading bytes.

Suffixes smaller than their successors are sorted directly; the others are induced: buckets of
equal first bytes are scanned in ascending order, and the predecessor of every suffix scanned
goes to the end of its own bucket, which puts it in its sorted place. A bucket's scan is a few
whole-array steps instead of a step for each suffix. Only the suffixes asked for are sorted,
with the chain of successors that each of them is induced from.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def byte_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts as they do; zeros follow the end."""
    x = np.concatenate([text, np.zeros(WORD, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        x[:-size] = (x[:-size] << np.uint64(8 * size)) | x[size:]
    return x[: len(text)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last one is not."""
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    until = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal bytes ends
    return np.append(np.append(step, -1)[until] > 0, False)


def _sorted(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions by their first depth bytes: word after word, and only where the words before are equal."""
    n = len(words)
    at = at[np.argsort(words[at], kind="stable")]
    tied = np.arange(len(at))
    group = np.cumsum(np.r_[True, words[at[1:]] != words[at[:-1]]]) if len(at) else tied
    for shift in range(WORD, depth, WORD):
        same = np.zeros(len(tied), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:].copy()
        tied, group = tied[same], group[same]
        if not len(tied):
            break
        places = at[tied]
        key = np.where(places + shift < n, words[np.minimum(places + shift, n - 1)], 0)
        order = np.lexsort((key, group))
        at[tied] = places[order]
        key, group = key[order], group[order]
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
    return at


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions (a mask) in the order of their suffixes' first depth bytes at least, as if zeros followed the end."""
    n = len(text)
    direct = smaller_than_next(text)
    # A wanted suffix is induced from its successor, that from the next one, up to one sorted directly or to the end.
    end = np.minimum.accumulate(np.where(direct, np.arange(n), n - 1)[::-1])[::-1]
    cover = np.zeros(n + 1, np.int64)
    asked = np.flatnonzero(wanted)
    np.add.at(cover, asked, 1)
    np.add.at(cover, end[asked] + 1, -1)
    needed = np.cumsum(cover[:n]) > 0
    words = byte_words(text)
    base = _sorted(words, np.flatnonzero(needed & direct), depth)
    first = text[base]
    cuts = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    if n and needed[-1]:  # its successor is the empty suffix, which comes before all
        waiting[text[-1]].append(np.array([n - 1]))

    def deal(found: np.ndarray) -> np.ndarray:
        """Hands on the predecessors of suffixes just scanned; returns them with their first bytes in the scan's order."""
        before = found[found > 0] - 1
        return before[needed[before] & ~direct[before]]

    def hand_on(before: np.ndarray, c: int) -> None:
        lead = text[before]
        order = np.argsort(lead, kind="stable")
        before, lead = before[order], lead[order]
        for b in np.unique(lead):
            if b != c:
                waiting[b].append(before[np.searchsorted(lead, b) : np.searchsorted(lead, b, "right")])

    for c in range(256):
        ready = waiting[c]
        while ready:  # larger suffixes come first in a bucket; runs of the same byte take a round for each byte
            found = np.concatenate(ready)
            out.append(found)
            before = deal(found)
            hand_on(before, c)
            more = before[text[before] == c]
            ready = [more] if len(more) else []
        found = base[cuts[c] : cuts[c + 1]]
        if len(found):
            out.append(found)
            hand_on(deal(found), c)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each sorted suffix the bytes it shares with the one before it, at most depth; 0 for the first."""
    n = len(text)
    words = byte_words(text)
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for shift in range(0, depth, WORD):
        a, b = order[open_ - 1] + shift, order[open_] + shift
        inside = np.maximum(a, b) < n
        open_, a, b = open_[inside], a[inside], b[inside]
        diff = words[a] ^ words[b]
        equal = diff == 0
        stop = open_[~equal]
        lead = 7 - (np.frexp((diff[~equal] >> np.uint64(1)).astype(np.float64) + 0.5)[1]) // 8  # whole equal bytes
        out[stop] = shift + lead
        open_ = open_[equal]
        out[open_] = shift + WORD
        if not len(open_):
            break
    limit = np.minimum(n - order, np.r_[0, n - order[:-1]]) if len(order) else out
    return np.minimum(np.minimum(out, depth), limit)
