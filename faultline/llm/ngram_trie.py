"""A bigram trie in Elias-Fano levels, memory-mapped, for one range of words.

Level 1 holds the words, level 2 below each word the words seen before it. Both
are monotone sequences in Elias-Fano form: low bits packed, high parts in unary.
Level 2 becomes monotone by putting each word's rank in front of its successors'
keys; the word's pointers, monotone too, bound its successors. A bigram is found
relative to its word: rank in level 1, range by the pointers, then the first
entry of the range not below the key (successor search).

Probabilities are logarithms in 16 bits, between the least and largest of their
level.
"""

from __future__ import annotations

import os
import tempfile
from typing import NamedTuple

import numpy as np

U = np.uint64
# An eight-byte read at any bit offset below 8 yields at least this many bits.
_MOST_LOW = 56
CONTEXT_BITS = 48


class Sequence(NamedTuple):
    """A monotone sequence: its length, low bits, unary high parts, directory."""

    size: int
    width: int
    low: np.ndarray  # packed, little end first
    high: np.ndarray  # uint64 words: a 1 for each entry, a 0 for each step up
    ones: np.ndarray  # ones before each word of ``high``


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other, and eight spare bytes."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    parts = []
    for block in range(0, len(values), 1 << 16):  # a multiple of eight entries
        part = values[block : block + (1 << 16)]
        raw = part.astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1, count=width, bitorder="little")
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def encode(values: np.ndarray, high_values: np.ndarray | None = None) -> Sequence:
    """Elias-Fano form of a non-decreasing sequence of numbers.

    With ``high_values``, entries are ``high_values * 2**CONTEXT_BITS + values``,
    which may be wider than 64 bits.
    """
    n = len(values)
    if high_values is None:
        values = values.astype(U)
        spread = int(values[-1]) // n if n else 0
        width = min(max(spread.bit_length() - 1, 0), _MOST_LOW)
        # few entries over a wide range: let no unary part outgrow them
        if n and (int(values[-1]) >> width) > 4 * n + 1024:
            width = int(values[-1]).bit_length() - (4 * n + 1024).bit_length() + 1
            width = min(width, _MOST_LOW)
        above = (values >> U(width)).astype(np.int64)
        below = values & U((1 << width) - 1)
    else:
        spread = ((int(high_values[-1]) + 1) << CONTEXT_BITS) // n if n else 1
        width = min(max(spread.bit_length() - 1, 0), CONTEXT_BITS)
        above = (high_values.astype(np.int64) << (CONTEXT_BITS - width)) + (
            values.astype(U) >> U(width)
        ).astype(np.int64)
        below = values.astype(U) & U((1 << width) - 1)
    length = (int(above[-1]) if n else 0) + n + 1
    bits = np.zeros(-(-length // 64) * 64, bool)
    bits[above + np.arange(n)] = True
    high = np.packbits(bits, bitorder="little").view("<u8")
    counts = np.bitwise_count(high).astype(np.int64)
    return Sequence(n, width, _pack(below, width), high, np.cumsum(counts) - counts)


def _select(seq: Sequence, wanted: np.ndarray, one: bool) -> np.ndarray:
    """Place of the ``wanted``-th (from 0) one or zero in the unary part."""
    before = seq.ones if one else np.arange(len(seq.high)) * 64 - seq.ones
    word = np.searchsorted(before, wanted, side="right") - 1
    rest = wanted - before[word]
    bits = seq.high[word] if one else ~seq.high[word]
    place = np.zeros(len(wanted), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        inside = np.bitwise_count(bits & U((1 << half) - 1)).astype(np.int64)
        go = rest >= inside
        rest = np.where(go, rest - inside, rest)
        place += np.where(go, half, 0)
        bits = np.where(go, bits >> U(half), bits)
    return word * 64 + place


def _low(seq: Sequence, places: np.ndarray) -> np.ndarray:
    if not seq.width:
        return np.zeros(len(places), U)
    bit = places * seq.width
    raw = seq.low[(bit >> 3)[:, None] + np.arange(8)]
    words = np.ascontiguousarray(raw).view("<u8").reshape(-1)
    return (words >> (bit & 7).astype(U)) & U((1 << seq.width) - 1)


def access(seq: Sequence, places: np.ndarray) -> np.ndarray:
    high = _select(seq, places, True) - places
    return (high.astype(U) << U(seq.width)) + _low(seq, places)


def successor(
    seq: Sequence, above: np.ndarray, below: np.ndarray, start: np.ndarray, stop: np.ndarray
) -> np.ndarray:
    """The first place in [start, stop) whose entry is not below the key, or stop.

    ``above`` and ``below`` are the key's high part and low bits.
    """
    # entries with the key's high part: between two zeros of the unary part
    most = len(seq.high) * 64 - seq.size - 1  # zeros beyond the last step pad a word
    top = np.minimum(above, most)
    first = np.where(top > 0, _select(seq, np.maximum(top - 1, 0), False) - top + 1, 0)
    last = _select(seq, top, False) - top
    low, high = np.maximum(first, start), np.minimum(np.maximum(last, start), stop)
    high = np.maximum(low, high)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return np.minimum(low, stop)
        middle = (low[open_] + high[open_]) // 2
        under = _low(seq, middle) < below[open_]
        low[open_] = np.where(under, middle + 1, low[open_])
        high[open_] = np.where(under, high[open_], middle)


def quantised(values: np.ndarray) -> tuple[np.ndarray, float, float]:
    """16-bit codes, and the least value and step they stand for."""
    least = float(values.min()) if len(values) else 0.0
    step = (float(values.max()) - least) / 65535 if len(values) else 0.0
    codes = np.rint((values - least) / step) if step else np.zeros(len(values))
    return codes.astype(np.uint16), least, step


class Trie(NamedTuple):
    words: Sequence
    pointers: Sequence
    contexts: Sequence
    scores: np.ndarray  # of bigrams
    scale: tuple[float, float]


def build(words: np.ndarray, owner: np.ndarray, before: np.ndarray, logs: np.ndarray) -> Trie:
    """``words``: sorted keys. ``owner``, ``before``, ``logs``: for each bigram, in
    order, the rank of its word, the key of the word before, its log-probability."""
    ends = np.searchsorted(owner, np.arange(len(words) + 1))
    codes, least, step = quantised(logs)
    return Trie(encode(words), encode(ends), encode(before, owner), codes, (least, step))


LOOKUPS = 1 << 17  # bigrams looked up together


def lookup(trie: Trie, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bigram its word's rank and its own place; -1 if unknown."""
    rank, place = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    for a in range(0, len(words), LOOKUPS):
        part = slice(a, a + LOOKUPS)
        rank[part], place[part] = _lookup(trie, words[part], before[part])
    return rank, place


def _lookup(trie: Trie, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = trie.words.size
    if not n:
        return np.full(len(words), -1), np.full(len(words), -1)
    width = trie.words.width
    above = (words >> U(width)).astype(np.int64)
    below = words & U((1 << width) - 1)
    every = np.zeros(len(words), np.int64)
    rank = successor(trie.words, above, below, every, every + n)
    known = rank < n
    known[known] = access(trie.words, rank[known]) == words[known]
    at = np.flatnonzero(known)
    place = np.full(len(words), -1)
    rank = np.where(known, rank, -1)
    if trie.contexts.size and len(at):
        start = access(trie.pointers, rank[at]).astype(np.int64)
        stop = access(trie.pointers, rank[at] + 1).astype(np.int64)
        width = trie.contexts.width
        key = before[at].astype(U)
        above = (rank[at] << (CONTEXT_BITS - width)) + (key >> U(width)).astype(np.int64)
        below = key & U((1 << width) - 1)
        found = successor(trie.contexts, above, below, start, stop)
        inside = found < stop
        got = np.minimum(found, trie.contexts.size - 1)
        same = inside & (_low(trie.contexts, got) == below)
        same &= (_select(trie.contexts, got, True) - got) == above
        place[at] = np.where(same, found, -1)
    return rank, place


def log_of(trie: Trie, places: np.ndarray) -> np.ndarray:
    least, step = trie.scale
    return least + step * trie.scores[places].astype(np.float64)


def mapped(trie: Trie) -> Trie:
    """The same trie with its levels memory-mapped from a file without a name.

    The file lies in the task's own temporary folder, is deleted while open, and
    is gone with the task.
    """
    arrays = [
        *(getattr(s, f) for s in trie[:3] for f in ("low", "high", "ones")),
        trie.scores,
    ]
    handle, path = tempfile.mkstemp()
    with os.fdopen(handle, "wb") as file:
        offsets = []
        for a in arrays:
            file.write(b"\0" * (-file.tell() % 8))
            offsets.append(file.tell())
            file.write(np.ascontiguousarray(a).data)
        file.write(b"\0" * 8)
    views = [
        np.memmap(path, a.dtype, "r", offset, a.shape) if a.size else a
        for a, offset in zip(arrays, offsets, strict=True)
    ]
    os.unlink(path)
    levels = [
        s._replace(low=views[3 * i], high=views[3 * i + 1], ones=views[3 * i + 2])
        for i, s in enumerate(trie[:3])
    ]
    return Trie(*levels, views[9], trie.scale)
