"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary and the order of merges are those of a SentencePiece model file.
Adjacent symbols whose union is a piece are candidates; the agenda takes the
best-ranked candidate of a chunk, the leftmost on ties, until none is left. A
candidate is skipped for good if a keyed hash of (seed, chunk, row key, place of
the chunk, place in it, piece) falls under the dropout rate. The decision depends
on the key alone, so a text is cut alike in every run and after every lost
executor, while another seed cuts it differently. Every occurrence of a word, in
one text or in several, has draws of its own.

Spaces become U+2581 with one in front, as the model wants it. Characters
outside the vocabulary become byte pieces, and so does U+2581 itself, which the
model would read as a space: every text comes back unchanged.

No piece of the model joins across a space, so chunks are cut there and worked
out together, one merge of every chunk at a time. A run of the agenda notes the
candidates it came by; another occurrence of the chunk whose draws agree on all of
them has the same pieces. So a repeated chunk is run once without dropout, then
once for each set of candidates dropped in that run, and what agrees with neither
by itself. Very long chunks run through a heap one by one.

Defined cases: a null text has null pieces, an empty one none. The row key may be
null or repeated; rows that agree in key and text are cut alike.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.llm.tokens import hashes_of, mixed, text_slices

SPACE = "▁"
DROPOUT = 0.1
LONG_CHUNK = 256
SLICE_CHARS = 2 << 20  # texts worked out together
CHUNKS = 1 << 16  # chunks cut or compared together
_NEVER = np.int32(2**31 - 1)
_SLOTS = 20


class Pieces(NamedTuple):
    """A vocabulary, as it is sent to the tasks."""

    texts: list[str]  # by id; byte pieces have their byte as one character
    is_byte: list[bool]
    ranks: list[int]  # by id: smaller merges first


def read_pieces(model_file: str) -> Pieces:
    """The vocabulary of a BPE model with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    scores = [model.get_score(i) for i in range(size)]
    order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
    texts, is_byte = [], []
    for i in range(size):
        piece = model.id_to_piece(i)
        is_byte.append(model.is_byte(i))
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        texts.append(chr(int(piece[3:5], 16)) if model.is_byte(i) else "" if special else piece)
    return Pieces(texts, is_byte, [order[s] for s in scores])


class Tables:
    """Lookups made of a vocabulary, once in each task."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.size = len(pieces.texts)
        self.bytes = np.zeros(256, np.int32)
        whole = {}
        for i, text in enumerate(pieces.texts):
            if pieces.is_byte[i]:
                self.bytes[ord(text)] = i
            elif text:
                whole[text] = i
        # single characters of pieces that are no piece themselves get ids beyond
        symbols = dict(whole)
        for c in sorted({c for text in whole for c in text} - whole.keys()):
            symbols[c] = self.size + len(symbols) - len(whole)
        self.n_symbols = self.size + len(symbols) - len(whole)
        self.of_char = np.full(0x110000, -1, np.int32)
        for text, i in symbols.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        self.merges = {}
        for text, i in whole.items():
            for cut in range(1, len(text)):
                a, b = symbols.get(text[:cut]), symbols.get(text[cut:])
                if a is not None and b is not None:
                    self.merges[a, b] = i
        self.ranks = np.array(pieces.ranks, np.int32)
        self._hash_merges()
        cuts = "".join(c for c in "\n\t\r" if all(c not in t or len(t) == 1 for t in whole))
        joins = any(t[i] == SPACE and t[i - 1] != SPACE for t in whole for i in range(1, len(t)))
        if joins:
            raise ValueError("a piece joins words across a space")
        self.chunk = re.compile(f" *[^ {cuts}{SPACE}]+| +|[{cuts}{SPACE}]", re.DOTALL)
        self.decoded = [
            bytes([ord(t)]) if pieces.is_byte[i] else t.replace(SPACE, " ").encode()
            for i, t in enumerate(pieces.texts)
        ]

    def _hash_merges(self):
        self.keys = np.full(1 << _SLOTS, -1, np.int64)
        self.values = np.full(1 << _SLOTS, -1, np.int32)
        self.probes = 1
        mask = (1 << _SLOTS) - 1
        for (a, b), i in self.merges.items():
            key = a * self.n_symbols + b
            slot = int(self._slot(np.array([key]))[0])
            probes = 1
            while self.keys[slot] != -1:
                slot, probes = (slot + 1) & mask, probes + 1
            self.keys[slot], self.values[slot] = key, i
            self.probes = max(self.probes, probes)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece each pair makes, or -1."""
        keys = a.astype(np.int64) * self.n_symbols + b
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], -1)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slots[open_] + step) & ((1 << _SLOTS) - 1)
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return np.where((a < 0) | (b < 0), -1, found).astype(np.int32)


def _dropped(keys: np.ndarray, places: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Whether each candidate is skipped."""
    if rate <= 0:
        return np.zeros(len(keys), bool)
    drawn = mixed(keys + mixed((places.astype(np.uint64) << np.uint64(32)) + piece.astype(np.uint64)))
    return (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def _segment_long(symbols: np.ndarray, key: np.uint64, tables: Tables, rate: float) -> list[tuple]:
    """(symbol, place) of one long chunk, by a heap."""
    ids, n = symbols.tolist(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple] = []

    def offer(lefts: list[int]):
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if not lefts:
            return
        a = np.array([ids[i] for i in lefts])
        b = np.array([ids[after[i]] for i in lefts])
        piece, at = tables.merged(a, b), np.array(lefts)
        ok = (piece >= 0) & ~_dropped(np.full(len(at), key), at, piece, rate)
        for i, p in zip(at[ok].tolist(), piece[ok].tolist(), strict=True):
            heapq.heappush(agenda, (int(tables.ranks[p]), i, p, ids[i], ids[after[i]], after[i]))

    offer(list(range(n)))
    gone = [False] * n
    while agenda:
        _, i, piece, a, b, right = heapq.heappop(agenda)
        if gone[i] or ids[i] != a or after[i] != right or ids[right] != b:
            continue
        ids[i], gone[right] = piece, True
        after[i] = after[right]
        if after[i] < n:
            before[after[i]] = i
        offer([before[i], i])
    return [(ids[i], i) for i in range(n) if not gone[i]]


def segmented(
    chunks: list[str],
    keys: np.ndarray,
    tables: Tables,
    rate: float,
    offered: list[tuple[np.ndarray, ...]] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all chunks, chunk after chunk, and how many each has.

    ``offered`` takes up (chunk, place, piece, dropped) of all candidates, but for
    chunks of over ``LONG_CHUNK`` characters.
    """
    points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    starts = np.cumsum(lengths) - lengths
    symbols = tables.of_char[points]
    chunk_of = np.repeat(np.arange(len(chunks), dtype=np.int32), lengths)
    place = (np.arange(len(points)) - starts[chunk_of]).astype(np.int32)
    final: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunk, place, symbol

    long = np.flatnonzero(lengths > LONG_CHUNK)
    for c in long:
        own = slice(starts[c], starts[c] + lengths[c])
        cut = _segment_long(symbols[own], keys[c], tables, rate)
        ids, at = np.array(cut, np.int64).T
        final.append((np.full(len(ids), c, np.int32), at.astype(np.int32), ids.astype(np.int32)))
    live = ~np.isin(chunk_of, long) if len(long) else np.ones(len(points), bool)
    owner, at, ids = chunk_of[live], place[live], symbols[live]

    def candidates(where: np.ndarray) -> np.ndarray:
        """Rank of the candidate that starts at each of ``where``."""
        rank = np.full(len(where), _NEVER, np.int32)
        inside = np.flatnonzero(where < len(ids) - 1)
        inside = inside[owner[where[inside]] == owner[where[inside] + 1]]
        left = where[inside]
        piece = tables.merged(ids[left], ids[left + 1])
        ok = piece >= 0
        left, inside, piece = left[ok], inside[ok], piece[ok]
        dropped = _dropped(keys[owner[left]], at[left], piece, rate)
        if offered is not None:
            offered.append((owner[left], at[left], piece, dropped))
        stays = ~dropped
        rank[inside[stays]] = tables.ranks[piece[stays]]
        return rank

    rank = candidates(np.arange(len(ids)))
    while len(ids):
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank, edges)
        sizes = np.diff(np.append(edges, len(ids)))
        done = np.repeat(least == _NEVER, sizes)
        if done.any():
            final.append((owner[done], at[done], ids[done]))
            owner, at, ids, rank = owner[~done], at[~done], ids[~done], rank[~done]
            if not len(ids):
                break
            edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(edges, len(ids)))
            least = least[least != _NEVER]
        best = np.flatnonzero(rank == np.repeat(least, sizes))
        first = np.append(True, owner[best[1:]] != owner[best[:-1]])
        best = best[first]
        ids = ids.copy()
        ids[best] = tables.merged(ids[best], ids[best + 1])
        keep = np.ones(len(ids), bool)
        keep[best + 1] = False
        moved = np.cumsum(keep) - 1
        owner, at, ids, rank = owner[keep], at[keep], ids[keep], rank[keep]
        best = moved[best]
        touched = np.zeros(len(ids), bool)
        touched[best] = True
        touched[best[best > 0] - 1] = True
        touched = np.flatnonzero(touched)
        rank[touched] = candidates(touched)

    if not final:
        return np.empty(0, np.int32), lengths * 0
    owner, at, ids = (np.concatenate(x) for x in zip(*final, strict=True))
    order = np.lexsort((at, owner))
    owner, at, ids = owner[order], at[order], ids[order]
    return _with_bytes(owner, ids, points[starts[owner] + at], len(chunks), tables)


def _with_bytes(owner, ids, points, n_chunks, tables) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece become byte pieces."""
    outside = (ids < 0) | (ids >= tables.size)
    width = np.ones(len(ids), np.int64)
    strange = np.flatnonzero(outside)
    raw = [(SPACE if c == ord(SPACE_LITERAL) else chr(c)).encode() for c in points[strange].tolist()]
    width[strange] = [len(x) for x in raw]
    ends = np.cumsum(width)
    out = np.repeat(ids, width).astype(np.int32)
    for i, encoded in zip(strange.tolist(), raw, strict=True):
        out[ends[i] - len(encoded) : ends[i]] = tables.bytes[list(encoded)]
    return out, np.bincount(owner, weights=width, minlength=n_chunks).astype(np.int64)


def _agreeing(
    offered: list[tuple[np.ndarray, ...]], runs: np.ndarray, keys: np.ndarray, rate: float
) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key draws what the run in ``runs`` did, and a mark of what it drops."""
    owner, at, piece, dropped = (np.concatenate(x) for x in zip(*offered, strict=True))
    order = np.argsort(owner, kind="stable")
    at, piece, dropped = at[order], piece[order], dropped[order]
    sizes = np.bincount(owner, minlength=int(runs.max()) + 1)
    starts = np.cumsum(sizes) - sizes
    agree, marks = [], []
    for i in range(0, len(runs), CHUNKS):
        run = runs[i : i + CHUNKS]
        n = sizes[run]
        own = np.repeat(np.arange(len(run)), n)
        places = np.arange(len(own)) - np.repeat(np.cumsum(n) - n - starts[run], n)
        drawn = _dropped(keys[i : i + CHUNKS][own], at[places], piece[places], rate)
        agree.append(np.bincount(own[drawn != dropped[places]], minlength=len(run)) == 0)
        weights = (mixed(places[drawn].astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(float)
        marks.append(np.bincount(own[drawn], weights=weights, minlength=len(run)))
    return np.concatenate(agree), np.concatenate(marks)


def _drawn(
    chunks: np.ndarray, codes: np.ndarray, keys: np.ndarray, tables: Tables, rate: float, block: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of runs of the agenda, how many each has, and the run of each
    occurrence: a place in ``chunks`` and a key."""
    parts, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    which = np.full(len(codes), -1)

    def run(words: np.ndarray, own: np.ndarray, share: float, offered: list | None = None) -> int:
        """Number of the first of these runs."""
        first = sum(map(len, sizes))
        for i in range(0, len(words), block):
            seen = None if offered is None else []
            ids, n = segmented(
                chunks[words[i : i + block]].tolist(), own[i : i + block], tables, share, seen
            )
            parts.append(ids)
            sizes.append(n)
            if seen:
                offered += [(owner + i, *others) for owner, *others in seen]
        return first

    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    uses = np.bincount(codes, minlength=len(chunks))
    # without dropout a chunk is run once for all its occurrences
    shared = (lengths <= LONG_CHUNK) & (uses > 1) if rate > 0 else uses > 0
    words = np.flatnonzero(shared)
    numbers = np.cumsum(shared) - 1
    offered: list[tuple[np.ndarray, ...]] = []
    first = run(words, np.zeros(len(words), np.uint64), 0.0, offered)
    open_ = np.flatnonzero(shared[codes])
    if rate <= 0 or not offered:
        which[open_] = first + numbers[codes[open_]]
        open_ = open_[:0]
    if len(open_):
        agree, marks = _agreeing(offered, numbers[codes[open_]], keys[open_], rate)
        which[open_[agree]] = first + numbers[codes[open_[agree]]]
        open_ = open_[~agree]
        of_mark, distinct = pd.factorize(marks[~agree])
        group, _ = pd.factorize(codes[open_] * max(1, len(distinct)) + of_mark)
        ones = open_[np.unique(group, return_index=True)[1]]
        offered = []
        first = run(codes[ones], keys[ones], rate, offered)
        if offered:
            agree, _ = _agreeing(offered, group, keys[open_], rate)
            which[open_[agree]] = first + group[agree]
    rest = np.flatnonzero(which < 0)
    which[rest] = run(codes[rest], keys[rest], rate) + np.arange(len(rest))
    return np.concatenate(parts), np.concatenate(sizes), which


def encoded(
    texts: list[str],
    row_keys: np.ndarray,
    tables: Tables,
    seed: int,
    rate: float,
    block: int = CHUNKS,
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and how many each has. ``block`` chunks are cut together."""
    find = tables.chunk.findall
    lists = [find(" " + t) if t else [] for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(lists))
    if not len(flat):
        return np.empty(0, np.int32), counts
    codes, distinct = pd.factorize(flat)
    # a literal U+2581 is a chunk of its own; it must not look like a space
    inner = np.empty(len(distinct), dtype=object)
    inner[:] = [SPACE_LITERAL if x == SPACE else x.replace(" ", SPACE) for x in distinct]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    spread = mixed(np.repeat(row_keys, counts) + place.astype(np.uint64))
    chunk_hashes = hashes_of([x.encode("utf-8", "surrogatepass") for x in distinct], seed)
    keys = mixed(chunk_hashes[codes] + spread)
    del lists, flat, spread, place
    ids, sizes, which = _drawn(inner, codes, keys, tables, rate, block)
    starts = np.cumsum(sizes) - sizes
    taken = sizes[which]
    ends = np.cumsum(taken)
    offset = np.arange(int(ends[-1])) - np.repeat(ends - taken, taken)
    total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return ids[np.repeat(starts[which], taken) + offset], np.diff(total)


# stands for a literal U+2581 while chunks are cut; a character of no text
SPACE_LITERAL = "\udfff"


def decoded(ids: list[int], tables: Tables) -> str:
    table = tables.decoded
    raw = b"".join([table[i] for i in ids])
    return raw[1:].decode()


def _encoded_array(
    column: pa.Array, keys: pa.Array, tables: Tables, seed: int, rate: float
) -> tuple[pa.ListArray, list[str | None]]:
    """Piece ids of a batch of texts, and the texts."""
    texts = column.to_pylist()
    row_keys = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    parts, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for a, b in text_slices([t or "" for t in texts], SLICE_CHARS):
        plain = [t or "" for t in texts[a:b]]
        ids, counts = encoded(plain, row_keys[a:b], tables, seed, rate)
        parts.append(ids)
        sizes.append(counts)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    missing = pa.array([t is None for t in texts], pa.bool_())
    ids = pa.array(np.concatenate(parts), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids, mask=missing), texts


def encode_column(
    text: Column,
    key: Column,
    pieces: Pieces,
    seed: int = 0,
    rate: float = DROPOUT,
) -> Column:
    """Piece ids of each text (array of int)."""

    def encode(column: pa.Array, keys: pa.Array) -> pa.Array:
        return _encoded_array(column, keys, _tables(pieces), seed, rate)[0]

    return F.arrow_udf(encode, "array<int>").asNondeterministic()(text, F.xxhash64(key))


ROUND_TRIP_TYPE = "struct<ids:array<int>,lossless:boolean>"


def round_trip_column(
    text: Column,
    key: Column,
    pieces: Pieces,
    seed: int = 0,
    rate: float = DROPOUT,
) -> Column:
    """``encode_column`` and whether ``decoded`` gives each text back, in one pass.

    A null text is lossless: it stays null.
    """

    def encode(column: pa.Array, keys: pa.Array) -> pa.Array:
        tables = _tables(pieces)
        ids, texts = _encoded_array(column, keys, tables, seed, rate)
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
        same = [
            t is None or decoded(values[a:b].tolist(), tables) == t
            for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)
        ]
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "lossless"])

    return F.arrow_udf(encode, ROUND_TRIP_TYPE).asNondeterministic()(text, F.xxhash64(key))


def decode_column(ids: Column, pieces: Pieces) -> Column:
    """The text of each list of piece ids."""

    def decode(column: pa.Array) -> pa.Array:
        tables = _tables(pieces)
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        missing = column.is_null().to_pylist()
        texts = [
            None if none else decoded(values[a:b].tolist(), tables)
            for a, b, none in zip(offsets[:-1], offsets[1:], missing, strict=True)
        ]
        return pa.array(texts, pa.string())

    return F.arrow_udf(decode, "string").asNondeterministic()(ids)


_made: dict = {}


def _tables(pieces: Pieces) -> Tables:
    # by identity: one task works with one vocabulary, which is kept alive here
    if _made.get("pieces") is not pieces:
        _made.update(pieces=pieces, tables=Tables(pieces))
    return _made["tables"]
