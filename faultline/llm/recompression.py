"""Substring dedup by recompression of words.

A text's words are renamed in rounds. A run round names every run of one symbol by
(symbol, length); a pair round deals all symbols into left and right ones by a
keyed hash and names every neighbouring (left, right) by the pair. Names are
hashes of what they stand for, so a name means the same in every text of the
corpus, no dictionary is shuffled, and a lost task renames its texts alike. What a
round does with a symbol hangs on its two neighbours only. So a window of
``WINDOW`` words forces a run of interior symbols in each round, whatever stands
around it: its outermost runs are dropped in a run round, a right symbol at its
front and a left one at its end in a pair round. The window's anchor is the
interior symbol that stands for most words, of all rounds from where ``FEW`` of
them are left. Equal windows have equal anchors, and neighbouring windows mostly
share one.

1. A text's last symbol stands for all of it: texts of the same words are grouped
   by their SHA-256, and all but those with the least key lose every word, or
   none if they are shorter than a window. Only the first ones go on.
2. Every text tells its distinct anchors. Grouped by name, combined before the
   shuffle, those of two or more documents are shared; all other windows are
   unique and done with.
3. Texts with shared anchors give their occurrences: the anchor and the extent of
   consecutive windows that hang on it. An extent whose words stand in a smaller
   document is repeated as a whole.
4. Where an anchor has extents of several kinds, as at the edges of every repeat,
   the windows of each kind (those of its least document) are compared one by one.

Names only propose. What is removed is decided by the 128-bit BLAKE2b of the exact
words, joined by a space, for extents and for single windows. A word goes if a
window that covers it also starts in a document with a strictly smaller key;
windows are judged on the input.

Groups are never collected: shares and origins are minima, combined before the
shuffle, and lists are as long as one text. Joins carry no hint, so that adaptive
execution can split a hot name or extent.

Defined cases. Words are maximal runs without space and ``\\x09-\\x0D``. A null
text has no words, and keeps being null in ``substring_dedup``. A text under
``WINDOW`` words keeps all. Rows with one key do not repeat each other, whether
their texts differ or not; equal rows fare alike. A row with a null key is neither
smaller nor larger than any: it keeps its words and takes none. What is left of a
text that loses words is joined by single spaces; other texts stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tokens import (
    Words,
    byte_texts,
    carried,
    hashes_of,
    mixed,
    text_slices,
    words_of,
)
from faultline.sources.scratch import stored

WINDOW = 50

# A run round goes before every eighth pair round.
RUN_EVERY = 8

# Interior symbols from which on a window looks for its longest one.
FEW = 8

# Windows followed through the rounds together.
BLOCK = 1 << 20

_RUN = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xE7037ED1A0B428DB)
_CLASS = 0x8EBC6AF09C88C6E3


class Round(NamedTuple):
    """One round over the symbols of several texts."""

    symbols: np.ndarray  # before the round
    length: np.ndarray  # words of each symbol
    group: np.ndarray  # place of each symbol's name after it
    right: np.ndarray | None  # class of each symbol; None in a run round


def rounds(symbols: np.ndarray, owner: np.ndarray) -> Iterator[Round]:
    """Endless rounds; symbols of different owners are never joined."""
    step, length = 0, np.ones(len(symbols), np.int64)
    while True:
        if step % RUN_EVERY == 0:
            change = np.ones(len(symbols), bool)
            change[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
            group = np.cumsum(change) - 1
            first = np.flatnonzero(change)
            times = np.diff(first, append=len(symbols)).astype(np.uint64)
            yield Round(symbols, length, group, None)
            one = symbols[first]
            symbols = np.where(times > 1, mixed(one ^ _RUN) + mixed(times * _RUN), one)
            length, owner = np.add.reduceat(length, first), owner[first]
        key = np.uint64(_CLASS * (step + 1) % (1 << 64))
        right = (mixed(symbols ^ key) >> np.uint64(63)).astype(bool)
        paired = np.zeros(len(symbols), bool)
        paired[:-1] = ~right[:-1] & right[1:] & (owner[1:] == owner[:-1])
        head = np.ones(len(symbols), bool)
        head[1:] = ~paired[:-1]
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        yield Round(symbols, length, group, right)
        joined = first[paired[first]]
        named = symbols[first]
        named[paired[first]] = mixed(mixed(symbols[joined] ^ _PAIR) * _PAIR + symbols[joined + 1])
        symbols, length, owner = named, np.add.reduceat(length, first), owner[first]
        step += 1


def _longest(now: Round, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the symbol with most words in each [a, b): among equals that of
    the least name, then the first."""
    place = a.copy()
    size, name = now.length[a], now.symbols[a]
    j = 1
    left = np.flatnonzero(a + j < b)
    while len(left):
        at = a[left] + j
        better = (now.length[at] > size[left]) | (
            (now.length[at] == size[left]) & (now.symbols[at] < name[left])
        )
        moved, to = left[better], at[better]
        place[moved], size[moved], name[moved] = to, now.length[to], now.symbols[to]
        j += 1
        left = left[a[left] + j < b[left]]
    return place


class Occurrences(NamedTuple):
    """Runs of consecutive windows with one anchor."""

    name: np.ndarray
    first: np.ndarray  # place of the first window among all words
    n: np.ndarray  # windows


def occurrences(words: Words, size: int = WINDOW) -> Occurrences:
    """The anchors of all windows of ``size`` words, text by text."""
    n_windows = np.maximum(words.counts - size + 1, 0)
    total = int(n_windows.sum())
    if not total:
        empty = np.empty(0, np.int64)
        return Occurrences(np.empty(0, np.uint64), empty, empty)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    before = np.cumsum(n_windows) - n_windows
    starts = np.arange(total) + np.repeat(words.starts - before, n_windows)
    more = rounds(hashes_of(words.distinct)[words.codes], owner)
    done: list[Round] = []
    name, level, place = np.empty(total, np.uint64), np.empty(total, np.int32), np.empty(total, np.int64)
    words_in = np.zeros(total, np.int64)
    for low in range(0, total, BLOCK):
        who = np.arange(low, min(low + BLOCK, total))
        a, b = starts[who], starts[who] + size
        depth = 0
        while len(who):
            if depth == len(done):
                done.append(next(more))
            now = done[depth]
            if now.right is None:
                a2, b2 = now.group[a] + 1, now.group[b - 1]
            else:
                a2 = now.group[a] + now.right[a]
                b2 = now.group[b - 1] + now.right[b - 1]
            last = a2 >= b2
            looked = np.flatnonzero(last | (b - a <= FEW))
            at = _longest(now, a[looked], b[looked])
            mine = who[looked]
            longer = now.length[at] > words_in[mine]
            at, mine = at[longer], mine[longer]
            name[mine], level[mine], place[mine] = now.symbols[at], depth, at
            words_in[mine] = now.length[at]
            a, b, who = a2[~last], b2[~last], who[~last]
            depth += 1
    fresh = np.ones(total, bool)
    fresh[1:] = (
        (level[1:] != level[:-1]) | (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    )
    cuts = np.flatnonzero(fresh)
    return Occurrences(name[cuts], starts[cuts], np.diff(cuts, append=total))


def _sliced(texts: list[bytes]) -> Iterator[tuple[int, Words, list[list[bytes]]]]:
    for low, high in text_slices(texts):
        yield low, words_of(texts[low:high]), [t.split() for t in texts[low:high]]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


PARSED = "struct<n_words:bigint,kept_sha256:string,names:array<bigint>>"


def parsed_column(text: Column, size: int) -> Column:
    """Words, their SHA-256, and the distinct anchors of each text."""

    def parse(column: pa.Array) -> pa.Array:
        counts, shas, names, offsets = [], [], [], [0]
        for _, words, lists in _sliced(byte_texts(column)):
            found = occurrences(words, size)
            cuts = np.searchsorted(found.first, words.starts)
            for i, own in enumerate(lists):
                end = cuts[i + 1] if i + 1 < len(lists) else len(found.name)
                distinct = np.unique(found.name[cuts[i] : end])
                names.append(distinct.view(np.int64))
                offsets.append(offsets[-1] + len(distinct))
                counts.append(len(own))
                shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
        flat = np.concatenate(names) if names else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        columns = [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), lists]
        return pa.StructArray.from_arrays(columns, ["n_words", "kept_sha256", "names"])

    return F.arrow_udf(parse, PARSED).asNondeterministic()(text)


EXTENTS = "array<struct<name:bigint,extent:binary,first:int,n:int>>"


def extents_column(text: Column, shared: Column, size: int) -> Column:
    """The occurrences of ``shared`` anchors with the digest of their words."""

    def cut(column: pa.Array, wanted: pa.Array) -> pa.Array:
        offsets, name, extent, first, n = [0], [], [], [], []
        wanted = [np.array(x, np.int64).view(np.uint64) for x in wanted.to_pylist()]
        for low, words, lists in _sliced(byte_texts(column)):
            found = occurrences(words, size)
            cuts = np.searchsorted(found.first, words.starts)
            for i, own in enumerate(lists):
                end = cuts[i + 1] if i + 1 < len(lists) else len(found.name)
                mine = np.arange(cuts[i], end)
                mine = mine[np.isin(found.name[mine], wanted[low + i])]
                at = (found.first[mine] - words.starts[i]).tolist()
                length = found.n[mine].tolist()
                name.append(found.name[mine].view(np.int64))
                extent += [_digest(own[p : p + k + size - 1]) for p, k in zip(at, length)]
                first += at
                n += length
                offsets.append(len(first))
        flat = np.concatenate(name) if name else np.empty(0, np.int64)
        columns = [
            pa.array(flat, pa.int64()),
            pa.array(extent, pa.binary()),
            pa.array(first, pa.int32()),
            pa.array(n, pa.int32()),
        ]
        values = pa.StructArray.from_arrays(columns, ["name", "extent", "first", "n"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return F.arrow_udf(cut, EXTENTS).asNondeterministic()(text, shared)


WINDOWS = "array<struct<place:int,digest:binary>>"


def windows_column(text: Column, runs: Column, size: int) -> Column:
    """The single windows of ``runs`` (first, n) with the digest of their words."""

    def cut(column: pa.Array, wanted: pa.Array) -> pa.Array:
        offsets, places, digests = [0], [], []
        for raw, mine in zip(byte_texts(column), wanted.to_pylist(), strict=True):
            own = raw.split() if mine else []
            for run in mine or []:
                for p in range(run["first"], run["first"] + run["n"]):
                    places.append(p)
                    digests.append(_digest(own[p : p + size]))
            offsets.append(len(places))
        columns = [pa.array(places, pa.int32()), pa.array(digests, pa.binary())]
        values = pa.StructArray.from_arrays(columns, ["place", "digest"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return F.arrow_udf(cut, WINDOWS).asNondeterministic()(text, runs)


KEPT = "struct<kept:string,n_removed:bigint>"


def kept_column(text: Column, runs: Column, size: int) -> Column:
    """The words outside of all ``runs`` (first, n: windows), joined by a space."""

    def cut(column: pa.Array, removed: pa.Array) -> pa.Array:
        kept, counts = [], []
        for raw, mine in zip(byte_texts(column), removed.to_pylist(), strict=True):
            own = raw.split()
            left, at = [], 0
            for run in sorted(mine or [], key=lambda r: (r["first"], r["n"])):
                left += own[at : run["first"]]
                at = max(at, run["first"] + run["n"] + size - 1)
            left += own[at:]
            kept.append(b" ".join(left).decode())
            counts.append(len(own) - len(left))
        columns = [pa.array(kept, pa.string()), pa.array(counts, pa.int64())]
        return pa.StructArray.from_arrays(columns, ["kept", "n_removed"])

    return F.arrow_udf(cut, KEPT).asNondeterministic()(text, runs)


ROW = ["_key", "_hash"]


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    columns = [F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")]
    return df.select(*columns)


def parsed_texts(df: DataFrame, text: str, key: str, size: int = WINDOW) -> DataFrame:
    """``_key``, ``_hash``, ``n_words``, ``kept_sha256`` and ``names`` of each row."""
    parsed = _keyed(df, text, key).withColumn("_parsed", parsed_column(F.col("_text"), size))
    return stored(parsed.select(*ROW, "_parsed.*"), "parsed")


def first_texts(parsed: DataFrame) -> DataFrame:
    """``parsed`` rows with a key, and ``_low``, the least key of the same words."""
    known = parsed.filter("_key IS NOT NULL")
    lows = known.groupBy("kept_sha256").agg(F.min("_key").alias("_low"))
    return known.join(lows, "kept_sha256")


def suspects(df: DataFrame, parsed: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """First texts that share an anchor with another document, and its extents there."""
    first = first_texts(parsed).filter("_key = _low")
    told = first.select(*ROW, F.explode("names").alias("_name"))
    shared = told.groupBy("_name").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    own = (
        told.join(shared.filter("_low < _high").select("_name"), "_name")
        .groupBy(*ROW)
        .agg(F.collect_set("_name").alias("_names"))
    )
    texts = _keyed(df, text, key).join(own, ROW)
    extents = extents_column(F.col("_text"), F.col("_names"), size)
    return stored(texts.select(*ROW, "_text", extents.alias("_extents")), "suspects")


def judged_extents(found: DataFrame) -> DataFrame:
    """(_key, _hash, _whole, _single): windows that are repeated with their whole
    extent, and those to be compared one by one, as runs (first, n)."""
    seen = found.select(*ROW, F.explode("_extents").alias("_e")).select(*ROW, "_e.*")
    origins = seen.groupBy("name", "extent").agg(F.min("_key").alias("_origin"))
    kinds = origins.groupBy("name").agg(F.count("*").alias("_kinds"))
    known = origins.join(kinds, "name")
    run = F.struct("first", "n")
    whole = F.col("_origin") < F.col("_key")
    single = (F.col("_kinds") > 1) & (F.col("_origin") == F.col("_key"))
    return (
        seen.join(known, ["name", "extent"])
        .filter(whole | single)
        .groupBy(*ROW)
        .agg(
            F.collect_set(F.when(whole, run)).alias("_whole"),
            F.collect_set(F.when(single, run)).alias("_single"),
        )
    )


def shortened_texts(
    df: DataFrame, parsed: DataFrame, text: str, key: str, size: int = WINDOW
) -> DataFrame:
    """``_key``, ``_hash``, ``kept`` and ``n_removed`` of the texts that lose words."""
    found = suspects(df, parsed, text, key, size)
    judged = found.select(*ROW, "_text").join(judged_extents(found), ROW)
    windows = windows_column(F.col("_text"), F.col("_single"), size)
    tested = stored(judged.select(*ROW, "_text", "_whole", windows.alias("_windows")), "tested")

    single = tested.select(*ROW, F.explode("_windows").alias("_w")).select(*ROW, "_w.*")
    origins = single.groupBy("digest").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    repeated = single.join(origins.filter("_low < _high"), "digest").filter("_low < _key")
    hits = repeated.groupBy(*ROW).agg(
        F.collect_set(F.struct(F.col("place").alias("first"), F.lit(1).alias("n"))).alias("_hits")
    )
    runs = F.concat("_whole", F.coalesce("_hits", F.array().cast("array<struct<first:int,n:int>>")))
    short = tested.select(*ROW, "_text", "_whole").join(hits, ROW, "left").withColumn("_runs", runs)
    cut = short.filter(F.size("_runs") > 0).select(
        *ROW, kept_column(F.col("_text"), F.col("_runs"), size).alias("_kept")
    )
    copies = first_texts(parsed).filter(f"_key > _low AND n_words >= {size}")
    copies = copies.select(*ROW, F.lit("").alias("kept"), F.col("n_words").alias("n_removed"))
    return cut.select(*ROW, "_kept.*").unionAll(copies).dropDuplicates(ROW)


def removal_counts(
    df: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW
) -> DataFrame:
    """Per row of ``df``: its key, ``n_words``, ``n_removed`` and ``kept_sha256``."""
    parsed = parsed_texts(df, text, key, size)
    short = shortened_texts(df, parsed, text, key, size).select(
        *ROW, F.sha2("kept", 256).alias("_sha"), "n_removed"
    )
    return parsed.drop("names").join(short, ROW, "left").select(
        F.col("_key").alias(key),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("_sha", "kept_sha256").alias("kept_sha256"),
    )


def substring_dedup(
    df: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW
) -> DataFrame:
    """``df`` without the words of repeated windows in ``text``."""
    parsed = parsed_texts(df, text, key, size)
    short = shortened_texts(df, parsed, text, key, size)
    joined = carried(df, _own=key, _text=text).join(
        short, (F.col("_own") == F.col("_key")) & (F.xxhash64("_text") == F.col("_hash")), "left"
    )
    cleaned = F.coalesce("kept", "_text")
    return joined.select(
        *[cleaned.alias(c) if c == text else F.col(f"_row.`{c}`") for c in df.columns]
    )
