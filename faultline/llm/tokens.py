"""Words of many texts at once, as numpy arrays.

A word is a maximal run of characters other than space and ``\\x09-\\x0D``. On
UTF-8 bytes that is what ``bytes.split()`` cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts handled together, so that a batch of long texts does not pile up words.
SLICE_BYTES = 2 << 20


class Words(NamedTuple):
    """Words of several texts: a code for each word, text after text."""

    codes: np.ndarray  # int64, places in ``distinct``
    distinct: list[bytes]
    counts: np.ndarray  # words of each text
    starts: np.ndarray  # place of each text's first word


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts, each of about ``limit`` bytes or one text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def words_of(texts: list[bytes]) -> Words:
    lists = [t.split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(lists))
    codes, distinct = pd.factorize(flat)
    return Words(codes, list(distinct), counts, np.cumsum(counts) - counts)


def hashes_of(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in distinct), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of ``x``."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def per_text(values: np.ndarray, words: Words) -> np.ndarray:
    """Sum of ``values`` (one for each word) over each text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[words.starts + words.counts] - sums[words.starts]


def windows(word_hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words inside one text, and its place."""
    n = len(words.codes)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rolled = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + word_hashes[j : n - size + 1 + j]
    ends = np.repeat(words.starts + words.counts, words.counts)
    places = np.flatnonzero(np.arange(n - size + 1) + size <= ends[: n - size + 1])
    return mixed(rolled[places]), places


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text, and their counts by text.

    Words are compared with A-Z in lower case. A text of fewer words has none.
    """
    words = words_of([t.lower() for t in texts])
    word_hashes = hashes_of(words.distinct)[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    found, _ = windows(word_hashes, words, size)
    return found, np.maximum(words.counts - size + 1, 0)


def carried(df: DataFrame, **named: str) -> DataFrame:
    """The whole row of ``df`` as ``_row``, beside the named columns, so that no
    column a step adds can clash with one of ``df``."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(row, *[F.col(c).alias(name) for name, c in named.items()])
