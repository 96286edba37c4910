"""Short items inside long documents: size-partitioned MinHash containment.

MinHash estimates Jaccard similarity, which is tiny for a short item in a long
document. So the items are partitioned by their number of shingles, and for each
partition the documents are seen as domains of a matching size: blocks of half
the partition's upper size, three of which make a window. An item whose shingles
stand together lies in one window whole, and a containment of 0.8 then means a
Jaccard similarity of at least

    0.8 n / (1.5 u + 0.2 n),  n > u / 2 shingles of the item, upper size u

which is 0.25. ``HASHES`` one-row bands miss that with a probability under 1e-6.
An item scattered over a document shares minima with several windows, each less
likely. The bound needs more than half the upper size, and the first partition
starts above ``WHOLE`` shingles: an item of so few is contained only with all of
them, so every document with its least shingle is a candidate, without sampling.
Every candidate (document, item) is then verified on the exact shingle
sets of the whole texts.

The items go to the tasks in blocks of at most ``ITEM_BLOCK``, the bound of what
is sent; each block is one pass over the documents. Documents are never moved.

Defined cases. Words are compared with A-Z in lower case. An item of under five
words has no shingle and is in no document; null texts have no words. Repeated
items are found once each; repeated documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tokens import byte_texts, carried, mixed, shingles, text_slices

SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 48
WHOLE = 4  # items of up to so many shingles must be found whole
SMALLEST = 8  # upper size of the first partition
ITEM_BLOCK = 20_000

_MULTIPLIERS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


class Partition(NamedTuple):
    """Minima of the items of one size, sorted, and whose they are."""

    upper: int
    bits: int
    filters: list[np.ndarray]  # by hash: a bitmap over the minima's first ``bits`` bits
    minima: list[np.ndarray]
    owners: list[np.ndarray]


class Items(NamedTuple):
    ids: list
    shingles: list[np.ndarray]  # sorted, distinct
    partitions: list[Partition]
    least: np.ndarray  # of the items of up to ``WHOLE`` shingles, sorted
    owners: np.ndarray


def _high(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def sketched(ids: list, texts: list[bytes]) -> Items:
    """The items' shingles and their minima by size."""
    found, counts = shingles(texts, SHINGLE)
    ends = np.cumsum(counts)
    sets = [np.unique(found[e - c : e]) for e, c in zip(ends, counts, strict=True)]
    sizes = np.array([len(x) for x in sets], np.int64)
    few = np.flatnonzero((sizes > 0) & (sizes <= WHOLE))
    least_few = np.array([sets[i][0] for i in few], np.uint64)
    few = few[np.argsort(least_few, kind="stable")]
    partitions, upper, lower = [], SMALLEST, WHOLE
    while lower < sizes.max(initial=0):
        inside = np.flatnonzero((sizes > lower) & (sizes <= upper))
        if len(inside):
            filters, minima, owners = [], [], []
            size = min(21, 8 + int(len(inside)).bit_length())
            for multiplier in _MULTIPLIERS:
                least = np.array([(sets[i] * multiplier).min() for i in inside], np.uint64)
                order = np.argsort(least, kind="stable")
                taken = np.zeros(1 << size, bool)
                taken[_high(least, size)] = True
                filters.append(np.packbits(taken))
                minima.append(least[order])
                owners.append(inside[order])
            partitions.append(Partition(upper, size, filters, minima, owners))
        lower, upper = upper, 2 * upper
    return Items(ids, sets, partitions, np.sort(least_few), few)


def _window_starts(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each block of each document, and the document it is in."""
    blocks = -(-counts // block)
    text_of = np.repeat(np.arange(len(counts)), blocks)
    place = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(np.cumsum(counts) - counts, blocks) + place * block
    return starts, text_of


def candidates(found: np.ndarray, counts: np.ndarray, partition: Partition) -> np.ndarray:
    """Distinct (document, item) pairs that agree in a minimum of a window."""
    starts, text_of = _window_starts(counts, max(1, partition.upper // 2))
    pairs = [np.empty((0, 2), np.int64)]
    if not len(starts):
        return pairs[0]
    second = np.append(text_of[1:] == text_of[:-1], False)
    third = np.append(second[:-1] & second[1:], False)
    for k, multiplier in enumerate(_MULTIPLIERS):
        least = np.minimum.reduceat(found * multiplier, starts)
        window = least.copy()
        window[second] = np.minimum(window[second], least[1:][second[:-1]])
        window[third] = np.minimum(window[third], least[2:][third[:-2]])
        high = _high(window, partition.bits)
        hits = np.flatnonzero(
            (partition.filters[k][high >> 3] >> (7 - (high & 7)).astype(np.uint8)) & 1
        )
        first = np.searchsorted(partition.minima[k], window[hits], side="left")
        last = np.searchsorted(partition.minima[k], window[hits], side="right")
        for j in np.flatnonzero(last > first):
            owners = partition.owners[k][first[j] : last[j]]
            pairs.append(np.column_stack([np.full(len(owners), text_of[hits[j]]), owners]))
    return np.unique(np.concatenate(pairs), axis=0)


def whole_candidates(found: np.ndarray, counts: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (document, item) pairs that share a small item's least shingle."""
    if not len(items.least) or not len(found):
        return np.empty((0, 2), np.int64)
    first = np.searchsorted(items.least, found, side="left")
    n = np.searchsorted(items.least, found, side="right") - first
    text_of = np.repeat(np.repeat(np.arange(len(counts)), counts), n)
    place = np.arange(len(text_of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.unique(np.column_stack([text_of, items.owners[place]]), axis=0)


def contained(texts: list[bytes], items: Items) -> list[tuple[int, int, int]]:
    """(document, item, item shingles found) for every item contained enough."""
    found, counts = shingles(texts, SHINGLE)
    pairs = [candidates(found, counts, p) for p in items.partitions]
    pairs.append(whole_candidates(found, counts, items))
    ends, rows = np.cumsum(counts), []
    for document, item in np.concatenate([np.empty((0, 2), np.int64), *pairs]).tolist():
        own = found[ends[document] - counts[document] : ends[document]]
        n = int(np.isin(items.shingles[item], own).sum())
        if n >= CONTAINMENT * len(items.shingles[item]):
            rows.append((document, item, n))
    return sorted(rows)


MATCH_TYPE = "array<struct<item:int,found:int>>"


def match_column(text: Column, items: Items) -> Column:
    """The items in each text: places in ``items.ids`` and shingles found."""

    def match(column: pa.Array) -> pa.Array:
        texts = byte_texts(column)
        places, item, n = [], [], []
        for a, b in text_slices(texts):
            for document, i, found in contained(texts[a:b], items):
                places.append(a + document)
                item.append(i)
                n.append(found)
        offsets = np.searchsorted(np.array(places, np.int64), np.arange(len(texts) + 1))
        values = pa.StructArray.from_arrays(
            [pa.array(item, pa.int32()), pa.array(n, pa.int32())], ["item", "found"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return F.arrow_udf(match, MATCH_TYPE).asNondeterministic()(text)


def item_blocks(
    benchmark: DataFrame, text: str = "text", key: str = "item_id", block: int = ITEM_BLOCK
) -> Iterator[Items]:
    """The items in blocks of at most ``block``; at least one, maybe empty."""
    ids, texts, n = [], [], 0
    for row in benchmark.select(key, text).toLocalIterator():
        ids.append(row[0])
        texts.append((row[1] or "").encode())
        if len(ids) == block:
            yield sketched(ids, texts)
            ids, texts, n = [], [], n + 1
    if ids or not n:
        yield sketched(ids, texts)


def benchmark_matches(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    block: int = ITEM_BLOCK,
) -> DataFrame:
    """(key, item key, ``n_item``, ``n_found``): every item in every document."""
    parts = []
    for items in item_blocks(benchmark, item_text, item_key, block):
        kind = benchmark.schema[item_key].dataType.simpleString()
        listed = df.sparkSession.createDataFrame(
            [(i, x, len(s)) for i, (x, s) in enumerate(zip(items.ids, items.shingles, strict=True))],
            f"_item int, _id {kind}, n_item int",
        )
        matched = df.select(
            F.col(key).alias("_key"), F.explode(match_column(F.col(text), items)).alias("_m")
        )
        named = matched.join(listed, F.col("_m.item") == F.col("_item"))
        parts.append(
            named.select(
                F.col("_key").alias(key),
                F.col("_id").alias(item_key),
                F.col("n_item").cast("bigint"),
                F.col("_m.found").cast("bigint").alias("n_found"),
            )
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def decontaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_key: str = "item_id",
    block: int = ITEM_BLOCK,
) -> DataFrame:
    """The rows of ``df`` whose text contains no item."""
    clean = carried(df, _text=text)
    for items in item_blocks(benchmark, item_text, item_key, block):
        clean = clean.withColumn("_matches", match_column(F.col("_text"), items))
        clean = clean.filter(F.size("_matches") == 0).drop("_matches")
    return clean.select("_row.*")


# Exact containment in plain SQL.
ORACLE = f"""
WITH lowered AS (
  SELECT doc_id AS id, 0 AS kind,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
  UNION ALL
  SELECT item_id, 1,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  FROM benchmark),
words AS (
  SELECT id, kind,
         list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
  FROM lowered WHERE t IS NOT NULL),
shingled AS (
  SELECT DISTINCT id, kind, unnest(list_transform(range(1, len(w) - 3),
           lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM words WHERE len(w) >= {SHINGLE}),
sizes AS (SELECT id, count(*) AS n_item FROM shingled WHERE kind = 1 GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_found
  FROM shingled d JOIN shingled q USING (s) WHERE d.kind = 0 AND q.kind = 1
  GROUP BY d.id, q.id)
SELECT doc_id, item_id, n_item, n_found
FROM shared JOIN sizes ON item_id = sizes.id
WHERE n_found >= {CONTAINMENT} * n_item
"""
