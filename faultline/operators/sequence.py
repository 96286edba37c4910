"""Dense row numbers and fixed-length batches without a single-task sort.

``row_number()`` over an unpartitioned window pulls every row into one task.
Here rows are range-partitioned by the whole sort key and sorted inside each
partition, so a leading value shared by a third of all rows is still cut into
many partitions. The sorted rows are stored once, with the place each row took
in its partition. A row's number is then that place plus the size of all
earlier partitions, which is one small lookup. Storing makes the numbers facts
of the data: whatever is later built from them, in however many jobs, and after
however many lost executors, agrees on which row is in which batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.schema import BATCH_SIZE
from faultline.sources.scratch import stored

# Adds columns to a frame without moving, dropping or multiplying rows.
RowLocal = Callable[[DataFrame], DataFrame]

INDEX = "row_index"
TOTAL = "row_total"
PART = "batch_part"

# monotonically_increasing_id() is documented as: partition number above bit 33,
# place in the partition below it.
PLACE_BITS = 33

# What a task gets of the wide rows of ``colocated_batches``, about, before compression.
PART_BYTES = 128 << 20


def add_row_index(
    df: DataFrame,
    order_by: Sequence[str],
    keep: Sequence[str] | None = None,
    derive: RowLocal | None = None,
    ties: str = "fail",
) -> DataFrame:
    """Add ``row_index`` (0-based, by ``order_by``, nulls first) and ``row_total``.

    Runs one job. ``derive`` adds row-local columns after the rows are in order,
    so that they are computed once and not again when the range partitioner
    samples its input. Only ``keep`` (default: all columns) is stored and
    returned; columns not needed for it are not read.

    ``order_by`` must tell rows apart, as equal rows would be numbered by the
    layout of files. ``ties`` says what about that:

    * ``"fail"``: fail with a key that repeats. It is looked for while the sorted
      rows are stored, which takes neither a pass nor a shuffle of its own.
    * ``"promised"``: the caller knows that no two rows agree; nothing is counted.
    * ``"scan"``: rows that agree stay in scan order, which also spreads copies of
      one row over several partitions. That takes a frame made of a scan and
      row-local steps, whose row order repeats when a task is retried.
    """
    if ties not in ("fail", "promised", "scan"):
        raise ValueError(f"ties must be fail, promised or scan, not {ties}")
    key = list(order_by)
    rows = df
    if ties == "scan":
        rows = rows.withColumn("_scan_order", F.monotonically_increasing_id())
        key.append("_scan_order")

    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    place = F.monotonically_increasing_id()
    if ties == "fail":
        ordered, place = _alone(ordered, key, [], place)
    placed = ordered.withColumn("_place", place)
    if derive is not None:
        placed = derive(placed)
    if keep is None:
        keep = [c for c in placed.columns if c not in ("_scan_order", "_place", "_same")]

    placed = _stored_alone(placed.select(*keep, "_place")).withColumns(
        {
            "_part": F.shiftright("_place", PLACE_BITS),
            "_place": F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1),
        }
    )

    # One row per range partition, whatever the data: small enough to broadcast.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    in_order = Window.orderBy("_part")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias(TOTAL),
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *keep, (F.col("_before") + F.col("_place")).alias(INDEX), TOTAL
    )


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or fail if two rows agree in ``key``.

    Counts on the map side, so copies of one row do not meet in one task first.
    """
    repeated = df.groupBy(*key).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    example = repeated.first()
    if example is not None:
        values = {c: example[c] for c in key}
        raise ValueError(f"{example['_rows']} rows have the key {values}")
    return df


def _alone(
    ordered: DataFrame, key: Sequence[str], within: Sequence[str], place: Column
) -> tuple[DataFrame, Column]:
    """``place``, failing the query at a row whose ``key`` another row has as well.

    ``ordered`` is partitioned by ``within`` and the key and sorted by them, so the
    window over equal rows needs no shuffle and no sort.
    """
    ordered = ordered.withColumn("_same", F.count("*").over(Window.partitionBy(*within, *key)))
    named = []
    for c in key:
        shown = F.col(c).cast("string")
        if ordered.schema[c].dataType.typeName() == "string":
            shown = F.concat(F.lit("'"), shown, F.lit("'"))
        named.append(F.concat(F.lit(f"'{c}': "), F.coalesce(shown, F.lit("None"))))
    message = F.concat(
        F.col("_same").cast("string"),
        F.lit(" rows have the key {"),
        F.concat_ws(", ", *named),
        F.lit("}"),
    )
    failed = F.raise_error(message).cast("bigint")
    return ordered, F.when(F.col("_same") == 1, place).otherwise(failed)


def _stored_alone(placed: DataFrame) -> DataFrame:
    """``stored``, with a repeated key as a ValueError."""
    try:
        return stored(placed, "indexed")
    except (Py4JJavaError, PySparkException) as error:
        repeated = re.search(r"\d+ rows have the key \{.*\}", str(error))
        if repeated is None:
            raise
        raise ValueError(repeated[0]) from error


def _batch_of(index: str, size: int) -> Column:
    return F.expr(f"{index} div {size}") + 1


def add_batches(
    df: DataFrame,
    order_by: Sequence[str],
    size: int = BATCH_SIZE,
    keep: Sequence[str] | None = None,
    derive: RowLocal | None = None,
    ties: str = "fail",
) -> DataFrame:
    """Cut the ordered rows into batches of ``size``, numbered from 1.

    Adds ``row_index``, ``row_total`` and ``batch_id``. ``keep``, ``derive`` and
    ``ties`` are as in ``add_row_index``.
    """
    rows = add_row_index(df, order_by, keep, derive, ties)
    return rows.withColumn("batch_id", _batch_of(INDEX, size))


class Colocated(NamedTuple):
    """Rows of which every batch lies in one partition, and their number."""

    rows: DataFrame
    total: int


def colocated_batches(
    df: DataFrame,
    order_by: Sequence[str],
    size: int = BATCH_SIZE,
    keep: Sequence[str] | None = None,
    derive: RowLocal | None = None,
    ties: str = "fail",
    parts: int | None = None,
) -> Colocated:
    """``add_batches`` with one shuffle of the wide rows, which also serves any
    aggregation by batch.

    The key columns alone are numbered first (one narrow shuffle), which gives the
    keys where each of ``parts`` equal runs of whole batches begins: one key for each
    partition comes to the driver. There are as many parts as the session has shuffle
    partitions, and with more rows one for each ``PART_BYTES`` of them.
    Each row then finds its part by a binary search among them and is sent there,
    sorted, and numbered by its place. ``batch_part`` is the part; Spark knows that
    it decides the partition, so ``groupBy(*batch_keys(rows))`` adds no exchange.

    Nothing but the keys is stored. The numbers are the same in every run of the
    plan as the key tells rows apart: ``ties`` is ``"fail"`` or ``"promised"``.
    ``keep`` and ``derive`` are as in ``add_row_index``.
    """
    if ties not in ("fail", "promised"):
        raise ValueError(f"ties must be fail or promised, not {ties}")
    key = list(order_by)
    numbered = add_row_index(df.select(*key), key, key, ties=ties)
    total = numbered.agg(F.count("*")).first()[0]
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(parts, -(-total * _row_bytes(df) // PART_BYTES))
    batches = -(-total // size)
    run = max(1, -(-batches // parts)) * size
    borders = (
        numbered.filter((F.col(INDEX) > 0) & (F.col(INDEX) % run == 0)).orderBy(INDEX).collect()
    )
    part = _part_of(df, key, borders)
    sent = df.withColumn(PART, part).repartitionById(parts, F.col(PART))
    ordered = sent.sortWithinPartitions(PART, *key)
    place = F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)
    rows = ordered.withColumn(INDEX, F.col(PART).cast("bigint") * run + place)
    if derive is not None:
        rows = derive(rows)
    if keep is None:
        keep = [c for c in rows.columns if c not in (PART, INDEX)]
    rows = rows.select(*keep, PART, INDEX, F.lit(total).cast("bigint").alias(TOTAL))
    return Colocated(rows.withColumn("batch_id", _batch_of(INDEX, size)), total)


def _row_bytes(df: DataFrame) -> int:
    """Of a row in a shuffle, about: strings and nested values count as 32."""
    plain = (T.NumericType, T.DatetimeType, T.BooleanType)
    return sum(8 if isinstance(field.dataType, plain) else 32 for field in df.schema)


def _part_of(df: DataFrame, key: Sequence[str], borders: Sequence[Row]) -> Column:
    """How many of the sorted ``borders`` are at or before the row's key."""
    if not borders:
        return F.lit(0)

    def value(c: str, x: Any) -> Column:
        return F.lit(x).cast(df.schema[c].dataType).alias(c)

    listed = F.array(*[F.struct(*[value(c, row[c]) for c in key]) for row in borders])
    own = F.struct(*[F.col(c) for c in key])
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]

    def step(low: Column, width: int) -> Column:
        there = F.get(listed, low + (width - 1))
        return F.when((low + width <= len(borders)) & (there <= own), low + width).otherwise(low)

    search = F.aggregate(
        F.array(*[F.lit(w) for w in steps]), F.lit(0), lambda low, w: step(low, w)
    )
    return search


def batch_keys(df: DataFrame) -> list[str]:
    """What to group ``df`` by to have one group for each batch, without a shuffle
    if its batches are colocated."""
    return [c for c in (PART, "batch_id") if c in df.columns]


def add_keyed_batches(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    size: int = BATCH_SIZE,
    keep: Sequence[str] | None = None,
    ties: str = "fail",
) -> DataFrame:
    """Cut the rows of each ``key`` into batches of ``size``, numbered from 1.

    A window per key would sort a hot key in one task. Instead all rows are
    numbered by (key, order) and each key's first number, which aggregates on
    the map side, is taken off. The join carries no hint: it is a broadcast
    when the keys are measured to be few, and otherwise a sort-merge join whose
    hot partitions adaptive execution splits.
    """
    keep = list(dict.fromkeys([key, *(df.columns if keep is None else keep)]))
    rows = add_row_index(df, [key, *order_by], keep, ties=ties)
    starts = rows.groupBy(F.col(key).alias("_key")).agg(F.min(INDEX).alias("_start"))
    return (
        rows.join(starts, F.col(key).eqNullSafe(F.col("_key")))
        .withColumn(INDEX, F.col(INDEX) - F.col("_start"))
        .withColumn("batch_id", _batch_of(INDEX, size))
        .select(*keep, INDEX, "batch_id")
    )


def full_batches(df: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Drop the incomplete batch at the end, if there is one."""
    return df.filter(F.col("batch_id") <= F.expr(f"{TOTAL} div {size}"))


def full_batch_ids(
    df: DataFrame, size: int = BATCH_SIZE, total: int | None = None
) -> DataFrame:
    """The ``batch_id`` of every full batch, from the number of rows alone, which
    ``total`` gives if it is known."""
    if total is None:
        first = df.select(TOTAL).first()
        total = first[TOTAL] if first is not None else 0
    return df.sparkSession.range(1, total // size + 1).withColumnRenamed("id", "batch_id")


def drop_batches(df: DataFrame, ids: Iterable[int]) -> DataFrame:
    """Drop the batches with the listed numbers."""
    return df.filter(~F.col("batch_id").isin(*ids))
