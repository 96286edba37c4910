"""Arithmetic and array expressions over measures, counts and sequences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_from_origin(x: Column, y: Column) -> Column:
    return F.sqrt(F.pow(x, F.lit(2)) + F.pow(y, F.lit(2)))


def class_probabilities(counts: Sequence[Column]) -> Column:
    """Share of each class among the classified rows; nulls when there are none."""
    total = reduce(add, counts)
    return F.array(*[F.try_divide(count, total) for count in counts])


def argmax_label(probabilities: Column) -> Column:
    """0-based place of the largest value, the first one on ties, null if all null."""
    place = F.array_position(probabilities, F.array_max(probabilities))
    return (place - 1).cast("int")


def ordered_steps(index: Column, measures: Sequence[str]) -> Column:
    """Aggregate: the group's rows as an array of measure arrays in index order.

    collect_list promises no order, so the index travels along and is dropped
    after the sort.
    """
    step = F.struct(index.alias("at"), F.array(*measures).alias("values"))
    return F.transform(F.sort_array(F.collect_list(step)), lambda s: s["values"])


def transposed(steps: Column, channels: int, element_type: str = "float") -> Column:
    """(step, channel) array -> (channel, step) array of ``element_type``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda c: F.transform(steps, lambda step: F.get(step, c).cast(element_type)),
    )
