"""Class counts and class probabilities per batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.vectors import class_probabilities
from faultline.operators.sequence import batch_keys
from faultline.schema import CLASSES

CODE = "fault_type_coded"


def count_names(classes: Sequence[int] = CLASSES) -> list[str]:
    return [f"n{k}" for k in classes]


def count_columns(classes: Sequence[int] = CLASSES, code: str = CODE) -> list[Column]:
    """Aggregates: rows of each class. Rows without a class count nowhere."""
    names = count_names(classes)
    return [F.count_if(F.col(code) == k).alias(n) for k, n in zip(classes, names)]


def class_counts(df: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """One row per batch with a count per class, in one partially aggregated pass."""
    return df.groupBy(*batch_keys(df)).agg(*count_columns(classes))


def class_counts_pivoted(df: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """As ``class_counts``, as a pivot over a given class list.

    The list saves the job that would look for the classes, and keeps a column
    for a class that does not occur.
    """
    counts = df.groupBy(*batch_keys(df)).pivot(CODE, list(classes)).count().fillna(0)
    return counts.withColumnsRenamed(
        {str(k): n for k, n in zip(classes, count_names(classes))}
    )


def class_target(counts: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Counts -> ``fault_type``, the array of class probabilities."""
    shares = class_probabilities([F.col(n) for n in count_names(classes)])
    return counts.select(*batch_keys(counts), shares.alias("fault_type"))
