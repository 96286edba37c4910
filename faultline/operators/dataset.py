"""Features and target brought together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.vectors import (
    argmax_label,
    class_probabilities,
    ordered_steps,
    transposed,
)
from faultline.operators.sequence import INDEX, PART, batch_keys
from faultline.operators.targets import count_columns, count_names
from faultline.schema import BATCH_SIZE, CLASSES, MEASURES


def join_target(features: DataFrame, target: DataFrame) -> DataFrame:
    """Every feature row with its batch's target.

    Both sides come out of an aggregation by ``batch_id``, so the join adds no
    shuffle.
    """
    both = [c for c in batch_keys(features) if c in target.columns]
    joined = features.join(target, both, "left")
    return joined.drop(PART)


def build_dataset(
    df: DataFrame,
    measures: Sequence[str] = MEASURES,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """``features`` and ``fault_type`` per batch out of one aggregation."""
    grouped = df.groupBy(*batch_keys(df)).agg(
        ordered_steps(F.col(INDEX), measures).alias("features"), *count_columns(classes)
    )
    shares = class_probabilities([F.col(n) for n in count_names(classes)])
    return grouped.select("batch_id", "features", shares.alias("fault_type"))


def model_rows(
    dataset: DataFrame, size: int = BATCH_SIZE, channels: int = len(MEASURES)
) -> DataFrame:
    """Channel-first float features and the hard label, as a model takes them,
    after the other columns of ``dataset``.

    The length of each sequence is checked on the way: a wrong one fails the
    query instead of reaching a model.
    """
    right = F.size("features") == size
    message = F.concat(
        F.lit("batch "),
        F.col("batch_id").cast("string"),
        F.lit(f" does not have {size} steps"),
    )
    steps = F.when(right, F.col("features")).otherwise(F.raise_error(message))
    others = [c for c in dataset.columns if c not in ("features", "fault_type")]
    return dataset.select(
        *others,
        transposed(steps, channels).alias("features"),
        argmax_label(F.col("fault_type")).alias("label"),
    )
