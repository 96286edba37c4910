"""Per-row and per-batch features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.vectors import ordered_steps
from faultline.operators.exact import exact_sums
from faultline.operators.sequence import INDEX, PART, batch_keys
from faultline.schema import MEASURES


def rounded(
    df: DataFrame,
    others: Sequence[str],
    measures: Sequence[str] = MEASURES,
    digits: int = 3,
) -> DataFrame:
    """``others`` as they are, then ``measures`` rounded half-up to ``digits``."""
    return df.select(*others, *[F.round(m, digits).alias(m) for m in measures])


def sequences(df: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per batch with ``features``: its rows' measures in row order.

    A batch holds a fixed number of rows, so no group outgrows a task.
    """
    return df.groupBy(*batch_keys(df)).agg(ordered_steps(F.col(INDEX), measures).alias("features"))


def feature_sizes(df: DataFrame) -> DataFrame:
    """Number of batches by sequence length; one row if all are the same.

    Takes either sequences or the rows they would be made of. Rows are counted,
    combined before the shuffle, and no measure is read.
    """
    if "features" not in df.columns:
        df = df.groupBy(*batch_keys(df)).agg(F.count("*").cast("int").alias("feature_size"))
    else:
        df = df.select(F.size("features").alias("feature_size"))
    return df.groupBy("feature_size").agg(F.count("*").alias("n_batches"))


def long_steps(df: DataFrame, features: Column, names: tuple[str, str]) -> DataFrame:
    """A nested array as (batch_id, outer position, inner position, value) rows."""
    outer, inner = names
    return (
        df.select("batch_id", F.posexplode(features).alias(outer, "_inner"))
        .select("batch_id", outer, F.posexplode("_inner").alias(inner, "value"))
    )


def summary_columns(measures: Sequence[str] = MEASURES) -> list[Column]:
    """Aggregates: sum, minimum and maximum of each measure.

    Sums are of doubles: their last digits depend on the order in which partial
    results arrive (``batch_summary`` has exact ones). NaN and infinity come through
    as such.
    """
    columns = []
    for m in measures:
        columns += [
            F.sum(m).alias(f"{m}_sum"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    return columns


def summary_names(measures: Sequence[str] = MEASURES) -> list[str]:
    return [f"{m}_{part}" for m in measures for part in ("sum", "min", "max")]


def batch_summary(
    df: DataFrame, measures: Sequence[str] = MEASURES, places: range | None = None
) -> DataFrame:
    """One row per batch with the summary of each measure.

    Aggregates on the map side, so far fewer bytes are shuffled than for
    ``sequences``. With the ``places`` of the values (``exact_places``) sums are
    exact: the same bits whatever the order of the rows.
    """
    keys = batch_keys(df)
    if places is None:
        return df.groupBy(*keys).agg(*summary_columns(measures)).drop(PART)
    totals = exact_sums(df, keys, measures, places, ends=True)
    return totals.select("batch_id", *summary_names(measures))
