"""Fault label columns for whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.labels import (
    bus_location,
    fault_code,
    normalised_label,
    phase_letters,
)
from faultline.schema import CLASS_CODES


def code_rows(
    df: DataFrame, label: str = "fault_class", codes: dict[str, int] = CLASS_CODES
) -> DataFrame:
    """Normalise ``label`` in place and add bus, phase letters and class number.

    No shuffle and no Python worker, and columns a query does not ask for are
    never computed.
    """
    return (
        df.withColumn(label, normalised_label(F.col(label)))
        .withColumns(
            {
                "Bus_loc": bus_location(F.col(label)),
                "extracted_letters": phase_letters(F.col(label)),
            }
        )
        .withColumn("fault_type_coded", fault_code(F.col("extracted_letters"), codes))
    )


def code_counts(df: DataFrame, code: str = "fault_type_coded") -> DataFrame:
    """Rows per class; ``n_coded`` skips nulls, so it is 0 for the null group."""
    return df.groupBy(code).agg(F.count(code).alias("n_coded"), F.count("*").alias("n_rows"))
