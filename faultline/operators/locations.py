"""Distances to the substation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.vectors import distance_from_origin
from faultline.operators.sequence import check_unique
from faultline.schema import UNFAULTED_CODE

DISTANCE = "distance_sub_station"


def with_distance(locations: DataFrame) -> DataFrame:
    """Add each location's straight-line distance to the substation at (0, 0)."""
    return locations.withColumn(
        DISTANCE, distance_from_origin(F.col("X_Coord"), F.col("Y_Coord"))
    )


def attach_distance(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """Coded rows with the distance of their bus; null for unknown or no bus.

    A bus name that repeats in ``locations`` is an error: it would repeat rows.
    Fault-free rows carry a stand-in bus and must not match a real one of the
    same name. The join carries no hint: Spark broadcasts the locations when
    their measured size is under its threshold, and otherwise sort-merges, with
    the partitions of a hot bus (and of the null key) split by adaptive
    execution.
    """
    named = check_unique(locations.filter(F.col("Bus_loc").isNotNull()), ["Bus_loc"])
    places = with_distance(named).select(F.col("Bus_loc").alias("_bus"), DISTANCE)
    faulted = F.col("fault_type_coded").isNull() | (
        F.col("fault_type_coded") != UNFAULTED_CODE
    )
    return (
        rows.withColumn("_at", F.when(faulted, F.col("Bus_loc")))
        .join(places, F.col("_at") == F.col("_bus"), "left")
        .drop("_at", "_bus")
    )
