"""Table sources, by catalog name or by path, checked against a row shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from faultline.schema import check_schema


def read_table(
    spark: SparkSession,
    source: str,
    expected: T.StructType | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Scan ``source``, a path if it contains ``/``, else a table name.

    No column is read until a query uses it; ``expected`` is checked on the
    schema alone.
    """
    if "/" in source:
        df = spark.read.format(fmt).load(source)
    else:
        df = spark.table(source)
    return df if expected is None else check_schema(df, expected)
