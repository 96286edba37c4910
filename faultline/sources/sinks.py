"""Schema handling and replacing table sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVENANCE = "written_by"

# Between a table's name and the mark of one of its versions.
_VERSION = "__v"


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{at}")


@contextmanager
def schema_in_use(
    spark: SparkSession, name: str, location: str | None = None
) -> Iterator[None]:
    """Create the schema if needed, use it inside the block, then restore the old one."""
    before = spark.catalog.currentDatabase()
    create_schema(spark, name, location)
    spark.sql(f"USE SCHEMA {name}")
    try:
        yield
    finally:
        spark.catalog.setCurrentDatabase(before)


def overwrite_table(
    df: DataFrame,
    table: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    provenance: bool = False,
    bucket_by: tuple[int, str] | None = None,
) -> DataFrame:
    """Replace ``table`` by the rows of ``df`` and return the stored table.

    The rows are written to a table of their own, a new version, and ``table`` is a
    view of one version. When all rows are there the view is switched, which is one
    change of the catalog: a writer that fails leaves the old rows, readers see the
    old rows or the new ones, and ``df`` may read ``table``. The version before stays
    for those who are reading it; older ones, and those of failed writers, are
    dropped. Of two writers at once the later switch wins.

    ``fmt`` takes any installed table format. ``provenance`` adds the session user as
    a column. ``bucket_by``, (number, column), deals the rows into that many buckets
    by the column and sorts them by it, so that joins and aggregations by it, with
    tables of as many buckets, need no shuffle.
    """
    spark = df.sparkSession
    if provenance:
        df = df.withColumn(PROVENANCE, F.current_user())
    *schema, name = table.split(".")
    prefix = ".".join(schema) + "." if schema else ""
    shown = _versions(spark, prefix, name)
    current = _viewed(spark, prefix, name)
    fresh = f"{name}{_VERSION}{uuid.uuid4().hex}"

    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by is not None:
        buckets, column = bucket_by
        writer = writer.bucketBy(buckets, column).sortBy(column)
    try:
        writer.saveAsTable(f"{prefix}{fresh}")
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{fresh}")
        raise
    if current == name:
        # a plain table, not written by this function, becomes the first version
        current = f"{name}{_VERSION}{uuid.uuid4().hex}"
        spark.sql(f"ALTER TABLE {table} RENAME TO {prefix}{current}")
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {prefix}{fresh}")
    for version in shown:
        if version != current:
            spark.sql(f"DROP TABLE IF EXISTS {prefix}{version}")
    return spark.table(table)


def _versions(spark: SparkSession, prefix: str, name: str) -> list[str]:
    """Names of the versions of a table that the catalog holds."""
    schema = f" IN {prefix.rstrip('.')}" if prefix else ""
    found = spark.sql(f"SHOW TABLES{schema} LIKE '{name}{_VERSION}*'").collect()
    return [row["tableName"] for row in found]


def _viewed(spark: SparkSession, prefix: str, name: str) -> str | None:
    """What ``name`` stands for: the version its view shows, itself if it is a plain
    table, None if there is neither."""
    if not spark.catalog.tableExists(f"{prefix}{name}"):
        return None
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {prefix}{name}").collect()
    described = {row["col_name"]: row["data_type"] for row in found}
    if described.get("Type") != "VIEW":
        return name
    return described["View Text"].rsplit(".", 1)[-1].rsplit(" ", 1)[-1].strip("`")
