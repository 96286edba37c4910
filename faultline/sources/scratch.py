"""Where intermediate tables go: a folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# The folder of the innermost ``scratch_scope``, if there is one.
_scope: ContextVar[str | None] = ContextVar("scratch scope", default=None)


def application_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Without that setting it lies in the warehouse, which executors share as well.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/faultline/{context.applicationId}"


def lasting_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's folder that ``clear_scratch`` leaves."""
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    folder = _scope.get() or f"{application_folder(spark)}/intermediate"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the table read back.

    Later jobs start from the files: nothing before them runs again, also not
    when an executor is lost.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of ``scratch_path`` or ``lasting_path`` that no frame needs."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside the block when it ends.

    Frames that leave the block must not need them: write their rows first.
    """
    folder = scratch_path(spark, "scope")
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        discard(spark, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no frame needs them."""
    discard(spark, f"{application_folder(spark)}/intermediate")
