"""Saved pipelines, their versions, and the latest of each name."""

from __future__ import annotations

from datetime import datetime, timezone
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.learning.model import SIGNATURE, signature
from faultline.schema import MODELS


def read_models(spark: SparkSession, root: str) -> DataFrame:
    """The table of saved models under ``root``."""
    entries = spark.read.schema(MODELS).option("recursiveFileLookup", True)
    return entries.parquet(f"{root}/models")


def latest_models(models: DataFrame) -> DataFrame:
    """Name, version and path of the newest version of each model."""
    return models.groupBy("name").agg(
        F.max("version").alias("version"), F.max_by("path", "version").alias("path")
    )


def latest_model_path(models: DataFrame, name: str) -> str:
    row = latest_models(models.filter(F.col("name") == name)).first()
    if row is None:
        raise LookupError(f"no saved model named {name}")
    return row["path"]


# Some file systems, the local one among them, look first and create then: within
# one driver the lock makes that one step.
_claiming = Lock()


def _claimed(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not exist; False if it does."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with _claiming:
        try:
            files.create(file, False).close()
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error) and "already exists" not in str(error):
                raise
            return False
    return True


def save_version(model: PipelineModel, spark: SparkSession, root: str, name: str) -> int:
    """Save ``model`` as the next free version of ``name`` and return the version.

    A version is claimed before its model is written, by a file that the file system
    creates only if there is none. Of several writers each gets its own, and
    whoever fails leaves a claim without a model, which nobody lists or loads. The
    model's signature is saved beside it.
    """
    try:
        saved = read_models(spark, root).filter(F.col("name") == name)
        newest = saved.agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None  # the first model of all
    version = (newest or 0) + 1
    while True:
        path = f"{root}/{name}/{version}"
        if _claimed(spark, f"{root}/_claims/{name}/{version}"):
            try:
                model.write().save(path)
                break
            except (Py4JJavaError, IllegalArgumentException, AnalysisException) as error:
                # saved by someone who claims nothing: never replace a model
                if "already exists" not in str(error):
                    raise
        version += 1
    inputs = spark.createDataFrame(signature(model), SIGNATURE).coalesce(1)
    inputs.write.parquet(f"{root}/_signatures/{name}/{version}")
    entry = [(name, version, path, datetime.now(timezone.utc))]
    # a folder for each entry: two jobs that append to one folder undo each other
    spark.createDataFrame(entry, MODELS).coalesce(1).write.parquet(f"{root}/models/{name}-{version}")
    return version


def read_signature(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    """Inputs and outputs of a saved version: role, name, type, length."""
    return spark.read.schema(SIGNATURE).parquet(f"{root}/_signatures/{name}/{version}")


def load_latest(spark: SparkSession, root: str, name: str) -> PipelineModel:
    return PipelineModel.load(latest_model_path(read_models(spark, root), name))
