"""The three steps from a parameter sweep to a saved classifier, table to table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import operators as ops
from faultline.learning import (
    FLATTENED,
    evaluate,
    fault_pipeline,
    fit,
    flattened_frame,
    save_version,
)
from faultline.operators.sweep import Simulator
from faultline.schema import BATCH_SIZE, MEASURES, SIMULATION
from faultline.sources import overwrite_table, read_table, scratch_scope


def generate_simulations(
    spark: SparkSession, simulate: Simulator, output: T.StructType, n: int, table: str
) -> DataFrame:
    """Run ``simulate`` on ``n`` log-spaced parameter sets and store the rows.

    ``output`` must keep ``id`` and ``Ron``; give it a step number as well, as the
    rows of a table have no order of their own.
    """
    params = ops.log_sweep(ops.run_ids(spark, n), n)
    return overwrite_table(ops.sweep_grouped(params, simulate, output), table)


def prepare_dataset(
    spark: SparkSession,
    source: str,
    order_by: Sequence[str],
    table: str,
    size: int = BATCH_SIZE,
    train: float = 0.7,
    val: float = 0.15,
    seed: int = 0,
) -> DataFrame:
    """Simulation rows -> stored sequences with target, partitioned by split.

    Leaves no intermediate tables behind.
    """
    simulation = read_table(spark, source, SIMULATION)
    with scratch_scope(spark):
        batches = ops.colocated_batches(
            simulation, order_by, size, keep=["fault_type_coded", *MEASURES], derive=ops.code_rows
        )
        ids = ops.full_batch_ids(batches.rows, size, batches.total)
        rows = ops.full_batches(batches.rows, size)
        dataset = ops.assign_split(ops.build_dataset(rows), ids, train=train, val=val, seed=seed)
        return overwrite_table(dataset, table, partition_by=["split"])


def train_classifier(
    spark: SparkSession,
    table: str,
    root: str,
    name: str,
    size: int = BATCH_SIZE,
    max_iter: int = 5,
    seed: int = 0,
) -> tuple[int, DataFrame]:
    """Fit on the ``train`` part of ``table`` and save the model under ``root``.

    Returns the model's version and its metrics on every part.
    """
    frame = flattened_frame(ops.model_rows(read_table(spark, table), size))
    pipeline = fault_pipeline(
        [FLATTENED], size * len(MEASURES), max_iter=max_iter, seed=seed
    )
    with ops.cached(frame.filter(F.col("split") == "train")) as rows:
        model = fit(pipeline, rows)
    version = save_version(model, spark, root, name)
    return version, evaluate(model.transform(frame))
