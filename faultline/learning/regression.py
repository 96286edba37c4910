"""How far from the substation a fault is: a regression on the measures of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.locations import DISTANCE, attach_distance
from faultline.schema import MEASURES, check_schema


def distance_frame(
    rows: DataFrame, locations: DataFrame, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Coded rows in batches -> ``batch_id``, the measures, and the distance of the
    row's bus as ``label``.

    Rows without a fault, and those at a bus that ``locations`` lacks or has without
    a place, have no distance and are left out.
    """
    known = F.col(DISTANCE).isNotNull() & ~F.isnan(DISTANCE)
    return (
        attach_distance(rows, locations)
        .filter(known)
        .select("batch_id", *measures, F.col(DISTANCE).alias("label"))
    )


def distance_pipeline(
    inputs: Sequence[str] = MEASURES, trees: int = 20, depth: int = 6, seed: int = 0
) -> Pipeline:
    """A forest of regression trees on ``inputs``.

    Trees grow level by level: each level is one aggregation of split statistics,
    whose size follows trees, bins and inputs and not the rows.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(inputs), outputCol="assembled"),
            RandomForestRegressor(
                featuresCol="assembled",
                labelCol="label",
                numTrees=trees,
                maxDepth=depth,
                seed=seed,
            ),
        ]
    )


def predict_distance(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """``frame`` with ``prediction``; inputs the model was not fitted for fail by name."""
    inputs = model.stages[0].getInputCols()
    check_schema(frame, T.StructType([T.StructField(c, T.DoubleType()) for c in inputs]))
    return model.transform(frame).select(*frame.columns, "prediction")


def regression_metrics(scored: DataFrame, by: str = "split") -> DataFrame:
    """(``by``, metric, value) rows: rmse, mae and r2, in one pass.

    Rows without label or prediction count nowhere. ``r2`` is null where all labels
    are equal, as it compares with their spread.
    """
    error = F.col("label") - F.col("prediction")
    known = scored.filter(error.isNotNull())
    sums = known.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum(error * error).alias("squared"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("label").alias("spread"),
    )
    return sums.select(
        by,
        F.sqrt(F.col("squared") / F.col("n")).alias("rmse"),
        "mae",
        (1 - F.try_divide("squared", F.col("spread") * F.col("n"))).alias("r2"),
    ).unpivot(by, ["rmse", "mae", "r2"], "metric", "value")
