"""The 8-class fault classifier as a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.vectors import argmax_label, class_probabilities
from faultline.operators.features import summary_columns, summary_names
from faultline.operators.sequence import PLACE_BITS, batch_keys
from faultline.operators.targets import count_columns, count_names
from faultline.schema import CLASSES, MEASURES, check_schema

# --- fixed values: widths of the hidden layers
HIDDEN_LAYERS = (120, 60)

FLATTENED = "flattened"

# What a learner keeps of the rows of one task, about.
TASK_BYTES = 64 << 20

_SMALLEST_PROBABILITY = 1e-15


def training_frame(
    df: DataFrame,
    measures: Sequence[str] = MEASURES,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """One row per batch: the measure summaries and ``label`` as a double.

    Summaries and class counts come out of one aggregation. Batches without any
    classified row have no label and are left out.
    """
    grouped = df.groupBy(*batch_keys(df)).agg(*summary_columns(measures), *count_columns(classes))
    shares = class_probabilities([F.col(n) for n in count_names(classes)])
    return (
        grouped.withColumn("label", argmax_label(shares).cast("double"))
        .filter(F.col("label").isNotNull())
        .select("batch_id", *summary_names(measures), "label")
    )


def flattened_frame(rows: DataFrame) -> DataFrame:
    """Model rows with all steps of all channels as one vector in ``flattened``."""
    values = F.flatten("features").cast("array<double>")
    return (
        rows.filter(F.col("label").isNotNull())
        .withColumn(FLATTENED, array_to_vector(values))
        .withColumn("label", F.col("label").cast("double"))
        .drop("features")
    )


def fault_pipeline(
    inputs: Sequence[str] | None = None,
    width: int | None = None,
    hidden: Sequence[int] = HIDDEN_LAYERS,
    n_classes: int = len(CLASSES),
    max_iter: int = 20,
    seed: int = 0,
    solver: str = "l-bfgs",
    step_size: float = 0.03,
    lengths: Mapping[str, int] | None = None,
) -> Pipeline:
    """Scale ``inputs`` (default: the summaries) and fit a perceptron on them.

    ``lengths`` has the number of values of each input that is a vector; it is kept
    in the pipeline and checked wherever that is used. For a single vector,
    ``width``, the number of values in all ``inputs``, does as well.
    ``step_size`` is used by the gradient descent solver, ``"gd"``.
    """
    inputs = list(summary_names() if inputs is None else inputs)
    lengths = dict(lengths or {})
    strangers = [name for name in lengths if name not in inputs]
    if strangers:
        raise ValueError(f"not among the inputs: {', '.join(strangers)}")
    known = sum(lengths.values()) + len(inputs) - len(lengths)
    layers = [width or known, *hidden, n_classes]
    return Pipeline(
        stages=[
            *[VectorSizeHint(inputCol=name, size=n) for name, n in lengths.items()],
            VectorAssembler(inputCols=inputs, outputCol="assembled"),
            StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True),
            MultilayerPerceptronClassifier(
                featuresCol="scaled",
                labelCol="label",
                layers=layers,
                maxIter=max_iter,
                seed=seed,
                solver=solver,
                stepSize=step_size,
            ),
        ]
    )


def fit(pipeline: Pipeline, rows: DataFrame, tasks: int | None = None) -> PipelineModel:
    """Fit on ``rows``, which should be stored or cached.

    Every step of the optimiser is a job over all of them in which each task
    sends a gradient as long as the weights, and reads its share of the rows as the
    learner keeps them. So the number of tasks is that of the session's cores, and
    with more rows one for each ``TASK_BYTES`` of them. ``tasks`` gives another.

    Few files make few tasks, whatever their rows unpack to: if one would get over
    1.5 times ``TASK_BYTES``, the rows are dealt out anew for the last stage.
    """
    if tasks:
        return pipeline.fit(rows.coalesce(tasks))
    *stages, learner = pipeline.getStages()
    row_bytes = _row_bytes(stages, learner)
    found = rows.groupBy(F.spark_partition_id().alias("part")).count().collect()
    counts = {row["part"]: row["count"] for row in found}
    total, largest = sum(counts.values()), max(counts.values(), default=0)
    shares = max(
        rows.sparkSession.sparkContext.defaultParallelism, -(-total * row_bytes // TASK_BYTES)
    )
    if largest * row_bytes <= 1.5 * TASK_BYTES:
        return pipeline.fit(rows.coalesce(shares))
    # a perceptron weighs its blocks of rows alike, so only the last may be short
    block = learner.getBlockSize() if learner.hasParam("blockSize") else 1
    fitted = Pipeline(stages=stages).fit(rows)
    dealt = _dealt(rows, counts, -(-total // (shares * block)) * block)
    return PipelineModel(stages=[*fitted.stages, learner.fit(fitted.transform(dealt))])


def _dealt(rows: DataFrame, counts: Mapping[int, int], size: int) -> DataFrame:
    """``rows`` in their order, ``size`` to a partition; ``counts`` has how many each
    partition has now."""
    starts = [sum(n for k, n in counts.items() if k < part) for part in range(max(counts) + 1)]
    start = F.get(F.array(*[F.lit(n).cast("bigint") for n in starts]), F.spark_partition_id())
    place = F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)
    parts = -(-sum(counts.values()) // size)
    share = F.least(F.expr(f"_place div {size}"), F.lit(parts - 1)).cast("int")
    placed = rows.withColumn("_place", F.coalesce(start, F.lit(0)) + place)
    return placed.repartitionById(parts, share).sortWithinPartitions("_place").drop("_place")


def _row_bytes(stages: Sequence[Estimator], learner: Estimator) -> int:
    """Of a row as ``learner`` keeps it, about: eight for each of its values and, as
    the learner has them, for each class or tree."""
    if learner.hasParam("layers"):
        layers = learner.getLayers()
        return 8 * (layers[0] + layers[-1])
    sizes = {s.getInputCol(): s.getSize() for s in stages if isinstance(s, VectorSizeHint)}
    inputs = [c for s in stages if isinstance(s, VectorAssembler) for c in s.getInputCols()]
    trees = learner.getNumTrees() if learner.hasParam("numTrees") else 1
    return 8 * (sum(sizes.get(c, 1) for c in inputs) + trees)


# Role is "input" or "output"; a scalar has length 1.
SIGNATURE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("length", T.IntegerType()),
    ]
)


def _inputs(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def _lengths(model: PipelineModel) -> dict[str, int]:
    return {s.getInputCol(): s.getSize() for s in model.stages if isinstance(s, VectorSizeHint)}


def signature(model: PipelineModel) -> list[tuple[str, str, str, int | None]]:
    """Rows of ``SIGNATURE``: what a fitted pipeline takes and gives.

    A single vector whose length is not given has what the classifier's first layer
    leaves for it.
    """
    inputs, lengths, last = _inputs(model), _lengths(model), model.stages[-1]
    rows: list[tuple[str, str, str, int | None]] = []
    classifier = isinstance(last, MultilayerPerceptronClassificationModel)
    if classifier and not lengths and last.getLayers()[0] != len(inputs) == 1:
        lengths = {inputs[0]: last.getLayers()[0]}
    for name in inputs:
        kind = "vector" if name in lengths else "double"
        rows.append(("input", name, kind, lengths.get(name, 1)))
    if classifier:
        rows.append(("output", "probabilities", "array<float>", last.getLayers()[-1]))
    rows.append(("output", "prediction", "double", 1))
    return rows


def score(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """``frame`` with ``prediction`` (0-based class) and ``probabilities``.

    Columns the model was not fitted for fail here by name. Vectors of another
    length, and results with another number of probabilities than the model's
    classes, fail by name in the task that meets them.
    """
    inputs, lengths = _inputs(model), _lengths(model)
    layers = model.stages[-1].getLayers()
    wanted = [
        T.StructField(name, frame.schema[name].dataType)
        if name in frame.columns and isinstance(frame.schema[name].dataType, VectorUDT)
        else T.StructField(name, T.DoubleType())
        for name in inputs
    ]
    check_schema(frame, T.StructType(wanted))
    vectors = [f.name for f in wanted if isinstance(f.dataType, VectorUDT)]
    scalars = [name for name in lengths if name not in vectors]
    if scalars:
        raise ValueError(f"expected vectors: {', '.join(scalars)}")
    if not vectors and len(inputs) != layers[0]:
        raise ValueError(f"{len(inputs)} inputs for a model of {layers[0]}")
    if len(vectors) == 1 and not lengths:
        lengths = {vectors[0]: layers[0] - (len(inputs) - 1)}
    unknown = [name for name in vectors if name not in lengths]
    if unknown:
        raise ValueError(f"fitted without the lengths of {', '.join(unknown)}")
    checked = frame.withColumns(
        {name: _of_length(name, F.col(name), length) for name, length in lengths.items()}
    )
    scored = model.transform(checked).withColumn(
        "probabilities", vector_to_array("probability", "float32")
    )
    n = F.size("probabilities")
    message = F.concat(F.lit(f"probabilities: expected {layers[-1]}, got "), n.cast("string"))
    right = F.when(n == layers[-1], F.col("probabilities")).otherwise(
        F.raise_error(message).cast("array<float>")
    )
    return scored.withColumn("probabilities", right).select(
        *frame.columns, "probabilities", "prediction"
    )


def _of_length(name: str, vector: Column, length: int) -> Column:
    values = vector_to_array(vector)
    message = F.concat(F.lit(f"{name}: expected {length} values, got "), F.size(values).cast("string"))
    wrong = array_to_vector(F.raise_error(message).cast("array<double>"))
    return F.when(F.size(values) == length, vector).otherwise(wrong)


def confusion_counts(scored: DataFrame, by: str = "split") -> DataFrame:
    """Rows of each part, class and predicted class, in one pass: (``by``, label,
    prediction, n, loss), ``loss`` being the sum of the rows' log losses."""
    own = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    loss = -F.ln(F.greatest(own, F.lit(_SMALLEST_PROBABILITY)))
    return scored.groupBy(by, "label", "prediction").agg(
        F.count("*").alias("n"), F.sum(loss).alias("loss")
    )


def evaluate(scored: DataFrame, by: str = "split") -> DataFrame:
    """(``by``, metric, value) rows: log_loss, accuracy and weighted f1.

    One pass over the scored rows leaves a confusion table, at most one row per
    part and pair of classes; everything else is worked out on that.
    """
    confusion = confusion_counts(scored, by)
    actual = F.sum("n").over(Window.partitionBy(by, "label"))
    predicted = F.sum("n").over(Window.partitionBy(by, "prediction"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    return (
        confusion.withColumns({"actual": actual, "predicted": predicted, "hit": hit})
        .groupBy(by)
        .agg(
            (F.sum("loss") / F.sum("n")).alias("log_loss"),
            (F.sum("hit") / F.sum("n")).alias("accuracy"),
            (
                F.sum(2 * F.col("hit") * F.col("actual") / (F.col("actual") + F.col("predicted")))
                / F.sum("n")
            ).alias("f1"),
        )
        .unpivot(by, ["log_loss", "accuracy", "f1"], "metric", "value")
    )
