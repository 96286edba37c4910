"""Fitting in epochs, each followed by the losses on training and validation rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.learning.model import confusion_counts, fit
from faultline.sources.scratch import stored


class Epochs(NamedTuple):
    model: PipelineModel  # of the epoch with the least validation loss
    best: int
    losses: DataFrame  # epoch, split, loss


def fit_epochs(
    pipeline: Pipeline,
    rows: DataFrame,
    epochs: int = 5,
    by: str = "split",
    train: str = "train",
    val: str = "val",
    tasks: int | None = None,
) -> Epochs:
    """Fit ``pipeline`` (see ``fault_pipeline``) on the ``train`` rows, epoch by epoch.

    An epoch is the pipeline's ``max_iter`` steps of the optimiser, begun with the
    weights that the one before ended with. After each, the mean log loss on the
    ``train`` and the ``val`` rows is taken in one pass. The model with the least
    validation loss is kept, the earliest of equal ones.

    What precedes the classifier is fitted once and its output stored, so an epoch
    reads vectors only; the weights, and two losses for each epoch, are all that
    comes to the driver. Sums of gradients end in the order in which tasks do:
    weights repeat to the last digit with one task, and to rounding with more.
    """
    if epochs < 1:
        raise ValueError("at least one epoch is needed")
    *stages, learner = pipeline.getStages()
    fitted = Pipeline(stages=stages).fit(rows.filter(F.col(by) == train))
    inputs = [by, learner.getLabelCol(), learner.getFeaturesCol()]
    known = rows.filter(F.col(by).isin(train, val))
    prepared = stored(fitted.transform(known).select(*inputs), "prepared")
    training = prepared.filter(F.col(by) == train)

    weights, best, kept, history = None, None, None, []
    for epoch in range(1, epochs + 1):
        if weights is not None:
            learner = learner.copy().setInitialWeights(weights)
        model = fit(Pipeline(stages=[learner]), training, tasks).stages[0]
        weights = model.weights
        sums = confusion_counts(model.transform(prepared), by).groupBy(by)
        losses = sums.agg((F.sum("loss") / F.sum("n")).alias("loss")).collect()
        found = {row[by]: row["loss"] for row in losses}
        if val not in found:
            raise ValueError(f"no rows with {by} = {val}")
        history += [(epoch, part, found[part]) for part in (train, val)]
        if best is None or found[val] < best:
            best, kept = found[val], (epoch, model)
    table = rows.sparkSession.createDataFrame(history, f"epoch int, {by} string, loss double")
    return Epochs(PipelineModel(stages=[*fitted.stages, kept[1]]), kept[0], table)
