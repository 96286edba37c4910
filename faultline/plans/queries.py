"""Every operator as a named query over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import operators as ops
from faultline.functions.vectors import argmax_label
from faultline.learning import (
    FLATTENED,
    confusion_counts,
    distance_frame,
    distance_pipeline,
    evaluate,
    fault_pipeline,
    fit,
    fit_epochs,
    flattened_frame,
    latest_models,
    load_latest,
    predict_distance,
    regression_metrics,
    save_version,
    score,
    training_frame,
)
from faultline.plans import views
from faultline.plans.views import KEY, SHOWN_KEY
from faultline.schema import BATCH_SIZE, CLASSES, LOCATIONS, MEASURES, SIMULATION, check_schema
from faultline.sources import discard, lasting_path, overwrite_table, schema_in_use, stored
from faultline.sources.scratch import application_folder
from faultline.sources.sinks import PROVENANCE

Query = Callable[[SparkSession, str], DataFrame]

SWEEP_STEPS = 11
SWEEP_OUTPUT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("Ron", T.DoubleType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_schema(views.simulation(spark, sf_dir), SIMULATION)


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.code_rows(_simulation(spark, sf_dir))


def _batches(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """Coded rows in full batches; only ``keep`` is stored."""
    rows = _simulation(spark, sf_dir)
    return ops.full_batches(ops.add_batches(rows, KEY, keep=keep, derive=ops.code_rows))


def _wide_batches(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """As ``_batches``, for wide rows that are aggregated by batch next."""
    found = ops.colocated_batches(
        _simulation(spark, sf_dir), KEY, keep=keep, derive=ops.code_rows
    )
    return ops.full_batches(found.rows)


def _shares(target: DataFrame, *others: str) -> DataFrame:
    parts = [F.get("fault_type", F.lit(i)).alias(f"p{k}") for i, k in enumerate(CLASSES)]
    return target.select("batch_id", *others, *parts)


def q01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulation(spark, sf_dir).select(*SHOWN_KEY, *MEASURES, "fault_class")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.runs(spark, sf_dir).count()
    return ops.log_sweep(ops.run_ids(spark, n), n)


def q02_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).select(
        "id", F.round("Ron", 9).alias("Ron"), F.round("Rg", 9).alias("Rg"), "StopTime"
    )


def q03_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select(*SHOWN_KEY, "fault_class")


def q04_bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select(*SHOWN_KEY, "Bus_loc")


def q05_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select(*SHOWN_KEY, "extracted_letters")


def q06_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select(*SHOWN_KEY, "fault_type_coded")


def q07_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.code_counts(_coded(spark, sf_dir))


def q08_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.add_batches(_simulation(spark, sf_dir), KEY, keep=SHOWN_KEY)
    return rows.select(*SHOWN_KEY, "row_index", "batch_id")


def q08b_batch_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    rows = ops.add_keyed_batches(
        events, "user_id", ["ts", "event_id"], size=10, keep=["event_id"]
    )
    return rows.select("user_id", "event_id", "batch_id")


def q09_full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _batches(spark, sf_dir, SHOWN_KEY)
    return rows.select(*SHOWN_KEY, "batch_id").orderBy("batch_id")


def q09b_drop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.add_batches(_simulation(spark, sf_dir), KEY, keep=SHOWN_KEY)
    return ops.drop_batches(rows, [41]).select(*SHOWN_KEY, "batch_id")


def q10_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rounded(_simulation(spark, sf_dir), SHOWN_KEY)


def q10b_round_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["fault_type_coded", "extracted_letters", "Bus_loc"]
    rows = _wide_batches(spark, sf_dir, [*labels, *MEASURES])
    return ops.rounded(rows, ["batch_id", *labels])


def q11_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.class_counts(_batches(spark, sf_dir, ["fault_type_coded"]))


def q11b_class_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.class_counts_pivoted(_batches(spark, sf_dir, ["fault_type_coded"]))


def _target(rows: DataFrame) -> DataFrame:
    return ops.class_target(ops.class_counts(rows))


def q12_class_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(_target(_batches(spark, sf_dir, ["fault_type_coded"])))


def q13_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ops.sequences(_wide_batches(spark, sf_dir, MEASURES)).select(
        "batch_id", F.posexplode("features").alias("position", "step")
    )
    values = [F.get("step", F.lit(i)).alias(m) for i, m in enumerate(MEASURES)]
    return steps.select("batch_id", "position", *values)


def q14_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.feature_sizes(_batches(spark, sf_dir, ["l_orderkey"]))


def _steps(dataset: DataFrame, *others: str) -> DataFrame:
    """One row per step of each sequence, beside the batch's target."""
    steps = dataset.select(
        "batch_id", *others, "fault_type", F.posexplode("features").alias("position", "_step")
    )
    values = [F.get("_step", F.lit(i)).alias(m) for i, m in enumerate(MEASURES)]
    return _shares(steps.select("*", *values), *others, "position", *MEASURES)


def q15_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide_batches(spark, sf_dir, ["fault_type_coded", *MEASURES])
    return _steps(ops.join_target(ops.sequences(rows), _target(rows)))


def q15b_dataset_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(ops.build_dataset(_wide_batches(spark, sf_dir, ["fault_type_coded", *MEASURES])))


def q16_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = check_schema(views.locations(spark, sf_dir), LOCATIONS)
    return ops.with_distance(places).select("Bus_loc", "distance_sub_station")


def q17_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = ops.build_dataset(_wide_batches(spark, sf_dir, ["fault_type_coded", *MEASURES]))
    values = ops.long_steps(
        ops.model_rows(dataset), F.col("features"), ("channel", "position")
    )
    return values.withColumn("value", F.col("value").cast("double"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _target(_batches(spark, sf_dir, ["fault_type_coded"]))
    return target.select("batch_id", argmax_label(F.col("fault_type")).alias("label"))


def q18_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


def q19_row_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = check_schema(views.locations(spark, sf_dir), LOCATIONS)
    rows = ops.attach_distance(_coded(spark, sf_dir), places)
    return rows.select(*SHOWN_KEY, "Bus_loc", "distance_sub_station")


def closed_form_runs(steps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A stand-in simulator: every run yields ``steps`` rows.

    An inner function travels to the Python workers by value, so they need not
    have this package installed.
    """

    def simulate(params: pd.DataFrame) -> pd.DataFrame:
        step = np.tile(np.arange(steps, dtype="int32"), len(params))
        ron = np.repeat(params["Ron"].to_numpy(), steps)
        rg = np.repeat(params["Rg"].to_numpy(), steps)
        return pd.DataFrame(
            {
                "id": np.repeat(params["id"].to_numpy(), steps),
                "Ron": ron,
                "step": step,
                "value": ron * (step + 1) + rg * step * step,
            }
        )

    return simulate


def _rounded_runs(results: DataFrame) -> DataFrame:
    return results.select(
        "id", F.round("Ron", 9).alias("Ron"), "step", F.round("value", 6).alias("value")
    )


def q20_sweep_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _sweep(spark, sf_dir)
    simulate = closed_form_runs(SWEEP_STEPS)
    return _rounded_runs(ops.sweep_grouped(params, simulate, SWEEP_OUTPUT))


def q21_sweep_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _sweep(spark, sf_dir)
    simulate = closed_form_runs(SWEEP_STEPS)
    return _rounded_runs(ops.sweep_mapped(params, simulate, SWEEP_OUTPUT))


def q21b_cached_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep that is read twice while it is cached: runs, runs that were simulated,
    rows by the first reading, and the sum of the steps by the second."""
    params = _sweep(spark, sf_dir)
    steps, simulated = SWEEP_STEPS, spark.sparkContext.accumulator(0)
    runs = closed_form_runs(steps)

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        simulated.add(len(frame))
        return runs(frame)

    with ops.cached(ops.sweep_mapped(params, counted, SWEEP_OUTPUT)) as held:
        n_rows = held.count()
        n_steps = held.agg(F.coalesce(F.sum("step"), F.lit(0))).first()[0]
    counts = {
        "n_runs": params.count(),
        "n_simulated": simulated.value,
        "n_rows": n_rows,
        "sum_steps": n_steps,
    }
    return spark.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()])


def running_differences() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Cents of each part times the group's size less the group's cents, and the sum
    of these so far, which is carried from frame to frame."""

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far = 0
        for part in frames:
            off = part["n_group"] * part["cents"] - part["group_cents"]
            running = so_far + off.cumsum()
            so_far = running.iloc[-1]
            yield part[["p_partkey", "p_brand", "n_group"]].assign(off_mean=off, running_off=running)

    return simulate


def q20b_sweep_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that needs its whole group, in order: how far each part's price is
    off its brand's mean, times the brand's parts, and the running sum of that.

    All in whole cents. The brands' sums are aggregated before the shuffle and come
    to the rows in a join; the function streams its group.
    """
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_brand", cents.alias("cents"))
    brands = parts.groupBy(F.col("p_brand").alias("_brand")).agg(
        F.count("*").alias("n_group"), F.sum("cents").alias("group_cents")
    )
    rows = parts.join(brands, F.col("p_brand").eqNullSafe(F.col("_brand"))).drop("_brand")
    output = T.StructType(
        [
            T.StructField("p_partkey", T.LongType()),
            T.StructField("p_brand", T.StringType()),
            T.StructField("n_group", T.LongType()),
            T.StructField("off_mean", T.LongType()),
            T.StructField("running_off", T.LongType()),
        ]
    )
    return ops.sweep_streamed(
        rows, running_differences(), output, key="p_brand", run_id="p_partkey"
    )


# One schema for all sinks, whose tables every run replaces.
SINK_SCHEMA = "faultline_queries"


def _sink(spark: SparkSession) -> AbstractContextManager[None]:
    return schema_in_use(spark, SINK_SCHEMA, f"{application_folder(spark)}/{SINK_SCHEMA}")


def q22_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _coded(spark, sf_dir)
    kept = [*SHOWN_KEY, "fault_class", "Bus_loc", "extracted_letters", "fault_type_coded"]
    with _sink(spark):
        overwrite_table(coded.select(*SHOWN_KEY), "coded_rows")
        overwrite_table(coded.select(*kept), "coded_rows", provenance=True)
    second = spark.table(f"{SINK_SCHEMA}.coded_rows")
    return second.select(*kept, (F.col(PROVENANCE) == F.current_user()).alias("by_user"))


def q22b_dataset_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with target and split, stored by split and read back."""
    rows = _simulation(spark, sf_dir)
    kept = ["fault_type_coded", *MEASURES]
    batches = ops.colocated_batches(rows, KEY, keep=kept, derive=ops.code_rows)
    ids = ops.full_batch_ids(batches.rows, total=batches.total)
    dataset = ops.assign_split(ops.build_dataset(ops.full_batches(batches.rows)), ids)
    with _sink(spark):
        overwrite_table(dataset, "dataset", partition_by=["split"])
    return _steps(spark.table(f"{SINK_SCHEMA}.dataset"), "split")


# Buckets of the stored features and of their target.
BUCKETS = 8


def q22c_bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and target, each stored in buckets by batch, joined and aggregated
    by batch without a shuffle."""
    rows = _wide_batches(spark, sf_dir, ["fault_type_coded", *MEASURES])
    by_batch = (BUCKETS, "batch_id")
    with _sink(spark):
        features = overwrite_table(
            ops.sequences(rows).select("batch_id", "features"), "features", bucket_by=by_batch
        )
        target = overwrite_table(
            _target(rows).select("batch_id", "fault_type"), "target", bucket_by=by_batch
        )
    joined = features.join(target, "batch_id").groupBy("batch_id").agg(
        F.sum(F.size("features")).alias("n_steps"), F.first("fault_type").alias("fault_type")
    )
    return _shares(joined, "n_steps")


def q23_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.add_batches(
        _simulation(spark, sf_dir), KEY, keep=["fault_type_coded"], derive=ops.code_rows
    )
    target = _target(ops.full_batches(rows))
    labels = target.select("batch_id", argmax_label(F.col("fault_type")).alias("label"))
    return ops.assign_split(labels, ops.full_batch_ids(rows))


def q24_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = ops.exact_places(_simulation(spark, sf_dir), MEASURES)
    return ops.batch_summary(_wide_batches(spark, sf_dir, MEASURES), places=places)


def _training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide_batches(spark, sf_dir, ["fault_type_coded", *MEASURES])
    return stored(training_frame(rows), "training")


def _train_and_evaluate(frame: DataFrame, pipeline: Pipeline) -> DataFrame:
    frame = ops.assign_split(frame, frame.select("batch_id"))
    # stored already: not cached as well
    model = fit(pipeline, frame.filter(F.col("split") == "train"))
    return evaluate(model.transform(frame))


def q25_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_and_evaluate(_training_frame(spark, sf_dir), fault_pipeline())


def q25b_train_eval_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide_batches(spark, sf_dir, ["fault_type_coded", *MEASURES])
    frame = stored(flattened_frame(ops.model_rows(ops.build_dataset(rows))), "training")
    width = BATCH_SIZE * len(MEASURES)
    return _train_and_evaluate(frame, fault_pipeline([FLATTENED], width, max_iter=5))


def _scored_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class shares as probabilities, and a prediction that is off by one class in
    every third batch."""
    batches = _batches(spark, sf_dir, ["fault_type_coded"])
    shares = _target(batches).withColumn("label", argmax_label(F.col("fault_type")))
    off = F.when(F.col("batch_id") % 3 == 0, 1).otherwise(0)
    part = F.when(F.col("batch_id") % 2 == 0, "even").otherwise("odd")
    return shares.filter("label IS NOT NULL").select(
        part.alias("split"),
        F.col("label").cast("double").alias("label"),
        array_to_vector("fault_type").alias("probability"),
        ((F.col("label") + off) % len(CLASSES)).cast("double").alias("prediction"),
    )


def q25c_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a frame scored by rule."""
    return evaluate(_scored_by_rule(spark, sf_dir)).withColumn("value", F.round("value", 9))


def q25d_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses on training and validation batches after each of five epochs."""
    frame = _training_frame(spark, sf_dir)
    frame = ops.assign_split(frame, frame.select("batch_id"))
    return fit_epochs(fault_pipeline(max_iter=4), frame, epochs=5).losses


def q25e_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by class and predicted class of a frame scored by rule."""
    counts = confusion_counts(_scored_by_rule(spark, sf_dir))
    return counts.select(
        "split", F.col("label").cast("int"), F.col("prediction").cast("int"), "n"
    )


def q26_batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved and reloaded predicts like the one that was fitted."""
    frame = _training_frame(spark, sf_dir)
    root = lasting_path(spark, "registry")
    fitted = fit(fault_pipeline(), frame)
    save_version(fitted, spark, root, "fault_prediction")
    scored = score(load_latest(spark, root, "fault_prediction"), frame)
    discard(spark, root)
    own = fitted.transform(frame).select("batch_id", F.col("prediction").alias("_fitted"))
    return scored.join(own, "batch_id").select(
        "batch_id",
        F.col("label").cast("int").alias("label"),
        (F.col("prediction") == F.col("_fitted")).alias("as_fitted"),
        F.size("probabilities").alias("n_probabilities"),
    )


def q27_latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_models(views.models(spark, sf_dir))


def q28_distance_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest that tells the distance of a fault from its row's measures: fitted on
    the rows of the training batches, saved, reloaded and scored on all parts."""
    places = check_schema(views.locations(spark, sf_dir), LOCATIONS)
    found = ops.colocated_batches(
        _simulation(spark, sf_dir),
        KEY,
        keep=["fault_type_coded", "Bus_loc", *MEASURES],
        derive=ops.code_rows,
    )
    frame = stored(distance_frame(ops.full_batches(found.rows), places), "distances")
    ids = ops.full_batch_ids(found.rows, total=found.total)
    frame = ops.assign_split(frame, ids)
    fitted = fit(distance_pipeline(), frame.filter(F.col("split") == "train"))
    root = lasting_path(spark, "registry")
    save_version(fitted, spark, root, "fault_distance")
    model = load_latest(spark, root, "fault_distance")
    discard(spark, root)
    return regression_metrics(predict_distance(model, frame))


def q28b_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of distances predicted by rule: too small, right or too large by an
    eighth, as the row's line number has it."""
    places = check_schema(views.locations(spark, sf_dir), LOCATIONS)
    rows = ops.attach_distance(_coded(spark, sf_dir), places)
    off = 1 + (F.col("l_linenumber") % 3 - 1) / 8
    scored = rows.select(
        F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd").alias("split"),
        F.col("distance_sub_station").alias("label"),
        (F.col("distance_sub_station") * off).alias("prediction"),
    )
    return regression_metrics(scored).withColumn("value", F.round("value", 6))


def queries() -> dict[str, Query]:
    return {
        query.__name__: query
        for query in (
            q01_scan,
            q02_sweep,
            q03_normalise,
            q04_bus,
            q05_letters,
            q06_code,
            q07_code_counts,
            q08_batch,
            q08b_batch_keyed,
            q09_full_batches,
            q09b_drop_ids,
            q10_round,
            q10b_round_batches,
            q11_class_counts,
            q11b_class_pivot,
            q12_class_prob,
            q13_sequence,
            q14_size,
            q15_dataset,
            q15b_dataset_fused,
            q16_distance,
            q17_transpose,
            q18_argmax,
            q19_row_distance,
            q20_sweep_grouped,
            q20b_sweep_groups,
            q21_sweep_map,
            q21b_cached_sweep,
            q22_sink,
            q22b_dataset_sink,
            q22c_bucketed_join,
            q23_split,
            q24_summary,
            q25_train_eval,
            q25b_train_eval_steps,
            q25c_evaluate,
            q25d_epochs,
            q25e_confusion,
            q26_batch_score,
            q27_latest_model,
            q28_distance_fit,
            q28b_regression_metrics,
        )
    }
