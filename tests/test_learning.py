from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from faultline.learning import model as model_module
from faultline.learning import (
    confusion_counts,
    evaluate,
    fault_pipeline,
    fit,
    flattened_frame,
    latest_model_path,
    latest_models,
    load_latest,
    read_models,
    read_signature,
    save_version,
    score,
    signature,
    training_frame,
)
from faultline.operators import add_batches, assign_split, build_dataset, cached, model_rows
from faultline.schema import MEASURES, MODELS, SchemaError

SIZE = 5


@pytest.fixture(scope="module")
def batched(spark):
    df = spark.range(40 * SIZE).select(
        "id",
        *[((F.col("id") * (c + 3)) % 17 / 3.0).alias(m) for c, m in enumerate(MEASURES)],
        (F.col("id") % 8 + 1).cast("int").alias("fault_type_coded"),
    )
    return add_batches(df, ["id"], SIZE)


@pytest.fixture(scope="module")
def scored(batched):
    frame = training_frame(batched)
    frame = assign_split(frame, frame.select("batch_id"))
    with cached(frame) as rows:
        model = fit(fault_pipeline(max_iter=3), rows.filter("split = 'train'"))
        yield model, model.transform(rows)


def test_one_row_per_batch(batched):
    frame = training_frame(batched)
    assert frame.count() == 40
    assert frame.schema["label"].dataType.simpleString() == "double"


def test_batches_without_a_class_are_left_out(batched):
    some = batched.withColumn(
        "fault_type_coded", F.when(F.col("batch_id") > 3, F.col("fault_type_coded"))
    )
    assert training_frame(some).count() == 37


@pytest.mark.parametrize("metric, name", [("log_loss", "logLoss"), ("accuracy", "accuracy"), ("f1", "f1")])
def test_metrics_are_those_of_the_evaluator(scored, metric, name):
    _, rows = scored
    got = {r.split: r.value for r in evaluate(rows).filter(F.col("metric") == metric).collect()}
    assert set(got) == {"train", "val", "test"}
    for part, value in got.items():
        evaluator = MulticlassClassificationEvaluator(metricName=name)
        assert value == pytest.approx(evaluator.evaluate(rows.filter(F.col("split") == part)))


def test_saved_versions(spark, scored, tmp_path):
    model, rows = scored
    root = str(tmp_path / "registry")
    assert save_version(model, spark, root, "faults") == 1
    assert save_version(model, spark, root, "faults") == 2
    assert save_version(model, spark, root, "other") == 1
    models = read_models(spark, root)
    assert models.schema == MODELS
    assert latest_model_path(models, "faults") == f"{root}/faults/2"
    unscored = rows.select(*model.stages[0].getInputCols(), "batch_id")
    again = score(load_latest(spark, root, "faults"), unscored)
    expected = {r.batch_id: r.prediction for r in rows.collect()}
    assert {r.batch_id: r.prediction for r in again.collect()} == expected
    with pytest.raises(LookupError, match="nothing"):
        latest_model_path(models, "nothing")


def test_a_taken_version_is_left_alone(spark, scored, tmp_path):
    model, _ = scored
    root = str(tmp_path / "registry")
    assert save_version(model, spark, root, "faults") == 1
    # another writer has saved, but not listed yet
    spark.range(1).write.parquet(f"{root}/faults/2")
    assert save_version(model, spark, root, "faults") == 3
    assert spark.read.parquet(f"{root}/faults/2").count() == 1


def test_tasks_do_not_follow_the_rows(spark, batched, monkeypatch):
    used, rows = [], training_frame(batched)
    real = type(rows).coalesce
    monkeypatch.setattr(type(rows), "coalesce", lambda df, n: used.append(n) or real(df, n))
    more = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("copy")
    for frame in (rows, more):
        fit(fault_pipeline(hidden=(4,), max_iter=1), frame)
    fit(fault_pipeline(hidden=(4,), max_iter=1), rows, tasks=3)
    assert used == [spark.sparkContext.defaultParallelism] * 2 + [3]


def test_vectors_of_another_length_fail_by_name(batched):
    rows = flattened_frame(model_rows(build_dataset(batched), SIZE))
    width = SIZE * len(MEASURES)
    model = fit(fault_pipeline(["flattened"], width, hidden=(6,), max_iter=1), rows)
    short = rows.withColumn("flattened", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    with pytest.raises(Exception, match=f"flattened: expected {width} values, got 2"):
        score(model, short).collect()


def test_score_shape_and_contract(scored):
    model, rows = scored
    frame = rows.select("batch_id", *model.stages[0].getInputCols())
    got = score(model, frame)
    assert got.columns == [*frame.columns, "probabilities", "prediction"]
    assert got.schema["probabilities"].dataType.simpleString() == "array<float>"
    assert {len(r.probabilities) for r in got.collect()} == {8}
    wrong = frame.withColumn("I0ph_1_max", F.lit("x")).drop("V1mag_13_sum")
    with pytest.raises(SchemaError, match="V1mag_13_sum: missing.*I0ph_1_max: string"):
        score(model, wrong)


def test_swapped_vectors_fail_by_name(spark, tmp_path):
    def rows(n_a, n_b):
        ones = lambda n: array_to_vector(F.array(*[F.col("id") / (i + 1.0) for i in range(n)]))
        return spark.range(20).select(
            "id", ones(n_a).alias("a"), ones(n_b).alias("b"), (F.col("id") % 2 + 0.0).alias("label")
        )

    lengths = {"a": 2, "b": 3}
    pipeline = fault_pipeline(["a", "b"], hidden=(2,), n_classes=2, max_iter=1, lengths=lengths)
    model = fit(pipeline, rows(2, 3))
    root = str(tmp_path / "registry")
    assert save_version(model, spark, root, "two") == 1
    again = load_latest(spark, root, "two")
    assert signature(again) == signature(model) == [
        ("input", "a", "vector", 2),
        ("input", "b", "vector", 3),
        ("output", "probabilities", "array<float>", 2),
        ("output", "prediction", "double", 1),
    ]
    saved = read_signature(spark, root, "two", 1).collect()
    assert [tuple(r) for r in saved] == signature(model)
    assert score(again, rows(2, 3)).count() == 20
    with pytest.raises(Exception, match="(a: expected 2 values, got 3|b: expected 3 values, got 2)"):
        score(again, rows(3, 2)).collect()
    with pytest.raises(ValueError, match="not among the inputs: c"):
        fault_pipeline(["a"], lengths={"c": 1})
    blind = fit(fault_pipeline(["a", "b"], 5, hidden=(2,), n_classes=2, max_iter=1), rows(2, 3))
    with pytest.raises(ValueError, match="without the lengths of a, b"):
        score(blind, rows(2, 3))


def test_writers_get_different_versions(spark, scored, tmp_path):
    model, rows = scored
    root = str(tmp_path / "registry")
    # a writer that failed after its claim
    claim = tmp_path / "registry" / "_claims" / "faults" / "1"
    claim.parent.mkdir(parents=True)
    claim.touch()
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: save_version(model, spark, root, "faults"), range(4)))
    assert sorted(got) == [2, 3, 4, 5]
    models = read_models(spark, root)
    assert {r.version for r in models.collect()} == set(got)
    for row in models.collect():
        own = rows.select(*model.stages[0].getInputCols()).limit(1)
        assert PipelineModel.load(row.path).transform(own).count() == 1


def test_confusion_counts(scored):
    _, rows = scored
    counts = {(r.split, r.label, r.prediction): r.n for r in confusion_counts(rows).collect()}
    by_hand = {}
    for r in rows.collect():
        at = r.split, r.label, r.prediction
        by_hand[at] = by_hand.get(at, 0) + 1
    assert counts == by_hand


def test_latest_of_each_name(spark):
    models = spark.createDataFrame(
        [("a", 1, "p1"), ("a", 10, "p10"), ("a", 9, "p9"), ("b", 3, "q3")],
        "name string, version long, path string",
    )
    assert {tuple(r) for r in latest_models(models).collect()} == {("a", 10, "p10"), ("b", 3, "q3")}


def test_whole_sequences_as_inputs(batched):
    rows = flattened_frame(model_rows(build_dataset(batched), SIZE))
    width = SIZE * len(MEASURES)
    with cached(rows) as data:
        model = fit(fault_pipeline(["flattened"], width, hidden=(6,), max_iter=2), data)
        assert score(model, data).select("prediction").count() == 40


def test_gradient_descent(batched):
    with cached(training_frame(batched)) as rows:
        model = fit(fault_pipeline(hidden=(4,), max_iter=2, solver="gd", step_size=1e-4), rows)
        assert model.transform(rows).filter("prediction NOT BETWEEN 0 AND 7").count() == 0


def test_cache_ends_with_the_block(spark):
    df = spark.range(3)
    with cached(df):
        assert df.storageLevel.useMemory
    assert not df.storageLevel.useMemory


def _sizes_of_fit(monkeypatch, pipeline, rows):
    """Rows in each partition that the pipeline's last stage is fitted on."""
    sizes, learner = [], type(pipeline.getStages()[-1])
    real = learner._fit

    def counted(stage, dataset):
        sizes.extend(dataset.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())
        return real(stage, dataset)

    monkeypatch.setattr(learner, "_fit", counted)
    return fit(pipeline, rows), sizes


def test_a_task_reads_no_more_as_rows_grow(spark, batched, monkeypatch):
    rows = training_frame(batched).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60))))
    rows = rows.drop("copy").coalesce(1)
    # 36 summaries and 8 classes, in blocks of 128 rows
    monkeypatch.setattr(model_module, "TASK_BYTES", 8 * (36 + 8) * 128, raising=False)
    model, sizes = _sizes_of_fit(monkeypatch, fault_pipeline(hidden=(4,), max_iter=1), rows)
    assert sizes == [128] * 18 + [96]
    assert score(model, rows).count() == 2400


def test_few_rows_are_not_dealt_out(batched, monkeypatch):
    rows = training_frame(batched).coalesce(1)
    _, sizes = _sizes_of_fit(monkeypatch, fault_pipeline(hidden=(4,), max_iter=1), rows)
    assert sizes == [40]
