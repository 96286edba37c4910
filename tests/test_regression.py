import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from faultline.learning import model as model_module
from faultline.learning import (
    distance_frame,
    distance_pipeline,
    fit,
    load_latest,
    predict_distance,
    regression_metrics,
    save_version,
)
from faultline.schema import MEASURES, SchemaError


@pytest.fixture(scope="module")
def frame(spark):
    """Rows whose first measure tells the bus, and buses whose place tells the distance."""
    places = spark.range(20).select(
        F.col("id").cast("string").alias("Bus_loc"),
        (F.col("id") * 3.0).alias("X_Coord"),
        (F.col("id") * 4.0).alias("Y_Coord"),
    )
    odd = [("90", None, 1.0), ("91", float("nan"), 1.0)]
    places = places.unionAll(spark.createDataFrame(odd, "Bus_loc string, X_Coord double, Y_Coord double"))
    rows = spark.range(2000).select(
        (F.col("id") % 50 + 1).alias("batch_id"),
        F.when(F.col("id") % 100 == 7, "90")
        .when(F.col("id") % 100 == 8, "91")
        .when(F.col("id") % 100 == 9, "nowhere")
        .otherwise((F.col("id") % 20).cast("string"))
        .alias("Bus_loc"),
        F.when(F.col("id") % 10 == 1, 1).otherwise(4).alias("fault_type_coded"),
        (F.col("id") % 20 / 7.0).alias(MEASURES[0]),
        *[(F.col("id") * (c + 3) % 17 / 3.0).alias(m) for c, m in enumerate(MEASURES[1:])],
    )
    found = distance_frame(rows, places)
    part = F.when(F.col("batch_id") % 5 == 0, "test").otherwise("train")
    return found.withColumn("split", part)


def test_only_rows_with_a_distance(frame):
    assert frame.columns == ["batch_id", *MEASURES, "label", "split"]
    # of a hundred rows ten have no fault, and three no place
    assert frame.count() == 2000 * 87 // 100
    assert frame.filter("label IS NULL OR isnan(label)").count() == 0


def test_distances_are_learned(spark, frame, tmp_path):
    model = fit(distance_pipeline(trees=10, depth=6), frame.filter("split = 'train'"))
    root = str(tmp_path / "registry")
    assert save_version(model, spark, root, "distance") == 1
    again = predict_distance(load_latest(spark, root, "distance"), frame)
    assert again.columns == [*frame.columns, "prediction"]
    values = {(r.split, r.metric): r.value for r in regression_metrics(again).collect()}
    assert set(values) == {(s, m) for s in ("train", "test") for m in ("rmse", "mae", "r2")}
    assert values["test", "r2"] > 0.7
    for name in ("rmse", "mae", "r2"):
        evaluator = RegressionEvaluator(metricName=name)
        own = evaluator.evaluate(model.transform(frame).filter("split = 'test'"))
        assert values["test", name] == pytest.approx(own)


def test_other_columns_fail_by_name(frame):
    model = fit(distance_pipeline(trees=2, depth=2), frame)
    with pytest.raises(SchemaError, match=f"{MEASURES[0]}: missing"):
        predict_distance(model, frame.drop(MEASURES[0]))


def test_metrics_of_odd_rows(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", None, 1.0), ("b", 5.0, 4.0), ("b", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "split string, label double, prediction double")
    got = {(r.split, r.metric): r.value for r in regression_metrics(df).collect()}
    assert got["a", "rmse"] == pytest.approx(0.5**0.5) and got["a", "mae"] == 0.5
    assert got["a", "r2"] == pytest.approx(0.5) and got["b", "r2"] is None
    assert regression_metrics(df.limit(0)).count() == 0


def test_a_task_of_a_forest_reads_no_more_as_rows_grow(spark, frame, monkeypatch):
    pipeline, sizes = distance_pipeline(trees=2, depth=2), []
    rows = frame.coalesce(1)
    monkeypatch.setattr(model_module, "TASK_BYTES", 8 * (len(MEASURES) + 2) * 100, raising=False)
    real = RandomForestRegressor._fit

    def counted(stage, dataset):
        sizes.extend(dataset.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())
        return real(stage, dataset)

    monkeypatch.setattr(RandomForestRegressor, "_fit", counted)
    first, second = fit(pipeline, rows), fit(pipeline, rows)
    assert len(sizes) == 36 and max(sizes) <= 100 and sum(sizes) == 2 * 1740
    assert first.stages[-1].toDebugString.split("\n")[1:] == second.stages[-1].toDebugString.split("\n")[1:]
