import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import transposed
from faultline.operators import (
    add_batches,
    batch_summary,
    build_dataset,
    class_counts,
    class_target,
    feature_sizes,
    join_target,
    long_steps,
    model_rows,
    rounded,
    sequences,
)
from faultline.schema import DATASET, MEASURES, TENSOR, SchemaError, check_schema
from tests.helpers import plan

SIZE = 4


@pytest.fixture(scope="module")
def rows(spark):
    """Three batches of four rows; value of channel c in row i is i + c / 100."""
    n = 3 * SIZE
    values = [F.col("id") + F.lit(c / 100) for c in range(len(MEASURES))]
    df = spark.range(n).select(
        "id",
        *[v.alias(m) for v, m in zip(values, MEASURES)],
        (F.col("id") % 3 + 1).cast("int").alias("fault_type_coded"),
    )
    return add_batches(df.repartition(5, "id"), ["id"], SIZE)


def expected_steps(batch):
    first = (batch - 1) * SIZE
    return [[i + c / 100 for c in range(len(MEASURES))] for i in range(first, first + SIZE)]


def test_round_half_up(spark):
    df = spark.createDataFrame([("k", 0.1234, 2.0005, -1.2346)], "k string, a double, b double, c double")
    got = rounded(df, ["k"], ["a", "b", "c"]).first()
    assert tuple(got) == ("k", 0.123, 2.001, -1.235)


def test_steps_come_in_row_order(rows):
    got = {r.batch_id: r.features for r in sequences(rows).collect()}
    assert got == {b: expected_steps(b) for b in (1, 2, 3)}


def test_one_size(rows):
    assert [tuple(r) for r in feature_sizes(sequences(rows)).collect()] == [(SIZE, 3)]


def test_fused_and_joined_datasets_agree(rows):
    joined = join_target(sequences(rows), class_target(class_counts(rows)))
    fused = build_dataset(rows)
    check_schema(joined, DATASET)
    check_schema(fused, DATASET)
    assert sorted(map(str, joined.collect())) == sorted(map(str, fused.collect()))


def test_join_keeps_batches_without_target(spark, rows):
    target = class_target(class_counts(rows)).filter("batch_id <> 2")
    got = {r.batch_id: r.fault_type for r in join_target(sequences(rows), target).collect()}
    assert set(got) == {1, 2, 3} and got[2] is None


def test_join_adds_no_shuffle(spark, rows):
    joined = join_target(sequences(rows), class_target(class_counts(rows)))
    alone = plan(sequences(rows)).count("ENSURE_REQUIREMENTS")
    other = plan(class_target(class_counts(rows))).count("ENSURE_REQUIREMENTS")
    assert plan(joined).count("ENSURE_REQUIREMENTS") <= alone + other


def test_model_rows(spark, rows):
    got = model_rows(build_dataset(rows), SIZE)
    check_schema(got, TENSOR)
    row = got.filter("batch_id = 2").first()
    expected = np.array(expected_steps(2), dtype="float32").T
    assert np.array_equal(np.array(row.features, dtype="float32"), expected)
    # rows 4..7 have classes 2, 3, 1, 2
    assert row.label == 1


def test_wrong_length_fails_the_query(rows):
    with pytest.raises(Exception, match="does not have 5 steps"):
        model_rows(build_dataset(rows), 5).collect()


def test_wrong_columns_are_named(rows):
    with pytest.raises(SchemaError, match="features: missing.*fault_type: missing"):
        check_schema(rows, DATASET)


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(steps=st.integers(1, 6), channels=st.integers(1, 5), seed=st.integers(0, 9))
def test_transposing_twice_changes_nothing(spark, steps, channels, seed):
    values = np.random.default_rng(seed).normal(size=(steps, channels)).tolist()
    df = spark.createDataFrame([(values,)], "x array<array<double>>")
    once = transposed(F.col("x"), channels, "double")
    once_df = df.select("x", once.alias("t"))
    row = once_df.select("x", "t", transposed(F.col("t"), steps, "double").alias("tt")).first()
    assert row.tt == row.x
    assert np.array_equal(np.array(row.t), np.array(values).T)


def test_long_form(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]])], "batch_id long, x array<array<double>>")
    got = {tuple(r) for r in long_steps(df, F.col("x"), ("i", "j")).collect()}
    assert got == {(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0)}


def test_summary(rows):
    row = batch_summary(rows).filter("batch_id = 2").first()
    assert (row.V1mag_13_sum, row.V1mag_13_min, row.V1mag_13_max) == (22.0, 4.0, 7.0)
    assert row.I0ph_1_sum == pytest.approx(22.44)
    assert len(row) == 1 + 3 * len(MEASURES)


@pytest.mark.parametrize(
    "values, total",
    [([1e-7, 1e-7, 1e-7], 3e-7), ([1.0, math.inf], math.inf), ([1.0, math.nan], math.nan)],
)
def test_sums_are_of_doubles(spark, values, total):
    df = spark.createDataFrame([(1, v) for v in values], "batch_id long, x double")
    got = batch_summary(df, ["x"]).first().x_sum
    assert got == pytest.approx(total, rel=1e-12, nan_ok=True)
