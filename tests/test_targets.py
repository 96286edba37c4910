import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import argmax_label, class_probabilities
from faultline.operators import class_counts, class_counts_pivoted, class_target
from faultline.schema import TARGET, check_schema


def coded(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, fault_type_coded int")


def target(spark, rows):
    return {
        r.batch_id: r.fault_type for r in class_target(class_counts(coded(spark, rows))).collect()
    }


def test_counts_and_pivot_agree(spark):
    rows = [(1, 1), (1, 1), (1, 5), (2, None), (2, 8), (3, None)]
    df = coded(spark, rows)
    counts = {tuple(r) for r in class_counts(df).collect()}
    assert counts == {
        (1, 2, 0, 0, 0, 1, 0, 0, 0),
        (2, 0, 0, 0, 0, 0, 0, 0, 1),
        (3, 0, 0, 0, 0, 0, 0, 0, 0),
    }
    pivoted = class_counts_pivoted(df)
    assert {tuple(r) for r in pivoted.collect()} == counts
    assert pivoted.columns == class_counts(df).columns


def test_unclassified_rows_are_not_in_the_total(spark):
    got = target(spark, [(1, 1), (1, 2), (1, None), (1, None)])
    assert got == {1: [0.5, 0.5, 0, 0, 0, 0, 0, 0]}


def test_no_classified_row_gives_nulls_and_no_error(spark):
    assert target(spark, [(1, None)]) == {1: [None] * 8}


def test_target_schema(spark):
    check_schema(class_target(class_counts(coded(spark, [(1, 1)]))), TARGET)


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    codes=st.lists(
        st.tuples(st.integers(1, 4), st.one_of(st.none(), st.integers(1, 8))),
        min_size=1,
        max_size=60,
    )
)
def test_probabilities_sum_to_one_or_are_null(spark, codes):
    for shares in target(spark, codes).values():
        assert shares == [None] * 8 or sum(shares) == pytest.approx(1.0)


@pytest.mark.parametrize(
    "values, label",
    [
        ([0.2, 0.5, 0.3], 1),
        ([0.4, 0.2, 0.4], 0),
        ([0.0, 0.5, 0.5], 1),
        ([None, None, None], None),
    ],
)
def test_argmax_takes_the_first_of_equals(spark, values, label):
    df = spark.createDataFrame([(values,)], "p array<double>")
    assert df.select(argmax_label(F.col("p")).alias("x")).first().x == label


def test_probabilities_of_any_number_of_counts(spark):
    df = spark.createDataFrame([(1, 3)], "a long, b long")
    got = df.select(class_probabilities([F.col("a"), F.col("b")]).alias("p")).first().p
    assert got == [0.25, 0.75]
