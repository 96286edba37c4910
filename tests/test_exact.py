"""Exact sums against math.fsum, whatever the order and the partitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import batch_summary, exact_places, exact_sums

random.seed(3)


def _mixed(n, low, high):
    return [random.uniform(-1, 1) * 2.0 ** random.randint(low, high) for _ in range(n)]


GROUPS = {
    "near": _mixed(400, -20, 20),
    "wide": _mixed(300, -300, 300),
    "cancel": [x * s for x in _mixed(200, -60, 60) for s in (1, -1)] + [2.0**-70],
    "tenths": [0.1] * 1000,
    "negative": [-1e-7, -3.0, -2.0**53, 1.0],
    "half way": [2.0**53, 1.0, 2.0**-200],
    "half way down": [2.0**53, 1.0, -(2.0**-200)],
    "tie to even": [2.0**53, 1.0],
    "tie to odd": [2.0**53, 3.0],
    "extremes": [5e-324, 1.7e308, -1.7e308, 5e-324],
    "least": [5e-324, 5e-324, 5e-324],
    "zeros": [0.0, -0.0],
    "one": [-0.3],
}


def _frame(spark, groups):
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    random.shuffle(rows)
    return spark.createDataFrame(rows, "k string, x double")


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_equal_to_fsum(spark, partitions):
    df = _frame(spark, GROUPS).repartition(partitions)
    got = {r.k: r.x_sum for r in exact_sums(df, ["k"], ["x"]).collect()}
    assert got == {k: math.fsum(xs) for k, xs in GROUPS.items()}


def test_defined_cases(spark):
    inf, nan = math.inf, math.nan
    groups = {
        "inf": [1.0, inf, None],
        "both": [inf, -inf, 2.0],
        "nan": [nan, 1.0],
        "null": [None, None],
        "some": [None, 0.1, 0.2],
        "over": [1.7e308, 1.7e308],
    }
    got = {r.k: r.x_sum for r in exact_sums(_frame(spark, groups), ["k"], ["x"]).collect()}
    assert (got["inf"], got["null"], got["over"]) == (inf, None, inf)
    assert got["some"] == math.fsum([0.1, 0.2])
    assert math.isnan(got["both"]) and math.isnan(got["nan"])


def test_no_values(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert exact_sums(df, ["k"], ["x"]).collect() == []
    only = spark.createDataFrame([("a", math.inf), ("b", None), ("c", 0.0)], df.schema)
    got = {r.k: r.x_sum for r in exact_sums(only, ["k"], ["x"]).collect()}
    assert got == {"a": math.inf, "b": None, "c": 0.0}


@pytest.mark.parametrize("value", [2.0**80, 2.0**-80])
def test_values_outside_the_places_fail(spark, value):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double")
    places = exact_places(df, ["x"])
    more = spark.createDataFrame([("a", value)], df.schema)
    with pytest.raises(Exception, match="outside the places"):
        exact_sums(df.union(more), ["k"], ["x"], places).collect()


def test_summary_is_the_same_for_any_partitions(spark):
    df = spark.range(2000).select(
        (F.col("id") % 3).alias("batch_id"),
        (F.rand(1) / 3 - 0.1).alias("x"),
        (F.exp(F.randn(2) * 20)).alias("y"),
    )
    rows = [tuple(r) for r in df.collect()]
    df = spark.createDataFrame(rows, df.schema)
    places = exact_places(df, ["x", "y"])
    seen = {
        tuple(sorted(map(tuple, batch_summary(df.repartition(n), ["x", "y"], places).collect())))
        for n in (1, 7, 50)
    }
    assert len(seen) == 1
    for batch, x_sum, x_min, x_max, y_sum, y_min, y_max in seen.pop():
        xs, ys = zip(*[r[1:] for r in rows if r[0] == batch], strict=True)
        assert (x_sum, x_min, x_max) == (math.fsum(xs), min(xs), max(xs))
        assert (y_sum, y_min, y_max) == (math.fsum(ys), min(ys), max(ys))
