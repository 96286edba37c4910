import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators import (
    log_sweep,
    run_ids,
    sweep_grouped,
    sweep_mapped,
    sweep_streamed,
)
from faultline.schema import SWEEP, check_schema
from tests.helpers import plan, set_conf

OUTPUT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("Ron", T.DoubleType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("rows_in_call", T.LongType()),
    ]
)


def simulator(steps):
    def simulate(params):
        runs = params.loc[params.index.repeat(steps)]
        return pd.DataFrame(
            {
                "id": runs["id"],
                "Ron": runs["Ron"],
                "step": pd.Series(list(range(steps)) * len(params), index=runs.index, dtype="int32"),
                "rows_in_call": len(params),
            }
        )

    return simulate


def test_parameters(spark):
    n = 10
    params = check_schema(log_sweep(run_ids(spark, n), n), SWEEP)
    for row in params.collect():
        assert row.Ron == pytest.approx(10 ** (-(n - row.id) / n))
        assert row.Rg == pytest.approx(10 ** (-2 * (n - row.id) / n))
        assert row.StopTime == 1.0
    assert params.count() == n


def test_other_parameters(spark):
    params = log_sweep(run_ids(spark, 2), 2, {"R": 3.0}, {"T": 5.0})
    assert params.columns == ["id", "R", "T"]
    assert params.orderBy("id").first().R == pytest.approx(1e-3)


@pytest.mark.parametrize("run", [sweep_grouped, sweep_mapped])
def test_every_run_yields_its_steps(spark, run):
    params = log_sweep(run_ids(spark, 25), 25)
    got = run(params, simulator(11), OUTPUT)
    assert got.schema == OUTPUT
    assert sorted((r.id, r.step) for r in got.collect()) == [
        (i, s) for i in range(25) for s in range(11)
    ]


def test_one_call_per_key(spark):
    params = log_sweep(run_ids(spark, 10), 10)
    got = sweep_grouped(params, simulator(1), OUTPUT).collect()
    assert {r.rows_in_call for r in got} == {1}


def test_hot_key_is_sliced_on_request_only(spark):
    params = spark.range(300).select(
        "id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") + 1.0).alias("Ron")
    )
    got = sweep_grouped(params, simulator(1), OUTPUT).collect()
    assert sorted(r.id for r in got) == list(range(300))
    assert max(r.rows_in_call for r in got) == 100
    sliced = sweep_grouped(params, simulator(1), OUTPUT, max_rows=30).collect()
    assert sorted(r.id for r in sliced) == list(range(300))
    assert max(r.rows_in_call for r in sliced) == 30


def test_a_key_is_one_call_whatever_its_ids(spark):
    params = spark.range(1020, 1028).select("id", F.lit(0.5).alias("Ron"))
    got = sweep_grouped(params, simulator(1), OUTPUT).collect()
    assert {r.rows_in_call for r in got} == {8}


def test_a_key_over_several_batches_is_one_call(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with set_conf(spark, **{name.replace(".", "__"): "7"}):
        params = spark.range(60).select(
            "id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3 * 1.0).alias("Ron")
        )
        got = sweep_grouped(params, simulator(1), OUTPUT, tasks=2).collect()
    assert sorted(r.id for r in got) == list(range(60))
    assert {r.rows_in_call for r in got} == {20}


def test_mapped_calls_are_bounded_and_evenly_dealt(spark):
    params = log_sweep(run_ids(spark, 64), 64)
    got = sweep_mapped(params, simulator(1), OUTPUT, tasks=4, max_runs=5)
    assert max(r.rows_in_call for r in got.collect()) == 5
    dealt = got.groupBy(F.spark_partition_id()).count().collect()
    assert {r["count"] for r in dealt} == {16}


def test_one_shuffle_that_stays_spread(spark):
    params = log_sweep(run_ids(spark, 10), 10)
    for df in (
        sweep_grouped(params, simulator(1), OUTPUT, tasks=6),
        sweep_mapped(params, simulator(1), OUTPUT, tasks=6),
    ):
        text = plan(df)
        assert text.count("REPARTITION_BY_NUM") == 1
        assert "ENSURE_REQUIREMENTS" not in text


def test_output_must_keep_key_and_run(spark):
    params = log_sweep(run_ids(spark, 2), 2)
    with pytest.raises(ValueError, match="must keep Ron"):
        sweep_grouped(params, simulator(1), T.StructType([OUTPUT["id"]]))
    with pytest.raises(TypeError, match="StructType"):
        sweep_mapped(params, simulator(1), "id long")


@pytest.mark.parametrize("change", ["drop", "add"])
def test_other_columns_than_declared_fail(spark, change):
    right = simulator(1)

    def wrong(params):
        result = right(params)
        return result.drop(columns="step") if change == "drop" else result.assign(extra=1)

    params = log_sweep(run_ids(spark, 2), 2)
    with pytest.raises(Exception, match="got columns"):
        sweep_grouped(params, wrong, OUTPUT).collect()


STREAMED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("Ron", T.DoubleType()),
        T.StructField("so_far", T.LongType()),
        T.StructField("alive", T.LongType()),
    ]
)


def counter():
    def counting(frames):
        """Rows of the group so far, and how many frames of it are still held."""
        seen, so_far = [], 0
        for frame in frames:
            seen.append(weakref.ref(frame))
            seen = [r for r in seen if r() is not None]
            so_far += len(frame)
            last = frame[["id", "Ron"]].tail(1)
            yield last.assign(so_far=so_far, alive=len(seen))
            del frame, last

    return counting


def test_a_group_may_be_larger_than_memory(spark):
    n = 5_000_000
    params = spark.range(n).select("id", F.lit(0.5).alias("Ron"))
    with set_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="5000"):
        got = sweep_streamed(params, counter(), STREAMED, tasks=2)
        rows = got.agg(F.count("*"), F.max("so_far"), F.max("alive"), F.max("id")).first()
    assert rows[0] >= n / 5000 and rows[1] == n and rows[2] <= 2 and rows[3] == n - 1


def test_streamed_groups_are_whole_and_in_order(spark):
    keys = [None, 1.0, 2.0]
    rows = [(i, keys[i % 3]) for i in range(300)]
    params = spark.createDataFrame(rows, "id long, Ron double").repartition(5)

    def places(frames):
        before = -1
        for frame in frames:
            assert (frame["id"].diff().dropna() > 0).all() and frame["id"].iloc[0] > before
            before = frame["id"].iloc[-1]
            yield frame.assign(so_far=frame["id"], alive=len(frame))

    with set_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="7"):
        got = sweep_streamed(params, places, STREAMED).collect()
    assert sorted((r.id, r.Ron) for r in got if r.Ron) == sorted(r for r in rows if r[1])
    assert sum(r.Ron is None for r in got) == 100
    assert max(r.alive for r in got) <= 7


def test_streamed_sweep_is_one_shuffle_and_one_sort(spark):
    params = log_sweep(run_ids(spark, 10), 10)
    text = plan(sweep_streamed(params, counter(), STREAMED)).split("\n\n")[0]
    assert text.count("Exchange") == 1 and text.count("Sort") == 1


def test_streamed_results_are_checked(spark):
    params = log_sweep(run_ids(spark, 10), 10)
    with pytest.raises(ValueError, match="keep id"):
        sweep_streamed(params, counter(), T.StructType(STREAMED.fields[1:]))
    wrong = lambda frames: (f for f in frames)
    with pytest.raises(Exception, match="got columns"):
        sweep_streamed(params, wrong, STREAMED).collect()
    assert sweep_streamed(params.limit(0), counter(), STREAMED).count() == 0
