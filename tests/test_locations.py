import pytest
from pyspark.sql import functions as F

from faultline.operators import attach_distance, with_distance
from tests.helpers import plan, set_conf

PLACES = [(3.0, 4.0, "13"), (0.0, 0.0, "149r"), (6.0, 8.0, "0")]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, "X_Coord double, Y_Coord double, Bus_loc string")


def test_distance(places):
    got = {r.Bus_loc: r.distance_sub_station for r in with_distance(places).collect()}
    assert got == {"13": 5.0, "149r": 0.0, "0": 10.0}


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_lookup(spark, places, limit):
    rows = spark.createDataFrame(
        [(1, "13", 4), (2, "149r", None), (3, "0", 1), (4, "0", 4), (5, "99", 4), (6, None, None)],
        "k long, Bus_loc string, fault_type_coded int",
    )
    with set_conf(spark, spark__sql__autoBroadcastJoinThreshold=limit):
        got = {r.k: r.distance_sub_station for r in attach_distance(rows, places).collect()}
    assert got == {1: 5.0, 2: 0.0, 3: None, 4: 10.0, 5: None, 6: None}


def test_size_decides_on_the_broadcast(spark, sf_dir):
    from faultline.plans import queries as q

    assert "BroadcastHashJoin LeftOuter" in plan(q.q19_row_distance(spark, sf_dir))
    with set_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        assert "SortMergeJoin LeftOuter" in plan(q.q19_row_distance(spark, sf_dir))


@pytest.mark.parametrize("faulted", [True, False], ids=["hot bus", "many rows without a bus"])
def test_hot_partition_is_split(spark, places, faulted):
    """Rows of one bus, or of none, that are two in three are joined in several tasks."""
    n = 200_000
    hot = F.col("id") % 3 > 0
    rows = spark.range(n, numPartitions=8).select(
        "id",
        F.when(hot, "13").otherwise(F.col("id").cast("string")).alias("Bus_loc"),
        F.when(hot, 4 if faulted else 1).otherwise(4).alias("fault_type_coded"),
        F.sha2(F.col("id").cast("string"), 512).alias("payload"),
    )
    with set_conf(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1MB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="1MB",
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
    ):
        counted = attach_distance(rows, places).agg(
            F.count("distance_sub_station"), F.count("*"), F.max("payload")
        )
        found, total, _ = counted.collect()[0]
        text = counted._jdf.queryExecution().executedPlan().toString()
    assert total == n
    # bus 13 if it is faulted, and run 0 at bus "0"
    assert found == (sum(i % 3 > 0 for i in range(n)) if faulted else 0) + 1
    assert "skew=true" in text


def test_repeated_names_are_refused(spark, places):
    twice = places.unionAll(spark.createDataFrame([(1.0, 1.0, "13")], places.schema))
    rows = spark.createDataFrame([("13", 4)], "Bus_loc string, fault_type_coded int")
    with pytest.raises(ValueError, match="2 rows have the key {'Bus_loc': '13'}"):
        attach_distance(rows, twice)
