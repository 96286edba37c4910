import hashlib

import pytest
from pyspark.sql import functions as F

from faultline.operators import assign_split


def split(spark, ids, **options):
    df = spark.createDataFrame([(i,) for i in ids], "batch_id long").repartition(3)
    df = df.withColumn("payload", F.col("batch_id") * 2)
    got = assign_split(df, df.select("batch_id"), **options).collect()
    assert all(r.payload == 2 * r.batch_id for r in got)
    return {r.batch_id: r.split for r in got}


def by_definition(ids, train=0.7, val=0.15, seed=0):
    order = sorted(ids, key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())
    n = len(order)
    first, second = int(n * train), int(n * (train + val))
    parts = ["train"] * first + ["val"] * (second - first) + ["test"] * (n - second)
    return dict(zip(order, parts))


@pytest.mark.parametrize(
    "n, sizes",
    [
        (0, (0, 0, 0)),
        (1, (0, 0, 1)),
        (10, (7, 1, 2)),
        (40, (28, 6, 6)),
        (108, (75, 16, 17)),
        (1083, (758, 162, 163)),
    ],
)
def test_sizes_and_members(spark, n, sizes):
    got = split(spark, range(1, n + 1))
    parts = list(got.values())
    assert tuple(parts.count(p) for p in ("train", "val", "test")) == sizes
    assert got == by_definition(range(1, n + 1))


@pytest.mark.parametrize("train, val", [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.5, 0.5), (0.5, 0.0)])
def test_edge_shares(spark, train, val):
    assert split(spark, range(20), train=train, val=val) == by_definition(range(20), train, val)


def test_seed_changes_the_members(spark):
    one, other = split(spark, range(50), seed=1), split(spark, range(50), seed=2)
    assert one == by_definition(range(50), seed=1)
    assert one != other


def test_rows_of_one_id_stay_together(spark):
    ids = spark.range(1, 31).withColumnRenamed("id", "batch_id")
    many = ids.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4))))
    got = assign_split(many, ids).groupBy("batch_id").agg(F.count_distinct("split").alias("n"))
    assert {r.n for r in got.collect()} == {1}


@pytest.mark.parametrize("train, val", [(0.9, 0.2), (-0.1, 0.5), (0.5, -0.1)])
def test_shares_are_checked(spark, train, val):
    ids = spark.range(3).withColumnRenamed("id", "batch_id")
    with pytest.raises(ValueError, match="shares"):
        assign_split(ids, ids, train=train, val=val)


def test_repeated_ids_are_refused(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,)], "batch_id long")
    with pytest.raises(ValueError, match="'batch_id': 2"):
        assign_split(ids, ids)
