import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.operators import sequence as sequence_module
from faultline.operators import (
    add_batches,
    add_keyed_batches,
    add_row_index,
    check_unique,
    code_rows,
    colocated_batches,
    drop_batches,
    full_batches,
)
from faultline.sources import scratch
from tests.helpers import plan, read_schemas, set_conf

FEW = settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)


def frame(spark, rows, parts=5):
    schema = "a long, b long, v double"
    return spark.createDataFrame(rows, schema).repartition(parts, "b", "v")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def stored(spark, rows, tmp_path):
    path = str(tmp_path / "rows")
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


@FEW
@given(
    leads=st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=200),
    seed=st.integers(0, 100),
)
def test_index_agrees_with_a_sort(spark, leads, seed):
    rows = [(lead, i, float(i)) for i, lead in enumerate(leads)]
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    indexed = add_row_index(frame(spark, shuffled), ["a", "b"], ties="promised").collect()
    by_index = sorted(indexed, key=lambda r: r.row_index)
    assert [r.row_index for r in by_index] == list(range(len(rows)))
    assert [(r.a, r.b, r.v) for r in by_index] == in_order(rows)
    assert {r.row_total for r in indexed} <= {len(rows)}


@pytest.mark.parametrize("n", [0, 1, 553, 554, 555, 1108])
def test_batch_sizes(spark, tmp_path, n):
    df = stored(spark, [(i // 7, i, 0.0) for i in range(n)], tmp_path)
    batches = add_batches(df, ["a", "b"])
    sizes = {r.batch_id: r["count"] for r in batches.groupBy("batch_id").count().collect()}
    full, rest = divmod(n, 554)
    expected = {i + 1: 554 for i in range(full)}
    assert sizes == (expected | {full + 1: rest} if rest else expected)
    kept = full_batches(batches).select("batch_id").distinct().collect()
    assert {r.batch_id for r in kept} == set(expected)


@FEW
@given(n=st.integers(0, 150), size=st.integers(1, 40))
def test_full_batches_have_one_size(spark, n, size):
    df = frame(spark, [(i % 3, i, 0.0) for i in range(n)])
    kept = full_batches(add_batches(df, ["a", "b"], size), size)
    counts = [r["count"] for r in kept.groupBy("batch_id").count().collect()]
    assert counts == [size] * (n // size)


def test_drop_listed_batches(spark):
    df = add_batches(frame(spark, [(0, i, 0.0) for i in range(50)]), ["b"], 10)
    left = drop_batches(df, [2, 41]).select("batch_id").distinct().collect()
    assert {r.batch_id for r in left} == {1, 3, 4, 5}


def test_rows_with_equal_keys_each_get_a_number(spark, tmp_path):
    df = stored(spark, [(1, 1, float(i)) for i in range(300)], tmp_path)
    rows = add_row_index(df, ["a", "b"], ties="scan").collect()
    assert sorted(r.row_index for r in rows) == list(range(300))
    assert sorted(r.v for r in rows) == [float(i) for i in range(300)]


def test_repeated_keys_can_be_refused(spark):
    df = frame(spark, [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0)])
    assert check_unique(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="2 rows have the key {'a': 1}"):
        check_unique(df, ["a"])
    for number in (add_row_index, add_batches):
        with pytest.raises(ValueError, match="2 rows have the key {'a': 1}"):
            number(df, ["a"])
    with pytest.raises(ValueError, match="'b': 1"):
        add_keyed_batches(df.unionAll(df.limit(1)), "a", ["b"])
    with pytest.raises(ValueError, match="ties"):
        add_row_index(df, ["a"], ties="maybe")


def largest_share(indexed):
    """Largest number of rows one task stored, from the stored files."""
    files = indexed.groupBy(F.col("_metadata.file_path")).count()
    return files.agg(F.max("count")).first()[0]


@pytest.mark.parametrize("copies", [False, True], ids=["hot lead value", "copies of one row"])
def test_hot_rows_are_spread_over_tasks(spark, tmp_path, monkeypatch, copies):
    n = 40_000
    hot = F.col("id") % 3 == 0
    rows = spark.range(n).select(
        F.when(hot, 7).otherwise(F.col("id")).alias("a"),
        (F.when(hot, 1).otherwise(F.col("id")) if copies else F.col("id")).alias("b"),
    )
    path = str(tmp_path / "hot")
    rows.repartition(6, F.rand(1)).write.parquet(path)

    paths = []
    real = scratch.scratch_path
    monkeypatch.setattr(
        scratch, "scratch_path", lambda *a: paths.append(real(*a)) or paths[-1]
    )
    with set_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        indexed = add_row_index(spark.read.parquet(path), ["a", "b"], ties="scan")
        numbers = indexed.agg(F.count_distinct("row_index"), F.max("row_index")).first()
    assert tuple(numbers) == (n, n - 1)
    assert largest_share(spark.read.parquet(paths[0])) < n / 4


def test_same_numbers_whatever_the_layout(spark, tmp_path):
    rows = [(i % 4, i, float(i)) for i in range(500)]
    results = set()
    for parts in (1, 3, 9):
        df = frame(spark, rows, parts)
        numbered = add_row_index(df, ["a", "b"], ties="promised")
        results.add(tuple(sorted((r.b, r.row_index) for r in numbered.collect())))
    assert len(results) == 1


def test_merged_partitions_keep_the_order(spark):
    rows = [(i % 10, i, 0.0) for i in range(2000)]
    with set_conf(
        spark,
        spark__sql__shuffle__partitions="64",
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
    ):
        numbered = add_row_index(frame(spark, rows), ["a", "b"], ties="promised").collect()
    got = [(r.a, r.b) for r in sorted(numbered, key=lambda r: r.row_index)]
    assert got == [(a, b) for a, b, _ in in_order(rows)]


def test_derived_columns_and_kept_columns(spark):
    df = spark.createDataFrame(
        [(i, "unfaulted" if i % 2 else "CB1_4_a_g") for i in range(20)],
        "k long, fault_class string",
    )
    rows = add_batches(df, ["k"], 10, keep=["fault_type_coded"], derive=code_rows)
    assert rows.columns == ["fault_type_coded", "row_index", "row_total", "batch_id"]
    got = sorted((r.row_index, r.fault_type_coded) for r in rows.collect())
    assert got == [(i, 1 if i % 2 else 4) for i in range(20)]


def test_only_the_offsets_meet_in_one_task(spark, sf_dir):
    from faultline.plans import queries as q

    text = plan(q.q08_batch(spark, sf_dir))
    assert text.count("SinglePartition") == 1
    assert any(schema == "struct<_place:bigint>" for schema in read_schemas(text))


@settings(FEW, max_examples=5)
@given(
    leads=st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=150),
    size=st.integers(1, 20),
    parts=st.integers(1, 9),
)
def test_colocated_batches_are_the_same(spark, leads, size, parts):
    df = frame(spark, [(lead, i, float(i)) for i, lead in enumerate(leads)])
    found = colocated_batches(df, ["a", "b"], size, parts=parts)
    one = add_batches(df, ["a", "b"], size)
    columns = ["a", "b", "v", "row_index", "row_total", "batch_id"]
    assert found.total == len(leads)
    assert sorted(map(str, found.rows.select(columns).collect())) == sorted(
        map(str, one.select(columns).collect())
    )
    placed = found.rows.select("batch_id", "batch_part", F.spark_partition_id().alias("task"))
    places = placed.groupBy("batch_id").agg(
        F.count_distinct("task").alias("n"), F.count_distinct("batch_part").alias("m")
    )
    assert all(r.n == r.m == 1 for r in places.collect())


def test_parts_of_colocated_batches_follow_the_rows(spark, monkeypatch):
    df = frame(spark, [(i % 7, i, float(i)) for i in range(3000)])
    # 100 rows of three numbers
    monkeypatch.setattr(sequence_module, "PART_BYTES", 8 * 3 * 100, raising=False)
    rows = colocated_batches(df, ["a", "b"], 10).rows
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sizes == [100] * 30
    columns = ["a", "b", "v", "row_index", "row_total", "batch_id"]
    one = add_batches(df, ["a", "b"], 10)
    assert sorted(map(str, rows.select(columns).collect())) == sorted(
        map(str, one.select(columns).collect())
    )


def test_colocated_batches_are_checked(spark):
    df = frame(spark, [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0)])
    with pytest.raises(ValueError, match="2 rows have the key {'a': 1}"):
        colocated_batches(df, ["a"])
    with pytest.raises(ValueError, match="ties"):
        colocated_batches(df, ["a", "b"], ties="scan")
    named = spark.createDataFrame([("x", None), ("x", None), ("y", 1)], "k string, n int")
    with pytest.raises(ValueError, match="2 rows have the key {'k': 'x', 'n': None}"):
        add_row_index(named, ["k", "n"])


@pytest.mark.parametrize("broadcast", [True, False])
def test_keyed_batches(spark, tmp_path, broadcast):
    # one user has a third of all rows; one has none but a null name
    rows = [(1 if i % 3 == 0 else (None if i % 50 == 1 else i % 11), i, 0.0) for i in range(3000)]
    df = stored(spark, rows, tmp_path)
    expected, seen = {}, {}
    for key, order, _ in sorted(rows, key=lambda r: r[1]):
        seen[key] = seen.get(key, -1) + 1
        expected[order] = (key, seen[key], seen[key] // 10 + 1)
    limit = "10MB" if broadcast else "-1"
    with set_conf(spark, spark__sql__autoBroadcastJoinThreshold=limit):
        keyed = add_keyed_batches(df, "a", ["b"], size=10)
        got = {r.b: (r.a, r.row_index, r.batch_id) for r in keyed.collect()}
    assert got == expected


def test_hot_key_is_split(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 10).alias("a"),
        F.col("id").alias("b"),
        F.sha2(F.col("id").cast("string"), 512).alias("payload"),
    )
    rows.write.parquet(str(tmp_path / "hot"))
    with set_conf(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1MB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="1MB",
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
    ):
        keyed = add_keyed_batches(spark.read.parquet(str(tmp_path / "hot")), "a", ["b"], 100)
        largest = keyed.filter("a = 7").agg(F.max("row_index"), F.count_distinct("row_index"))
        assert tuple(largest.first()) == ((n + 2) // 3 - 1, (n + 2) // 3)
        total = keyed.agg(F.count("*"), F.max("payload"), F.max("batch_id"))
        assert total.collect()[0][0] == n
        text = total._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in text
