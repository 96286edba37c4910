from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.schema import LOCATIONS, SIMULATION, SchemaError
from faultline.sources import (
    clear_scratch,
    lasting_path,
    overwrite_table,
    read_table,
    schema_in_use,
    scratch,
    scratch_path,
    scratch_scope,
    stored,
)
from tests.helpers import plan, set_conf


def test_missing_and_mistyped_columns_are_named(spark, tmp_path):
    path = str(tmp_path / "places")
    spark.createDataFrame([(1, "13")], "X_Coord long, Bus_loc string").write.parquet(path)
    with pytest.raises(SchemaError) as error:
        read_table(spark, path, LOCATIONS)
    assert str(error.value) == "X_Coord: bigint, expected double; Y_Coord: missing, expected double"


def test_extra_columns_are_allowed(spark, tmp_path):
    path = str(tmp_path / "places")
    schema = T.StructType([*LOCATIONS.fields, T.StructField("note", T.StringType())])
    spark.createDataFrame([(1.0, 2.0, "13", "x")], schema).write.parquet(path)
    assert read_table(spark, path, LOCATIONS).columns == schema.names


def test_only_used_columns_are_read(spark, sf_dir):
    from faultline.plans import queries as q

    text = plan(q.q07_code_counts(spark, sf_dir))
    assert "l_extendedprice" not in text.split("ReadSchema")[1].splitlines()[0]


def test_filter_on_a_label_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "simulation")
    spark.createDataFrame([(*[0.0] * 12, "unfaulted")], SIMULATION).write.parquet(path)
    df = read_table(spark, path, SIMULATION).filter("fault_class = 'unfaulted'").select("V1mag_13")
    text = plan(df)
    assert "EqualTo(fault_class,unfaulted)" in text
    assert "ReadSchema: struct<V1mag_13:double,fault_class:string>" in text


def test_second_write_wins(spark):
    with schema_in_use(spark, "sink_test"):
        overwrite_table(spark.range(5), "t")
        table = overwrite_table(spark.range(3).selectExpr("id", "id % 2 AS part"), "t", partition_by=["part"])
        assert sorted(r.id for r in table.collect()) == [0, 1, 2]
        assert read_table(spark, "sink_test.t").count() == 3
    assert spark.catalog.currentDatabase() == "default"


def test_partitioned_sink_is_pruned(spark):
    df = spark.range(30).selectExpr("id", "CASE WHEN id < 20 THEN 'train' ELSE 'test' END AS split")
    with schema_in_use(spark, "prune_test"):
        table = overwrite_table(df, "prune_test.t", partition_by=["split"])
    test = table.filter("split = 'test'")
    assert "PartitionFilters: [isnotnull(split" in plan(test)
    assert test.count() == 10


def test_other_format(spark):
    with schema_in_use(spark, "format_test"):
        assert overwrite_table(spark.range(4), "t", fmt="orc").count() == 4


def test_provenance(spark):
    with schema_in_use(spark, "who_test"):
        table = overwrite_table(spark.range(2), "t", provenance=True)
        user = spark.sql("SELECT current_user()").first()[0]
        assert {r.written_by for r in table.collect()} == {user}


def test_schema_is_restored_after_an_error(spark):
    with pytest.raises(RuntimeError), schema_in_use(spark, "error_test"):
        raise RuntimeError
    assert spark.catalog.currentDatabase() == "default"


class StubSession:
    """As much of a session without the setting as ``scratch_path`` looks at."""

    applicationId = "app-1"

    def __init__(self):
        self.conf = self.sparkContext = self

    def get(self, name, default=None):
        return "/shared/warehouse" if name == "spark.sql.warehouse.dir" else default

    def getCheckpointDir(self):
        return None


def test_scratch_falls_back_to_the_warehouse():
    path = scratch_path(StubSession(), "x")
    assert path.startswith("/shared/warehouse/_scratch/faultline/app-1/intermediate/x-")


def test_scope_deletes_what_was_stored_in_it(spark):
    outside = stored(spark.range(3), "outside")
    with scratch_scope(spark):
        inside = stored(spark.range(3), "inside")
        (file,) = {f.removeprefix("file:") for f in inside.inputFiles()[:1]}
        assert inside.count() == 3 and Path(file).exists()
    assert not Path(file).exists() and outside.count() == 3


def test_scratch_is_in_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(root) and first != second


def test_stored_frame_starts_from_files(spark):
    df = spark.range(10).repartition(3).withColumn("x", F.rand())
    once = stored(df, "test")
    assert once.schema.simpleString() == df.schema.simpleString()
    assert sorted(once.collect()) == sorted(once.collect())
    assert "Exchange" not in plan(once) and "Range" not in plan(once)


def test_clearing_deletes_this_folder_only(spark, tmp_path, monkeypatch):
    mine, other = tmp_path / "faultline" / "mine", tmp_path / "faultline" / "other"
    other.mkdir(parents=True)
    monkeypatch.setattr(scratch, "application_folder", lambda _: str(mine))
    assert stored(spark.range(3), "test").count() == 3
    spark.range(1).write.parquet(lasting_path(spark, "registry"))
    assert (mine / "intermediate").exists()
    clear_scratch(spark)
    assert not (mine / "intermediate").exists() and other.exists()
    assert [p.name[:8] for p in mine.iterdir()] == ["registry"]


def versions(spark, schema, name):
    rows = spark.sql(f"SHOW TABLES IN {schema} LIKE '{name}__v*'").collect()
    return {r.tableName for r in rows}


def test_failed_writer_leaves_the_old_rows(spark):
    late = F.when(F.col("id") == 90, F.raise_error(F.lit("broken off"))).otherwise(F.col("id"))
    with schema_in_use(spark, "atomic_test"):
        overwrite_table(spark.range(5), "t")
        with pytest.raises(Exception, match="broken off"):
            overwrite_table(spark.range(100).select(late.cast("long").alias("id")), "t")
        assert [r.id for r in spark.table("t").orderBy("id").collect()] == [0, 1, 2, 3, 4]
        assert len(versions(spark, "atomic_test", "t")) == 1


def test_a_table_can_be_made_from_itself(spark):
    with schema_in_use(spark, "self_test"):
        overwrite_table(spark.range(4), "t")
        overwrite_table(spark.table("t").selectExpr("id + 10 AS id"), "t")
        assert {r.id for r in spark.table("self_test.t").collect()} == {10, 11, 12, 13}
        overwrite_table(spark.table("t").selectExpr("id", "id * 2 AS twice"), "self_test.t")
        assert {r.twice for r in spark.table("t").collect()} == {20, 22, 24, 26}


def test_readers_see_old_or_new(spark):
    with schema_in_use(spark, "reader_test"):
        before = overwrite_table(spark.range(3), "t")
        after = overwrite_table(spark.range(7), "t")
        # a frame made before the switch still reads what it was made from
        assert before.count() == 3 and after.count() == 7
        assert len(versions(spark, "reader_test", "t")) == 2
        overwrite_table(spark.range(1), "t")
        assert len(versions(spark, "reader_test", "t")) == 2


def test_plain_table_is_replaced(spark):
    with schema_in_use(spark, "plain_test"):
        spark.range(3).write.saveAsTable("t")
        assert overwrite_table(spark.table("t").filter("id > 0"), "t").count() == 2
        assert overwrite_table(spark.range(9), "t").count() == 9


def test_bucketed_tables_join_without_a_shuffle(spark):
    features = spark.range(500).selectExpr("id % 50 AS batch_id", "id * 0.5 AS x")
    target = spark.range(50).selectExpr("id AS batch_id", "id % 8 AS label")
    with schema_in_use(spark, "bucket_test"), set_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        left = overwrite_table(features, "features", bucket_by=(4, "batch_id"))
        right = overwrite_table(target, "target", bucket_by=(4, "batch_id"))
        joined = left.join(right, "batch_id").groupBy("batch_id").agg(F.sum("x"), F.max("label"))
        assert "Exchange" not in plan(joined)
        assert joined.count() == 50
