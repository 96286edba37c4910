"""Every query against the checking SQL, on whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "nation customer supplier part orders lineitem events".split()
# the others are checked in tests/llm
QUERIES = {k: v for k, v in entry_point.queries().items() if k.startswith("q")}
ORACLES = {k: v for k, v in entry_point.oracle_sql().items() if k.startswith("q")}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(rows):
    def key(row):
        return tuple((v is not None, v) for v in row)

    def value(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(value(v) for v in row) for row in rows), key=key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    assert got == plain(expected.project(", ".join(columns)).fetchall())
    assert got


def test_only_learned_results_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {
        "q25_train_eval",
        "q25b_train_eval_steps",
        "q25d_epochs",
        "q28_distance_fit",
    }
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["batch_id", *[f"p{k}" for k in range(1, 9)]]
    assert df.count() == 10


@pytest.mark.parametrize("name", ["q25_train_eval", "q25b_train_eval_steps"])
def test_train_eval(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert {(r.split, r.metric) for r in rows} == {
        (s, m) for s in ("train", "val", "test") for m in ("log_loss", "accuracy", "f1")
    }
    assert all(r.value >= 0 for r in rows)
    assert all(r.value <= 1 for r in rows if r.metric != "log_loss")


def test_batch_score(spark, sf_dir):
    rows = QUERIES["q26_batch_score"](spark, sf_dir).collect()
    assert {r.batch_id for r in rows} == set(range(1, 11))
    assert all(r.as_fitted and r.n_probabilities == 8 for r in rows)


def test_sinks_leave_one_schema(spark, sf_dir):
    QUERIES["q22_sink"](spark, sf_dir)
    QUERIES["q22_sink"](spark, sf_dir)
    names = [s.name for s in spark.catalog.listDatabases()]
    assert [n for n in names if "sink" in n] == []


def test_sorted_by_batch(spark, sf_dir):
    ids = [r.batch_id for r in QUERIES["q09_full_batches"](spark, sf_dir).collect()]
    assert ids == sorted(ids)
