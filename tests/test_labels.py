import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faultline.operators import add_batches, code_counts, code_rows
from faultline.schema import BATCHED, CODED, SIMULATION, check_schema

EDGE_ROWS = [
    # raw label, normalised, bus, letters, code
    ("unfaulted", "CB0_0_z_z", "0", "z_z", 1),
    ("CB1_13_a_b_c_g", "CB1_13_a_b_c_g", "13", "a_b_c_g", 5),
    ("L3_149r_b_g", "L3_149r_b_g", "149r", "b_g", 6),
    ("X_9_q_q", "X_9_q_q", "9", "q_q", None),
    ("nosep", "nosep", None, "", None),
    ("", "", None, "", None),
    ("_a_g", "_a_g", "a", "a_g", 4),
    ("CB1_7_a1_c_g", "CB1_7_a1_c_g", "7", "a_c_g", 2),
    (None, None, None, None, None),
]
ALL_CLASSES = [
    ("z_z", 1),
    ("a_c_g", 2),
    ("c_g", 3),
    ("a_g", 4),
    ("a_b_c_g", 5),
    ("b_g", 6),
    ("a_b_g", 7),
    ("b_c_g", 8),
    ("b_c", None),
]


@pytest.mark.parametrize("row", EDGE_ROWS, ids=lambda r: repr(r[0]))
def test_edge_rows(spark, row):
    df = code_rows(spark.createDataFrame([(row[0],)], "fault_class string"))
    got = df.select("fault_class", "Bus_loc", "extracted_letters", "fault_type_coded").first()
    assert tuple(got) == row[1:]


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text(alphabet="abZ_19 é-", max_size=14), min_size=1, max_size=80))
def test_any_label_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "fault_class string")
    for row in code_rows(df).collect():
        parts = row.fault_class.split("_")
        assert row.Bus_loc == (parts[1] if len(parts) > 1 else None)
        letters = re.findall("(?<=_)[a-zA-Z]+", row.fault_class)
        assert row.extracted_letters == "_".join(letters)


def test_row_shapes(spark):
    rows = spark.createDataFrame([(*[0.0] * 12, "unfaulted")], SIMULATION)
    check_schema(code_rows(rows), CODED)
    check_schema(add_batches(rows, ["V1mag_13"], derive=code_rows), BATCHED)


def test_every_class(spark):
    rows = [(f"CB1_5_{letters}",) for letters, _ in ALL_CLASSES]
    df = code_rows(spark.createDataFrame(rows, "fault_class string"))
    assert [r.fault_type_coded for r in df.collect()] == [k for _, k in ALL_CLASSES]


def test_other_code_table(spark):
    df = spark.createDataFrame([("CB1_5_q",)], "fault_class string")
    assert code_rows(df, codes={"q": 9}).first().fault_type_coded == 9


def test_counts_show_zero_for_the_null_group(spark):
    rows = [("CB1_5_a_g",)] * 3 + [("CB1_5_b_c",)] * 2
    counts = code_counts(code_rows(spark.createDataFrame(rows, "fault_class string")))
    assert {tuple(r) for r in counts.collect()} == {(4, 3, 3), (None, 0, 2)}


def test_same_result_on_a_stream(spark, tmp_path):
    labels = spark.createDataFrame([(r[0],) for r in EDGE_ROWS], "fault_class string")
    labels.write.parquet(str(tmp_path / "in"))
    stream = code_rows(spark.readStream.schema(labels.schema).parquet(str(tmp_path / "in")))
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, code_rows(labels).collect()))


def test_row_local_without_python(spark, sf_dir):
    from faultline.plans import queries as q
    from tests.helpers import plan

    text = plan(q.q06_code(spark, sf_dir))
    assert "Exchange" not in text and "EvalPython" not in text
