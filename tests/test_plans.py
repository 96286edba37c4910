"""What must not turn up in the plans, at any scale."""

import pytest

from faultline.plans.queries import queries
from tests.helpers import plan, set_conf

PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsIn", "MapIn"]
LEARNED = {"q25_train_eval", "q25b_train_eval_steps", "q25d_epochs", "q26_batch_score", "q28_distance_fit"}


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    return {name: plan(query(spark, sf_dir)) for name, query in queries().items() if name not in LEARNED}


def test_no_cross_join(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text, name
        assert "NestedLoopJoin" not in text, name


def test_python_only_in_the_sweeps(plans):
    with_python = {n for n, text in plans.items() if any(node in text for node in PYTHON_NODES)}
    assert with_python == {
        "q20_sweep_grouped",
        "q20b_sweep_groups",
        "q21_sweep_map",
    }


def test_single_tasks_only_for_offsets(plans):
    """Each indexed scan in a plan brings one window over its partition sizes."""
    for name, text in plans.items():
        tree = text.split("\n\n")[0]
        # evaluate() has two windows by part and class over its confusion table
        offsets = tree.count("Window") - (2 if name == "q25c_evaluate" else 0)
        assert offsets <= 2, name
        assert text.count("SinglePartition") == offsets, name


def test_bucketed_tables_are_not_shuffled(spark, sf_dir):
    with set_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(queries()["q22c_bucketed_join"](spark, sf_dir))
    assert "Exchange" not in text and "SortMergeJoin" in text


def test_row_local_queries_do_not_shuffle(plans):
    for name in ("q01_scan", "q02_sweep", "q03_normalise", "q04_bus", "q05_letters", "q06_code", "q10_round", "q16_distance"):
        assert "Exchange" not in plans[name], name


def test_counts_are_aggregated_before_the_shuffle(plans):
    for name in ("q07_code_counts", "q11_class_counts", "q12_class_prob", "q24_summary", "q27_latest_model"):
        assert "partial_" in plans[name], name


@pytest.fixture
def ordered(monkeypatch):
    """Plans of the frames that were put in order and stored."""
    import faultline.operators.sequence as sequence

    texts, real = [], sequence.stored

    def watched(df, label):
        texts.append(plan(df))
        return real(df, label)

    monkeypatch.setattr(sequence, "stored", watched)
    return texts


def test_ordering_reads_only_what_is_kept(spark, sf_dir, ordered):
    queries()["q12_class_prob"](spark, sf_dir)
    (text,) = ordered
    read = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "l_shipdate" in read and "l_quantity" not in read


@pytest.mark.parametrize("name", ["q08_batch", "q12_class_prob", "q15_dataset"])
def test_ordering_is_one_range_shuffle(spark, sf_dir, ordered, name):
    """The check for repeated keys included; nothing wide is among what is ordered."""
    queries()[name](spark, sf_dir)
    (text,) = ordered
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("Sort") == 1 and "Window" in tree
    assert "l_quantity" not in text
    assert "rangepartitioning(l_orderkey" in text and "SinglePartition" not in text


def test_labels_are_worked_out_after_the_shuffle(spark, sf_dir, ordered):
    queries()["q12_class_prob"](spark, sf_dir)
    (text,) = ordered
    exchange = next(line for line in text.splitlines() if ") Exchange" in line and "(" == line[0])
    number = int(exchange[1 : exchange.index(")")])
    labels = [
        int(part.split(")")[0])
        for part in text.split("\n(")[1:]
        if "regexp_extract_all" in part
    ]
    assert labels and min(labels) > number


@pytest.mark.parametrize("name", ["q13_sequence", "q15_dataset", "q15b_dataset_fused", "q17_transpose", "q24_summary"])
def test_wide_rows_are_shuffled_once(plans, name):
    """Rows with measures are sent to their batch's partition and nowhere else."""
    wide = [
        part
        for part in plans[name].split("\n\n")
        if part.startswith("(") and ") Exchange" in part.splitlines()[0] and "V1mag_13" in part
    ]
    assert len(wide) == 1 and "shufflepartitionidpassthrough" in wide[0]
    assert "hashpartitioning" not in plans[name]
