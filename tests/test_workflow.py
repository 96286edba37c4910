from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from faultline.learning import load_latest, score
from faultline.learning.model import flattened_frame
from faultline.operators import model_rows
from faultline.plans.workflow import generate_simulations, prepare_dataset, train_classifier
from faultline.schema import CLASS_CODES, DATASET, MEASURES, SIMULATION, check_schema
from faultline.sources import schema_in_use
from faultline.sources.scratch import application_folder
from tests.helpers import plan

STEPS = 6
OUTPUT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("Ron", T.DoubleType()),
        T.StructField("step", T.IntegerType()),
        *SIMULATION.fields,
    ]
)


def simulator():
    letters, measures, columns, steps = list(CLASS_CODES), list(MEASURES), OUTPUT.names, STEPS

    def simulate(params):
        rows = params.loc[params.index.repeat(steps)].reset_index(drop=True)
        step = np.tile(np.arange(steps, dtype="int32"), len(params))
        kind = rows["id"].to_numpy() % len(letters)
        values = {m: rows["Rg"] * (i + 1) + kind + step for i, m in enumerate(measures)}
        label = pd.Series([f"CB1_{step_}_{letters[k]}" for step_, k in zip(step, kind)])
        return pd.DataFrame({**rows, "step": step, **values, "fault_class": label})[columns]

    return simulate


def test_from_sweep_to_scored_batches(spark, tmp_path):
    runs = 40
    root = str(tmp_path / "registry")
    with schema_in_use(spark, "workflow_test"):
        stored = generate_simulations(spark, simulator(), OUTPUT, runs, "workflow_test.simulation")
        assert stored.count() == runs * STEPS

        dataset = prepare_dataset(
            spark, "workflow_test.simulation", ["id", "step"], "workflow_test.dataset", STEPS
        )
        check_schema(dataset, DATASET)
        left = Path(application_folder(spark).removeprefix("file:")) / "intermediate"
        assert not list(left.glob("scope-*"))
        parts = {r.split: r["count"] for r in dataset.groupBy("split").count().collect()}
        assert parts == {"train": 28, "val": 6, "test": 6}
        # one batch is one run, so it has one class for certain
        for row in dataset.collect():
            assert row.fault_type[(row.batch_id - 1) % 8] == 1.0
            assert len(row.features) == STEPS
        assert "PartitionFilters: [isnotnull(split" in plan(dataset.filter("split = 'train'"))

        version, metrics = train_classifier(
            spark, "workflow_test.dataset", root, "faults", STEPS, max_iter=20
        )
        assert version == 1
        values = {(r.split, r.metric): r.value for r in metrics.collect()}
        assert len(values) == 9 and values["train", "accuracy"] > 0.5

        frame = flattened_frame(model_rows(dataset, STEPS))
        assert score(load_latest(spark, root, "faults"), frame).count() == runs
