import pytest
from pyspark.sql import functions as F

from faultline.learning import evaluate, fault_pipeline, fit_epochs
from faultline.learning.model import training_frame
from faultline.operators import add_batches, assign_split
from faultline.schema import MEASURES

SIZE = 5


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(60 * SIZE).select(
        "id",
        *[((F.col("id") * (c + 3)) % 17 / 3.0).alias(m) for c, m in enumerate(MEASURES)],
        (F.col("id") % 8 + 1).cast("int").alias("fault_type_coded"),
    )
    rows = training_frame(add_batches(df, ["id"], SIZE))
    return assign_split(rows, rows.select("batch_id"))


def small(**options):
    return fault_pipeline(hidden=(6,), max_iter=3, **options)


def test_the_best_epoch_is_kept(frame):
    found = fit_epochs(small(), frame, epochs=6, tasks=1)
    rows = found.losses.collect()
    assert [(r.epoch, r.split) for r in rows] == [(e, s) for e in range(1, 7) for s in ("train", "val")]
    losses = {(r.epoch, r.split): r.loss for r in rows}
    best = min(range(1, 7), key=lambda e: losses[e, "val"])
    assert found.best == best
    # each epoch goes on from the one before
    assert losses[6, "train"] < losses[1, "train"]
    got = evaluate(found.model.transform(frame)).filter("metric = 'log_loss'").collect()
    kept = {r.split: r.value for r in got}
    for part in ("train", "val"):
        assert kept[part] == pytest.approx(losses[best, part], rel=1e-9)


def test_a_rerun_gives_the_same_weights(frame):
    one, two = (fit_epochs(small(), frame, epochs=3, tasks=1) for _ in range(2))
    assert one.model.stages[-1].weights == two.model.stages[-1].weights
    assert one.losses.collect() == two.losses.collect()


def test_what_epochs_need(frame):
    with pytest.raises(ValueError, match="one epoch"):
        fit_epochs(small(), frame, epochs=0)
    with pytest.raises(ValueError, match="split = val"):
        fit_epochs(small(), frame.filter("split = 'train'"), epochs=1)
