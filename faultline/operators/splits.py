"""Exact, repeatable train / validation / test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.sequence import INDEX, TOTAL, add_row_index


def assign_split(
    df: DataFrame,
    ids: DataFrame,
    id_column: str = "batch_id",
    train: float = 0.7,
    val: float = 0.15,
    seed: int = 0,
) -> DataFrame:
    """Add ``split`` to ``df``: the first int(train * n) ids of a seeded shuffle
    are ``train``, those up to int((train + val) * n) ``val``, the rest ``test``.

    ``ids`` holds each id of ``df`` once, which is checked. Only the ids are ranked; the (at most
    two) ids at the cuts come to the driver, and every row of ``df`` then finds
    its part by comparing its own hash, so wide rows are not shuffled.
    """
    if not (0 <= train <= 1 and 0 <= val <= 1 and train + val <= 1):
        raise ValueError("train and val must be shares with a sum of at most 1")

    shuffled = _shuffle_key(id_column, seed)
    ranked = add_row_index(
        ids.select(id_column, shuffled.alias("_hash")), ["_hash", id_column], ties="fail"
    )
    train_end = F.floor(F.col(TOTAL) * F.lit(float(train)))
    val_end = F.floor(F.col(TOTAL) * F.lit(float(train + val)))
    cuts = (
        ranked.withColumns({"_train": train_end, "_val": val_end})
        .filter((F.col(INDEX) == F.col("_train")) | (F.col(INDEX) == F.col("_val")))
        .select("_hash", id_column, INDEX, "_train", "_val")
        .collect()
    )

    own = F.struct(shuffled, F.col(id_column))
    id_type = df.schema[id_column].dataType

    def before(cut: str) -> Column:
        for row in cuts:
            if row[INDEX] == row[cut]:
                at_cut = F.lit(row[id_column]).cast(id_type)
                return own < F.struct(F.lit(row["_hash"]), at_cut)
        # no id at the cut: every id lies before it
        return F.lit(True)

    part = (
        F.when(before("_train"), "train").when(before("_val"), "val").otherwise("test")
    )
    return df.withColumn("split", part)


def _shuffle_key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))
