"""Fixed values, row shapes and the check that a frame has the shape asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
# Rows in one sequence: the fault sequences of one simulated run.
BATCH_SIZE = 554

# The twelve measured channels, in feature order.
MEASURES = [
    "V1mag_13",
    "V1ph_13",
    "V2mag_13",
    "V2ph_13",
    "V0mag_13",
    "V0ph_13",
    "I1mag_1",
    "I1ph_1",
    "I2mag_1",
    "I2ph_1",
    "I0mag_1",
    "I0ph_1",
]

# Phase letters of a fault and the class number they stand for.
CLASS_CODES = {
    "z_z": 1,
    "a_c_g": 2,
    "c_g": 3,
    "a_g": 4,
    "a_b_c_g": 5,
    "b_g": 6,
    "a_b_g": 7,
    "b_c_g": 8,
}

# Raw label of a row without a fault, and the label it is rewritten to.
UNFAULTED = "unfaulted"
UNFAULTED_LABEL = "CB0_0_z_z"

# A run of letters directly after an underscore.
LETTERS_PATTERN = "(?<=_)([a-zA-Z]+)"
# --- end of fixed values --------------------------------------------------

CLASSES = sorted(CLASS_CODES.values())
UNFAULTED_CODE = CLASS_CODES["z_z"]


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.DoubleType()) for name in names]


SWEEP = T.StructType(_doubles(["Ron", "Rg", "StopTime"]))

SIMULATION = T.StructType([*_doubles(MEASURES), T.StructField("fault_class", T.StringType())])

LOCATIONS = T.StructType(
    [*_doubles(["X_Coord", "Y_Coord"]), T.StructField("Bus_loc", T.StringType())]
)

CODED = T.StructType(
    [
        *SIMULATION.fields,
        T.StructField("Bus_loc", T.StringType()),
        T.StructField("extracted_letters", T.StringType()),
        T.StructField("fault_type_coded", T.IntegerType()),
    ]
)

# batch_id is a long: an int runs out at about 1.2e12 rows.
BATCHED = T.StructType([*CODED.fields, T.StructField("batch_id", T.LongType())])

TARGET = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("fault_type", T.ArrayType(T.DoubleType())),
    ]
)

DATASET = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("features", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("fault_type", T.ArrayType(T.DoubleType())),
    ]
)

TENSOR = T.StructType(
    [
        T.StructField("features", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("label", T.IntegerType()),
    ]
)

MODELS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("created", T.TimestampType()),
    ]
)


class SchemaError(ValueError):
    """A frame lacks columns, or has them with another type."""


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return ``df`` unchanged, or fail naming every missing or mistyped column.

    Columns beyond ``expected`` are allowed: row keys differ between tables.
    """
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    for field in expected.fields:
        wanted = field.dataType.simpleString()
        if field.name not in found:
            problems.append(f"{field.name}: missing, expected {wanted}")
        elif found[field.name] != wanted:
            problems.append(f"{field.name}: {found[field.name]}, expected {wanted}")
    if problems:
        raise SchemaError("; ".join(problems))
    return df
