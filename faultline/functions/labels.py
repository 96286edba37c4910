"""Raw fault label -> bus, phase letters and class number, as column expressions.

All of it stays inside generated JVM code and is row-local, so it works the
same on a batch frame and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schema import CLASS_CODES, LETTERS_PATTERN, UNFAULTED, UNFAULTED_LABEL


def normalised_label(label: Column) -> Column:
    """Give fault-free rows a label of the common shape."""
    return F.when(label == UNFAULTED, F.lit(UNFAULTED_LABEL)).otherwise(label)


def bus_location(label: Column) -> Column:
    """Second ``_``-separated part of the label; null when there is none."""
    return F.try_element_at(F.split(label, "_"), F.lit(2))


def phase_letters(label: Column, pattern: str = LETTERS_PATTERN) -> Column:
    """All letter runs after an underscore, joined by ``_``; null stays null."""
    letters = F.regexp_extract_all(label, F.lit(pattern), F.lit(1))
    # concat_ws alone would turn a null label into an empty string
    return F.when(label.isNotNull(), F.concat_ws("_", letters))


def fault_code(letters: Column, codes: dict[str, int] = CLASS_CODES) -> Column:
    """Class number of the letters; null when they are in no class."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), letters).cast("int")
