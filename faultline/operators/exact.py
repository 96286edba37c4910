"""Sums of doubles that are exact, so that no result depends on their order.

A double is a whole number of steps of some power of two. Each value is cut into
signed parts of 32 bits at fixed places, the parts are summed as integers, combined
before the shuffle, and a group's parts are put together and rounded once. As many
places are used as the values span.

Defined cases. Nulls are passed over, and a group of nulls has a null sum. With
infinity or NaN in a group the sum is what IEEE addition gives, in any order. A sum
beyond the largest double is infinite. Values outside the given places fail by
name. A group may have up to 2**31 rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32
BASE = 2**BITS
LAST_BIT = -1074  # of the least double
DIGITS = 53
OUTSIDE = "value outside the places of the sum"


def exact_places(df: DataFrame, columns: Sequence[str]) -> range:
    """The places, as powers of 2**32, that the finite values of ``columns`` need.

    One aggregate over all rows; two numbers reach the driver.
    """
    sizes = [F.abs(F.col(c).cast("double")) for c in columns]
    some = [F.when((s > 0) & (s < math.inf), s) for s in sizes]
    never = F.lit(None).cast("double")
    least, most = df.agg(
        F.least(never, never, *map(F.min, some)), F.greatest(never, never, *map(F.max, some))
    ).first()
    if least is None:
        return range(0, 2)
    last = max(math.frexp(least)[1] - DIGITS, LAST_BIT)
    # one more than the largest value has, as parts are rounded to both sides
    return range(last // BITS, (math.frexp(most)[1] - 1) // BITS + 2)


def _halves(power: int) -> tuple[float, float]:
    """Two factors that make 2**power, which alone may be no double."""
    return 2.0 ** (power // 2), 2.0 ** (power - power // 2)


def _in_units(value: Column, place: int) -> Column:
    power = -BITS * place
    if abs(power) < 1000:
        return value * F.lit(2.0**power)
    low, high = _halves(power)
    return value * F.lit(low) * F.lit(high)


def _part(value: Column, place: int, places: range) -> Column:
    here = _in_units(value, place)
    if place == places[-1]:
        part, bad = F.rint(here), F.abs(here) > BASE / 2
    else:
        # exact: both are the value without its bits below a place
        part = F.rint(here) - F.rint(_in_units(value, place + 1)) * F.lit(float(BASE))
        # a value this large has no bits here
        part = F.when(F.abs(here) < 2.0**90, part).otherwise(F.lit(0.0))
        bad = here != F.rint(here) if place == places[0] else None
    if bad is not None:
        part = F.when(bad, F.raise_error(F.lit(OUTSIDE)).cast("double")).otherwise(part)
    return part.cast("bigint")


def _carried(parts: Column) -> Column:
    """``digits`` from 0 up to the base, lowest first, and the ``carry`` beyond."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("carry"),
        F.array().cast("array<bigint>").alias("digits"),
    )

    def add(state: Column, part: Column) -> Column:
        whole = state["carry"] + part
        digit = whole.bitwiseAND(F.lit(BASE - 1).cast("bigint"))
        return F.struct(
            F.shiftright(whole, BITS).alias("carry"),
            F.concat(state["digits"], F.array(digit)).alias("digits"),
        )

    return F.aggregate(parts, start, add)


def _leading(digits: Column) -> Column:
    """The three digits from the first that is not 0 as ``head``, how many digits
    come after (``after``), and whether any of those is not 0 (``more``)."""
    number = "decimal(38,0)"
    start = F.struct(
        F.lit(0).cast(number).alias("head"),
        F.lit(0).alias("taken"),
        F.lit(0).alias("after"),
        F.lit(False).alias("more"),
    )

    def take(state: Column, digit: Column) -> Column:
        full = state["taken"] == 3
        begun = (state["taken"] > 0) | (digit > 0)
        longer = (state["head"] * F.lit(BASE).cast("decimal(10,0)") + digit).cast(number)
        return F.struct(
            F.when(full, state["head"]).otherwise(longer).alias("head"),
            F.when(full | ~begun, state["taken"]).otherwise(state["taken"] + 1).alias("taken"),
            F.when(full, state["after"] + 1).otherwise(state["after"]).alias("after"),
            (state["more"] | (full & (digit > 0))).alias("more"),
        )

    return F.aggregate(F.reverse(digits), start, take)


def exact_value(parts: Column, odd: Column, places: range) -> Column:
    """The double nearest to the sum whose ``parts`` (an array) are given.

    Three digits hold over 64 bits, so one more bit for "something follows" makes
    the cast round as the whole number would.
    """

    def magnitude(carried: Column) -> Column:
        lead = _leading(F.concat(carried["digits"], F.array(carried["carry"])))
        marked = (lead["head"] * 2 + lead["more"].cast("int")).cast("decimal(38,0)").cast("double")
        low, high = zip(
            *[_halves(BITS * (places[0] + n) - 1) for n in range(len(places) + 1)], strict=True
        )
        powers = [F.get(F.array(*map(F.lit, p)), lead["after"]) for p in (low, high)]
        return marked * powers[0] * powers[1]

    plus = _carried(parts)
    minus = _carried(F.transform(parts, lambda x: -x))
    total = F.when(plus["carry"] < 0, -magnitude(minus)).otherwise(magnitude(plus))
    return F.coalesce(odd, F.when(F.get(parts, F.lit(0)).isNotNull(), total))


def exact_sums(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    places: range | None = None,
    ends: bool = False,
) -> DataFrame:
    """One row per group: ``by`` and, for each column, its exact ``<column>_sum``.

    ``ends`` adds ``<column>_min`` and ``<column>_max``. Without ``places`` the values
    are read twice, once to see what they span. The columns are summed one below the
    other, so that the compiled loop stays small however many there are; what they
    add up to is put side by side again, one narrow row per group and column.
    """
    places = exact_places(df, columns) if places is None else places
    values = F.array(*[F.col(c).cast("double") for c in columns])
    below = df.select(*by, F.posexplode(values).alias("_column", "_value"))
    value = F.col("_value")
    finite = F.when(F.abs(value) < math.inf, value)
    made = below.groupBy(*by, "_column").agg(
        *[F.sum(_part(finite, k, places)).alias(f"_{k}") for k in places],
        F.sum(F.when(F.abs(value) >= math.inf, value)).alias("_odd"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    parts = F.array(*[F.col(f"_{k}") for k in places])
    totals = made.withColumn("_sum", exact_value(parts, F.col("_odd"), places))
    shown = ("sum", "min", "max") if ends else ("sum",)
    side_by_side = [
        F.max(F.when(F.col("_column") == i, F.col(f"_{part}"))).alias(f"{c}_{part}")
        for i, c in enumerate(columns)
        for part in shown
    ]
    return totals.groupBy(*by).agg(*side_by_side)
