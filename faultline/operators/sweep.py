"""Parameter sweeps and user functions run over them.

The function is the user's simulator: it takes a pandas frame of parameter rows
and returns a frame of result rows. It is the one place with Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Simulator = Callable[[pd.DataFrame], pd.DataFrame]
StreamSimulator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# --- fixed values: exponents of the swept and values of the constant parameters
EXPONENTS = {"Ron": 1.0, "Rg": 2.0}
CONSTANTS = {"StopTime": 1.0}

# Most runs in one call of ``sweep_mapped``, to bound the memory its results take.
MAX_RUNS = 1024

# Rows of small results that travel together.
RESULT_ROWS = 10_000


def run_ids(spark: SparkSession, n: int) -> DataFrame:
    """Run numbers 0 .. n-1 in a column ``id``."""
    return spark.range(n)


def log_sweep(
    runs: DataFrame,
    n: int | Column,
    exponents: Mapping[str, float] = EXPONENTS,
    constants: Mapping[str, float] = CONSTANTS,
    run_id: str = "id",
) -> DataFrame:
    """Log-spaced parameters for ``n`` numbered runs.

    Parameter ``p`` with exponent ``k`` rises from ``10 ** -k`` at run 0 towards
    1. The run number is kept: it tells the runs apart when results are stored.
    """
    number = F.col(run_id).cast("double")
    size = n if isinstance(n, Column) else F.lit(n)
    swept = {
        name: F.pow(F.lit(10.0), F.lit(-k) * (size - number) / size)
        for name, k in exponents.items()
    }
    fixed = {name: F.lit(value) for name, value in constants.items()}
    return runs.withColumns({**swept, **fixed}).select(run_id, *swept, *fixed)


def sweep_grouped(
    params: DataFrame,
    simulate: Simulator,
    output: T.StructType,
    key: str = "Ron",
    run_id: str = "id",
    tasks: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Call ``simulate`` once on all the runs that share a ``key``.

    Rows are dealt out by key to ``tasks`` tasks (default: the session's shuffle
    partitions) and sorted there; each task cuts its stream where the key
    changes. A null key is a key. A task holds the rows of one key, which a hot
    key must fit: a call sees its whole group by contract. ``sweep_streamed`` has
    no such bound. If the runs are independent, use ``sweep_mapped``, or give
    ``max_rows``, and a group is handed over in slices of that many rows.
    """
    _check_output(output, key, run_id)
    columns = params.sparkSession.createDataFrame([], output).toArrow().schema

    def call(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        step = max_rows or len(group)
        for start in range(0, len(group), step):
            result = simulate(group.iloc[start : start + step].reset_index(drop=True))
            if set(result.columns) != set(columns.names):
                raise ValueError(f"got columns {list(result.columns)}, not {columns.names}")
            yield result

    # inner functions travel by value: workers need not have this package
    def same(one: pa.Scalar, other: pa.Scalar) -> bool:
        a, b = one.as_py(), other.as_py()
        return a == b or (a is None and b is None) or (a != a and b != b)

    def joined(results: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        # many small results travel together
        whole = pd.concat(results, ignore_index=True)
        table = pa.Table.from_pandas(whole, schema=columns, preserve_index=False)
        yield from table.to_batches()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            frame = batch.to_pandas()
            # equal values, NaN and null have one code each
            codes = pd.factorize(frame[key], use_na_sentinel=False)[0]
            missing = batch.column(key).is_null().to_numpy(zero_copy_only=False)
            codes = codes * 2 + missing
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1), len(frame)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = frame.iloc[start:stop]
                own = batch.column(key)[start]
                if held and not same(own, last):
                    yield pd.concat(held) if len(held) > 1 else held[0]
                    held = []
                held.append(part)
                last = own
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pd.DataFrame] = []
        rows = 0
        for group in groups(batches):
            for result in call(group):
                waiting.append(result)
                rows += len(result)
                if rows >= RESULT_ROWS:
                    yield from joined(waiting)
                    waiting, rows = [], 0
        if waiting:
            yield from joined(waiting)

    spread = params.repartition(_tasks(params, tasks), F.col(key))
    return spread.sortWithinPartitions(key, run_id).mapInArrow(stream, output)


def sweep_streamed(
    params: DataFrame,
    simulate: StreamSimulator,
    output: T.StructType,
    key: str = "Ron",
    run_id: str = "id",
    tasks: int | None = None,
) -> DataFrame:
    """Call ``simulate`` once on the runs that share a ``key``, as a stream.

    It takes an iterator over frames, the group's rows by ``run_id`` in pieces of
    at most ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, and yields
    frames of results. What it does not keep is gone, so a group may be larger than
    a worker's memory; its rows still pass through one task, in order, as the
    group is one call's by contract. A null key is a key. Rows that ``simulate``
    leaves unread are skipped.
    """
    _check_output(output, key, run_id)
    columns = params.sparkSession.createDataFrame([], output).toArrow().schema

    # the annotations tell Spark which form of the function this is
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for result in simulate(batch.to_pandas() for batch in batches):
            if set(result.columns) != set(columns.names):
                raise ValueError(f"got columns {list(result.columns)}, not {columns.names}")
            yield pa.RecordBatch.from_pandas(result, schema=columns, preserve_index=False)

    # postponed annotations are strings, which Spark does not look up
    call.__annotations__ = {
        "batches": Iterator[pa.RecordBatch],
        "return": Iterator[pa.RecordBatch],
    }
    spread = params.repartition(_tasks(params, tasks), F.col(key)).sortWithinPartitions(key, run_id)
    return spread.groupBy(key).applyInArrow(call, output)


def sweep_mapped(
    params: DataFrame,
    simulate: Simulator,
    output: T.StructType,
    run_id: str = "id",
    tasks: int | None = None,
    max_runs: int = MAX_RUNS,
) -> DataFrame:
    """Call ``simulate`` on up to ``max_runs`` runs at a time, with no grouping.

    Parameter rows are few and small but each may take minutes to run, so they
    are dealt out evenly to ``tasks`` tasks (default: the session's shuffle
    partitions).
    """
    _check_output(output, run_id)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), max_runs):
                yield simulate(frame.iloc[start : start + max_runs])

    return params.repartition(_tasks(params, tasks)).mapInPandas(batches, output)


def _tasks(params: DataFrame, tasks: int | None) -> int:
    # an explicit number, as adaptive execution would merge such small partitions
    if tasks is not None:
        return tasks
    return int(params.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _check_output(output: T.StructType, *columns: str) -> None:
    if not isinstance(output, T.StructType):
        raise TypeError("the output columns must be given as a StructType")
    lost = [c for c in columns if c not in output.names]
    if lost:
        raise ValueError(f"the output must keep {', '.join(lost)}")
