"""Vectors as short codes: integer product quantisation with norm-of-sum bounds.

Components become integers, vectors are cut into equal parts, and each part
position has a codebook that is fitted in rounds: every part goes to its nearest
entry, every entry to the floored mean of its parts. All sums and distances are of
integers, so results are exact and the same in every run.

A part keeps what its last scan found: its entry, the distance to it, the distance
to the next nearest, and the round of each, the bounds' stamps. The codebooks of
all rounds are kept as well. An entry that moved away and back has a small net
displacement, the norm of the sum of its moves, whatever the sum of their norms.
So the distance to the entry has grown by no more than that entry's net
displacement since its stamp, and the next nearest has come closer by no more than
the largest one of the others since theirs. While the first bound is below the
second, the assignment stands, and no distance is worked out; else the first is
made exact and compared again; only then all entries are scanned. Bounds are
floats and leave room for rounding, so ties always come to a scan, where the lower
index wins.

Each round is one pass over the vectors and their bounds, with no shuffle of
either: the new state is written to the shared folder and the one before it is
deleted. The sums by part and entry are added up in the tasks. What comes to the
driver is one codebook for each round, ``entries`` times the vector's length.

Defined cases. Null vectors and those with a null, NaN or infinite component are
dropped. The first codebooks are the vectors of the smallest keys, nulls after all
others, equal keys by their integers; of fewer than ``entries`` kept vectors, each
is an entry. Rows with equal keys are vectors like all others. Null labels share
their sum of errors. An empty table, or one whose vectors are all dropped, gives
no rows. Vectors of another length than the first one's, a length that ``parts``
does not divide, and components too large for exact distances in 64 bits (beyond
46,000 at 64 components) fail by name. Columns that are not named are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.sources.scratch import discard, scratch_path

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6

# Room for rounding in a comparison of bounds, as a share of all its terms.
SLACK = 1e-9

FAR = np.iinfo(np.int64).max  # distance of a next nearest entry that does not exist


class Bounds(NamedTuple):
    """Of each part of some vectors; distances are squared integers."""

    code: np.ndarray
    near: np.ndarray  # to the entry ``code`` as it was in round ``near_at``
    near_at: np.ndarray
    next: np.ndarray  # to the nearest other entry as they were in ``next_at``
    next_at: np.ndarray


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(axis=-1)


def _scanned(x: np.ndarray, book: np.ndarray, now: int) -> Bounds:
    """Distances of ``x`` (rows, width) to all entries of ``book``."""
    distances = np.stack([_squared(x, entry) for entry in book], axis=1)
    code = distances.argmin(axis=1)  # the first of equal ones
    rows = np.arange(len(x))
    near = distances[rows, code]
    distances[rows, code] = FAR
    stamp = np.full(len(x), now, np.uint8)
    return Bounds(code.astype(np.uint8), near, stamp, distances.min(axis=1), stamp.copy())


def net_displacements(books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry of ``books`` (round, entry, width) is now from where it
    was in each round, and the largest such distance of the other entries."""
    moved = np.sqrt(_squared(books[-1], books).astype(np.float64))
    n = moved.shape[1]
    others = np.zeros_like(moved)
    for k in range(n):
        if n > 1:
            others[:, k] = np.delete(moved, k, axis=1).max(axis=1)
    return moved, others


def reassigned(x: np.ndarray, books: np.ndarray, held: Bounds | None, exact: bool) -> tuple[Bounds, int]:
    """Nearest entries in the newest of ``books``, and the number of full scans.

    ``exact`` makes every distance to the own entry that of the newest round.
    """
    now = len(books) - 1
    if held is None:
        return _scanned(x, books[now], now), len(x)
    moved, others = net_displacements(books)
    code, near, near_at, nxt, next_at = (a.copy() for a in held)
    drift = others[next_at, code]
    next_root = np.sqrt(nxt.astype(np.float64))

    def stands(rows: np.ndarray) -> np.ndarray:
        upper = np.sqrt(near[rows].astype(np.float64)) + moved[near_at[rows], code[rows]] + drift[rows]
        return upper + SLACK * (upper + next_root[rows]) < next_root[rows]

    everyone = np.arange(len(x))
    sure = stands(everyone)
    renewed = everyone if exact else everyone[~sure]
    near[renewed] = _squared(x[renewed], books[now][code[renewed]])
    near_at[renewed] = now
    open_ = everyone[~sure]
    open_ = open_[~stands(open_)]
    fresh = _scanned(x[open_], books[now], now)
    for kept, new in zip((code, near, near_at, nxt, next_at), fresh, strict=True):
        kept[open_] = new
    return Bounds(code, near, near_at, nxt, next_at), len(open_)


STATE = (
    "_ints array<int>, _code binary, _near array<bigint>, _near_at binary,"
    " _next array<bigint>, _next_at binary"
)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _byte_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    flat = pa.array(np.ascontiguousarray(values).ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values)], pa.binary())


def assigned(state: DataFrame, books: list[np.ndarray], exact: bool = False) -> DataFrame:
    """``state`` with every part at its nearest entry of the newest book.

    ``books`` has one array (part, entry, width) for each round so far.
    """
    history = np.stack(books)
    _, parts, _, width = history.shape
    first = "_code" not in state.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch.column("_ints")
            x = _matrix(ints, parts * width).reshape(len(ints), parts, width)
            held = None
            if not first:
                held = Bounds(
                    _byte_matrix(batch.column("_code"), parts),
                    _matrix(batch.column("_near"), parts),
                    _byte_matrix(batch.column("_near_at"), parts),
                    _matrix(batch.column("_next"), parts),
                    _byte_matrix(batch.column("_next_at"), parts),
                )
            found = []
            for p in range(parts):
                own = None if held is None else Bounds(*[a[:, p] for a in held])
                found.append(reassigned(x[:, p], history[:, p], own, exact)[0])
            code, near, near_at, nxt, next_at = (np.stack(a, axis=1) for a in zip(*found))
            columns = [
                batch.column("_key"),
                batch.column("_label"),
                ints,
                _bytes(code),
                _lists(near, pa.int64()),
                _bytes(near_at),
                _lists(nxt, pa.int64()),
                _bytes(next_at),
            ]
            names = ["_key", "_label", "_ints", "_code", "_near", "_near_at", "_next", "_next_at"]
            yield pa.RecordBatch.from_arrays(columns, names)

    head = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("_key", "_label"))
    return state.mapInArrow(step, f"{head}, {STATE}")


def _next_book(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Floored means of the parts of each entry; entries without parts stay."""
    parts, entries, width = book.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            ints = batch.column("_ints")
            x = _matrix(ints, parts * width).reshape(len(ints), parts, width)
            codes = _byte_matrix(batch.column("_code"), parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        place = np.arange(parts * entries)
        columns = [
            pa.array(place, pa.int32()),
            pa.array(counts.reshape(-1)),
            _lists(sums.reshape(parts * entries, width), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["place", "n", "sums"])

    partial = state.select("_ints", "_code").mapInArrow(add, "place int, n bigint, sums array<bigint>")
    total = partial.groupBy("place").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)],
    )
    book = book.copy()
    for row in total.filter("n > 0").collect():  # one row for each entry
        sums = np.array([row[f"s{i}"] for i in range(width)], np.int64)
        book[row["place"] // entries, row["place"] % entries] = sums // row["n"]
    return book


class Codes(NamedTuple):
    rows: DataFrame  # _key, _label, _code (one byte for each part), _error
    books: np.ndarray  # (part, entry, place in the part)


def _integers(vector: Column, length: int) -> Column:
    """Checked integers of a vector whose components are all finite."""
    limit = isqrt((1 << 61) // max(length, 1))
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    too_large = F.exists(vector, lambda x: F.abs(x.cast("double")) * SCALE >= limit)
    size = F.concat(F.lit(f"a vector of {length} components expected, got "), F.size(vector))
    wrong = F.raise_error(size).cast("array<int>")
    large = F.raise_error(F.lit(f"a component is beyond {limit // SCALE}")).cast("array<int>")
    return (
        F.when(F.size(vector) != length, wrong).when(too_large, large).otherwise(floors.cast("array<int>"))
    )


def vector_codes(
    df: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    n_rounds: int = ROUNDS,
) -> Codes | None:
    """Codes of all usable vectors and the last codebooks; None if there are none."""
    spark = df.sparkSession
    usable = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    kept = df.filter(F.col(vector).isNotNull() & usable).select(
        F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector")
    )
    one = kept.select(F.size("_vector").alias("n")).first()
    if one is None:
        return None
    if one["n"] % parts:
        raise ValueError(f"{one['n']} components cannot be cut into {parts} parts")
    state = kept.select("_key", "_label", _integers(F.col("_vector"), one["n"]).alias("_ints"))
    least = state.orderBy(F.col("_key").asc_nulls_last(), "_ints").limit(entries).collect()
    first = np.array([row["_ints"] for row in least], np.int64)
    books = [first.reshape(len(first), parts, one["n"] // parts).swapaxes(0, 1)]
    path = None
    for turn in range(n_rounds + 1):
        last = turn == n_rounds
        before, path = path, scratch_path(spark, "state")
        moved = assigned(state, books, exact=last)
        moved.write.parquet(path)
        state = spark.read.schema(moved.schema).parquet(path)
        if before is not None:
            discard(spark, before)
        if not last:
            books.append(_next_book(state, books[-1]))
    error = F.aggregate("_near", F.lit(0).cast("long"), lambda a, x: a + x)
    return Codes(state.select("_key", "_label", "_code", error.alias("_error")), books[-1])


def coded_vectors(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", **sizes: int
) -> DataFrame:
    """``key``, ``code`` in hex, ``error``, ``label_error`` and ``codebooks_sha256``."""
    found = vector_codes(df, vector, key, label, **sizes)
    if found is None:
        none = df.limit(0).select(F.col(key), F.lit("").alias("code"))
        zero = F.lit(0).cast("long")
        return none.withColumns({"error": zero, "label_error": zero, "codebooks_sha256": F.lit("")})
    listed = ",".join(map(str, found.books.reshape(-1).tolist()))
    sha = hashlib.sha256(listed.encode()).hexdigest()
    sums = found.rows.groupBy(F.col("_label").alias("_of")).agg(F.sum("_error").alias("label_error"))
    return found.rows.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_key").alias(key),
        F.lower(F.hex("_code")).alias("code"),
        F.col("_error").alias("error"),
        "label_error",
        F.lit(sha).alias("codebooks_sha256"),
    )


def _round_sql(t: int) -> str:
    return f"""
near{t} AS MATERIALIZED (
  SELECT rid, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT rid, p, e, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT AS d
    FROM parts JOIN book{t} USING (p))
  GROUP BY rid, p),
mean{t} AS (
  SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (
    SELECT p, best.e AS e, unnest(x) AS v, unnest(range(len(x))) AS i
    FROM parts JOIN near{t} USING (rid, p))
  GROUP BY p, e, i),
book{t + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM book{t} b LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM mean{t} GROUP BY p, e) m
    ON b.p = m.p AND b.e = m.e),"""


# The same by comparing every part with every entry in every round.
ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(x::DOUBLE * {SCALE})::BIGINT FOR x IN embedding] AS v,
         row_number() OVER (ORDER BY vec_id, embedding) AS rid
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
  FROM (SELECT rid, v, unnest(range({PARTS})) AS p FROM kept)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= {ENTRIES}),
{"".join(_round_sql(t) for t in range(ROUNDS))}
last AS (
  SELECT rid, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT rid, p, e, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT AS d
    FROM parts JOIN book{ROUNDS} USING (p))
  GROUP BY rid, p),
codes AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM last GROUP BY rid),
book AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha FROM book) AS codebooks_sha256
FROM kept JOIN codes USING (rid)
"""
