"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides, from their content
alone, whether a chunk ends there: on average after ``DIVISOR`` lines. An
inserted line therefore moves only the boundaries beside it, and a passage that
stands in two texts is cut alike in both. A line of ``LONG_LINE`` words or more is
a passage in itself: it is always a chunk of its own, whatever stands beside it.
Every such line, and every chunk of two lines or more, that occurs more than once
in the corpus is removed everywhere but in its first place (smallest key, then
smallest place), after its bytes were compared with those of the first place.

Only digests meet to be counted, combined before the shuffle. The bytes of the
repeated chunks then meet their first copy in a join without a hint, whose hot
chunks adaptive execution splits, and each text loses its chunks in its own row.

The edges of a chunk hang on the lines beside it, so a repeated passage of short
lines keeps its head and tail, or all of it. ``passages=True`` takes those too:
from each line on, and back from each line, the least run of lines with over
``PASSAGE_WORDS`` words is a window, known by its SHA-256. Whatever stands beside
a passage, its windows are the same and cover it, so every run of whole lines of
over ``PASSAGE_WORDS`` words goes everywhere but in its first place. Windows and
chunks may overlap; of a run that repeats itself the first period stays.

Defined cases. A null text has no chunks and stays null. Lines are separated by
``\\n``; a chunk of empty lines counts like any other but needs ``MIN_WORDS``
words over all its lines to be removed, so that blank or trivial runs stay; a
single line needs ``LONG_LINE``. What
is left of a text keeps its lines in order, joined by ``\\n``; a text that loses
everything becomes empty. Rows with equal key and text are in the same place: of
such rows the chunks inside stay, and are only removed when they repeat an
earlier place. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tokens import byte_texts, carried
from faultline.sources.scratch import stored

DIVISOR = 4
MIX = (0x9E3779B1, 0x85EBCA6B)  # odd factors of the rolling hash
MIN_LINES = 2
MIN_WORDS = 10
LONG_LINE = 50
PASSAGE_WORDS = 50  # a passage has more

CHUNK_TYPE = (
    "array<struct<first_line:int,n_lines:int,digest:binary,n_words:int,begin:int,size:int>>"
)


def line_hash(line: bytes) -> int:
    """32 bits of the line's MD5."""
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def is_cut(before: int, now: int) -> bool:
    """Whether a chunk ends at a line, by the hashes of the line before and of it.

    The upper bits of the sum depend on all bits of both, also where they are equal.
    """
    return (before * MIX[0] + now * MIX[1]) % (1 << 32) * DIVISOR >> 32 == 0


def line_chunks(lines: list[bytes]) -> list[tuple[int, int, int]]:
    """(first line, number of lines, words) of each chunk of a text."""
    chunks, start, before, words = [], 0, 0, 0
    for i, line in enumerate(lines):
        now, own = line_hash(line), len(line.split())
        if own >= LONG_LINE and i > start:
            chunks.append((start, i - start, words))
            start, words = i, 0
        words += own
        if own >= LONG_LINE or is_cut(before, now) or i == len(lines) - 1:
            chunks.append((start, i + 1 - start, words))
            start, words = i + 1, 0
        before = now
    return chunks


def chunk_column(text: Column) -> Column:
    """The chunks of each text that are long enough to be removed.

    ``begin`` and ``size`` are in bytes.
    """

    def cut(column: pa.Array) -> pa.Array:
        offsets, rows = [0], []
        for raw in byte_texts(column):
            lines = raw.split(b"\n")
            ends = np.cumsum([len(x) + 1 for x in lines])
            for first, n, n_words in line_chunks(lines):
                if n_words >= (MIN_WORDS if n >= MIN_LINES else LONG_LINE):
                    begin, end = int(ends[first - 1]) if first else 0, int(ends[first + n - 1]) - 1
                    digest = hashlib.md5(raw[begin:end]).digest()
                    rows.append((first, n, digest, n_words, begin, end - begin))
            offsets.append(len(rows))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        names = ["first_line", "n_lines", "digest", "n_words", "begin", "size"]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        values = pa.StructArray.from_arrays(columns, names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return F.arrow_udf(cut, CHUNK_TYPE).asNondeterministic()(text)


def passage_windows(words: list[int]) -> list[tuple[int, int]]:
    """(first line, number of lines) of the windows of a text, by its lines' words.

    Windows of one line are left out: they are chunks.
    """
    found, start, total = set(), 0, 0
    for i, n in enumerate(words):
        total += n
        # each start whose least run ends here
        while total > PASSAGE_WORDS:
            found.add((start, i + 1 - start))
            total -= words[start]
            start += 1
        # the least run back from here starts one line earlier
        if start and total + words[start - 1] > PASSAGE_WORDS:
            found.add((start - 1, i + 2 - start))
    return sorted(x for x in found if x[1] > 1)


WINDOW_TYPE = "array<struct<first_line:int,n_lines:int,digest:binary>>"


def window_column(text: Column) -> Column:
    """The windows of each text."""

    def cut(column: pa.Array) -> pa.Array:
        offsets, first, lines, digests = [0], [], [], []
        for raw in byte_texts(column):
            parts = raw.split(b"\n")
            ends = np.cumsum([len(x) + 1 for x in parts]).tolist()
            for start, n in passage_windows([len(x.split()) for x in parts]):
                begin, end = ends[start - 1] if start else 0, ends[start + n - 1] - 1
                first.append(start)
                lines.append(n)
                digests.append(hashlib.sha256(raw[begin:end]).digest())
            offsets.append(len(first))
        columns = [pa.array(first, pa.int32()), pa.array(lines, pa.int32()), pa.array(digests, pa.binary())]
        values = pa.StructArray.from_arrays(columns, ["first_line", "n_lines", "digest"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return F.arrow_udf(cut, WINDOW_TYPE).asNondeterministic()(text)


RUN_TYPE = "array<struct<_first:int,_lines:int>>"


def _merged(runs: Column) -> Column:
    """Sorted runs of lines, those that overlap made one."""

    def merge(column: pa.Array) -> pa.Array:
        merged = []
        for row in column.to_pylist():
            out: list[dict] = []
            for run in row or []:
                if out and run["_first"] < out[-1]["_first"] + out[-1]["_lines"]:
                    end = max(out[-1]["_first"] + out[-1]["_lines"], run["_first"] + run["_lines"])
                    out[-1]["_lines"] = end - out[-1]["_first"]
                else:
                    out.append(run)
            merged.append(out)
        kind = pa.list_(pa.struct([("_first", pa.int32()), ("_lines", pa.int32())]))
        return pa.array(merged, kind)

    return F.arrow_udf(merge, RUN_TYPE)(runs)


def _place(key: str, text: str) -> list[Column]:
    """Identity of a row: its key and its text."""
    return [F.col(key).alias("_key"), F.xxhash64(text).alias("_hash")]


def _chunks(df: DataFrame, text: str, key: str, body: bool) -> DataFrame:
    """One row per chunk; ``body`` adds its bytes."""
    columns = [*_place(key, text), chunk_column(F.col(text)).alias("_chunks")]
    if body:
        columns.append(F.col(text).cast("binary").alias("_raw"))
    rows = df.filter(F.col(text).isNotNull()).select(*columns)
    chunk = F.col("_chunk")
    more = [F.substring("_raw", chunk["begin"] + 1, chunk["size"]).alias("_body")] if body else []
    return rows.select("*", F.explode("_chunks").alias("_chunk")).select(
        "_key",
        "_hash",
        chunk["first_line"].alias("_first"),
        chunk["n_lines"].alias("_lines"),
        chunk["digest"].alias("_digest"),
        chunk["size"].alias("_size"),
        *more,
    )


def repeated_chunks(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chunks to remove: ``_key``, ``_hash``, ``_first`` and ``_lines``.

    A chunk qualifies when its bytes equal those of the first place of its
    digest and it stands elsewhere.
    """
    same = ["_digest", "_size"]
    place = F.struct(F.col("_key").isNotNull().alias("k0"), "_key", "_hash", "_first")
    counted = _chunks(df, text, key, body=False).groupBy(*same).agg(
        F.count("*").alias("_n"), F.min(place).alias("_origin")
    )
    repeated = counted.filter("_n > 1").select(*same, "_origin")
    chunks = _chunks(df, text, key, body=True).withColumn("_place", place)
    # only repeated chunks are left: their bytes are sent once and kept
    copies = stored(chunks.join(repeated, same), "copies")
    origins = copies.filter("_place = _origin").groupBy(*same).agg(F.min("_body").alias("_ours"))
    return (
        copies.filter("_place != _origin")
        .join(origins, same)
        .filter(F.col("_body") == F.col("_ours"))
        .select("_key", "_hash", "_first", "_lines")
    )


def repeated_windows(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Windows to remove, like ``repeated_chunks``."""
    rows = df.filter(F.col(text).isNotNull()).select(
        *_place(key, text), window_column(F.col(text)).alias("_windows")
    )
    window = F.col("_window")
    windows = rows.select("*", F.explode("_windows").alias("_window")).select(
        "_key",
        "_hash",
        window["first_line"].alias("_first"),
        window["n_lines"].alias("_lines"),
        window["digest"].alias("_digest"),
    )
    place = F.struct(F.col("_key").isNotNull().alias("k0"), "_key", "_hash", "_first")
    counted = windows.groupBy("_digest").agg(F.count("*").alias("_n"), F.min(place).alias("_origin"))
    repeated = counted.filter("_n > 1").select("_digest", "_origin")
    return (
        windows.withColumn("_place", place)
        .join(repeated, "_digest")
        .filter("_place != _origin")
        .select("_key", "_hash", "_first", "_lines")
    )


def line_dedup(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    counts: bool = False,
    passages: bool = False,
) -> DataFrame:
    """``df`` with the repeated chunks cut out of ``text``.

    ``passages`` cuts out all other repeated runs of over ``PASSAGE_WORDS`` words,
    too. ``counts`` adds ``n_removed_chunks`` (with ``passages`` runs) and
    ``n_removed_lines``.
    """
    repeated = repeated_chunks(df, text, key)
    if passages:
        repeated = repeated.unionAll(repeated_windows(df, text, key))
    removed = (
        repeated.distinct()
        .groupBy("_key", "_hash")
        .agg(F.sort_array(F.collect_list(F.struct("_first", "_lines"))).alias("_removed"))
    )
    if passages:
        removed = removed.withColumn("_removed", _merged(F.col("_removed")))
    joined = carried(df, _own=key, _text=text).join(
        removed,
        F.col("_own").eqNullSafe(F.col("_key")) & (F.xxhash64("_text") == F.col("_hash")),
        "left",
    )
    # the lines between one removed chunk and the next
    ends = F.concat(
        F.array(F.lit(0)), F.transform("_removed", lambda c: c["_first"] + c["_lines"])
    )
    starts = F.concat(F.transform("_removed", lambda c: c["_first"]), F.array(F.size("_split")))
    between = F.zip_with(ends, starts, lambda e, s: F.slice("_split", e + 1, s - e))
    kept = F.array_join(F.flatten(between), "\n")
    cleaned = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(kept)
    joined = joined.withColumn("_split", F.split("_text", "\n", -1))
    columns = [cleaned.alias(c) if c == text else F.col(f"_row.`{c}`") for c in df.columns]
    if counts:
        n_lines = F.aggregate("_removed", F.lit(0), lambda n, c: n + c["_lines"])
        columns += [
            F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint").alias("n_removed_chunks"),
            F.coalesce(n_lines, F.lit(0)).cast("bigint").alias("n_removed_lines"),
        ]
    return joined.select(*columns)


# The same rules in plain SQL, with the lines themselves in place of digests.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
hashed AS MATERIALIZED (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT::HUGEINT AS h,
         len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0b\\f\\r]+'),
             lambda x: x <> '')) AS words
  FROM lines),
ends AS (
  SELECT *, ((coalesce(lag(h) OVER w, 0) * {MIX[0]} + h * {MIX[1]}) % {1 << 32}) * {DIVISOR}
              < {1 << 32}
         OR words >= {LONG_LINE}
         OR coalesce(lead(words) OVER w, 0) >= {LONG_LINE} AS cut
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM ends),
chunks AS (
  SELECT doc_id, min(i) AS first, count(*) AS n, sum(words) AS words,
         string_agg(line, chr(10) ORDER BY i) AS body
  FROM numbered GROUP BY doc_id, chunk),
removed_chunks AS (
  SELECT doc_id, first, n FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS place
    FROM chunks
    WHERE words >= CASE WHEN n >= {MIN_LINES} THEN {MIN_WORDS} ELSE {LONG_LINE} END)
  WHERE place > 1),
upto AS MATERIALIZED (
  SELECT doc_id, i, words, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM hashed),
starts AS (
  SELECT doc_id, upto - words AS before, max(i) AS i FROM upto GROUP BY doc_id, upto - words),
stops AS (SELECT doc_id, upto, min(i) AS i FROM upto GROUP BY doc_id, upto),
runs AS (
  SELECT a.doc_id, a.i AS first, b.i AS last
  FROM (SELECT *, upto - words + {PASSAGE_WORDS} AS least FROM upto) a
  ASOF JOIN stops b ON a.doc_id = b.doc_id AND a.least < b.upto
  UNION
  SELECT a.doc_id, b.i, a.i
  FROM (SELECT *, upto - {PASSAGE_WORDS} AS most FROM upto) a
  ASOF JOIN starts b ON a.doc_id = b.doc_id AND a.most > b.before),
bodies AS (
  SELECT r.doc_id, first, last, string_agg(line, chr(10) ORDER BY i) AS body
  FROM runs r JOIN lines l ON r.doc_id = l.doc_id AND l.i BETWEEN first AND last
  WHERE first < last GROUP BY r.doc_id, first, last),
removed_runs AS (
  SELECT doc_id, first, last - first + 1 AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS place FROM bodies)
  WHERE place > 1),
removed AS MATERIALIZED (
  SELECT doc_id, first, n FROM removed_chunks UNION SELECT doc_id, first, n FROM removed_runs),
merged AS (
  SELECT doc_id, count(*) FILTER (first >= reached) AS n_removed_chunks FROM (
    SELECT *, coalesce(max(first + n) OVER (PARTITION BY doc_id ORDER BY first, n
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
    FROM removed)
  GROUP BY doc_id),
gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(first, first + n)) AS i FROM removed),
left_over AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM lines l ANTI JOIN gone g USING (doc_id, i) GROUP BY l.doc_id),
totals AS (SELECT doc_id, count(*) AS n_removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       coalesce(m.n_removed_chunks, 0) AS n_removed_chunks,
       coalesce(t.n_removed_lines, 0) AS n_removed_lines
FROM documents d LEFT JOIN left_over o USING (doc_id) LEFT JOIN merged m USING (doc_id)
LEFT JOIN totals t USING (doc_id)
"""
