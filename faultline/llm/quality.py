"""Quality rules: fixed limits, then robust multivariate outliers.

Every text gets word, symbol, line and repetition counts. Five of their
transforms make a vector. For each language and source the minimum-covariance-
determinant (MCD) centre and scatter of the vectors are estimated, and a text
whose Mahalanobis distance is too large is rejected.

The estimate is the deterministic MCD, as aggregations over a narrow table:

* The vectors are whole numbers on a grid of 1/1024, so that all sums are exact
  and no result depends on the order of partial sums.
* Medians and median deviations give three starts: the scaled identity, the
  scatter of the vectors' hyperbolic tangents, and that of their directions.
* A concentration step needs the rows with the smallest distances. Moments are
  summed per distance bin in one aggregation, combined before the shuffle, and
  the bins are added up until they hold the wanted share. A hot source is never
  sorted or gathered.
* The start of the smallest determinant goes on to more steps.

The scatter is shrunk towards the scaled identity, as counts that are nearly
always zero would make it singular. Distances are put in proportion to the
chi-square median, for finite samples.

Defined cases. A null text is an empty one: it fails the fixed limits and has no
vector. Null language or source is a group of its own. A group under ``min_rows``
is judged by the fit of its whole language, and where that is too small as well by
the fit of the whole table, of whatever size, so every text with a word is judged.
Equal rows get equal verdicts. Other columns pass through untouched.

Fits, scales and group keys have one row for each group. They are broadcast up to
``SENT`` rows (a few hundred bytes each); beyond that rows meet them by group and
by partition of origin, so that a hot group is dealt over many tasks either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tokens import (
    byte_texts,
    carried,
    hashes_of,
    per_text,
    text_slices,
    windows,
    words_of,
)
from faultline.sources.scratch import stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
COUNTS_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
FEATURES = ("word_length", "line_length", "symbols", "dup_lines", "repeats")

# --- fixed values: limits of the base rules
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

GRID = 1024
# Least scale of each feature: below it a spread means nothing. At 0.4 a text of
# nearly all duplicate lines is an outlier by that alone; repeats alone are left to
# the base rule, whose limit is reached first.
FLOORS = (0.4, 0.4, 0.3, 0.4, 0.4)
SHARE = 0.75  # of a group's rows that the scatter is estimated on
SHRINK = 0.1
BINS_PER_OCTAVE = 8
SENT = 20_000  # rows of a broadcast table, about 10 MB
SALTS = 64


def _repeated_words(texts: list[bytes]) -> np.ndarray:
    words = words_of(texts)
    if not len(words.codes):
        return np.zeros(len(texts), np.int64)
    found, places = windows(hashes_of(words.distinct)[words.codes], words, REPEAT_WINDOW)
    text_of = np.repeat(np.arange(len(texts)), words.counts)
    frame = pd.DataFrame({"text": text_of[places], "window": found})
    twice = places[frame.duplicated(keep=False).to_numpy()]
    # in one text, equal hashes must also be equal words
    if len(twice):
        exact = np.column_stack(
            [text_of[twice], *(words.codes[twice + j] for j in range(REPEAT_WINDOW))]
        )
        twice = twice[pd.DataFrame(exact).duplicated(keep=False).to_numpy()]
    edges = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + REPEAT_WINDOW, -1)
    return per_text((np.cumsum(edges)[:-1] > 0).astype(np.int64), words)


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text, by the names in ``COUNTS``."""
    words = words_of(texts)
    chars = np.fromiter((len(x.decode()) for x in words.distinct), np.int64, len(words.distinct))
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2)
    return {
        "n_words": words.counts,
        "word_chars": per_text(chars[words.codes], words),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": _repeated_words(texts),
        "n_lines": lines[:, 0],
    }


def counts_column(text: Column) -> Column:
    """A struct of the counts of each text."""

    def count(column: pa.Array) -> pa.Array:
        texts = byte_texts(column)
        parts = [text_counts(texts[a:b]) for a, b in text_slices(texts)]
        joined = [
            pa.array(np.concatenate([p[c] for p in parts] or [np.empty(0, np.int64)]), pa.int64())
            for c in COUNTS
        ]
        return pa.StructArray.from_arrays(joined, list(COUNTS))

    # else a filter on the counts would run the function a second time
    return F.arrow_udf(count, COUNTS_TYPE).asNondeterministic()(text)


def failed_base(counts: Column) -> Column:
    words, repeats = counts["n_words"], counts["n_repeat_words"]
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def _features(counts: Column) -> list[Column]:
    """The transformed statistics on the grid; null for a text without words."""
    words = F.nullif(counts["n_words"], F.lit(0)).cast("double")
    lines = F.nullif(counts["n_lines"], F.lit(0)).cast("double")
    values = [
        counts["word_chars"] / words,
        F.ln(words / lines),
        F.sqrt(counts["n_symbols"] / words),
        F.sqrt(counts["n_dup_lines"] / lines),
        F.sqrt(counts["n_repeat_words"] / words),
    ]
    return [F.round(v * GRID).cast("bigint") for v in values]


def _group_key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def _level_keys(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """Group keys from the finest to the coarsest level."""
    keys = [_group_key(df[c]) for c in by]
    return [
        F.concat_ws("\x1f", F.lit(str(n)), *keys[:n]) for n in range(len(keys), -1, -1)
    ]


def _strata(keys: DataFrame, n_levels: int, min_rows: int) -> DataFrame:
    """For each finest group, the finest level whose pool is large enough.

    ``keys`` has one row for each finest group, with its keys ``_k0``.. and
    ``_rows``. A pool is all rows under its key; the last level takes any number.
    """
    found = keys.withColumn("_stratum", F.lit(None).cast("string"))
    for i in range(n_levels):
        pools = keys.groupBy(f"_k{i}").agg(F.sum("_rows").alias("_pool"))
        enough = F.lit(True) if i == n_levels - 1 else F.col("_pool") >= min_rows
        found = (
            found.join(pools, f"_k{i}")
            .withColumn("_stratum", F.coalesce("_stratum", F.when(enough, F.col(f"_k{i}"))))
            .drop("_pool")
        )
    return found.select(F.col("_k0").alias("_group"), "_stratum")


def _beside(rows: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a stored table of few rows for each group."""
    if table.count() <= SENT:
        return rows.join(F.broadcast(table), on, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = rows.withColumn("_salt", F.spark_partition_id() % SALTS)
    return rows.join(table.withColumn("_salt", salts), [on, "_salt"], how).drop("_salt")


def _z(i: int) -> Column:
    return (F.col(f"_x{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}")


def _distance() -> Column:
    """Squared distance by the factor of the precision matrix in ``_l_i_j``."""
    p = len(FEATURES)
    terms = []
    for j in range(p):
        parts = [F.col(f"_l_{i}_{j}") * (F.col(f"_x{i}") - F.col(f"_c{i}")) for i in range(j, p)]
        whole = reduce(Column.__add__, parts)
        terms.append(whole * whole)
    return reduce(Column.__add__, terms)


def _fit_names() -> list[str]:
    p = len(FEATURES)
    return [f"_c{i}" for i in range(p)] + [f"_l_{i}_{j}" for i in range(p) for j in range(i + 1)]


def _fit_row(centre: np.ndarray, scatter: np.ndarray, scale: np.ndarray) -> dict:
    """Centre and Cholesky factor of the precision, in grid units."""
    p = len(centre)
    unit = scatter / np.outer(scale, scale)
    shrunk = (1 - SHRINK) * unit + SHRINK * np.eye(p)
    factor = np.linalg.cholesky(np.linalg.inv(shrunk)) / scale[:, None]
    row = {f"_c{i}": float(centre[i]) for i in range(p)}
    row |= {f"_l_{i}_{j}": float(factor[i, j]) for i in range(p) for j in range(i + 1)}
    return row | {"_logdet": float(np.linalg.slogdet(shrunk)[1])}


def _bin() -> Column:
    return F.ceil(F.log2(F.col("_d2") + 2.0**-20) * BINS_PER_OCTAVE).cast("int")


def _moments(prefix: str) -> list[Column]:
    p = len(FEATURES)
    first = [F.sum(f"{prefix}{i}").alias(f"_a{i}") for i in range(p)]
    second = [
        F.sum(F.col(f"{prefix}{i}") * F.col(f"{prefix}{j}")).alias(f"_b_{i}_{j}")
        for i in range(p)
        for j in range(i + 1)
    ]
    return [F.count("*").alias("_n"), *first, *second]


def _scatter(sums: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    p, n = len(FEATURES), float(sums["_n"])
    mean = np.array([float(sums[f"_a{i}"]) for i in range(p)]) / n
    second = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            second[i, j] = second[j, i] = float(sums[f"_b_{i}_{j}"]) / n
    return mean, second - np.outer(mean, mean)


def _starts(scales: DataFrame, rows: DataFrame) -> DataFrame:
    """Three fits per stratum to start from."""
    p = len(FEATURES)
    joined = _beside(rows, scales, "_stratum")
    norm = F.sqrt(reduce(Column.__add__, [_z(i) * _z(i) for i in range(p)]) + 1e-9)
    bent = joined.select(
        "_stratum",
        *[F.round(F.tanh(_z(i)) * GRID).cast("bigint").alias(f"_t{i}") for i in range(p)],
        *[F.round(_z(i) / norm * GRID).cast("bigint").alias(f"_u{i}") for i in range(p)],
    )
    products = [
        F.sum(F.col(f"_{k}{i}") * F.col(f"_{k}{j}")).alias(f"{k}_{i}_{j}")
        for k in "tu"
        for i in range(p)
        for j in range(i + 1)
    ]
    sums = bent.groupBy("_stratum").agg(*products).join(scales, "_stratum")
    names = [*_fit_names(), "_logdet"]

    def start(frames):
        for frame in frames:
            out = []
            for _, row in frame.iterrows():
                scale = np.array([row[f"_s{i}"] for i in range(p)])
                centre = np.array([row[f"_m{i}"] for i in range(p)])
                shapes = [np.eye(p)]
                for k in "tu":
                    m = np.zeros((p, p))
                    for i in range(p):
                        for j in range(i + 1):
                            m[i, j] = m[j, i] = float(row[f"{k}_{i}_{j}"])
                    size = np.sqrt(np.maximum(np.diag(m), 1.0))
                    m = m / np.outer(size, size)
                    np.fill_diagonal(m, 1.0)
                    shapes.append(m)
                for number, shape in enumerate(shapes):
                    fit = _fit_row(centre, shape * np.outer(scale, scale), scale)
                    out.append({"_stratum": row["_stratum"], "_start": number, **fit})
            yield pd.DataFrame(out, columns=["_stratum", "_start", *names])

    schema = "_stratum string, _start int, " + ", ".join(f"{n} double" for n in names)
    return sums.mapInPandas(start, schema)


def _concentrated(rows: DataFrame, fits: DataFrame, scales: DataFrame, best: bool) -> DataFrame:
    """One concentration step for every fit; ``best`` keeps one fit per stratum."""
    p = len(FEATURES)
    sums = (
        _beside(rows, fits.select("_stratum", "_start", *_fit_names()), "_stratum")
        .withColumn("_d2", _distance())
        .withColumn("_bin", _bin())
        .groupBy("_stratum", "_start", "_bin")
        .agg(*_moments("_x"))
    )
    # stored, so that the sums are added up by bin before a stratum's task gets them
    binned = stored(sums, "bins").join(scales, "_stratum")
    names = [*_fit_names(), "_logdet", "_median_d2"]

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        # the bins of one stratum: bounded by the range of doubles, not by rows
        out = []
        for number, bins in frame.groupby("_start"):
            bins = bins.sort_values("_bin")
            reached = bins["_n"].cumsum()
            total = int(reached.iloc[-1])
            inner = bins[(reached - bins["_n"]).to_numpy() < math.ceil(SHARE * total)]
            half = bins[(reached >= total / 2).to_numpy()].iloc[0]
            scale = bins[[f"_s{i}" for i in range(p)]].iloc[0].to_numpy(float)
            sums = inner[[c for c in inner if c[:2] in ("_a", "_b", "_n") and c != "_bin"]].sum()
            centre, scatter = _scatter(sums)
            out.append(
                {
                    "_stratum": bins["_stratum"].iloc[0],
                    "_start": int(number),
                    **_fit_row(centre, scatter, scale),
                    "_median_d2": 2.0 ** ((int(half["_bin"]) - 0.5) / BINS_PER_OCTAVE),
                }
            )
        found = pd.DataFrame(out, columns=["_stratum", "_start", *names])
        return found.sort_values(["_logdet", "_start"]).head(1) if best else found

    schema = "_stratum string, _start int, " + ", ".join(f"{n} double" for n in names)
    return stored(binned.groupBy("_stratum").applyInPandas(step, schema), "mcd")


def chi_square(share: float, freedom: int) -> float:
    """Quantile by the Wilson-Hilferty approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(share)
    return freedom * (1 - 2 / (9 * freedom) + z * math.sqrt(2 / (9 * freedom))) ** 3


def fit_outliers(vectors: DataFrame, min_rows: int, steps: int = 3) -> DataFrame:
    """The MCD fit of each finest group: ``_group`` and the fit of its pool.

    ``vectors`` is a narrow table with ``_k0``.. and ``_x0``...
    """
    p = len(FEATURES)
    xs = [f"_x{i}" for i in range(p)]
    levels = [c for c in vectors.columns if c.startswith("_k")]
    rows = vectors.filter(F.col("_x0").isNotNull())
    sizes = stored(rows.groupBy(*levels).agg(F.count("*").alias("_rows")), "sizes")
    strata = stored(_strata(sizes, len(levels), min_rows), "strata")
    # a row counts for every level that some group is judged by
    needed = stored(strata.select("_stratum").distinct(), "needed")
    rows = rows.select(F.explode(F.array(*levels)).alias("_stratum"), *xs)
    rows = _beside(rows, needed, "_stratum")

    # exact: the grid bounds how many values there are
    medians = rows.groupBy("_stratum").agg(
        *[F.percentile(x, 0.5).alias(f"_m{i}") for i, x in enumerate(xs)]
    )
    medians = stored(medians, "medians")
    spread = [
        F.greatest(
            F.percentile(F.abs(F.col(x) - F.col(f"_m{i}")), 0.5) * 1.4826, F.lit(FLOORS[i] * GRID)
        ).alias(f"_s{i}")
        for i, x in enumerate(xs)
    ]
    scales = _beside(rows, medians, "_stratum").groupBy("_stratum").agg(*spread)
    scales = stored(scales.join(medians, "_stratum"), "scales")

    fits = stored(_starts(scales, rows), "starts")
    fits = _concentrated(rows, fits, scales, best=False)
    fits = _concentrated(rows, fits, scales, best=True)
    for _ in range(steps):
        fits = _concentrated(rows, fits, scales, best=True)
    # once more, for the median distance under the last fit
    last = _concentrated(rows, fits, scales, best=True).select("_stratum", "_median_d2")
    fits = fits.drop("_median_d2").join(last, "_stratum")
    return stored(strata.join(fits, "_stratum").drop("_start", "_logdet"), "fits")


def quality_vectors(
    df: DataFrame, text: str = "text", by: Sequence[str] = ("lang", "source")
) -> DataFrame:
    """``df`` with the struct ``_counts`` and the columns ``_k0``.. and ``_x0``..."""
    counted = df.withColumn("_counts", counts_column(F.col(text)))
    keys = {f"_k{i}": key for i, key in enumerate(_level_keys(df, by))}
    xs = {f"_x{i}": x for i, x in enumerate(_features(F.col("_counts")))}
    return counted.withColumns({**keys, **xs})


def judged(vectors: DataFrame, fits: DataFrame, quantile: float) -> DataFrame:
    """``vectors`` with ``_base_failed``, ``_distance`` and ``_kept``."""
    p = len(FEATURES)
    names = [*_fit_names(), "_median_d2"]
    scale = F.greatest(F.col("_median_d2") / chi_square(0.5, p), F.lit(1.0))
    fits = fits.withColumnRenamed("_group", "_k0").select("_k0", *names)
    joined = _beside(vectors, fits, "_k0", "left")
    base = failed_base(F.col("_counts"))
    distance = _distance() / scale
    near = F.coalesce(distance <= chi_square(quantile, p), F.lit(True))
    return joined.withColumns(
        {"_base_failed": base, "_distance": distance, "_kept": ~base & near}
    ).drop(*names)


QUANTILE = 1 - 1e-9
MIN_ROWS = 200


def quality_filter(
    df: DataFrame,
    text: str = "text",
    by: Sequence[str] = ("lang", "source"),
    quantile: float = QUANTILE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The rows of ``df`` that pass the fixed limits and are not outliers.

    ``quantile`` is the share of normally distributed vectors that would stay.
    The texts are counted twice, once to fit and once to filter, so that no wide
    row is stored or sent by its key.
    """
    groups = {f"_by{i}": c for i, c in enumerate(by)}
    vectors = quality_vectors(carried(df, _text=text, **groups), "_text", list(groups))
    narrow = [c for c in vectors.columns if c.startswith(("_k", "_x"))]
    fits = fit_outliers(stored(vectors.select(*narrow), "vectors"), min_rows)
    return judged(vectors, fits, quantile).filter("_kept").select("_row.*")


def quality_verdicts(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    by: Sequence[str] = ("lang", "source"),
    quantile: float = QUANTILE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """One narrow row per text: ``key``, counts, base verdict, distance, verdict."""
    vectors = quality_vectors(df.select(F.col(key), F.col(text), *by), text, by)
    vectors = stored(vectors.drop(text, *by), "vectors")
    judgement = judged(vectors, fit_outliers(vectors, min_rows), quantile)
    return judgement.select(
        key,
        "_counts.*",
        F.col("_base_failed").alias("base_failed"),
        F.round("_distance", 6).alias("distance"),
        F.col("_kept").alias("kept"),
    )
