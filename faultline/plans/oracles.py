"""The same queries as plain SQL over the supplied tables, to check results by."""

from __future__ import annotations

from faultline.plans.views import (
    KEY,
    LOCATIONS_SQL,
    MODELS_SQL,
    RUNS_SQL,
    SHOWN_KEY,
    SIMULATION_SQL,
)
from faultline.schema import (
    BATCH_SIZE,
    CLASS_CODES,
    CLASSES,
    MEASURES,
    UNFAULTED,
    UNFAULTED_CODE,
    UNFAULTED_LABEL,
)

_SHOWN = ", ".join(SHOWN_KEY)
_ORDER = ", ".join(f"{c} NULLS FIRST" for c in KEY)
_MEASURES = ", ".join(MEASURES)
_ROUNDED = ", ".join(f"round({m}, 3) AS {m}" for m in MEASURES)

_CODE_CASE = " ".join(f"WHEN '{letters}' THEN {k}" for letters, k in CLASS_CODES.items())

_SIM = f"sim AS ({SIMULATION_SQL.format(lineitem='lineitem')})"

_CODED = f"""{_SIM},
clean AS (
  SELECT * REPLACE (CASE WHEN fault_class = '{UNFAULTED}' THEN '{UNFAULTED_LABEL}'
                         ELSE fault_class END AS fault_class)
  FROM sim),
lettered AS (
  SELECT *, string_split(fault_class, '_')[2] AS Bus_loc,
         array_to_string(regexp_extract_all(fault_class, '_([a-zA-Z]+)', 1), '_')
           AS extracted_letters
  FROM clean),
coded AS (
  SELECT *, CAST(CASE extracted_letters {_CODE_CASE} END AS INTEGER) AS fault_type_coded
  FROM lettered)"""

_NUMBERED = f"""{_CODED},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS row_index,
         count(*) OVER () AS row_total
  FROM coded),
batched AS (
  SELECT *, CAST(row_index // {BATCH_SIZE} + 1 AS BIGINT) AS batch_id FROM numbered),
batches AS (
  SELECT * FROM batched WHERE batch_id <= row_total // {BATCH_SIZE})"""

_COUNTS = f"""{_NUMBERED},
counts AS (
  SELECT batch_id, {", ".join(
      f"count(*) FILTER (fault_type_coded = {k}) AS n{k}" for k in CLASSES)}
  FROM batches GROUP BY batch_id),
totals AS (
  SELECT *, {" + ".join(f"n{k}" for k in CLASSES)} AS total FROM counts),
shares AS (
  SELECT batch_id, {", ".join(
      f"CAST(n{k} AS DOUBLE) / nullif(total, 0) AS p{k}" for k in CLASSES)}
  FROM totals)"""

_P = ", ".join(f"p{k}" for k in CLASSES)
_LABELS = f"""{_COUNTS},
labels AS (
  SELECT batch_id, CAST(list_position(ps, list_max(ps)) - 1 AS INTEGER) AS label
  FROM (SELECT batch_id, [{_P}] AS ps FROM shares))"""

_PLACES = f"""places AS (
  SELECT Bus_loc, sqrt(pow(X_Coord, 2) + pow(Y_Coord, 2)) AS distance_sub_station
  FROM ({LOCATIONS_SQL.format(supplier='supplier')}))"""

_PARAMS = f"""params AS (
  SELECT id, pow(10.0::DOUBLE, -1.0::DOUBLE * (n - id) / n) AS Ron,
         pow(10.0::DOUBLE, -2.0::DOUBLE * (n - id) / n) AS Rg, 1.0::DOUBLE AS StopTime
  FROM (SELECT id, CAST(count(*) OVER () AS DOUBLE) AS n
        FROM ({RUNS_SQL.format(part='part')})))"""

_SWEPT = f"""WITH {_PARAMS}
SELECT id, round(Ron, 9) AS Ron, step,
       round(Ron * (step + 1) + Rg * step * step, 6) AS value
FROM params, (SELECT CAST(range AS INTEGER) AS step FROM range(11))"""

_SPLIT = f"""{_LABELS},
shuffled AS (
  SELECT batch_id, label, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5(concat('0|', batch_id)), batch_id) - 1 AS place
  FROM labels)"""

# Sums without rounding: values are whole numbers of 2**-64, at most 2**16 in size,
# and the two parts of a total are doubles that hold them exactly.
_STEPS = "CAST({m} * 18446744073709551616.0 AS HUGEINT)"
_HALF = "CAST(1099511627776 AS HUGEINT)"
_TOTAL = (
    f"CAST(sum({_STEPS}) // {_HALF} AS DOUBLE) / 16777216.0"
    f" + CAST(sum({_STEPS}) % {_HALF} AS DOUBLE) / 18446744073709551616.0"
)
_SUMMARY = ", ".join(
    f"{_TOTAL.format(m=m)} AS {m}_sum, min({m}) AS {m}_min, max({m}) AS {m}_max"
    for m in MEASURES
)

_UNNESTED = f"""{_NUMBERED},
unnested AS (
  SELECT batch_id, row_index, unnest(range({len(MEASURES)})) AS channel,
         unnest([{_MEASURES}]) AS value
  FROM batches)"""


_PART = """CASE WHEN place < floor(n * 0.7::DOUBLE) THEN 'train'
                WHEN place < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END"""

_EVALUATED = f"""scored AS (
  SELECT CASE WHEN batch_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, label,
         (label + CASE WHEN batch_id % 3 = 0 THEN 1 ELSE 0 END) % {len(CLASSES)} AS prediction,
         list_extract([{_P}], label + 1) AS own
  FROM labels JOIN shares USING (batch_id) WHERE label IS NOT NULL),
by_class AS (
  SELECT a.split, a.label, a.n AS actual, a.hits, coalesce(p.n, 0) AS predicted
  FROM (SELECT split, label, count(*) AS n, count(*) FILTER (label = prediction) AS hits
        FROM scored GROUP BY split, label) a
  LEFT JOIN (SELECT split, prediction, count(*) AS n FROM scored GROUP BY split, prediction) p
    ON a.split = p.split AND a.label = p.prediction),
f1s AS (
  SELECT split, sum(actual * 2.0::DOUBLE * hits / (actual + predicted)) / sum(actual) AS f1
  FROM by_class GROUP BY split)"""

_METRICS = """
SELECT split, 'log_loss' AS metric, round(avg(-ln(greatest(own, 1e-15))), 9) AS value
FROM scored GROUP BY split
UNION ALL
SELECT split, 'accuracy', round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 9)
FROM scored GROUP BY split
UNION ALL SELECT split, 'f1', round(f1, 9) FROM f1s"""


_DISTANCES = f"""scored AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS split,
         distance_sub_station AS y,
         distance_sub_station * (1 + (l_linenumber % 3 - 1) / 8.0::DOUBLE) AS p
  FROM coded JOIN places ON coded.Bus_loc = places.Bus_loc
   AND fault_type_coded IS DISTINCT FROM {UNFAULTED_CODE})"""

_ERRORS = """
SELECT split, 'rmse' AS metric, round(sqrt(avg((y - p) * (y - p))), 6) AS value
FROM scored GROUP BY split
UNION ALL SELECT split, 'mae', round(avg(abs(y - p)), 6) FROM scored GROUP BY split
UNION ALL
SELECT split, 'r2', round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6)
FROM scored GROUP BY split"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def oracle_sql() -> dict[str, str]:
    position = f"CAST(row_index % {BATCH_SIZE} AS INTEGER)"
    dataset = _with(
        _COUNTS,
        f"""SELECT batch_id, {position} AS position, {_MEASURES}, {_P}
        FROM batches LEFT JOIN shares USING (batch_id)""",
    )
    counts = _with(
        _COUNTS, f"SELECT batch_id, {', '.join(f'n{k}' for k in CLASSES)} FROM counts"
    )
    return {
        "q01_scan": _with(_SIM, f"SELECT {_SHOWN}, {_MEASURES}, fault_class FROM sim"),
        "q02_sweep": _with(
            _PARAMS,
            "SELECT id, round(Ron, 9) AS Ron, round(Rg, 9) AS Rg, StopTime FROM params",
        ),
        "q03_normalise": _with(_CODED, f"SELECT {_SHOWN}, fault_class FROM coded"),
        "q04_bus": _with(_CODED, f"SELECT {_SHOWN}, Bus_loc FROM coded"),
        "q05_letters": _with(_CODED, f"SELECT {_SHOWN}, extracted_letters FROM coded"),
        "q06_code": _with(_CODED, f"SELECT {_SHOWN}, fault_type_coded FROM coded"),
        "q07_code_counts": _with(
            _CODED,
            """SELECT fault_type_coded, count(fault_type_coded) AS n_coded,
                      count(*) AS n_rows
               FROM coded GROUP BY fault_type_coded""",
        ),
        "q08_batch": _with(_NUMBERED, f"SELECT {_SHOWN}, row_index, batch_id FROM batched"),
        "q08b_batch_keyed": """
            SELECT user_id, event_id, CAST((row_number() OVER (
                     PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST
                   ) - 1) // 10 + 1 AS BIGINT) AS batch_id
            FROM events""",
        "q09_full_batches": _with(_NUMBERED, f"SELECT {_SHOWN}, batch_id FROM batches"),
        "q09b_drop_ids": _with(
            _NUMBERED,
            f"SELECT {_SHOWN}, batch_id FROM batched WHERE batch_id NOT IN (41)",
        ),
        "q10_round": _with(_SIM, f"SELECT {_SHOWN}, {_ROUNDED} FROM sim"),
        "q10b_round_batches": _with(
            _NUMBERED,
            f"""SELECT batch_id, fault_type_coded, extracted_letters, Bus_loc, {_ROUNDED}
                FROM batches""",
        ),
        "q11_class_counts": counts,
        "q11b_class_pivot": counts,
        "q12_class_prob": _with(_COUNTS, f"SELECT batch_id, {_P} FROM shares"),
        "q13_sequence": _with(
            _NUMBERED,
            f"SELECT batch_id, {position} AS position, {_MEASURES} FROM batches",
        ),
        "q14_size": _with(
            _NUMBERED,
            """SELECT CAST(n AS INTEGER) AS feature_size, count(*) AS n_batches
               FROM (SELECT count(*) AS n FROM batches GROUP BY batch_id) GROUP BY n""",
        ),
        "q15_dataset": dataset,
        "q15b_dataset_fused": dataset,
        "q16_distance": _with(_PLACES, "SELECT Bus_loc, distance_sub_station FROM places"),
        "q17_transpose": _with(
            _UNNESTED,
            f"""SELECT batch_id, CAST(channel AS INTEGER) AS channel,
                       {position} AS position,
                       CAST(CAST(value AS FLOAT) AS DOUBLE) AS value
                FROM unnested""",
        ),
        "q18_argmax": _with(_LABELS, "SELECT batch_id, label FROM labels"),
        "q19_row_distance": _with(
            f"{_CODED}, {_PLACES}",
            f"""SELECT {_SHOWN}, coded.Bus_loc, distance_sub_station
                FROM coded LEFT JOIN places
                  ON coded.Bus_loc = places.Bus_loc
                 AND fault_type_coded IS DISTINCT FROM {UNFAULTED_CODE}""",
        ),
        "q20_sweep_grouped": _SWEPT,
        "q21_sweep_map": _SWEPT,
        "q21b_cached_sweep": """
            SELECT count(*) AS n_runs, count(*) AS n_simulated, count(*) * 11 AS n_rows,
                   count(*) * 55 AS sum_steps
            FROM part""",
        "q22c_bucketed_join": _with(
            _COUNTS, f"SELECT batch_id, CAST({BATCH_SIZE} AS BIGINT) AS n_steps, {_P} FROM shares"
        ),
        "q20b_sweep_groups": """
            WITH priced AS (
              SELECT p_partkey, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS cents
              FROM part),
            offs AS (
              SELECT p_partkey, p_brand, count(*) OVER w AS n_group,
                     CAST(count(*) OVER w * cents - sum(cents) OVER w AS BIGINT) AS off_mean
              FROM priced WINDOW w AS (PARTITION BY p_brand))
            SELECT *, CAST(sum(off_mean) OVER (
                     PARTITION BY p_brand ORDER BY p_partkey
                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_off
            FROM offs""",
        "q22_sink": _with(
            _CODED,
            f"""SELECT {_SHOWN}, fault_class, Bus_loc, extracted_letters, fault_type_coded,
                       TRUE AS by_user
                FROM coded""",
        ),
        "q22b_dataset_sink": _with(
            _SPLIT,
            f"""SELECT batch_id, {_PART} AS split, {position} AS position, {_MEASURES}, {_P}
               FROM batches JOIN shuffled USING (batch_id) LEFT JOIN shares USING (batch_id)""",
        ),
        "q23_split": _with(_SPLIT, f"SELECT batch_id, label, {_PART} AS split FROM shuffled"),
        "q25c_evaluate": _with(f"{_LABELS}, {_EVALUATED}", _METRICS),
        "q25e_confusion": _with(
            f"{_LABELS}, {_EVALUATED}",
            """SELECT split, label, prediction, count(*) AS n
               FROM scored GROUP BY split, label, prediction""",
        ),
        "q28b_regression_metrics": _with(f"{_CODED}, {_PLACES}, {_DISTANCES}", _ERRORS),
        "q26_batch_score": _with(
            _LABELS,
            """SELECT batch_id, label, TRUE AS as_fitted, 8 AS n_probabilities
               FROM labels WHERE label IS NOT NULL""",
        ),
        "q24_summary": _with(
            _NUMBERED, f"SELECT batch_id, {_SUMMARY} FROM batches GROUP BY batch_id"
        ),
        "q27_latest_model": f"""
            SELECT name, max(version) AS version, arg_max(path, version) AS path
            FROM ({MODELS_SQL.format(part='part')}) GROUP BY name""",
    }
