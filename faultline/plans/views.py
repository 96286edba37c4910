"""The supplied tables seen in the shapes the operators expect.

Each view is one SQL text that Spark and the checking engine both run, with the
table names as ``{...}`` fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.sources import read_table

# The columns that put simulation rows in a total order.
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]

# Key columns shown in results; timestamps stay out, as engines print them differently.
SHOWN_KEY = KEY[:4]

# Divisors 3, 7 and 9 keep a two-decimal value off the halves at three decimals.
SIMULATION_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       l_quantity/3 AS V1mag_13, l_extendedprice/3 AS V1ph_13,
       l_discount/3 AS V2mag_13, l_tax/3 AS V2ph_13,
       l_quantity/7 AS V0mag_13, l_extendedprice/7 AS V0ph_13,
       l_discount/7 AS I1mag_1, l_tax/7 AS I1ph_1,
       l_quantity/9 AS I2mag_1, l_extendedprice/9 AS I2ph_1,
       l_discount/9 AS I0mag_1, l_tax/9 AS I0ph_1,
       CASE (l_orderkey*7 + l_linenumber + l_partkey) % 9
         WHEN 0 THEN 'unfaulted'
         WHEN 1 THEN concat('CB', l_linenumber, '_', l_suppkey, '_a_c_g')
         WHEN 2 THEN concat('CB', l_linenumber, '_', l_suppkey, '_c_g')
         WHEN 3 THEN concat('CB', l_linenumber, '_', l_suppkey, '_a_g')
         WHEN 4 THEN concat('CB', l_linenumber, '_', l_suppkey, '_a_b_c_g')
         WHEN 5 THEN concat('CB', l_linenumber, '_', l_suppkey, '_b_g')
         WHEN 6 THEN concat('CB', l_linenumber, '_', l_suppkey, '_a_b_g')
         WHEN 7 THEN concat('CB', l_linenumber, '_', l_suppkey, '_b_c_g')
         ELSE concat('CB', l_linenumber, '_', l_suppkey, '_b_c') END AS fault_class
FROM {lineitem}
"""

# Every supplier is a bus with a place on the map.
LOCATIONS_SQL = """
SELECT CAST(s_suppkey AS STRING) AS Bus_loc, s_acctbal AS X_Coord,
       CAST(s_nationkey AS DOUBLE) * 100 AS Y_Coord
FROM {supplier}
"""

# Every part is a run of the sweep; part keys count up from 0.
RUNS_SQL = "SELECT p_partkey AS id FROM {part}"

# Every part is a saved model: its brand names the model, its key the version.
MODELS_SQL = """
SELECT p_brand AS name, p_partkey AS version,
       concat('models/', p_brand, '/', p_partkey) AS path
FROM {part}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIMULATION_SQL, "lineitem")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LOCATIONS_SQL, "supplier")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RUNS_SQL, "part")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MODELS_SQL, "part")
