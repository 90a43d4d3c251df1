"""Views over the test tables with the schemas of the weather fact, the static grid and the event history. The same text
runs in Spark SQL, with DataFrames for the names in braces, and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FULL_WEIGHT = [f"NATION_{k}" for k in range(6)]
HALF_WEIGHT = [f"NATION_{k}" for k in range(6, 10)]
START_YEAR, END_YEAR = 1996, 2000

WEATHER = """
WITH b AS (
  SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date,
         SUM(CAST(l_quantity AS BIGINT)) AS q, SUM(l_partkey) AS p,
         SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS x
  FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE))
SELECT CONCAT(CAST(10000 + k % 10 AS STRING), '_', CAST(19500 + CAST(FLOOR(k / 10) AS BIGINT) AS STRING)) AS grid_id,
  date,
  CAST((q * 7 + p) % 400 - 120 AS INT) AS ta_mean, CAST((q * 7 + p) % 400 - 70 AS INT) AS ta_max,
  CASE WHEN p % 97 = 0 THEN NULL ELSE CAST(150 + (p * 13 + q) % 850 AS INT) END AS hm_mean,
  CAST(50 + (p * 13 + q) % 850 AS INT) AS hm_min,
  CAST((q * 7 + p) % 400 - 200 AS INT) AS td_mean, CAST((q * 7 + p) % 400 - 250 AS INT) AS td_min,
  CAST((x * 5 + q) % 90 AS INT) AS wind_ws_mean, CAST((x * 11 + p) % 135 AS INT) AS wind_ws_max,
  CAST(q % 41 - 20 AS INT) AS wind_uu_mean, CAST(p % 41 - 20 AS INT) AS wind_vv_mean,
  SIN(RADIANS(CAST(p % 360 AS DOUBLE))) AS wind_wd_sin_mean,
  COS(RADIANS(CAST(p % 360 AS DOUBLE))) AS wind_wd_cos_mean,
  CASE WHEN p % 89 = 0 THEN NULL WHEN (q + p) % 5 < 3 THEN 0 ELSE CAST(p % 150 AS INT) END AS rn_day_mean,
  CASE WHEN (q + p) % 5 < 3 THEN 0 ELSE CAST(2 * (p % 150) AS INT) END AS rn_day_max
FROM b
"""

MASTER_GRID = """
WITH s AS (
  SELECT s_suppkey AS k, s_acctbal AS a, n_name
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey),
g AS (
  SELECT CONCAT(CAST(10000 + k % 10 AS STRING), '_', CAST(19500 + CAST(FLOOR(k / 10) AS BIGINT) AS STRING)) AS grid_id,
    10000 + k % 10 AS grid_x, 19500 + CAST(FLOOR(k / 10) AS BIGINT) AS grid_y,
    CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k % 14 AS INT) END AS pole_count,
    CASE WHEN k % 31 = 5 THEN NULL WHEN k % 4 = 0 THEN 0 ELSE 1 END AS is_forest,
    CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k % 5 AS INT) END AS forest_type_code,
    CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(1 + k % 9 AS INT) END AS age_class_code,
    CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(2 * (k % 21) AS INT) END AS tree_height_code,
    ABS(a) / 8.0 AS elevation,
    CASE WHEN k % 19 = 0 THEN NULL ELSE CAST((k * 7) % 84 AS DOUBLE) END AS slope,
    SIN(RADIANS(CAST((k * 37) % 360 AS DOUBLE))) AS aspect_sin,
    COS(RADIANS(CAST((k * 37) % 360 AS DOUBLE))) AS aspect_cos,
    CASE WHEN k % 17 = 0 THEN NULL WHEN k % 29 = 3 THEN -5.0e0 ELSE ABS(a) / 100.0 END AS nearest_road_dist,
    CASE WHEN k % 23 = 0 THEN NULL ELSE ABS(a) / 40.0 END AS nearest_river_dist,
    n_name AS city_name, k
  FROM s)
SELECT grid_id, grid_x, grid_y, pole_count, is_forest, forest_type_code, age_class_code, tree_height_code,
  elevation, slope, aspect_sin, aspect_cos, nearest_road_dist, nearest_river_dist, city_name FROM g
UNION ALL
SELECT grid_id, grid_x, grid_y, pole_count, is_forest, forest_type_code, age_class_code, tree_height_code,
  elevation, slope, aspect_sin, aspect_cos, nearest_road_dist, nearest_river_dist, ' NATION _0 ' FROM g WHERE k % 10 = 3
"""

FIRE_HISTORY = """
SELECT CAST(o_orderkey AS STRING) AS objt_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS occu_date,
  CAST(YEAR(o_orderdate) AS INT) AS occu_year, CAST(MONTH(o_orderdate) AS INT) AS occu_mt,
  127.5003e0 + (o_orderkey % 10) * 0.00113e0 AS longitude,
  37.5495e0 + (o_custkey % 10) * 0.0009e0 AS latitude,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE CONCAT('강원 ', CAST(o_custkey % 30 AS STRING)) END AS adres,
  CASE WHEN o_custkey % 5 = 0 THEN 42 WHEN o_custkey % 5 = 1 THEN 51 ELSE 41 END AS ctprvn_cd,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amount,
  CONCAT('cause_', CAST(o_custkey % 12 AS STRING)) AS resn
FROM {orders} WHERE o_orderpriority = '1-URGENT'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, sf_dir, WEATHER, "lineitem")
    return df.selectExpr("*", "date_format(date, 'yyyy-MM') AS month")


def master_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MASTER_GRID, "supplier", "nation")


def fire_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, FIRE_HISTORY, "orders")


def sql_text(view: str) -> str:
    """A view's text for an engine that knows the tables by name."""
    return view.format(lineitem="lineitem", supplier="supplier", nation="nation", orders="orders")
