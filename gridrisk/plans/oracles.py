"""The same queries in SQL for DuckDB, over the fixture views and, where it helps, over SQL that names the steps."""

from __future__ import annotations

from gridrisk.functions import projection as P
from gridrisk.plans import fixtures as fx


def r(names: str) -> str:
    """Rounded doubles, without negative zeros."""
    return ", ".join(f"ROUND(CAST({n} AS DOUBLE), 6) + 0 AS {n}" for n in names.split())


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


SCALED = "ta_mean ta_max hm_mean hm_min td_mean td_min wind_ws_mean wind_ws_max wind_uu_mean wind_vv_mean rn_day_mean rn_day_max".split()
GRADE = "CASE WHEN {0} < 1 THEN 0 WHEN {0} < 5 THEN 1 WHEN {0} < 10 THEN 2 ELSE 3 END"
CLASS = "CASE " + " ".join(f"WHEN predwi <= {b} THEN {i}" for i, b in enumerate((0.1183, 0.1878, 0.2571, 0.3320, 0.4089, 0.4932, 0.5861, 0.6862, 0.7820), 1)) + " ELSE 10 END"
EFFECT = "CASE WHEN rne_temp < 2 THEN 1e0 WHEN rne_temp < 3 THEN 5e-1 WHEN rne_temp < 4 THEN 4e-1 WHEN rne_temp < 5 THEN 3e-1 WHEN rne_temp < 6 THEN 2e-1 ELSE 1e-1 END"
WEIGHT = """CASE month(date) WHEN 1 THEN .85e0 WHEN 2 THEN .85e0 WHEN 5 THEN .85e0 WHEN 6 THEN .8e0 WHEN 7 THEN .33e0 WHEN 8 THEN .33e0 WHEN 9 THEN .5e0 WHEN 10 THEN .61e0
  WHEN 11 THEN .78e0 WHEN 12 THEN .83e0 WHEN 3 THEN CASE WHEN day(date) <= 10 THEN .9e0 WHEN day(date) <= 20 THEN .95e0 ELSE 1e0 END
  WHEN 4 THEN CASE WHEN day(date) <= 10 THEN 1e0 WHEN day(date) <= 20 THEN .95e0 ELSE .9e0 END END"""
UNIT = "LEAST(GREATEST({0}, 0e0), 1e0)"
CITY = "replace(trim(city_name), ' ', '')"
WEATHER_WINDOW = "(PARTITION BY grid_id ORDER BY date)"
REALS = "ta_mean ta_max hm_mean hm_min td_mean td_min wind_ws_mean wind_ws_max wind_uu_mean wind_vv_mean wind_wd_sin_mean wind_wd_cos_mean rn_day_mean rn_day_max"


def _metres() -> tuple[str, str]:
    series = [(j, repr(a)) for j, a in enumerate(P.SERIES, 1)]
    x = f"{P.EAST!r} + {P.SCALE * P.RADIUS!r} * (eta + " + " + ".join(f"{a} * cos(2 * {j} * xi) * sinh(2 * {j} * eta)" for j, a in series) + ")"
    y = f"{P.NORTH!r} + {P.SCALE * P.RADIUS!r} * (xi - ({P.START!r}) + " + " + ".join(f"{a} * sin(2 * {j} * xi) * cosh(2 * {j} * eta)" for j, a in series) + ")"
    return x, y


def _projected(source: str) -> str:
    x, y = _metres()
    k = repr(P.SQUEEZE)
    return f"""
  SELECT *, {x} AS x5179, {y} AS y5179 FROM (
    SELECT *, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM (
      SELECT *, sinh(atanh(sin(radians(latitude))) - {k} * atanh({k} * sin(radians(latitude)))) AS t, radians(longitude - {P.ORIGIN_LON!r}) AS turn FROM {source}))"""


def _cells(size: int, label: str) -> str:
    return f"""
  SELECT date, target_grid_x, target_grid_y, {size} AS target_grid_size_m, 1 AS fire_label,
    'epsg5179_{label}_' || target_grid_x || '_' || target_grid_y AS target_grid_id, COUNT(*) AS fire_count,
    string_agg(DISTINCT objt_id, '|' ORDER BY objt_id) AS fire_objt_ids,
    COALESCE(string_agg(DISTINCT NULLIF(adres, ''), '|' ORDER BY NULLIF(adres, '')), '') AS fire_addresses,
    COALESCE(SUM(amount), 0e0) AS fire_amount_sum, AVG(longitude) AS event_lon_mean, AVG(latitude) AS event_lat_mean,
    AVG(x5179) AS event_x5179_mean, AVG(y5179) AS event_y5179_mean
  FROM (SELECT *, CAST(floor(x5179 / {size}) AS BIGINT) AS target_grid_x, CAST(floor(y5179 / {size}) AS BIGINT) AS target_grid_y FROM fire)
  GROUP BY date, target_grid_x, target_grid_y"""


def _target(size: int, label: str) -> str:
    return f"""
  SELECT c.*, m.grid_id FROM ({_cells(size, label)}) c
  JOIN (SELECT grid_id, CAST(floor(MIN(grid_x) * 100 / {size}) AS BIGINT) AS gx, CAST(floor(MIN(grid_y) * 100 / {size}) AS BIGINT) AS gy FROM fx_master_grid GROUP BY grid_id) m
    ON c.target_grid_x = m.gx AND c.target_grid_y = m.gy"""


def _bucket(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % 1000000)"


STEPS = {
    "fx_weather": fx.sql_text(fx.WEATHER),
    "fx_master_grid": fx.sql_text(fx.MASTER_GRID),
    "fx_fire_history": fx.sql_text(fx.FIRE_HISTORY),
    "wb": "SELECT grid_id, date, strftime(date, '%Y-%m') AS month, month(date) AS month_num, day(date) AS day_num, " + ", ".join(f"CAST({c} AS DOUBLE) / 10e0 AS {c}" for c in SCALED) + ", wind_wd_sin_mean, wind_wd_cos_mean FROM fx_weather",
    "wl": "SELECT *, " + ", ".join([f"LAG(date, {k}) OVER {WEATHER_WINDOW} AS lag_date{k}, LAG(hm_mean, {k}) OVER {WEATHER_WINDOW} AS h{k}" for k in range(1, 5)] + [f"LAG(rn_day_mean, {k}) OVER {WEATHER_WINDOW} AS r{k}" for k in (1, 2)]) + " FROM wb",
    "wd": "SELECT *, " + ", ".join(f"CASE WHEN date_diff('day', lag_date{k}, date) = {k} THEN h{k} ELSE hm_mean END AS hm_lag{k}_used" for k in range(1, 5)) + f", {GRADE.format('rn_day_mean')} AS rn_class, " + ", ".join(f"CASE WHEN date_diff('day', lag_date{k}, date) = {k} THEN {GRADE.format(f'r{k}')} ELSE 0 END AS rn_class{k}" for k in (1, 2)) + " FROM wl",
    "we": f"SELECT *, 0.3e0 * (hm_mean + 0.7e0 * hm_lag1_used + 0.49e0 * hm_lag2_used + 0.343e0 * hm_lag3_used + 0.2401e0 * hm_lag4_used) AS effective_humidity, rn_class + rn_class1 + rn_class2 AS rne_temp, fmod(degrees(atan2(wind_wd_sin_mean, wind_wd_cos_mean)) + 360e0, 360e0) AS wind_theta_deg, {WEIGHT} AS day_weight FROM wd",
    "wp": f"SELECT *, {EFFECT} AS rne, 1e0 / (1e0 + exp(-(2.706e0 + 0.088e0 * ta_mean - 0.055e0 * hm_mean - 0.023e0 * effective_humidity - 0.104e0 * wind_ws_mean))) AS predwi FROM we",
    "wf": f"SELECT *, {CLASS} AS predwi_class, CAST({CLASS} AS DOUBLE) * rne AS dwi, CAST({CLASS} AS DOUBLE) * rne / 10e0 AS dwi_n FROM wp",
    "forest": "SELECT DISTINCT *, CASE WHEN is_forest <> 1 THEN 0e0 WHEN forest_type_code = 1 THEN 10e0 WHEN forest_type_code = 2 THEN 2e0 WHEN forest_type_code = 3 THEN 3e0 ELSE 0e0 END AS fmi, CASE WHEN is_forest <> 1 THEN 0e0 WHEN forest_type_code = 1 THEN 1e0 WHEN forest_type_code = 2 THEN 2e-1 WHEN forest_type_code = 3 THEN 3e-1 ELSE 0e0 END AS fmi_n FROM (SELECT grid_id, is_forest, forest_type_code, age_class_code, tree_height_code FROM fx_master_grid)",
    "ex": f"SELECT m.*, {UNIT.format('pole_count / qp')} AS pole_n, 1e0 - {UNIT.format('nearest_road_dist / qr')} AS road_prox, {UNIT.format('nearest_river_dist / qv')} AS river_far, CASE WHEN is_forest = 1 THEN 1e0 ELSE 0e0 END AS forest_contact FROM (SELECT grid_id, CAST(COALESCE(pole_count, 0) AS DOUBLE) AS pole_count, nearest_road_dist, nearest_river_dist, is_forest FROM fx_master_grid) m, (SELECT COALESCE(NULLIF(quantile_cont(CAST(COALESCE(pole_count, 0) AS DOUBLE), 0.95), 0), 1) AS qp, COALESCE(NULLIF(quantile_cont(nearest_road_dist, 0.95), 0), 1) AS qr, COALESCE(NULLIF(quantile_cont(nearest_river_dist, 0.95), 0), 1) AS qv FROM fx_master_grid)",
    "expo": "SELECT DISTINCT grid_id, pole_count, pole_n, nearest_road_dist, nearest_river_dist, road_prox, river_far, forest_contact, 0.45e0 * pole_n + 0.2e0 * road_prox + 0.2e0 * river_far + 0.15e0 * forest_contact AS pei FROM ex",
    "cells": f"SELECT grid_id, MAX(elevation) AS elevation, MAX(slope) AS slope, MAX(aspect_sin) AS aspect_sin, MAX(aspect_cos) AS aspect_cos, MAX(CASE WHEN {CITY} IN ({_in(fx.FULL_WEIGHT)}) THEN 1e0 WHEN {CITY} IN ({_in(fx.HALF_WEIGHT)}) THEN 5e-1 ELSE 0e0 END) AS Rm FROM fx_master_grid GROUP BY grid_id",
    "te": "SELECT w.grid_id, w.date, w.month, elevation, slope, Rm, wind_ws_max, wind_theta_deg, effective_humidity, fmod(degrees(atan2(aspect_sin, aspect_cos)) + 360e0, 360e0) AS aspect_deg FROM wf w JOIN cells c ON w.grid_id = c.grid_id",
    "tb": f"SELECT grid_id, date, month, elevation, slope, sin(radians(aspect_deg)) AS aspect_sin, cos(radians(aspect_deg)) AS aspect_cos, aspect_deg, Rm, {UNIT.format('(wind_ws_max - 7e0) / 4e0')} AS Ws, GREATEST(0e0, cos(radians(wind_theta_deg - 270e0))) AS Dr, {UNIT.format('(40e0 - effective_humidity) / 15e0')} AS Da, {UNIT.format('0.5e0 * ' + UNIT.format('elevation / 1000e0') + ' + 0.5e0 * ((1e0 - cos(radians(aspect_deg))) / 2e0)')} AS tmi_base_n FROM te",
    "terrain": f"SELECT *, Rm * Ws * Dr * Da AS ywi, 0.55e0 * tmi_base_n + 0.25e0 * {UNIT.format('slope / 35e0')} + 0.2e0 * (Rm * Ws * Dr * Da) AS tmi_p FROM tb",
    "idx": "SELECT w.grid_id, w.date, w.month, w.day_weight, w.dwi, w.dwi_n, f.fmi, f.fmi_n, t.tmi_base_n, t.tmi_p, p.pei, (7e0 * w.dwi + 1.5e0 * f.fmi + 1.5e0 * (t.tmi_base_n * 10e0)) * w.day_weight AS ffdri, 100e0 * (0.55e0 * w.dwi_n + 0.1e0 * f.fmi_n + 0.15e0 * t.tmi_p + 0.2e0 * p.pei) * w.day_weight AS pffdri FROM wf w LEFT JOIN forest f ON w.grid_id = f.grid_id LEFT JOIN terrain t ON w.grid_id = t.grid_id AND w.date = t.date LEFT JOIN expo p ON w.grid_id = p.grid_id",
    "fin": "SELECT w.grid_id, w.date, w.month, w.day_weight, ta_mean, ta_max, hm_mean, hm_min, wind_ws_mean, wind_ws_max, wind_wd_sin_mean, wind_wd_cos_mean, rn_day_mean, rn_day_max, effective_humidity, rne, w.dwi, w.dwi_n, is_forest, forest_type_code, f.fmi, f.fmi_n, age_class_code, tree_height_code, elevation, slope, aspect_sin, aspect_cos, aspect_deg, t.tmi_base_n, t.tmi_p, ywi, Rm, Ws, Dr, Da, pole_count, pole_n, nearest_road_dist, nearest_river_dist, road_prox, river_far, p.pei, i.ffdri, i.pffdri FROM wf w LEFT JOIN forest f ON w.grid_id = f.grid_id LEFT JOIN terrain t ON w.grid_id = t.grid_id AND w.date = t.date LEFT JOIN expo p ON w.grid_id = p.grid_id LEFT JOIN idx i ON w.grid_id = i.grid_id AND w.date = i.date",
    "fire0": f"SELECT objt_id, TRY_CAST(occu_date AS DATE) AS date, longitude, latitude, COALESCE(adres, '') AS adres, amount FROM fx_fire_history WHERE (COALESCE(adres, '') LIKE '%강원%' OR ctprvn_cd IN (42, 51)) AND occu_year BETWEEN {fx.START_YEAR} AND {fx.END_YEAR} AND TRY_CAST(occu_date AS DATE) IS NOT NULL",
    "fire": _projected("fire0"),
    "season0": f"SELECT * FROM fx_fire_history WHERE ctprvn_cd IN (42, 51) AND occu_year BETWEEN {fx.START_YEAR} AND {fx.END_YEAR} AND occu_mt BETWEEN 2 AND 5",
    "season": _projected("season0"),
    "target_a": _target(500, "500m"),
    "cut": "SELECT CASE WHEN pos = 0 THEN 0 ELSE GREATEST(1, CAST(floor(LEAST(200000, pos * 2) / n * 1000000) AS BIGINT)) END AS cut FROM (SELECT COUNT(*) AS pos FROM fin f JOIN target_a t ON f.date = t.date AND f.grid_id = t.grid_id), (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM fin)",
    "smp": f"""SELECT f.*, t.fire_label, t.fire_count, t.target_grid_id, t.fire_amount_sum FROM fin f JOIN target_a t ON f.date = t.date AND f.grid_id = t.grid_id
      UNION ALL SELECT f.*, 0, 0, NULL, NULL FROM fin f, cut WHERE {_bucket("f.grid_id || '|' || CAST(f.date AS VARCHAR) || '|42'")} < cut AND NOT EXISTS (SELECT 1 FROM target_a t WHERE t.date = f.date AND t.grid_id = f.grid_id)""",
    "day0": "SELECT split_part(grid_id, '_', 1) AS grid_id, date, AVG(rn_day_mean) AS rn_day_mean, AVG(hm_mean) AS hm_mean FROM wb GROUP BY 1, 2",
    "day1": "SELECT *, SUM(CASE WHEN rn_day_mean < 1 THEN 0 ELSE 1 END) OVER (PARTITION BY grid_id ORDER BY date) AS island FROM day0",
    "day": "SELECT *, SUM(CASE WHEN rn_day_mean < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY grid_id, island ORDER BY date) AS streak FROM day1",
    "fired": "SELECT DISTINCT TRY_CAST(occu_date AS DATE) AS date FROM season0",
    "flagged": "SELECT d.*, CASE WHEN f.date IS NULL THEN 0 ELSE 1 END AS fire FROM day d LEFT JOIN fired f ON d.date = f.date",
    "near": "SELECT s.objt_id, s.occu_year, (CAST(floor(x5179 / 100) AS BIGINT) + dx) || '_' || (CAST(floor(y5179 / 100) AS BIGINT) + dy) AS grid_id FROM season s, range(-{r}, {r1}) a(dx), range(-{r}, {r1}) b(dy) WHERE dx * dx + dy * dy <= {r} * {r}".replace("{r1}", "3").replace("{r}", "2"),
    "near5": "SELECT (CAST(floor(x5179 / 100) AS BIGINT) + dx) || '_' || (CAST(floor(y5179 / 100) AS BIGINT) + dy) AS grid_id FROM season s, range(-5, 6) a(dx), range(-5, 6) b(dy) WHERE dx * dx + dy * dy <= 25",
}
USES = {k: {n for n in STEPS if n != k and f" {n} " in f" {v.replace(',', ' ').replace(')', ' ').replace(chr(10), ' ')} "} for k, v in STEPS.items()}


def q(select: str) -> str:
    """The statement with the steps that it needs before it."""
    needed: list[str] = []

    def add(text_uses: set[str]) -> None:
        for n in STEPS:
            if n in text_uses and n not in needed:
                add(USES[n])
                needed.append(n)

    flat = f" {select.replace(',', ' ').replace(')', ' ').replace(chr(10), ' ')} "
    add({n for n in STEPS if f" {n} " in flat})
    steps = ", ".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in needed)
    rest = f", {select[5:]}" if select.startswith("WITH ") else f" {select}"
    return f"WITH {steps}{rest}" if needed else select


SCORES = "dwi fmi tmi_p pei ffdri pffdri".split()
ATTRIBUTES = "elevation slope aspect_sin aspect_cos nearest_road_dist nearest_river_dist".split()
WEATHER_COLUMNS = "ta_mean ta_max td_mean hm_mean wind_uu_mean".split()
LINES = "l_quantity l_extendedprice l_discount l_tax".split()


def _long(source: str, columns: list[str], keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {source} " for c in columns)


DESCRIBED = "COUNT(value) AS n, ROUND(AVG(value), 6) + 0 AS mean, ROUND(stddev_samp(value), 6) + 0 AS std, ROUND(MIN(value), 6) + 0 AS min, ROUND(quantile_cont(value, 0.25), 6) + 0 AS q25, ROUND(quantile_cont(value, 0.5), 6) + 0 AS q50, ROUND(quantile_cont(value, 0.75), 6) + 0 AS q75, ROUND(MAX(value), 6) + 0 AS max"
LIFT = f"""SELECT variable, CAST(SUM(pos) AS BIGINT) AS positives, ROUND(SUM(CASE WHEN cd <= 0.1 THEN pos ELSE 0 END) / SUM(pos), 6) AS top10_capture,
  ROUND(SUM(CASE WHEN cd <= 0.2 THEN pos ELSE 0 END) / SUM(pos), 6) AS top20_capture, ROUND(SUM(value * pos) / SUM(pos), 6) + 0 AS positive_mean, ROUND(SUM(value * (1 - pos)) / SUM(1 - pos), 6) + 0 AS negative_mean
  FROM (SELECT *, fire_label AS pos, CUME_DIST() OVER (PARTITION BY variable ORDER BY value DESC) AS cd FROM ({_long("smp", SCORES, "fire_label, ")}) WHERE value IS NOT NULL) GROUP BY variable"""


def _corr(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return f"ROUND(covar_pop(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) / NULLIF(stddev_pop(CAST({x} AS DOUBLE)) FILTER ({both}) * stddev_pop(CAST({y} AS DOUBLE)) FILTER ({both}), 0), 6) + 0"


def _pairs(source: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {_corr(a, b)} AS r FROM {source} " for a, b in pairs)


CITIES = f"SELECT grid_id, MIN({CITY}) AS city, MAX(CAST(COALESCE(pole_count, 0) AS DOUBLE)) AS pole_count FROM fx_master_grid GROUP BY grid_id"
OFFICIAL = f"""SELECT o.grid_id, date, month, {r("effective_humidity")}, rne_temp, {r("predwi")}, {r("dwi fmi tmi day_weight")}, ROUND((7e0 * dwi + 1.5e0 * fmi + 1.5e0 * tmi) * day_weight, 6) + 0 AS ffdri FROM (
  SELECT p.grid_id, date, month, effective_humidity, rne_temp, predwi, {CLASS} * {EFFECT} AS dwi, fmi, tmi, {WEIGHT} AS day_weight FROM (
    SELECT *, 1e0 / (1e0 + exp(-(2.706e0 + 0.088e0 * ta_mean - 0.055e0 * hm_mean - 0.023e0 * effective_humidity - 0.104e0 * wind_ws_mean))) AS predwi FROM (
      SELECT *, 0.3e0 * hm_mean + 0.21e0 * COALESCE(LAG(hm_mean, 1) OVER m, hm_mean) + 0.147e0 * COALESCE(LAG(hm_mean, 2) OVER m, hm_mean) + 0.103e0 * COALESCE(LAG(hm_mean, 3) OVER m, hm_mean) + 0.072e0 * COALESCE(LAG(hm_mean, 4) OVER m, hm_mean) AS effective_humidity,
        g + COALESCE(LAG(g, 1) OVER m, 0) + COALESCE(LAG(g, 2) OVER m, 0) AS rne_temp
      FROM (SELECT *, {GRADE.format("rn_day_mean")} AS g FROM wb JOIN (VALUES (DATE '1996-03-01', DATE '1996-03-31'), (DATE '1996-04-01', DATE '1996-04-30'), (DATE '1996-05-01', DATE '1996-05-31')) run(first, last) ON date BETWEEN first - 4 AND last)
      WINDOW m AS (PARTITION BY grid_id, first ORDER BY date)) WHERE date >= first) p
  LEFT JOIN (SELECT grid_id, CASE forest_type_code WHEN 1 THEN 10e0 WHEN 2 THEN 2e0 WHEN 3 THEN 3e0 WHEN 4 THEN 1e0 ELSE 0e0 END AS fmi,
      CASE WHEN elevation >= 876 THEN 1e0 WHEN elevation >= 628 THEN 2e0 WHEN elevation >= 380 THEN 3e0 WHEN elevation >= 132 THEN 4e0 ELSE 5e0 END
      + CASE WHEN a >= 337.5 OR a < 22.5 THEN 2.5e0 WHEN a < 67.5 THEN 4.5e0 WHEN a < 112.5 THEN 1.5e0 WHEN a < 202.5 THEN 4e0 WHEN a < 247.5 THEN 5e0 WHEN a < 292.5 THEN 2.5e0 WHEN a < 337.5 THEN 4.5e0 ELSE 0e0 END AS tmi
    FROM (SELECT *, fmod(degrees(atan2(aspect_sin, aspect_cos)) + 360e0, 360e0) AS a FROM fx_master_grid )) s ON p.grid_id = s.grid_id) o
  WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'"""
CELL = "date, target_grid_x, target_grid_y, target_grid_size_m, fire_label, target_grid_id, fire_count, fire_objt_ids, fire_addresses, " + r("fire_amount_sum event_lon_mean event_lat_mean event_x5179_mean event_y5179_mean")
FEATURE = f"grid_id, date, month, month_num, day_num, {r(REALS + ' wind_theta_deg effective_humidity')}, rn_class, rn_class1, rn_class2, rne_temp, {r('rne predwi')}, predwi_class, {r('dwi dwi_n day_weight')}"

ORACLES = {
    "scan_month_prune": q("SELECT grid_id, date, ta_mean FROM fx_weather WHERE strftime(date, '%Y-%m') IN ('1996-03', '1996-04')"),
    "weather_loader": q(f"SELECT grid_id, date, month, {r('ta_mean rn_day_mean wind_wd_sin_mean')} FROM wb WHERE grid_id IN ('10001_19500', '10002_19500', '10003_19500') AND date BETWEEN DATE '1995-02-01' AND DATE '1996-05-31'"),
    "months_available": q("SELECT DISTINCT month FROM wb"),
    "table_summary": q("SELECT COUNT(*) AS row_count, COUNT(DISTINCT grid_id) AS grid_count, MIN(date) AS min_date, MAX(date) AS max_date, COUNT(DISTINCT month) AS month_count FROM wb"),
    "month_summary": q("SELECT month, COUNT(*) AS row_count, COUNT(DISTINCT grid_id) AS grid_count, MIN(date) AS min_date, MAX(date) AS max_date FROM wb GROUP BY month"),
    "lag_gap_guard": q(f"SELECT grid_id, date, lag_date1, lag_date4, {r('hm_lag1_used hm_lag2_used hm_lag3_used hm_lag4_used')}, rn_class, rn_class1, rn_class2 FROM wd"),
    "rain_effect": q(f"SELECT rn_class, rn_class1, rn_class2, rne_temp, {r('rne')}, COUNT(*) AS n FROM wp GROUP BY rn_class, rn_class1, rn_class2, rne_temp, rne"),
    "effective_humidity": q(f"SELECT grid_id, date, {r('effective_humidity')} FROM we"),
    "weather_class": q(f"SELECT grid_id, date, {r('predwi')}, predwi_class, {r('dwi dwi_n')} FROM wf"),
    "day_weight": q("SELECT month_num, day_num, ROUND(MAX(day_weight), 6) AS day_weight FROM we GROUP BY month_num, day_num"),
    "wind_bearing": q(f"SELECT grid_id, date, {r('wind_theta_deg')} FROM we"),
    "weather_features": q(f"SELECT {FEATURE} FROM wf"),
    "weather_features_chunked": q(f"SELECT grid_id, date, {r('effective_humidity')}, rne_temp, {r('dwi')} FROM wf").replace(WEATHER_WINDOW, "(PARTITION BY grid_id, month ORDER BY date)"),
    "safe_cast": "SELECT o_orderkey, TRY_CAST(raw AS DOUBLE) AS as_double, COALESCE(TRY_CAST(raw AS DOUBLE), 0) AS or_zero FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey % 100 AS VARCHAR) || '.5' END AS raw FROM orders)",
    "whole_cast": "SELECT o_orderkey, CAST(number AS INTEGER) AS of_number, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(number AS VARCHAR) END AS INTEGER) AS of_text FROM (SELECT o_orderkey, CAST(o_orderkey % 21 - 10 AS DOUBLE) + 0.5 AS number FROM orders)",
    "forest_score": q(f"SELECT grid_id, is_forest, forest_type_code, age_class_code, tree_height_code, {r('fmi fmi_n')} FROM forest"),
    "exposure_score": q(f"SELECT grid_id, {r('pole_count pole_n nearest_road_dist nearest_river_dist road_prox river_far forest_contact pei')} FROM expo"),
    "static_dedup": q(f"SELECT grid_id, {r('elevation slope aspect_sin aspect_cos Rm')} FROM cells"),
    "terrain_wind": q(f"SELECT grid_id, date, month, {r('elevation slope aspect_sin aspect_cos aspect_deg tmi_base_n tmi_p ywi Rm Ws Dr Da')} FROM terrain"),
    "terrain_wind_to": q(f"SELECT grid_id, date, {r('Dr')}, ROUND(Rm * Ws * Dr * Da, 6) + 0 AS ywi, ROUND(0.55e0 * tmi_base_n + 0.25e0 * {UNIT.format('slope / 35e0')} + 0.2e0 * (Rm * Ws * Dr * Da), 6) + 0 AS tmi_p FROM tb").replace("- 270e0", "- 90e0"),
    "risk_index": q(f"SELECT grid_id, date, month, {r('day_weight dwi dwi_n fmi fmi_n tmi_base_n tmi_p pei ffdri pffdri')} FROM idx"),
    "final_dataset": q(f"SELECT grid_id, date, month, is_forest, forest_type_code, age_class_code, tree_height_code, {r('day_weight ta_mean ta_max hm_mean hm_min wind_ws_mean wind_ws_max wind_wd_sin_mean wind_wd_cos_mean rn_day_mean rn_day_max effective_humidity rne dwi dwi_n fmi fmi_n elevation slope aspect_sin aspect_cos aspect_deg tmi_base_n tmi_p ywi Rm Ws Dr Da pole_count pole_n nearest_road_dist nearest_river_dist road_prox river_far pei ffdri pffdri')} FROM fin"),
    "final_with_target": q("SELECT fire_label, COUNT(*) AS n, ROUND(AVG(pffdri), 6) AS avg_pffdri FROM (SELECT f.*, l.fire_label FROM fin f LEFT JOIN (SELECT DISTINCT grid_id, CASE WHEN grid_id IN (SELECT grid_id FROM near5 ) THEN 1 ELSE 0 END AS fire_label FROM fx_master_grid ) l ON f.grid_id = l.grid_id) GROUP BY fire_label"),
    "official_index": q(OFFICIAL),
    "crs_transform": q("SELECT objt_id, ROUND(x5179, 4) AS x5179, ROUND(y5179, 4) AS y5179 FROM fire"),
    "cell_assign": q("SELECT DISTINCT grid_id, CAST(split_part(grid_id, '_', 1) AS BIGINT) * 100 + 50 AS cx, CAST(split_part(grid_id, '_', 2) AS BIGINT) * 100 + 50 AS cy, CAST(floor(grid_x * 100 / 500) AS BIGINT) AS x500, CAST(floor(grid_y * 100 / 2000) AS BIGINT) AS y2000 FROM fx_master_grid"),
    "event_filter": q(f"SELECT objt_id, date, adres, {r('amount')} FROM fire0"),
    "event_filter_seasonal": q("SELECT objt_id, occu_year, occu_mt FROM season0"),
    "event_cells": q(f"SELECT {CELL} FROM ({_cells(1000, '1km')})"),
    "target_500m": q(f"SELECT grid_id, {CELL} FROM target_a"),
    "target_1km": q(f"SELECT grid_id, {CELL} FROM ({_target(1000, '1km')})"),
    "target_2km": q(f"SELECT grid_id, {CELL} FROM ({_target(2000, '2km')})"),
    "buffer_label": q("SELECT grid_id, city_name, CASE WHEN grid_id IN (SELECT grid_id FROM near ) THEN 1 ELSE 0 END AS fire_label FROM fx_master_grid"),
    "buffer_report": q("SELECT s.occu_year, COUNT(*) AS events, COUNT(*) FILTER (n > 0) AS matched, ROUND(100e0 * COUNT(*) FILTER (n > 0) / COUNT(*), 6) AS matched_pct, CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS cells_sum, ROUND(AVG(COALESCE(n, 0)), 6) AS cells_mean FROM season s LEFT JOIN (SELECT objt_id, COUNT(*) AS n FROM near WHERE grid_id IN (SELECT grid_id FROM fx_master_grid ) GROUP BY objt_id) m ON s.objt_id = m.objt_id GROUP BY s.occu_year"),
    "positives": q(f"SELECT f.date, f.grid_id, target_grid_id, fire_count, {r('pffdri')} FROM fin f JOIN target_a t ON f.date = t.date AND f.grid_id = t.grid_id"),
    "negatives": q(f"SELECT date, grid_id, {r('pffdri')} FROM fin f WHERE {_bucket("grid_id || '|' || CAST(date AS VARCHAR) || '|42'")} < 100000 AND NOT EXISTS (SELECT 1 FROM target_a t WHERE t.date = f.date AND t.grid_id = f.grid_id)"),
    "labelled_sample": q(f"SELECT date, grid_id, fire_label, fire_count, target_grid_id, {r('fire_amount_sum ffdri pffdri')} FROM smp"),
    "label_counts": q("SELECT fire_label, COUNT(*) AS row_count, COUNT(DISTINCT grid_id) AS grid_count, COUNT(DISTINCT date) AS date_count, MIN(date) AS min_date, MAX(date) AS max_date, ROUND(AVG(pffdri), 6) AS avg_pffdri, ROUND(AVG(ffdri), 6) AS avg_ffdri FROM smp GROUP BY fire_label"),
    "month_label_counts": q("SELECT month, fire_label, COUNT(*) AS row_count, COUNT(DISTINCT grid_id) AS grid_count, ROUND(AVG(pffdri), 6) AS avg_pffdri, ROUND(AVG(ffdri), 6) AS avg_ffdri FROM smp GROUP BY month, fire_label"),
    "variable_profile": q(f"SELECT variable, fire_label, {DESCRIBED} FROM ({_long('smp', SCORES, 'fire_label, ')}) WHERE value IS NOT NULL GROUP BY variable, fire_label"),
    "lift": q(LIFT),
    "label_corr": q(f"SELECT x AS variable, r, abs(r) AS abs_r FROM ({_pairs('smp', [(c, 'fire_label') for c in SCORES])})"),
    "corr_matrix": _pairs("lineitem", [(a, b) for a in LINES for b in LINES]),
    "corr_pairs": f"SELECT * FROM ({_pairs('(SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)', [(a, b) for i, a in enumerate(LINES) for b in [*LINES, 'revenue'][i + 1 :]])}) WHERE abs(r) >= 0.3",
    "corr_pairs_weather": q(f"SELECT * FROM ({_pairs('wb', [(a, b) for i, a in enumerate(WEATHER_COLUMNS) for b in WEATHER_COLUMNS[i + 1 :]])}) WHERE abs(r) >= 0.3"),
    "category_top": q("SELECT CAST(forest_type_code AS VARCHAR) AS category, COUNT(*) AS row_count, COUNT(*) FILTER (fire_label = 1) AS positive_count, ROUND(AVG(ffdri), 6) AS avg_ffdri, ROUND(AVG(pffdri), 6) AS avg_pffdri, ROUND(COUNT(*) FILTER (fire_label = 1) / CAST(COUNT(*) AS DOUBLE), 6) AS positive_rate FROM smp GROUP BY forest_type_code ORDER BY positive_count DESC, positive_rate DESC, row_count DESC, category LIMIT 20"),
    "metric_ranking": q(f"SELECT variable, positive_mean, ROUND(100e0 * c, 6) AS capture_pct FROM (SELECT *, t AS c FROM ({LIFT.replace('ROUND(SUM(CASE WHEN cd <= 0.1 THEN pos ELSE 0 END) / SUM(pos), 6) AS top10_capture', 'SUM(CASE WHEN cd <= 0.1 THEN pos ELSE 0 END) / SUM(pos) AS t')})) ORDER BY c DESC, variable LIMIT 4"),
    "rankings": q(f"WITH l AS ({LIFT.replace('ROUND(SUM(CASE WHEN cd <= 0.1 THEN pos ELSE 0 END) / SUM(pos), 6)', 'SUM(CASE WHEN cd <= 0.1 THEN pos ELSE 0 END) / SUM(pos)').replace('ROUND(SUM(value * pos) / SUM(pos), 6) + 0', 'SUM(value * pos) / SUM(pos)')}), e AS (SELECT 'positive_mean' AS ranking, variable, positive_mean AS value, positive_mean AS rank_by FROM l UNION ALL SELECT 'top10_capture', variable, 100e0 * top10_capture, 100e0 * top10_capture FROM l UNION ALL SELECT 'label_correlation', x, r, abs(r) FROM ({_pairs('smp', [(c, 'fire_label') for c in SCORES])})) SELECT ranking, CAST(row_number() OVER (PARTITION BY ranking ORDER BY rank_by DESC, variable) AS INTEGER) AS place, variable, ROUND(value, 6) + 0 AS value FROM e"),
    "missing_profile": q("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, COUNT(*) - COUNT({c}) AS missing, ROUND(100e0 * (COUNT(*) - COUNT({c})) / COUNT(*), 6) AS missing_pct FROM fx_master_grid " for c in ["grid_id", "grid_x", "grid_y", "pole_count", "is_forest", "forest_type_code", "age_class_code", "tree_height_code", *ATTRIBUTES, "city_name"]) + ") WHERE missing > 0"),
    "iqr_outliers": q(f"WITH l AS ({_long('fx_master_grid', ATTRIBUTES)}), z AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, COUNT(*) AS n FROM l GROUP BY variable) SELECT z.variable, ROUND(q1, 6) + 0 AS q1, ROUND(q3, 6) + 0 AS q3, ROUND(q3 - q1, 6) + 0 AS iqr, ROUND(q1 - 1.5 * (q3 - q1), 6) + 0 AS lower, ROUND(q3 + 1.5 * (q3 - q1), 6) + 0 AS upper, COUNT(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers, ROUND(100e0 * COUNT(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / n, 6) AS outlier_pct FROM l JOIN z ON l.variable = z.variable GROUP BY z.variable, q1, q3, n"),
    "duplicate_profile": q("SELECT (SELECT COUNT(*) FROM fx_master_grid ) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM fx_master_grid )) AS duplicate_rows, (SELECT COUNT(*) - COUNT(DISTINCT grid_id) FROM fx_master_grid ) AS duplicate_keys"),
    "moments": q(f"SELECT variable, ROUND(m, 6) + 0 AS mean, ROUND(med, 6) + 0 AS median, ROUND(sk, 6) + 0 AS skew, ROUND(ku, 6) + 0 AS kurt, CASE WHEN sk > 0.5 THEN 'right' WHEN sk < -0.5 THEN 'left' ELSE 'symmetric' END AS shape FROM (SELECT variable, AVG(value) AS m, quantile_cont(value, 0.5) AS med, (AVG(dv * dv * dv)) / power(AVG(dv * dv), 1.5) AS sk, AVG(dv * dv * dv * dv) / power(AVG(dv * dv), 2) - 3 AS ku FROM (SELECT *, value - AVG(value) OVER (PARTITION BY variable) AS dv FROM ({_long('fx_master_grid', ATTRIBUTES)}) WHERE value IS NOT NULL) GROUP BY variable)"),
    "histogram": "SELECT LEAST(CAST(floor((x - lo) / (hi - lo) * 50) AS INT) + 1, 50) AS bin, COUNT(*) AS n FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem), (SELECT MIN(CAST(l_extendedprice AS DOUBLE)) AS lo, MAX(CAST(l_extendedprice AS DOUBLE)) AS hi FROM lineitem) GROUP BY 1",
    "category_share": "SELECT c_mktsegment AS category, COUNT(*) AS n, ROUND(100e0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS pct FROM customer GROUP BY c_mktsegment",
    "describe": f"SELECT variable, {DESCRIBED} FROM ({_long('lineitem', LINES)}) GROUP BY variable",
    "box_stats": "WITH v AS (SELECT l_returnflag AS grp, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem), z AS (SELECT grp, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM v GROUP BY grp) SELECT z.grp, ROUND(q25, 6) AS q25, ROUND(q50, 6) AS q50, ROUND(q75, 6) AS q75, ROUND(MIN(value) FILTER (value >= q25 - 1.5 * (q75 - q25)), 6) AS whisker_low, ROUND(MAX(value) FILTER (value <= q75 + 1.5 * (q75 - q25)), 6) AS whisker_high, COUNT(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS outliers FROM v JOIN z ON v.grp = z.grp GROUP BY z.grp, q25, q50, q75",
    "daily_mean": q("SELECT date, year(date) AS year, month(date) AS month_num, CASE month(date) WHEN 2 THEN '2월' WHEN 3 THEN '3월' WHEN 4 THEN '4월' WHEN 5 THEN '5월' END AS month_name, " + ", ".join(f"ROUND(AVG({c}), 6) + 0 AS {c}" for c in ("ta_mean", "hm_mean", "wind_ws_mean", "rn_day_mean")) + " FROM wb GROUP BY date"),
    "dry_streak": q("SELECT grid_id, date, CAST(streak AS BIGINT) AS streak FROM day"),
    "streak_fire_rate": q("SELECT CASE WHEN s <= 3 THEN '1-3' WHEN s <= 7 THEN '4-7' WHEN s <= 14 THEN '8-14' WHEN s <= 21 THEN '15-21' WHEN s <= 999 THEN '22+' END AS bin, COUNT(*) AS row_count, CAST(SUM(fire) AS BIGINT) AS positive_count, ROUND(100e0 * SUM(fire) / COUNT(*), 6) AS rate_pct FROM (SELECT *, GREATEST(streak, 1) AS s FROM flagged ) GROUP BY 1"),
    "flag_compare": q(" UNION ALL ".join(f"SELECT '{c}' AS variable, ROUND(quantile_cont({c}, 0.5) FILTER (fire = 1), 6) AS with_fire, ROUND(quantile_cont({c}, 0.5) FILTER (fire = 0), 6) AS without, ROUND(quantile_cont({c}, 0.5) FILTER (fire = 1) - quantile_cont({c}, 0.5) FILTER (fire = 0), 6) + 0 AS difference FROM flagged " for c in ("hm_mean", "rn_day_mean"))),
    "period_counts": q("SELECT CAST(m AS INT) AS month, n FROM range(1, 15) t(m) LEFT JOIN (SELECT occu_mt, COUNT(*) AS n FROM fx_fire_history GROUP BY occu_mt) f ON m = occu_mt"),
    "amount_stats": q("SELECT COUNT(a) AS n, ROUND(AVG(a), 6) AS mean, ROUND(quantile_cont(a, 0.5), 6) AS median, ROUND(MIN(a), 6) AS min, ROUND(MAX(a), 6) AS max, COUNT(*) FILTER (a < 1) AS below_1, COUNT(*) FILTER (a >= 100) AS from_100, COUNT(*) FILTER (a >= 1000) AS from_1000, ROUND(AVG(CASE WHEN a > 0 THEN log10(a) END), 6) AS log_mean FROM (SELECT CAST(amount AS DOUBLE) / 10000 AS a FROM fx_fire_history )"),
    "amount_bins": q("SELECT CASE WHEN a >= 0 AND a < 1 THEN '<1' WHEN a >= 1 AND a < 10 THEN '1-10' WHEN a >= 10 AND a < 100 THEN '10-100' WHEN a >= 100 AND a < 1000 THEN '100-1000' WHEN a >= 1000 AND a < 1e9 THEN '>=1000' END AS bin, COUNT(*) AS n, ROUND(SUM(a), 6) AS total FROM (SELECT CAST(amount AS DOUBLE) / 10000 AS a FROM fx_fire_history WHERE amount IS NOT NULL) GROUP BY 1"),
    "top_rest": q("SELECT CASE WHEN k <= 8 THEN resn ELSE 'rest' END AS category, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT resn, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, resn) AS k FROM fx_fire_history GROUP BY resn) GROUP BY 1"),
    "seeded_sample": q(f"SELECT objt_id, occu_date, {_bucket("objt_id || '|7'")} AS bucket FROM fx_fire_history ORDER BY bucket, objt_id LIMIT 50"),
    "risk_grade": q("SELECT CASE WHEN ffdri >= 86 THEN 'Extreme' WHEN ffdri >= 66 THEN 'High' WHEN ffdri >= 51 THEN 'Moderate' ELSE 'Low' END AS grade, ffdri >= 66 AS alarm, COUNT(*) AS n FROM idx GROUP BY 1, 2"),
    "validation_metrics": q("SELECT ROUND(tp / NULLIF(tp + fn, 0), 6) AS recall, ROUND(tp / NULLIF(tp + fp, 0), 6) AS precision, ROUND(5 * tp / NULLIF(5 * tp + 4 * fn + fp, 0), 6) AS f2, ROUND((tp + fp) / NULLIF(n, 0), 6) AS flagged_share FROM (SELECT CAST(COUNT(*) FILTER (ffdri >= 50 AND fire_label = 1) AS DOUBLE) AS tp, COUNT(*) FILTER (ffdri >= 50 AND fire_label <> 1) AS fp, COUNT(*) FILTER (NOT ffdri >= 50 AND fire_label = 1) AS fn, COUNT(*) AS n FROM smp )"),
    "top_hit_rate": q("SELECT CAST(k AS DOUBLE) AS share, ROUND(SUM(CASE WHEN cd <= k THEN fire_label ELSE 0 END) / SUM(fire_label), 6) AS hit_rate FROM (SELECT fire_label, CUME_DIST() OVER (ORDER BY ffdri DESC) AS cd FROM smp WHERE ffdri IS NOT NULL), (VALUES (0.05), (0.1), (0.3)) t(k) GROUP BY k"),
    "pole_exposure": q(f"SELECT city, COUNT(*) FILTER (days > 0) AS cells_at_risk, ROUND(COALESCE(SUM(pole_count) FILTER (days > 0), 0), 6) AS poles_at_risk, ROUND(SUM(pole_count * COALESCE(days, 0)), 6) AS pole_days FROM ({CITIES}) c LEFT JOIN (SELECT grid_id, COUNT(DISTINCT date) AS days FROM idx WHERE ffdri >= 66 GROUP BY grid_id) k ON c.grid_id = k.grid_id GROUP BY city"),
    "monthly_check": q("SELECT month, COUNT(*) AS row_count, " + ", ".join(f"ROUND({f}({c}), 6) + 0 AS {f}_{c}" for c in ("ffdri", "pffdri") for f in ("min", "avg", "max")) + " FROM idx GROUP BY month"),
    "time_split": q("SELECT CASE WHEN year(date) <= 1995 THEN 'train' WHEN year(date) <= 1996 THEN 'valid' ELSE 'predict' END AS part, COUNT(*) AS n, ROUND(AVG(pffdri), 6) AS avg_pffdri FROM idx GROUP BY 1"),
    "hourly_to_daily": "SELECT CAST(ts AS DATE) AS date, ROUND(AVG(v), 6) + 0 AS mean, ROUND(MAX(v), 6) + 0 AS max, ROUND(AVG(sin(a)), 6) + 0 AS sin_mean, ROUND(AVG(cos(a)), 6) + 0 AS cos_mean, COUNT(*) AS n FROM (SELECT ts, NULLIF(NULLIF(CAST(value AS DOUBLE), -9990), -9999) AS v, radians(fmod(CAST(value AS DOUBLE) * 36e0, 360e0)) AS a FROM events) GROUP BY 1",
    "feature_transforms": q("SELECT grid_id, city_name, ROUND(ln(1 + GREATEST(nearest_road_dist, 0)), 6) + 0 AS road_log, ROUND(LEAST(GREATEST(nearest_road_dist, 0), 50), 6) + 0 AS road_capped, ROUND((nearest_road_dist - b) / NULLIF(c - a, 0), 6) + 0 AS road_robust, " + ", ".join(f"CAST(COALESCE(forest_type_code, 0) = {k} AS INT) AS type_{k}" for k in range(5)) + " FROM fx_master_grid , (SELECT quantile_cont(nearest_road_dist, 0.25) AS a, quantile_cont(nearest_road_dist, 0.5) AS b, quantile_cont(nearest_road_dist, 0.75) AS c FROM fx_master_grid )"),
    "class_weights": q("SELECT fire_label, n, ROUND(SUM(n) OVER () / (COUNT(*) OVER () * n), 6) AS weight FROM (SELECT fire_label, COUNT(*) AS n FROM smp GROUP BY fire_label)"),
    "city_risk": q(f"SELECT city, COUNT(*) AS n, ROUND(AVG(ffdri), 6) AS avg_ffdri, ROUND(MAX(ffdri), 6) AS max_ffdri, ROUND(AVG(pffdri), 6) AS avg_pffdri FROM idx i JOIN ({CITIES}) c ON i.grid_id = c.grid_id GROUP BY city"),
}
ORACLES["final_in_one_pass"] = ORACLES["final_dataset"]
ORACLES["risk_index_joined"] = ORACLES["risk_index"]

FINAL_NUMBERS = (
    "day_weight ta_mean ta_max hm_mean hm_min wind_ws_mean wind_ws_max wind_wd_sin_mean wind_wd_cos_mean rn_day_mean rn_day_max effective_humidity rne dwi dwi_n is_forest forest_type_code "
    "age_class_code tree_height_code fmi fmi_n elevation slope aspect_sin aspect_cos aspect_deg tmi_base_n tmi_p ywi Rm Ws Dr Da pole_count pole_n nearest_road_dist nearest_river_dist road_prox "
    "river_far pei ffdri pffdri"
).split()


def _matrix(source: str, columns: list[str]) -> str:
    """Every pair of columns from one pass: a struct per pair, unnested, and the other way round."""
    pairs = ", ".join(f"{{'x': '{a}', 'y': '{b}', 'r': CORR({a}, {b})}}" for i, a in enumerate(columns) for b in columns[i:])
    half = f"SELECT unnest([{pairs}]) AS u FROM {source} "
    both = "unnest(CASE WHEN u.x = u.y THEN [[u.x, u.y]] ELSE [[u.x, u.y], [u.y, u.x]] END) AS n"
    return f"SELECT n[1] AS x, n[2] AS y, ROUND(CASE WHEN isfinite(r) THEN r END, 6) + 0 AS r FROM (SELECT u.r AS r, {both} FROM ({half}))"


ORACLES["corr_matrix_final"] = q(_matrix("fin", FINAL_NUMBERS))
ORACLES["sample_feature_summary"] = q(
    f"SELECT variable, fire_label, COUNT(*) AS row_count, {DESCRIBED.removeprefix('COUNT(value) AS n, ').replace('AS q50', 'AS median')} FROM ({_long('smp', FINAL_NUMBERS, 'fire_label, ')}) GROUP BY variable, fire_label"
)
ORACLES["sample_month_summary"] = q(
    "SELECT month, COUNT(*) AS row_count, COUNT(*) FILTER (fire_label = 1) AS positive_rows, ROUND(AVG(CAST(fire_label AS DOUBLE)), 6) AS positive_rate, ROUND(AVG(pffdri), 6) AS avg_pffdri, "
    "ROUND(AVG(ffdri), 6) AS avg_ffdri FROM smp GROUP BY month ORDER BY positive_rows DESC, AVG(CAST(fire_label AS DOUBLE)) DESC, row_count DESC, month LIMIT 30"
)
ORACLES["dry_streak_reset"] = q(
    "SELECT grid_id, date, CAST(SUM(dry) OVER (PARTITION BY grid_id, island ORDER BY date) AS BIGINT) AS streak FROM (SELECT *, SUM(stop) OVER (PARTITION BY grid_id ORDER BY date) AS island FROM ("
    "SELECT grid_id, date, CASE WHEN rn_day_mean < 1 THEN 1 ELSE 0 END AS dry, CASE WHEN rn_day_mean < 1 AND date - LAG(date) OVER (PARTITION BY grid_id ORDER BY date) <= 1 THEN 0 ELSE 1 END AS stop FROM wb ))"
)
