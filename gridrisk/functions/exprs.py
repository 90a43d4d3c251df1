"""Column expressions: scaling, grades, scores and indices. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published break lists, weights and code tables.
SCALED_BY_TEN = ("ta_mean", "ta_max", "hm_mean", "hm_min", "td_mean", "td_min", "wind_ws_mean", "wind_ws_max", "wind_uu_mean", "wind_vv_mean", "rn_day_mean", "rn_day_max")
WEATHER_BREAKS = (0.1183, 0.1878, 0.2571, 0.3320, 0.4089, 0.4932, 0.5861, 0.6862, 0.7820)
RAIN_BREAKS = (1, 5, 10)
RAIN_EFFECTS = ((2, 1.0), (3, 0.5), (4, 0.4), (5, 0.3), (6, 0.2))
MONTH_WEIGHTS = {1: 0.85, 2: 0.85, 5: 0.85, 6: 0.80, 7: 0.33, 8: 0.33, 9: 0.50, 10: 0.61, 11: 0.78, 12: 0.83}
TEN_DAY_WEIGHTS = {3: (0.90, 0.95, 1.00), 4: (1.00, 0.95, 0.90)}
FOREST_SCORES = {1: 10.0, 2: 2.0, 3: 3.0}
FOREST_SCORES_OFFICIAL = {1: 10.0, 2: 2.0, 3: 3.0, 4: 1.0}
ELEVATION_BREAKS = ((876, 1.0), (628, 2.0), (380, 3.0), (132, 4.0))
ASPECT_SCORES = ((22.5, 2.5), (67.5, 4.5), (112.5, 1.5), (157.5, 4.0), (202.5, 4.0), (247.5, 5.0), (292.5, 2.5), (337.5, 4.5))
OFFICIAL_HUMIDITY_WEIGHTS = (0.300, 0.210, 0.147, 0.103, 0.072)
RISK_GRADES = ((86, "Extreme"), (66, "High"), (51, "Moderate"))


def cases(pairs: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    """A CASE of (condition, value); a null condition goes on to the next."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def real(name: str, scaled: bool = False) -> Column:
    """The column as double, null where it is no number; tenths if scaled."""
    value = F.col(name).try_cast("double")
    return value / 10.0 if scaled and name in SCALED_BY_TEN else value


def whole(name: str) -> Column:
    """The column as int, null where it is no number. As a database casts: halves in text and decimals go away from zero,
    halves in doubles to the even neighbour."""
    number = F.col(name).try_cast("double")
    return F.when(F.typeof(F.col(name)).rlike("^(string|decimal)"), F.round(number)).otherwise(F.rint(number)).try_cast("int")


def weather_class(score: Column) -> Column:
    """1 to 10; upper bounds belong to their class; null is the highest class."""
    return cases([(score <= b, i) for i, b in enumerate(WEATHER_BREAKS, 1)], 10)


def rain_grade(rain: Column) -> Column:
    """0 to 3; upper bounds belong to the next grade; null is the highest."""
    return cases([(rain < b, i) for i, b in enumerate(RAIN_BREAKS)], 3)


def rain_effect(grades: Column) -> Column:
    return cases([(grades < b, v) for b, v in RAIN_EFFECTS], 0.1)


def day_weight(date: Column) -> Column:
    month, day = F.month(date), F.dayofmonth(date)
    tens = [(condition, v) for m, (a, b, c) in TEN_DAY_WEIGHTS.items() for condition, v in (((month == m) & (day <= 10), a), ((month == m) & (day <= 20), b), (month == m, c))]
    return cases([(month == m, v) for m, v in MONTH_WEIGHTS.items()] + tens, 1.0)


def effective_humidity(today: Column, before: list[Column]) -> Column:
    total = today
    for k, h in enumerate(before, 1):
        total = total + 0.7**k * h
    return 0.3 * total


def weather_score(ta: Column, hm: Column, eh: Column, ws: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(2.706 + 0.088 * ta - 0.055 * hm - 0.023 * eh - 0.104 * ws)))


def bearing(sin: Column, cos: Column) -> Column:
    return (F.degrees(F.atan2(sin, cos)) + 360.0) % 360.0


def unit(x: Column) -> Column:
    """Between 0 and 1; null is 0, as greatest and least pass over nulls."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def alignment(theta: Column, towards: float) -> Column:
    return F.greatest(F.lit(0.0), F.cos(F.radians(theta - towards)))


def forest_score(is_forest: Column, code: Column, scale: float = 1.0) -> Column:
    """0 off forest; a null flag counts as forest."""
    return cases([(is_forest != 1, 0.0)] + [(code == k, v * scale) for k, v in FOREST_SCORES.items()], 0.0)


def forest_score_official(code: Column) -> Column:
    return cases([(code == k, v) for k, v in FOREST_SCORES_OFFICIAL.items()], 0.0)


def region_weight(name: Column, full: list[str], half: list[str]) -> Column:
    plain = F.replace(F.trim(name), F.lit(" "), F.lit(""))
    return cases([(plain.isin(full), 1.0), (plain.isin(half), 0.5)], 0.0)


def elevation_class(elevation: Column) -> Column:
    return cases([(elevation >= b, v) for b, v in ELEVATION_BREAKS], 5.0)


def aspect_score(degrees: Column) -> Column:
    """The eight directions; north wraps around; null is 0."""
    north = [((degrees >= 337.5) | (degrees < 22.5), 2.5)]
    return cases(north + [(degrees < b, v) for b, v in ASPECT_SCORES[1:]], 0.0)


def exposure(pole: Column, road: Column, river: Column, forest: Column) -> Column:
    return 0.45 * pole + 0.20 * road + 0.20 * river + 0.15 * forest


def composite(dwi: Column, fmi: Column, tmi: Column, weight: Column) -> Column:
    return (7.0 * dwi + 1.5 * fmi + 1.5 * tmi) * weight


def power_composite(dwi_n: Column, fmi_n: Column, tmi_p: Column, pei: Column, weight: Column) -> Column:
    return 100.0 * (0.55 * dwi_n + 0.10 * fmi_n + 0.15 * tmi_p + 0.20 * pei) * weight


def risk_grade(index: Column) -> Column:
    return cases([(index >= b, v) for b, v in RISK_GRADES], "Low")


def right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Bins (edge, next edge]; null outside."""
    return cases([((x > a) & (x <= b), n) for a, b, n in zip(edges, edges[1:], labels, strict=False)], None)


def left_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Bins [edge, next edge); null outside."""
    return cases([((x >= a) & (x < b), n) for a, b, n in zip(edges, edges[1:], labels, strict=False)], None)


def hash_bucket(parts: list[Column], seed: int) -> Column:
    """0 to 999,999 by md5 of the parts and the seed: the same in any engine."""
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000


def correlation(x: Column, y: Column) -> Column:
    """Pearson over rows where both are present; null where one does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
