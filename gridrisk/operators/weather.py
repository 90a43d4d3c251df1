"""Daily weather features with lags that respect the calendar, and the official variant without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.functions import exprs as E
from gridrisk.sources import readers

REALS = (*E.SCALED_BY_TEN[:10], "wind_wd_sin_mean", "wind_wd_cos_mean", *E.SCALED_BY_TEN[10:])
FEATURES = (
    "grid_id", "date", "month", "month_num", "day_num", *REALS[:12], "wind_theta_deg", "rn_day_mean", "rn_day_max", "effective_humidity",
    "rn_class", "rn_class1", "rn_class2", "rne_temp", "rne", "predwi", "predwi_class", "dwi", "dwi_n", "day_weight",
)


#: Days that lags reach back.
LOOKBACK = 4


def base(weather: DataFrame, scaled: bool = True) -> DataFrame:
    date = F.col("date").cast("date")
    return weather.select(
        "grid_id", date.alias("date"), F.date_format(date, "yyyy-MM").alias("month"), F.month(date).alias("month_num"), F.dayofmonth(date).alias("day_num"),
        *[E.real(c, scaled).alias(c) for c in REALS],
    )


def _lag(column: str, days: int, *chunk: str) -> Column:
    return F.lag(column, days).over(Window.partitionBy("grid_id", *chunk).orderBy("date"))


def with_lags(df: DataFrame, *chunk: str) -> DataFrame:
    """Lags 1 to 4 of date and humidity and 1 to 2 of rain: one exchange, one sort. hm_used k is the humidity of k days
    ago, or today's where that day is missing; grade k likewise, or 0. chunk: columns whose change ends the history."""
    df = df.select(
        "*", *[_lag("date", k, *chunk).alias(f"lag_date{k}") for k in range(1, 5)],
        *[_lag("hm_mean", k, *chunk).alias(f"hm_lag{k}") for k in range(1, 5)], *[_lag("rn_day_mean", k, *chunk).alias(f"rn_lag{k}") for k in (1, 2)],
    )
    follows = lambda k: F.datediff("date", f"lag_date{k}") == k
    return df.select(
        "*",
        *[F.when(follows(k), F.col(f"hm_lag{k}")).otherwise(F.col("hm_mean")).alias(f"hm_lag{k}_used") for k in range(1, 5)],
        E.rain_grade(F.col("rn_day_mean")).alias("rn_class"),
        *[F.when(follows(k), E.rain_grade(F.col(f"rn_lag{k}"))).otherwise(0).alias(f"rn_class{k}") for k in (1, 2)],
    )


#: What to do with a second row of a cell and date, which shifts the lags of later days.
REPEATS = ("keep", "mark", "fail")


def features(
    weather: DataFrame, scaled: bool = True, months: list[str] | None = None, start: str | None = None, end: str | None = None,
    *, chunk: str | None = None, repeats: str = "keep",
) -> DataFrame:
    """The daily features. months, start and end: which days to keep. The lags see LOOKBACK days before these, which is
    all that they use, so no other day is read. chunk: 'month' or 'year', for days that see no history before their own,
    as in runs chunk by chunk; nothing before the window is read then. repeats: rows that repeat a cell and date are kept,
    marked in a column ``repeated``, or end the job; the lags' own exchange finds them."""
    if repeats not in REPEATS or chunk not in (None, "month", "year"):
        raise ValueError(f"repeats is one of {REPEATS}, chunk month, year or None")
    if months or start or end:
        weather = readers.in_dates(weather, months, start, end) if chunk else readers.with_lookback(weather, LOOKBACK, months, start, end)
    df = base(weather, scaled)
    if chunk:
        # The cell's own exchange serves the lags within its chunks, and joins by cell later on.
        df = df.repartition("grid_id").withColumn("chunk", F.col("month") if chunk == "month" else F.substring("month", 1, 4))
    df = with_lags(df, *(["chunk"] if chunk else []))
    again = F.coalesce(F.col("lag_date1") == F.col("date"), F.lit(False))
    if repeats == "fail":
        what = F.concat(F.lit("two rows of a cell and date: "), F.col("grid_id"), F.lit(" "), F.col("date").cast("string"))
        df = df.withColumn("date", F.when(again, F.raise_error(what).cast("date")).otherwise(F.col("date")))
    df = df.withColumns({
        "effective_humidity": E.effective_humidity(F.col("hm_mean"), [F.col(f"hm_lag{k}_used") for k in range(1, 5)]),
        "rne_temp": F.col("rn_class") + F.col("rn_class1") + F.col("rn_class2"),
        "wind_theta_deg": E.bearing(F.col("wind_wd_sin_mean"), F.col("wind_wd_cos_mean")),
        "day_weight": E.day_weight(F.col("date")),
    })
    df = df.withColumns({"rne": E.rain_effect(F.col("rne_temp")), "predwi": E.weather_score(F.col("ta_mean"), F.col("hm_mean"), F.col("effective_humidity"), F.col("wind_ws_mean"))})
    df = df.withColumn("predwi_class", E.weather_class(F.col("predwi")))
    df = df.withColumn("dwi", F.col("predwi_class").cast("double") * F.col("rne")).withColumn("dwi_n", F.col("dwi") / 10.0)
    marks = [again.alias("repeated")] if repeats == "mark" else []
    return readers.in_dates(df.select(*FEATURES, *marks), months, start, end)


def features_by_chunk(weather: DataFrame, scaled: bool = True, months: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """As ``features``, but the first days of a month see no history before it."""
    return features(weather, scaled, months, start, end, chunk="month")


def official(weather: DataFrame, static: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The official formula: lags without a gap guard, class sums for terrain, duplicated cells fan out. It is made month
    by month, from the days of the month and LOOKBACK days before it, so a lag reaches no further back than that."""
    if start or end:
        weather = readers.with_lookback(weather, LOOKBACK, None, f"{start[:7]}-01" if start else None, end)
    df = base(weather)
    df = df.withColumn("rn_grade", E.rain_grade(F.col("rn_day_mean")))
    seen = lambda k: _lag("date", k) >= F.date_sub(F.trunc("date", "month"), LOOKBACK)
    df = df.select("*", *[F.when(seen(k), _lag("hm_mean", k)).alias(f"hm_lag{k}") for k in range(1, 5)], *[F.when(seen(k), _lag("rn_grade", k)).alias(f"grade{k}") for k in (1, 2)])
    humidity = sum((w * F.coalesce(F.col(f"hm_lag{k}"), F.col("hm_mean")) for k, w in enumerate(E.OFFICIAL_HUMIDITY_WEIGHTS) if k), E.OFFICIAL_HUMIDITY_WEIGHTS[0] * F.col("hm_mean"))
    df = df.withColumn("effective_humidity", humidity).withColumn("rne_temp", F.col("rn_grade") + F.coalesce("grade1", F.lit(0)) + F.coalesce("grade2", F.lit(0)))
    df = df.withColumn("predwi", E.weather_score(F.col("ta_mean"), F.col("hm_mean"), F.col("effective_humidity"), F.col("wind_ws_mean")))
    df = df.withColumn("dwi", E.weather_class(F.col("predwi")) * E.rain_effect(F.col("rne_temp")))
    degrees = E.bearing(F.col("aspect_sin"), F.col("aspect_cos"))
    terrain = static.select("grid_id", E.forest_score_official(F.col("forest_type_code")).alias("fmi"), (E.elevation_class(F.col("elevation")) + E.aspect_score(degrees)).alias("tmi"))
    out = df.select("grid_id", "date", "month", "effective_humidity", "rne_temp", "predwi", "dwi").join(terrain, "grid_id", "left")
    out = out.withColumn("day_weight", E.day_weight(F.col("date")))
    out = out.withColumn("ffdri", E.composite(F.col("dwi"), F.col("fmi"), F.col("tmi"), F.col("day_weight")))
    return readers.in_dates(out, None, start, end)
