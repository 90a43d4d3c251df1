"""Queries over the fixture views, one or more per operator; doubles are rounded so that engines agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.functions import exprs as E
from gridrisk.operators import events, profile, reports, risk, sample, static, summaries, weather
from gridrisk.plans import fixtures as fx
from gridrisk.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SCORES = ["dwi", "fmi", "tmi_p", "pei", "ffdri", "pffdri"]
ATTRIBUTES = ["elevation", "slope", "aspect_sin", "aspect_cos", "nearest_road_dist", "nearest_river_dist"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


#: Doubles below this have all of their places within a long; greater ones are rounded as decimals.
PLAIN = 1e9


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded as SQL rounds them, without negative zeros: halves of the scaled value go away from zero.

    Spark's own round makes a decimal of each value's text, which takes longer than all else that most queries do to a row.
    The doubles of a row are rounded as one array: a rounding spelled out for each of 40 columns makes a method that is too
    long for Java to compile."""
    at = {f.name: k for k, f in enumerate(f for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)))}
    if not at:
        return df

    def tidy(value: Column) -> Column:
        scaled = F.floor(F.abs(value) * 10.0**places + 0.5).cast("double") / 10.0**places
        return F.when(F.abs(value) < PLAIN, F.when(value < 0, 0.0 - scaled).otherwise(scaled)).otherwise(F.round(value, places)) + 0.0

    out = df.withColumn("__rounded", F.transform(F.array(*[F.col(c).cast("double") for c in at]), tidy))
    return out.select(*[F.get("__rounded", F.lit(at[c])).alias(c) if c in at else F.col(c) for c in df.columns])


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def _features(s: SparkSession, d: str) -> DataFrame:
    return weather.features(fx.weather(s, d))


def _cells(s: SparkSession, d: str) -> DataFrame:
    return static.terrain_cells(fx.master_grid(s, d), fx.FULL_WEIGHT, fx.HALF_WEIGHT)


INDEX = ("grid_id", "date", "month", "day_weight", "dwi", "dwi_n", "fmi", "fmi_n", "tmi_base_n", "tmi_p", "pei", "ffdri", "pffdri")


def _index(s: SparkSession, d: str) -> DataFrame:
    return _final(s, d).select(*INDEX)


def _final(s: SparkSession, d: str) -> DataFrame:
    m = fx.master_grid(s, d)
    return risk.in_one_pass(_features(s, d), static.forest(m), _cells(s, d), static.exposure(m))


def _events(s: SparkSession, d: str) -> DataFrame:
    return events.project(events.normalise(fx.fire_history(s, d), fx.START_YEAR, fx.END_YEAR))


def _target(s: SparkSession, d: str, size: int) -> DataFrame:
    return events.mapped_target(_events(s, d), fx.master_grid(s, d), size)


def _sample(s: SparkSession, d: str) -> DataFrame:
    return sample.labelled(_final(s, d), _target(s, d, 500), ratio=2, keys=fx.weather(s, d))


def _stored_sample(s: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """The sample's label and columns, made once for a query that reads them more than once."""
    return sample.kept(_sample(s, d).select("fire_label", *columns))


def _seasonal(s: SparkSession, d: str) -> DataFrame:
    return events.project(events.seasonal(fx.fire_history(s, d), fx.START_YEAR, fx.END_YEAR))


# Sources and filters


@query
def scan_month_prune(s, d):
    return readers.in_dates(fx.weather(s, d), months=["1996-03", "1996-04"]).select("grid_id", "date", "ta_mean")


@query
def weather_loader(s, d):
    cells = ["10001_19500", "10002_19500", "10003_19500"]
    return readers.weather(fx.weather(s, d), start="1995-02-01", end="1996-05-31", cells=cells, columns=["grid_id", "date", "month", "ta_mean", "rn_day_mean", "wind_wd_sin_mean"])


@query
def months_available(s, d):
    return readers.available_months(fx.weather(s, d))


@query
def table_summary(s, d):
    return summaries.table_ranges(fx.weather(s, d))


@query
def month_summary(s, d):
    return summaries.table_ranges(fx.weather(s, d), ["month"])


# Weather


@query
def lag_gap_guard(s, d):
    names = ["grid_id", "date", "lag_date1", "lag_date4", *[f"hm_lag{k}_used" for k in range(1, 5)], "rn_class", "rn_class1", "rn_class2"]
    return weather.with_lags(weather.base(fx.weather(s, d))).select(*names)


@query
def rain_effect(s, d):
    return _features(s, d).groupBy("rn_class", "rn_class1", "rn_class2", "rne_temp", "rne").agg(F.count("*").alias("n"))


@query
def effective_humidity(s, d):
    return _features(s, d).select("grid_id", "date", "effective_humidity")


@query
def weather_class(s, d):
    return _features(s, d).select("grid_id", "date", "predwi", "predwi_class", "dwi", "dwi_n")


@query
def day_weight(s, d):
    return _features(s, d).groupBy("month_num", "day_num").agg(F.max("day_weight").alias("day_weight"))


@query
def wind_bearing(s, d):
    return _features(s, d).select("grid_id", "date", "wind_theta_deg")


@query
def weather_features(s, d):
    return _features(s, d)


@query
def weather_features_chunked(s, d):
    return weather.features_by_chunk(fx.weather(s, d)).select("grid_id", "date", "effective_humidity", "rne_temp", "dwi")


# Static cells


@query
def safe_cast(s, d):
    raw = fx.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(".5"))).alias("raw"))
    return raw.select("o_orderkey", E.real("raw").alias("as_double"), F.coalesce(E.real("raw"), F.lit(0.0)).alias("or_zero"))


@query
def whole_cast(s, d):
    """Halves as text and as double."""
    half = (F.col("o_orderkey") % 21 - 10) + F.lit(0.5)
    raw = fx.table(s, d, "orders").select("o_orderkey", half.alias("number"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(half.cast("string")).alias("words"))
    return raw.select("o_orderkey", E.whole("number").alias("of_number"), E.whole("words").alias("of_text"))


@query
def forest_score(s, d):
    return static.forest(fx.master_grid(s, d))


@query
def exposure_score(s, d):
    return static.exposure(fx.master_grid(s, d))


@query
def static_dedup(s, d):
    return _cells(s, d)


# Composites


@query
def terrain_wind(s, d):
    return risk.terrain_wind(_features(s, d), _cells(s, d))


@query
def terrain_wind_to(s, d):
    """Bearings that say where the wind blows to."""
    return risk.terrain_wind(_features(s, d), _cells(s, d), mode="to").select("grid_id", "date", "Dr", "ywi", "tmi_p")


@query
def risk_index(s, d):
    return _index(s, d)


@query
def risk_index_joined(s, d):
    """The join form, for stored inputs."""
    w, m = _features(s, d), fx.master_grid(s, d)
    return risk.index(w, static.forest(m), risk.terrain_wind(w, _cells(s, d)), static.exposure(m))


@query
def final_dataset(s, d):
    """The join form, for stored inputs."""
    w, m = _features(s, d), fx.master_grid(s, d)
    return risk.final_dataset(w, static.forest(m), risk.terrain_wind(w, _cells(s, d)), static.exposure(m))


@query
def final_in_one_pass(s, d):
    return _final(s, d)


@query
def final_with_target(s, d):
    w, m = _features(s, d), fx.master_grid(s, d)
    label = events.buffer_label(m.select("grid_id").distinct(), _seasonal(s, d))
    return risk.final_dataset(w, static.forest(m), risk.terrain_wind(w, _cells(s, d)), static.exposure(m), _index(s, d), label).groupBy("fire_label").agg(F.count("*").alias("n"), F.avg("pffdri").alias("avg_pffdri"))


@query
def official_index(s, d):
    return weather.official(fx.weather(s, d), fx.master_grid(s, d), "1996-03-01", "1996-05-31")


# Events


@query
def crs_transform(s, d):
    return _events(s, d).select("objt_id", F.round("x5179", 4).alias("x5179"), F.round("y5179", 4).alias("y5179"))


@query
def cell_assign(s, d):
    x, y = events.cell_centre(F.col("grid_id"))
    m = fx.master_grid(s, d).select("grid_id", "grid_x", "grid_y").distinct()
    return m.select("grid_id", x.alias("cx"), y.alias("cy"), events.cell(F.col("grid_x") * 100, 500).alias("x500"), events.cell(F.col("grid_y") * 100, 2000).alias("y2000"))


@query
def event_filter(s, d):
    return events.normalise(fx.fire_history(s, d), fx.START_YEAR, fx.END_YEAR).select("objt_id", "date", "adres", "amount")


@query
def event_filter_seasonal(s, d):
    return events.seasonal(fx.fire_history(s, d), fx.START_YEAR, fx.END_YEAR).select("objt_id", "occu_year", "occu_mt")


@query
def event_cells(s, d):
    return events.cells(_events(s, d), 1000)


@query
def target_500m(s, d):
    return _target(s, d, 500)


@query
def target_1km(s, d):
    return _target(s, d, 1000)


@query
def target_2km(s, d):
    return _target(s, d, 2000)


@query
def buffer_label(s, d):
    return events.buffer_label(fx.master_grid(s, d).select("grid_id", "city_name"), _seasonal(s, d), 2)


@query
def buffer_report(s, d):
    return events.buffer_report(fx.master_grid(s, d), _seasonal(s, d), 2)


# Samples


@query
def positives(s, d):
    return sample.positives(_final(s, d), _target(s, d, 500)).select("date", "grid_id", "target_grid_id", "fire_count", "pffdri")


@query
def negatives(s, d):
    return sample.negatives(_final(s, d), _target(s, d, 500), 100_000).select("date", "grid_id", "pffdri")


@query
def labelled_sample(s, d):
    return _sample(s, d).select("date", "grid_id", "fire_label", "fire_count", "target_grid_id", "fire_amount_sum", "ffdri", "pffdri")


@query
def label_counts(s, d):
    return sample.label_counts(_sample(s, d))


@query
def month_label_counts(s, d):
    return sample.label_counts(_sample(s, d), by_month=True)


# Profiles


@query
def variable_profile(s, d):
    return profile.describe(_stored_sample(s, d, SCORES), SCORES, ["fire_label"])


@query
def lift(s, d):
    return profile.lift(_stored_sample(s, d, SCORES), SCORES)


@query
def label_corr(s, d):
    out = profile.correlations(_stored_sample(s, d, SCORES), SCORES, ["fire_label"])
    return out.select(F.col("x").alias("variable"), "r", F.abs("r").alias("abs_r"))


@query
def corr_matrix(s, d):
    return profile.correlation_matrix(fx.table(s, d, "lineitem"), LINE_NUMBERS)


#: Every number of the final dataset.
FINAL_NUMBERS = [
    "day_weight", "ta_mean", "ta_max", "hm_mean", "hm_min", "wind_ws_mean", "wind_ws_max", "wind_wd_sin_mean", "wind_wd_cos_mean", "rn_day_mean", "rn_day_max", "effective_humidity",
    "rne", "dwi", "dwi_n", "is_forest", "forest_type_code", "age_class_code", "tree_height_code", "fmi", "fmi_n", "elevation", "slope", "aspect_sin", "aspect_cos", "aspect_deg", "tmi_base_n",
    "tmi_p", "ywi", "Rm", "Ws", "Dr", "Da", "pole_count", "pole_n", "nearest_road_dist", "nearest_river_dist", "road_prox", "river_far", "pei", "ffdri", "pffdri",
]


@query
def corr_matrix_final(s, d):
    """All 42 numeric columns of the final dataset by each other, in long form."""
    return profile.correlation_matrix(_final(s, d), FINAL_NUMBERS)


@query
def sample_feature_summary(s, d):
    """Every number of the labelled sample by label, as the reports have it."""
    return reports.feature_summary(_stored_sample(s, d, FINAL_NUMBERS), FINAL_NUMBERS)


@query
def sample_month_summary(s, d):
    return reports.category_summary(_sample(s, d), "month", 30)


@query
def corr_pairs(s, d):
    lines = fx.table(s, d, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return profile.strong_pairs(lines, [*LINE_NUMBERS, "revenue"])


@query
def corr_pairs_weather(s, d):
    """Columns of which some are strongly correlated."""
    return profile.strong_pairs(weather.base(fx.weather(s, d)), ["ta_mean", "ta_max", "td_mean", "hm_mean", "wind_uu_mean"])


@query
def category_top(s, d):
    return profile.categories(_sample(s, d), "forest_type_code", ["ffdri", "pffdri"])


@query
def metric_ranking(s, d):
    ranks = profile.lift(_stored_sample(s, d, SCORES), SCORES).select("variable", "positive_mean", (100.0 * F.col("top10_capture")).alias("capture_pct"))
    return ranks.orderBy(F.desc("capture_pct"), "variable").limit(4)


@query
def rankings(s, d):
    return summaries.rankings(_stored_sample(s, d, SCORES), SCORES)


@query
def missing_profile(s, d):
    return profile.missing(fx.master_grid(s, d))


@query
def iqr_outliers(s, d):
    return profile.iqr_outliers(fx.master_grid(s, d), ATTRIBUTES)


@query
def duplicate_profile(s, d):
    return profile.duplicates(fx.master_grid(s, d), ["grid_id"])


@query
def moments(s, d):
    return profile.moments(fx.master_grid(s, d), ATTRIBUTES)


@query
def histogram(s, d):
    return profile.histogram(fx.table(s, d, "lineitem"), "l_extendedprice", 50)


@query
def category_share(s, d):
    return profile.shares(fx.table(s, d, "customer"), "c_mktsegment")


@query
def describe(s, d):
    return profile.describe(fx.table(s, d, "lineitem"), LINE_NUMBERS)


@query
def box_stats(s, d):
    return profile.box_stats(fx.table(s, d, "lineitem"), "l_extendedprice", "l_returnflag")


# Time


@query
def daily_mean(s, d):
    return summaries.with_season(summaries.daily_means(weather.base(fx.weather(s, d)), ["ta_mean", "hm_mean", "wind_ws_mean", "rn_day_mean"]))


def _daily(s: SparkSession, d: str) -> DataFrame:
    """Mean rain per block column and day, with a streak per block column."""
    w = weather.base(fx.weather(s, d)).withColumn("grid_id", F.substring_index("grid_id", "_", 1))
    days = w.groupBy("grid_id", "date").agg(F.avg("rn_day_mean").alias("rn_day_mean"), F.avg("hm_mean").alias("hm_mean"))
    return profile.dry_streak(days)


def _fire_days(s: SparkSession, d: str) -> DataFrame:
    return _seasonal(s, d).select(F.try_to_date("occu_date").alias("date")).distinct().withColumn("fire", F.lit(1))


@query
def dry_streak(s, d):
    return _daily(s, d).select("grid_id", "date", "streak")


@query
def dry_streak_reset(s, d):
    """Streaks that end where a day is missing, over ranges of 100 days."""
    return profile.dry_streak(weather.base(fx.weather(s, d)), reset_at_gaps=True, days=100).select("grid_id", "date", "streak")


@query
def streak_fire_rate(s, d):
    df = _daily(s, d).join(_fire_days(s, d), "date", "left").withColumn("fire", F.coalesce("fire", F.lit(0)))
    bin_ = E.right_closed(F.greatest("streak", F.lit(1)), [0, 3, 7, 14, 21, 999], ["1-3", "4-7", "8-14", "15-21", "22+"])
    return profile.binned_rate(df, bin_, "fire")


@query
def flag_compare(s, d):
    df = _daily(s, d).join(_fire_days(s, d), "date", "left").withColumn("fire", F.coalesce("fire", F.lit(0)))
    return summaries.flag_medians(df, ["hm_mean", "rn_day_mean"], "fire")


@query
def period_counts(s, d):
    return summaries.period_counts(fx.fire_history(s, d), "occu_mt", range(1, 15)).withColumnRenamed("period", "month")


@query
def amount_stats(s, d):
    return summaries.amount_stats(fx.fire_history(s, d))


@query
def amount_bins(s, d):
    return summaries.amount_bins(fx.fire_history(s, d), summaries.scaled_amount())


@query
def top_rest(s, d):
    return profile.top_and_rest(fx.fire_history(s, d), "resn")


@query
def seeded_sample(s, d):
    return summaries.hashed_sample(fx.fire_history(s, d).select("objt_id", "occu_date"), [F.col("objt_id")], 7, 50, ["objt_id"])


# Documented additions


@query
def risk_grade(s, d):
    return _index(s, d).groupBy(E.risk_grade(F.col("ffdri")).alias("grade"), (F.col("ffdri") >= 66).alias("alarm")).agg(F.count("*").alias("n"))


@query
def validation_metrics(s, d):
    return risk.validation(_sample(s, d), "ffdri", "fire_label", 50.0)


@query
def top_hit_rate(s, d):
    return risk.top_hit_rate(_stored_sample(s, d, ["ffdri"]), "ffdri", "fire_label", (0.05, 0.1, 0.3))


@query
def pole_exposure(s, d):
    m = fx.master_grid(s, d).groupBy("grid_id").agg(F.min(F.replace(F.trim("city_name"), F.lit(" "), F.lit(""))).alias("city"), F.max(F.coalesce(E.real("pole_count"), F.lit(0.0))).alias("pole_count"))
    return risk.pole_exposure(_index(s, d), m)


@query
def monthly_check(s, d):
    return summaries.monthly_ranges(_index(s, d), ["ffdri", "pffdri"])


@query
def time_split(s, d):
    return risk.time_split(_index(s, d), 1995, 1996).groupBy("part").agg(F.count("*").alias("n"), F.avg("pffdri").alias("avg_pffdri"))


@query
def hourly_to_daily(s, d):
    return summaries.hourly_to_daily(fx.table(s, d, "events"), "ts", "value", F.col("value").cast("double") * 36.0 % 360.0)


@query
def feature_transforms(s, d):
    return summaries.transformed(fx.master_grid(s, d)).select("grid_id", "city_name", "road_log", "road_capped", "road_robust", *[f"type_{k}" for k in range(5)])


@query
def class_weights(s, d):
    return summaries.class_weights(_sample(s, d), "fire_label")


@query
def city_risk(s, d):
    m = fx.master_grid(s, d).groupBy("grid_id").agg(F.min(F.replace(F.trim("city_name"), F.lit(" "), F.lit(""))).alias("city"))
    return summaries.city_risk(_index(s, d), m)
