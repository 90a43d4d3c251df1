"""Terrain and wind, composite indices, the final dataset and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.functions import exprs as E
from gridrisk.operators import profile

TERRAIN = ("grid_id", "date", "month", "elevation", "slope", "aspect_sin", "aspect_cos", "aspect_deg", "tmi_base_n", "tmi_p", "ywi", "Rm", "Ws", "Dr", "Da")
#: Those of them that a day without a cell would have too.
OF_DAY = ("tmi_p", "ywi", "Ws", "Dr", "Da")


def _of_cells(cells: DataFrame) -> DataFrame:
    """Cells with what terrain scores owe to them alone, so that it is made once per cell and not once per day."""
    df = cells.withColumn("aspect_deg", E.bearing(F.col("aspect_sin"), F.col("aspect_cos")))
    df = df.withColumns({
        "aspect_sin": F.sin(F.radians("aspect_deg")),
        "aspect_cos": F.cos(F.radians("aspect_deg")),
        "tmi_base_n": E.unit(0.5 * E.unit(F.col("elevation") / 1000.0) + 0.5 * ((1.0 - F.cos(F.radians("aspect_deg"))) / 2.0)),
    })
    return df.withColumn("tmi_still", 0.55 * F.col("tmi_base_n") + 0.25 * E.unit(F.col("slope") / 35.0))


def _with_terrain(df: DataFrame, mode: str) -> DataFrame:
    """df (weather features beside ``_of_cells``) with terrain and wind scores, row by row."""
    df = df.withColumns({
        "Ws": E.unit((F.col("wind_ws_max") - 7.0) / 4.0),
        "Dr": E.alignment(F.col("wind_theta_deg"), 270.0 if mode == "from" else 90.0),
        "Da": E.unit((40.0 - F.col("effective_humidity")) / 15.0),
    })
    df = df.withColumn("ywi", F.col("Rm") * F.col("Ws") * F.col("Dr") * F.col("Da"))
    return df.withColumn("tmi_p", F.col("tmi_still") + 0.20 * F.col("ywi")).drop("tmi_still")


def terrain_wind(weather: DataFrame, cells: DataFrame, mode: str = "from") -> DataFrame:
    """weather: features. mode: whether bearings say where the wind comes 'from' or blows 'to'."""
    df = weather.select("grid_id", "date", "month", "wind_ws_max", "wind_theta_deg", "effective_humidity").join(_of_cells(cells), "grid_id")
    return _with_terrain(df, mode).select(*TERRAIN)


#: Weather columns that the final dataset leaves out.
NOT_FINAL = ("month_num", "day_num", "td_mean", "td_min", "wind_uu_mean", "wind_vv_mean", "wind_theta_deg", "rn_class", "rn_class1", "rn_class2", "rne_temp", "predwi", "predwi_class")
INDEX = ("grid_id", "date", "month", "day_weight", "dwi", "dwi_n", "fmi", "fmi_n", "tmi_base_n", "tmi_p", "pei", "ffdri", "pffdri")


def in_one_pass(weather: DataFrame, forest: DataFrame, cells: DataFrame, exposure: DataFrame, mode: str = "from") -> DataFrame:
    """The columns of ``final_dataset`` straight from weather features and static cells: the fact is read and shuffled
    once and never joined to itself. Weather cells that are not among cells stay, with null terrain; cells once per
    cell."""
    return wide(weather, forest, cells, exposure, mode).drop(*NOT_FINAL, "in_cells")


def wide(weather: DataFrame, forest: DataFrame, cells: DataFrame, exposure: DataFrame, mode: str = "from") -> DataFrame:
    """Every column of weather, terrain, forest, exposure and indices side by side; in_cells: whether terrain is known."""
    df = _with_terrain(weather.join(_of_cells(cells).withColumn("in_cells", F.lit(True)), "grid_id", "left"), mode)
    df = df.withColumns({c: F.when(F.col("in_cells"), F.col(c)) for c in OF_DAY})
    df = df.join(forest, "grid_id", "left").join(exposure.drop("forest_contact"), "grid_id", "left")
    return _with_indices(df)


def _with_indices(df: DataFrame) -> DataFrame:
    weight = F.col("day_weight")
    return df.withColumns({
        "ffdri": E.composite(F.col("dwi"), F.col("fmi"), F.col("tmi_base_n") * 10.0, weight),
        "pffdri": E.power_composite(F.col("dwi_n"), F.col("fmi_n"), F.col("tmi_p"), F.col("pei"), weight),
    })


def index(weather: DataFrame, forest: DataFrame, terrain: DataFrame, exposure: DataFrame) -> DataFrame:
    df = weather.select("grid_id", "date", "month", "day_weight", "dwi", "dwi_n")
    df = df.join(terrain.select("grid_id", "date", "tmi_base_n", "tmi_p"), ["grid_id", "date"], "left")
    df = df.join(forest.select("grid_id", "fmi", "fmi_n"), "grid_id", "left").join(exposure.select("grid_id", "pei"), "grid_id", "left")
    return df.select(
        "grid_id", "date", "month", "day_weight", "dwi", "dwi_n", "fmi", "fmi_n", "tmi_base_n", "tmi_p", "pei",
        E.composite(F.col("dwi"), F.col("fmi"), F.col("tmi_base_n") * 10.0, F.col("day_weight")).alias("ffdri"),
        E.power_composite(F.col("dwi_n"), F.col("fmi_n"), F.col("tmi_p"), F.col("pei"), F.col("day_weight")).alias("pffdri"),
    )


def final_dataset(weather: DataFrame, forest: DataFrame, terrain: DataFrame, exposure: DataFrame, indices: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """All features side by side. Indices that are not stored are made of the joined columns, which takes no further join of
    the fact; target, if given, is joined by cell only."""
    w = weather.select("grid_id", "date", "month", "day_weight", "ta_mean", "ta_max", "hm_mean", "hm_min", "wind_ws_mean", "wind_ws_max", "wind_wd_sin_mean", "wind_wd_cos_mean", "rn_day_mean", "rn_day_max", "effective_humidity", "rne", "dwi", "dwi_n")
    df = w.join(terrain.drop("month"), ["grid_id", "date"], "left")
    if indices is not None:
        df = df.join(indices.select("grid_id", "date", "ffdri", "pffdri"), ["grid_id", "date"], "left")
    df = df.join(forest, "grid_id", "left").join(exposure.drop("forest_contact"), "grid_id", "left")
    df = _with_indices(df) if indices is None else df
    return df.join(target, "grid_id", "left") if target is not None else df


def validation(df: DataFrame, score: str, label: str, cut: float) -> DataFrame:
    """Recall, precision, F2 and flagged share of score >= cut."""
    flagged, real = F.col(score) >= cut, F.col(label) == 1
    n = df.agg(F.count_if(flagged & real).alias("tp"), F.count_if(flagged & ~real).alias("fp"), F.count_if(~flagged & real).alias("fn"), F.count("*").alias("n"))
    recall, precision = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tp", F.col("tp") + F.col("fp"))
    return n.select(recall.alias("recall"), precision.alias("precision"), F.try_divide(5 * F.col("tp"), 5 * F.col("tp") + 4 * F.col("fn") + F.col("fp")).alias("f2"), F.try_divide(F.col("tp") + F.col("fp"), F.col("n")).alias("flagged_share"))


def top_hit_rate(df: DataFrame, score: str, label: str, shares: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """Per share k the part of the positives that lie in the top k of the rows by score. Rows of equal score are in together
    if all rows scored as high make at most that share."""
    ranked = profile.refined(profile.long_form(df, [score], [label]), ["variable"], [1 - k for k in shares], pos=F.count_if(F.col(label) == 1))
    rates = F.array(*[F.struct(F.lit(k).alias("share"), F.try_divide(profile.captured(k), F.max("total_pos")).alias("hit_rate")) for k in shares])
    return ranked.agg(rates.alias("r")).select(F.inline("r"))


def pole_exposure(indices: DataFrame, cells: DataFrame, cut: float = 66.0) -> DataFrame:
    """Per city: cells and poles at risk on some day, and pole-days. cells: grid_id (once), city, pole_count."""
    risky = indices.where(F.col("ffdri") >= cut).groupBy("grid_id").agg(F.countDistinct("date").alias("days"))
    df = cells.join(risky, "grid_id", "left").withColumn("days", F.coalesce("days", F.lit(0)))
    hit = F.col("days") > 0
    return df.groupBy("city").agg(F.count_if(hit).alias("cells_at_risk"), F.coalesce(F.sum(F.when(hit, F.col("pole_count"))), F.lit(0.0)).alias("poles_at_risk"), F.coalesce(F.sum(F.col("pole_count") * F.col("days")), F.lit(0.0)).alias("pole_days"))


def time_split(df: DataFrame, train_until: int, valid_until: int) -> DataFrame:
    return df.withColumn("part", E.cases([(F.year("date") <= train_until, "train"), (F.year("date") <= valid_until, "valid")], "predict"))
