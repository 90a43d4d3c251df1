"""Static cell features: forest, exposure, terrain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.functions import exprs as E
from gridrisk.operators import profile


def forest(master: DataFrame) -> DataFrame:
    codes = ("is_forest", "forest_type_code", "age_class_code", "tree_height_code")
    df = master.select("grid_id", *[E.whole(c).alias(c) for c in codes])
    score = lambda scale: E.forest_score(F.col("is_forest"), F.col("forest_type_code"), scale)
    return df.withColumns({"fmi": score(1.0), "fmi_n": score(0.1)}).distinct()


def exposure(master: DataFrame) -> DataFrame:
    """Normalised by global 95th percentiles over all rows, duplicated cells included; a zero percentile counts as 1."""
    df = master.select("grid_id", F.coalesce(E.real("pole_count"), F.lit(0.0)).alias("pole_count"), E.real("nearest_road_dist").alias("nearest_road_dist"), E.real("nearest_river_dist").alias("nearest_river_dist"), E.whole("is_forest").alias("is_forest"))
    measured = ("pole_count", "nearest_road_dist", "nearest_river_dist")
    q = profile.quantiles(profile.long_form(df, [*measured]), ["variable"], [0.95])
    stats = q.agg(*[F.expr(f"coalesce(nullif(max(CASE WHEN variable = '{c}' THEN q END), 0D), 1D) AS q_{c}") for c in measured])
    df = df.crossJoin(F.broadcast(stats)).withColumns({  # one row
        "pole_n": E.unit(F.col("pole_count") / F.col("q_pole_count")),
        "road_prox": 1.0 - E.unit(F.col("nearest_road_dist") / F.col("q_nearest_road_dist")),
        "river_far": E.unit(F.col("nearest_river_dist") / F.col("q_nearest_river_dist")),
        "forest_contact": F.when(F.col("is_forest") == 1, 1.0).otherwise(0.0),
    })
    df = df.withColumn("pei", E.exposure(F.col("pole_n"), F.col("road_prox"), F.col("river_far"), F.col("forest_contact")))
    return df.select("grid_id", "pole_count", "pole_n", "nearest_road_dist", "nearest_river_dist", "road_prox", "river_far", "forest_contact", "pei").distinct()


def terrain_cells(master: DataFrame, full: list[str], half: list[str]) -> DataFrame:
    """One row per cell; where duplicates differ the greatest value stays."""
    attributes = ("elevation", "slope", "aspect_sin", "aspect_cos")
    df = master.select("grid_id", *[E.real(c).alias(c) for c in attributes], E.region_weight(F.col("city_name"), full, half).alias("Rm"))
    return df.groupBy("grid_id").agg(*[F.max(c).alias(c) for c in (*attributes, "Rm")])
