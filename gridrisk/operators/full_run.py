"""The full run: from the weather fact and the static grid to every stage's output, by month."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridrisk.operators import events, risk, static, weather
from gridrisk.sources import readers, sinks

#: Static tables of at most so many cells, some 100 bytes each, are broadcast to the fact; more join by its exchange.
BROADCAST_CELLS = 500_000


@dataclass(frozen=True)
class Run:
    """Where a run reads and writes; weather is a path, or with fact_table a table's name, as ``sinks.replace_fact`` stores
    it so that the run needs no exchange of the fact at all. months, start and end limit it. chunk: 'month' or 'year' gives the first days of a
    chunk no history, as runs chunk by chunk do. target_sizes: cell sizes of the targets, in metres. parts: a folder of
    part files with numbers up to most_part, that replace the weather fact first. repeats: what to do with a second row of
    a cell and date, 'keep' or 'fail'. broadcast_cells: see BROADCAST_CELLS."""

    weather: str
    master: str
    out: str
    full_weight: list[str]
    half_weight: list[str]
    events: str | None = None
    months: list[str] | None = None
    start: str | None = None
    end: str | None = None
    chunk: str | None = None
    target_sizes: tuple[int, ...] = (500, 1000, 2000)
    start_year: int = 2020
    end_year: int = 2024
    wind: str = "from"
    codec: str = "zstd"
    level: int | None = 6
    parts: str | None = None
    most_part: int = 721
    repeats: str = "keep"
    broadcast_cells: int = BROADCAST_CELLS
    fact_table: bool = False


def _window(run: Run) -> dict:
    return {"months": run.months, "start": run.start, "end": run.end}


def fact_of(spark: SparkSession, run: Run) -> DataFrame:
    return spark.table(run.weather) if run.fact_table else readers.read_tree(spark, run.weather)


def final_of(fact: DataFrame, master: DataFrame, run: Run) -> DataFrame:
    """The final dataset of a run as one plan: the fact is shuffled once, by cell."""
    days = weather.features(fact, **_window(run), chunk=run.chunk, repeats=run.repeats)
    cells = static.terrain_cells(master, run.full_weight, run.half_weight)
    return risk.in_one_pass(days, static.forest(master), cells, static.exposure(master), run.wind)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df (a static table) with the number of each row among those of its cell."""
    order = Window.partitionBy("grid_id").orderBy(*[c for c in df.columns if c != "grid_id"])
    return df.withColumn(name, F.row_number().over(order))


def stage_of(fact: DataFrame, forest: DataFrame, cells: DataFrame, exposure: DataFrame, run: Run, few: bool) -> DataFrame:
    """Every column that any output of the run has, from one exchange of the fact. A cell with several static rows has as
    many rows a day; ``once`` is true for the first of them, which stands for the day in what no static row is part of.
    few: the static tables are small enough to be broadcast."""
    days = weather.features(fact, **_window(run), chunk=run.chunk, repeats="mark" if run.repeats == "keep" else run.repeats)
    sent = F.broadcast if few else lambda df: df
    made = risk.wide(days, sent(_numbered(forest, "forest_row")), sent(cells), sent(_numbered(exposure, "exposure_row")), run.wind)
    first = lambda c: F.coalesce(F.col(c), F.lit(1)) == 1
    return made.withColumn("once", first("forest_row") & first("exposure_row")).drop("forest_row", "exposure_row")


def outputs_of(stage: DataFrame) -> dict[str, DataFrame]:
    """The daily outputs, each a projection of the stage."""
    return {
        "feat_weather_daily": stage.where("once").select(*weather.FEATURES),
        "feat_terrain_ywi_daily": stage.where("once AND in_cells").select(*risk.TERRAIN),
        "feat_pffdri_daily": stage.select(*risk.INDEX),
        "final_feature_daily": stage.drop(*risk.NOT_FINAL, "in_cells", "once", "repeated"),
    }


def run_all(spark: SparkSession, run: Run) -> dict[str, sinks.Written]:
    """Writes the static features, the daily weather, terrain, index and final features by month and, with events, the
    targets by month. Days of the run are replaced and others stay, so a month that runs twice is there once, and a run
    over part of a month leaves its other days. Returns by name what was written, counted by the tasks that wrote it;
    ``repeated`` counts the rows that repeat a cell and date, by the lags' exchange.

    The fact is shuffled once, into a stage table of all columns that is dropped at the end; the outputs are read off it,
    so a lost executor costs no more than its own tasks."""
    if run.parts:
        loaded = readers.read_parts(spark, run.parts, run.most_part).drop("filename")
        sinks.write_months(loaded.withColumn("month", F.date_format("date", "yyyy-MM")), run.weather, "all", run.codec, run.level)
    fact, master = fact_of(spark, run), readers.read_source(spark, "master_grid", run.master)
    readers.require_columns(fact, ["grid_id", "date", "month", *weather.REALS], "weather")
    readers.require_columns(master, ["grid_id", "pole_count", "is_forest", "forest_type_code", "elevation", "slope", "aspect_sin", "aspect_cos", "city_name"], "master grid")
    out = {}
    for name, made in (("feat_forest_static", static.forest(master)), ("feat_power_access_static", static.exposure(master))):
        out[name] = sinks.write_parquet(made, f"{run.out}/{name}", run.codec, run.level, "overwrite")
    forest, exposure = (spark.read.parquet(out[name].path) for name in ("feat_forest_static", "feat_power_access_static"))
    few = max(w.rows for w in out.values()) <= run.broadcast_cells
    cells = static.terrain_cells(master, run.full_weight, run.half_weight)
    table = f"gridrisk_stage_{uuid.uuid4().hex}"
    stage, seen = sinks.observed(stage_of(fact, forest, cells, exposure, run, few), repeated=F.count_if("repeated") if run.repeats == "keep" else F.lit(0))
    try:
        stage.write.partitionBy("month").saveAsTable(table)
        out["repeated"] = seen.get.get("repeated", 0)
        for name, made in outputs_of(spark.table(table)).items():
            out[name] = sinks.write_months(made, f"{run.out}/{name}", "months", run.codec, run.level, **_window(run))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    if run.events:
        found = events.normalise(readers.read_events_csv(spark, run.events), run.start_year, run.end_year, run.start, run.end)
        for size in run.target_sizes:
            name = f"target_fire_daily_{events.size_label(size)}"
            target = readers.in_dates(events.with_month(events.mapped_target(events.project(found), master, size)), run.months)
            out[name] = sinks.write_months(target, f"{run.out}/{name}", "months", run.codec, run.level, **_window(run))
    return out
