"""Point events on grids: filters, cells, mapped targets, buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.projection import to_metres

REQUIRED = ["objt_id", "occu_date", "occu_year", "longitude", "latitude", "adres"]
REGION_WORD, REGION_CODES = "강원", (42, 51)


def normalise(events: DataFrame, start_year: int, end_year: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dated events with coordinates of the region (by address or province code) and years."""
    amount = F.col("amount").try_cast("double") if "amount" in events.columns else F.lit(None).cast("double")
    code = F.col("ctprvn_cd").try_cast("double") if "ctprvn_cd" in events.columns else F.lit(None).cast("double")
    df = events.select(
        F.col("objt_id").cast("string").alias("objt_id"), F.try_to_date("occu_date").alias("date"), F.col("occu_year").try_cast("double").alias("year"),
        F.col("longitude").try_cast("double").alias("longitude"), F.col("latitude").try_cast("double").alias("latitude"),
        F.coalesce(F.col("adres").cast("string"), F.lit("")).alias("adres"), amount.alias("amount"), code.alias("code"),
    )
    df = df.where(F.col("adres").contains(REGION_WORD) | F.coalesce(F.col("code").isin(*REGION_CODES), F.lit(False)))
    df = df.where(F.col("year").between(start_year, end_year) & F.col("longitude").isNotNull() & F.col("latitude").isNotNull() & F.col("date").isNotNull())
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return (df.where(F.col("date") <= F.lit(end).cast("date")) if end else df).drop("year", "code")


def seasonal(events: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """The narrower rule: province code, years and months 2 to 5."""
    number = lambda c: F.col(c).try_cast("double")
    df = events.where(number("ctprvn_cd").isin(*REGION_CODES) & number("occu_year").between(start_year, end_year) & number("occu_mt").between(2, 5))
    return df.where(number("longitude").isNotNull() & number("latitude").isNotNull())


def project(events: DataFrame) -> DataFrame:
    x, y = to_metres(F.col("longitude"), F.col("latitude"))
    return events.withColumns({"x5179": x, "y5179": y})


def size_label(size: int) -> str:
    return f"{size // 1000}km" if size % 1000 == 0 else f"{size}m"


def cell(x: Column, size: int) -> Column:
    return F.floor(x / size).cast("long")


def cells(events: DataFrame, size: int) -> DataFrame:
    """One row per date and target cell with what happened in it."""
    df = events.withColumns({"target_grid_x": cell(F.col("x5179"), size), "target_grid_y": cell(F.col("y5179"), size)})
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    out = df.groupBy("date", "target_grid_x", "target_grid_y").agg(
        F.count("*").alias("fire_count"), text("objt_id").alias("fire_objt_ids"), text(F.when(F.col("adres") != "", F.col("adres"))).alias("fire_addresses"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("fire_amount_sum"), F.avg("longitude").alias("event_lon_mean"), F.avg("latitude").alias("event_lat_mean"),
        F.avg("x5179").alias("event_x5179_mean"), F.avg("y5179").alias("event_y5179_mean"),
    )
    return out.withColumns({
        "target_grid_size_m": F.lit(size), "fire_label": F.lit(1),
        "target_grid_id": F.concat_ws("_", F.lit("epsg5179"), F.lit(size_label(size)), F.col("target_grid_x"), F.col("target_grid_y")),
    })


TARGET = (
    "date", "grid_id", "target_grid_id", "target_grid_size_m", "target_grid_x", "target_grid_y", "fire_label", "fire_count", "fire_objt_ids", "fire_addresses",
    "fire_amount_sum", "event_lon_mean", "event_lat_mean", "event_x5179_mean", "event_y5179_mean",
)


def mapped_target(events: DataFrame, master: DataFrame, size: int) -> DataFrame:
    """Positive rows only: each base cell of a target cell with events, per date. events: projected."""
    # Duplicated cells agree in their coordinates; the least stays if not.
    base = master.groupBy("grid_id").agg(F.min(F.struct("grid_x", "grid_y")).alias("at"))
    fine = base.select("grid_id", cell(F.col("at.grid_x") * 100, size).alias("target_grid_x"), cell(F.col("at.grid_y") * 100, size).alias("target_grid_y"))
    return cells(events, size).join(fine, ["target_grid_x", "target_grid_y"]).select(*TARGET)


def with_month(df: DataFrame) -> DataFrame:
    """df with the month of its dates, to be written by month."""
    return df.withColumn("month", F.date_format("date", "yyyy-MM"))


def _spot(events: DataFrame, *names: str) -> DataFrame:
    return events.select(*names, cell(F.col("x5179"), 100).alias("cx"), cell(F.col("y5179"), 100).alias("cy"))


def _around(spots: DataFrame, radius: int) -> DataFrame:
    """spots (cx, cy) with grid_id: a row for each cell within radius cells."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    df = spots.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius)
    return df.withColumn("grid_id", F.concat_ws("_", F.col("cx") + F.col("dx"), F.col("cy") + F.col("dy"))).drop("dx", "dy")


def buffer_matches(events: DataFrame, radius: int) -> DataFrame:
    """Per event the ids of all cells within radius cells. events: objt_id, x5179, y5179."""
    return _around(_spot(events, "objt_id", "occu_year"), radius).drop("cx", "cy")


def buffer_label(master: DataFrame, events: DataFrame, radius: int = 5) -> DataFrame:
    """master with fire_label: whether any event lies within radius cells."""
    hit = _around(_spot(events).distinct(), radius).select("grid_id").distinct().withColumn("hit", F.lit(1))
    return master.join(hit, "grid_id", "left").withColumn("fire_label", F.coalesce("hit", F.lit(0))).drop("hit")


def buffer_report(master: DataFrame, events: DataFrame, radius: int = 5) -> DataFrame:
    """Per year: events, matched events, their share in %, and matched cells in all and on average."""
    at, known = _spot(events, "occu_year"), master.select("grid_id").distinct()
    found = _around(at.select("cx", "cy").distinct(), radius).join(known, "grid_id").groupBy("cx", "cy").agg(F.count("*").alias("cells"))
    df = at.join(found, ["cx", "cy"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    return df.groupBy("occu_year").agg(F.count("*").alias("events"), F.count_if(F.col("cells") > 0).alias("matched"), (100.0 * F.count_if(F.col("cells") > 0) / F.count("*")).alias("matched_pct"), F.sum("cells").alias("cells_sum"), F.avg("cells").alias("cells_mean"))


def cell_centre(grid_id: Column) -> tuple[Column, Column]:
    parts = F.split(grid_id, "_")
    return parts[0].cast("long") * 100 + 50, parts[1].cast("long") * 100 + 50
