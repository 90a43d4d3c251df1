"""Labelled samples and their profile as files: one stored sample per cell size, and every table read off it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrisk.operators import events, profile, sample, summaries
from gridrisk.sources import readers, sinks

#: Columns of the sample that say what happened rather than what was known before.
HAPPENED = events.TARGET[2:]
#: Scores that reports compare, in their order.
METRICS = ("pffdri", "ffdri", "dwi", "dwi_n", "fmi", "fmi_n", "tmi_p", "ywi", "pei")


@dataclass(frozen=True)
class Report:
    """final: the final dataset by month. targets: the targets' paths by the name of their cell size. months, start and end
    limit the sample, ratio and most its negatives. columns: of a correlation matrix. top: rows of a category table."""

    final: str
    targets: dict[str, str]
    out: str
    months: list[str] | None = None
    start: str | None = None
    end: str | None = None
    ratio: int = 10
    most: int = 200_000
    seed: int = 42
    columns: int = 24
    top: int = 30
    codec: str = "zstd"
    level: int | None = 6


def stored_sample(spark: SparkSession, report: Report, label: str) -> DataFrame:
    """Writes the labelled sample of a cell size, and its positives, and reads the sample back."""
    final = readers.in_dates(readers.read_tree(spark, report.final), report.months, report.start, report.end)
    target = readers.read_tree(spark, report.targets[label])
    drawn = sample.labelled(final, target.drop("month"), report.ratio, report.most, report.seed)
    path = f"{report.out}/eda_sample_{label}"
    sinks.write_parquet(drawn, path, report.codec, report.level, "overwrite")
    rows = spark.read.parquet(path)
    sinks.write_parquet(rows.where("fire_label = 1"), f"{report.out}/eda_positive_{label}", report.codec, report.level, "overwrite")
    return rows


def _in_order(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """df with ``place``, where a name comes among names."""
    return df.withColumn("place", F.array_position(F.array(*map(F.lit, names)), F.col(column)))


def feature_summary(rows: DataFrame, features: list[str], label: str = "fire_label") -> DataFrame:
    """Per variable and label: rows, missing ones too, mean, std, min, quartiles, max."""
    counts = rows.groupBy(label).agg(F.count("*").alias("row_count"))
    found = profile.describe(rows, features, [label]).join(F.broadcast(counts), label)  # a row per label
    return found.select("variable", label, "row_count", "mean", "std", "min", "q25", F.col("q50").alias("median"), "q75", "max")


def wide_correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The correlation matrix with a row and a column for each of columns."""
    r = profile.correlation_matrix(rows, columns)
    return r.groupBy(F.col("x").alias("variable")).pivot("y", columns).agg(F.first("r"))


def category_summary(rows: DataFrame, column: str, top: int, label: str = "fire_label") -> DataFrame:
    """The top categories by positives, then by their rate, then by rows."""
    out = rows.groupBy(column).agg(
        F.count("*").alias("row_count"), F.count_if(F.col(label) == 1).alias("positive_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"),
        F.avg("pffdri").alias("avg_pffdri"), F.avg("ffdri").alias("avg_ffdri"),
    )
    return out.orderBy(*_by_positives(column)).limit(top)


def _by_positives(column: str) -> list[Column]:
    return [F.desc("positive_rows"), F.desc("positive_rate"), F.desc("row_count"), F.col(column)]


def tables_of(rows: DataFrame, report: Report) -> dict[str, tuple]:
    """Every report table of a stored sample, by name, with its order. The names of the columns that correlate most with
    the label, one row per column, pass through the driver."""
    features = profile.numeric_columns(rows, [*HAPPENED])
    counts, months = sample.label_counts(rows), sample.label_counts(rows, by_month=True)
    pearson = profile.correlations(rows, features, ["fire_label"]).select(F.col("x").alias("variable"), F.col("r").alias("pearson_corr_fire_label"))
    by_size = (F.abs("pearson_corr_fire_label").desc_nulls_last(), F.col("variable"))
    ranked = [r.variable for r in pearson.orderBy(*by_size).limit(report.columns).collect()]
    lifted = profile.lift(rows, features, counted=True).select(
        "variable", "row_count", F.col("positives").alias("positive_rows"), "positive_mean", "negative_mean",
        F.col("top10_capture").alias("positive_top10_share"), F.col("top20_capture").alias("positive_top20_share"),
    )
    metrics = [m for m in METRICS if m in features]
    return {
        "eda_label_counts": (counts, F.desc("fire_label")),
        "eda_monthly_counts": (months, "month", F.desc("fire_label")),
        "label_counts": (counts.select("fire_label", "row_count", "date_count", "grid_count"), F.desc("fire_label")),
        "feature_summary": (_in_order(feature_summary(rows, features), "variable", features), "place", F.desc("fire_label")),
        "lift_summary": (_in_order(lifted, "variable", features), "place"),
        "pearson_fire_label": (pearson, *by_size),
        "feature_corr_matrix": (_in_order(wide_correlations(rows, ranked), "variable", ranked), "place"),
        "month_summary": (category_summary(rows, "month", report.top), *_by_positives("month")),
        "grid_summary": (category_summary(rows, "grid_id", report.top), *_by_positives("grid_id")),
        "rankings": (summaries.rankings(rows, metrics), "ranking", "place"),
    }


def run_reports(spark: SparkSession, report: Report) -> dict[str, str]:
    """Samples and profiles of every cell size: two Parquet folders and ten sorted CSV files each. The sample is made
    once and stored; each table is a pass or two over it. Returns the paths by name. Without rows of the final dataset in
    the window it raises ValueError."""
    paths = {}
    for label in report.targets:
        rows = stored_sample(spark, report, label)
        paths |= {f"{name}_{label}": f"{report.out}/{name}_{label}" for name in ("eda_sample", "eda_positive")}
        for name, (df, *order) in tables_of(rows, report).items():
            path = paths[f"{name}_{label}"] = f"{report.out}/{name}_{label}"
            sinks.write_report(df, path, *order)
    return paths
