"""Sinks: tables, Parquet with a codec and level, month partitions, CSV."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def replace_fact(df: DataFrame, name: str, buckets: int) -> None:
    """A table of days by cell, partitioned by month and bucketed by cell, with a file per month and bucket. Lags over the
    table need no exchange, and neither do joins of such tables by cell and date where the session sets
    spark.sql.requireAllClusterKeysForCoPartition to false."""
    rows = df.repartition(buckets, "grid_id")
    rows.write.mode("overwrite").partitionBy("month").bucketBy(buckets, "grid_id").sortBy("date").saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


LEVEL_KEYS = {"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level", "brotli": "compression.brotli.quality"}

#: Hadoop's names of the levels of zlib, 0 to 9.
ZLIB_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


@dataclass(frozen=True)
class Written:
    """What a write put where: rows, about how many cells (within 1 %), first and last date, and months, where df has
    these columns. All are counted by the tasks that write."""

    path: str
    rows: int
    cells: int | None = None
    first: dt.date | None = None
    last: dt.date | None = None
    months: tuple[str, ...] = ()


def observed(df: DataFrame, **more) -> tuple[DataFrame, Observation]:
    counts = {"rows": F.count(F.lit(1))}
    if "grid_id" in df.columns:
        counts["cells"] = F.approx_count_distinct("grid_id", 0.01)
    if "date" in df.columns:
        counts |= {"first": F.min("date"), "last": F.max("date")}
    if "month" in df.columns:
        counts["months"] = F.array_sort(F.collect_set("month"))
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in (counts | more).items()]), seen


def _written(seen: Observation, path: str) -> Written:
    found = seen.get
    return Written(path, found.get("rows", 0), found.get("cells"), found.get("first"), found.get("last"), tuple(found.get("months") or ()))


def _compressed(df: DataFrame, codec: str, level: int | None) -> DataFrameWriter:
    writer, key = df.write.option("compression", codec), LEVEL_KEYS.get(codec.lower())
    if level is None or key is None:
        return writer
    return writer.option(key, ZLIB_LEVELS[level] if codec.lower() == "gzip" else str(level))


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", level: int | None = None, mode: str = "error") -> Written:
    """level: for zstd, gzip and brotli; other codecs have none and ignore it."""
    df, seen = observed(df)
    _compressed(df, codec, level).mode(mode).parquet(path)
    return _written(seen, path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet at path, if there is some."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_months(
    df: DataFrame, path: str, how: str = "months", codec: str = "zstd", level: int | None = None,
    *, months: list[str] | None = None, start: str | None = None, end: str | None = None,
) -> Written:
    """Partitions by month. how: 'all' replaces everything, 'months' only what df is about, 'append' adds rows (twice if
    run twice).

    With 'months', months, start and end say what df is about, and df must hold nothing else; without them it is about
    the months that it has. Such days are replaced, also where df has none: other days of the first and last month stay,
    and a month without any row left becomes an empty partition. Partitions are exchanged when all tasks are done.
    """
    before = existing(df.sparkSession, path) if how == "months" else None
    rows, had = df, []
    if before is not None and (months or start or end):
        about = lambda m: (not months or m in months) and (not start or m >= start[:7]) and (not end or m <= end[:7])
        had = [m for (m,) in before.select(F.col("month").cast("string")).distinct().collect() if about(m)]  # partitions by month
    if before is not None and (start or end):
        edges = [m for m in (start and start[:7], end and end[:7]) if m and (not months or m in months)]
        outside = (F.col("date") < start if start else F.lit(False)) | (F.col("date") > end if end else F.lit(False))
        rows = df.unionByName(before.withColumn("month", F.col("month").cast("string")).where(F.col("month").isin(edges) & outside), allowMissingColumns=True)
    rows, seen = observed(rows)
    writer = _compressed(rows, codec, level).partitionBy("month")
    if how == "months":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if how == "append" else "overwrite").parquet(path)
    written = _written(seen, path)
    for month in had:
        if month not in written.months:
            _compressed(df.drop("month").limit(0), codec, level).mode("overwrite").parquet(f"{path}/month={month}")
    return written


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, *order: Column) -> None:
    """A report of few rows as one sorted CSV file with a header, in a folder; replaces an earlier one. Column ``place`` only
    orders rows and is left out where it comes last."""
    rows = df.repartition(1).sortWithinPartitions(*order)
    rows = rows.drop("place") if df.columns[-1] == "place" else rows
    rows.write.mode("overwrite").option("header", True).csv(path)
