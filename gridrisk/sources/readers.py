"""Sources: partitioned and single Parquet, part files, CSV with an encoding, tables, and column contracts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrisk.functions.exprs import SCALED_BY_TEN

#: Longer lists of cells become a join.
MOST_LISTED = 1_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """A partitioned Parquet tree; files may lack columns that others have."""
    return spark.read.option("mergeSchema", True).parquet(root)


def read_parts(spark: SparkSession, root: str, most: int) -> DataFrame:
    """Files part.N.parquet with N <= most, with the file's path as ``filename``."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part\.(\d+)\.parquet$", 1)
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(root)
    return df.select("*", F.col("_metadata.file_path").alias("filename"), number.try_cast("int").alias("__n")).where(F.col("__n") <= most).drop("__n")


def read_source(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """The Parquet at path, or else the table."""
    return spark.read.parquet(path) if path else spark.table(name)


#: Decoders of Java for the encodings that event files come in.
DECODERS = {"utf-8-sig": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}


def _csv(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    name = DECODERS.get(encoding.lower(), encoding)
    if not name.upper().startswith("UTF"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # the lazy read needs it later, so it stays
    return spark.read.csv(paths, header=True, encoding=name, multiLine=True, escape='"')


def read_events_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """CSV files with a header, in an encoding; without one each file of a folder is decided for itself: UTF-8 if all of
    its text is valid so, else cp949, which holds EUC-KR. Files may lack columns that others have, and quoted values may
    hold line breaks; a file is one task's, as such breaks allow no cut. For other encodings than Unicode the session is
    set to admit all of Java's. A row per file passes through the driver."""
    if encoding is not None:
        return _csv(spark, path, encoding)
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.every(F.is_valid_utf8("value")).alias("valid"))
    files = lines.collect()
    parts = [_csv(spark, [r.file for r in files if r.valid is valid], name) for valid, name in ((True, "utf-8-sig"), (False, "cp949")) if any(r.valid is valid for r in files)]
    if not parts:
        return _csv(spark, path, "utf-8-sig")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def require_columns(df: DataFrame, required: list[str], name: str) -> DataFrame:
    """df, or an error before any job if columns are missing."""
    if missing := sorted(set(required) - set(df.columns)):
        raise KeyError(f"{name} lacks columns: {missing}")
    return df


def available_months(df: DataFrame) -> DataFrame:
    return df.select("month").distinct().where(F.col("month").rlike(r"^\d{4}-\d{2}$"))


def in_dates(df: DataFrame, months: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A date window. Bounds also become bounds on ``month``, the partition column, so the scan can prune."""
    if months:
        df = df.where(F.col("month").isin(months))
    if start:
        df = df.where((F.col("month") >= start[:7]) & (F.col("date") >= F.lit(start).cast("date")))
    if end:
        df = df.where((F.col("month") <= end[:7]) & (F.col("date") <= F.lit(end).cast("date")))
    return df


def with_lookback(df: DataFrame, days: int, months: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The days of a window and so many days before it. months: before each of them; the earlier months are read for
    their last days only."""
    back = lambda day: day - dt.timedelta(days=days)
    if start:
        start = back(dt.date.fromisoformat(start)).isoformat()
    if not months:
        return in_dates(df, None, start, end)
    firsts = [dt.date.fromisoformat(f"{m}-01") for m in sorted(set(months))]
    read = sorted({f"{d:%Y-%m}" for first in firsts for d in (first, back(first))})
    tails = [(F.col("month") == f"{first:%Y-%m}") | F.col("date").between(F.lit(back(first)), F.lit(first - dt.timedelta(days=1))) for first in firsts]
    near = tails[0]
    for tail in tails[1:]:
        near = near | tail
    return in_dates(df, read, start, end).where(near)


def weather(df: DataFrame, months: list[str] | None = None, start: str | None = None, end: str | None = None, cells: list[str] | None = None, columns: list[str] | None = None, scale: bool = True) -> DataFrame:
    """Chosen columns of the weather fact with optional filters; tenths become units if scale."""
    df = in_dates(df, months, start, end)
    if cells:
        if len(cells) <= MOST_LISTED:
            df = df.where(F.col("grid_id").isin(cells))
        else:
            wanted = df.sparkSession.createDataFrame([(c,) for c in set(cells)], "grid_id string")
            df = df.join(wanted, "grid_id", "left_semi")
    names = columns or df.columns
    require_columns(df, names, "weather")
    return df.select(*[(F.col(c).cast("double") / 10.0).alias(c) if scale and c in SCALED_BY_TEN else F.col(c) for c in names])
