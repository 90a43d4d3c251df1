"""Summaries that reports are made of: counts and ranges, days, periods, amounts, medians by flag, rankings, transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions import exprs as E
from gridrisk.operators import profile

# The bins of amounts and the labels of spring months.
AMOUNT_EDGES, AMOUNT_LABELS = [0, 1, 10, 100, 1000, 1e9], ["<1", "1-10", "10-100", "100-1000", ">=1000"]
MONTH_NAMES = {2: "2월", 3: "3월", 4: "4월", 5: "5월"}


def table_ranges(weather: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows, cells, first and last date, and the number of months unless by month."""
    months = [] if "month" in by else [F.countDistinct("month").alias("month_count")]
    return weather.groupBy(*by).agg(F.count("*").alias("row_count"), F.countDistinct("grid_id").alias("grid_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date"), *months)


def daily_means(weather: DataFrame, columns: list[str]) -> DataFrame:
    return weather.groupBy("date").agg(*[F.avg(c).alias(c) for c in columns])


def with_season(daily: DataFrame) -> DataFrame:
    """daily with year, month_num and month_name; months outside the spring have no name."""
    month = F.month("date")
    return daily.withColumns({"year": F.year("date"), "month_num": month, "month_name": E.cases([(month == m, name) for m, name in MONTH_NAMES.items()], None)})


def period_counts(events: DataFrame, column: str, periods: range) -> DataFrame:
    """Events of each period of the range; null where there are none."""
    found = events.groupBy(F.col(column).cast("int").alias("period")).agg(F.count("*").alias("n"))
    every = events.sparkSession.range(periods.start, periods.stop, periods.step).select(F.col("id").cast("int").alias("period"))
    return every.join(found, "period", "left")


def scaled_amount(column: str = "amount") -> Column:
    """Amounts in units of ten thousand."""
    return F.col(column).cast("double") / 10000


def amount_stats(events: DataFrame) -> DataFrame:
    a = events.select(scaled_amount().alias("a"))
    log = F.when(F.col("a") > 0, F.log10("a"))
    above = [F.count_if(F.col("a") >= n).alias(f"from_{n}") for n in (100, 1000)]
    return a.agg(F.count("a").alias("n"), F.avg("a").alias("mean"), F.median("a").alias("median"), F.min("a").alias("min"), F.max("a").alias("max"), F.count_if(F.col("a") < 1).alias("below_1"), *above, F.avg(log).alias("log_mean"))


def amount_bins(events: DataFrame, amount: Column) -> DataFrame:
    """Events and their total by bin [edge, next edge) of amount; rows without an amount are left out."""
    a = events.select(amount.alias("a")).where("a IS NOT NULL")
    return a.groupBy(E.left_closed(F.col("a"), AMOUNT_EDGES, AMOUNT_LABELS).alias("bin")).agg(F.count("*").alias("n"), F.sum("a").alias("total"))


def flag_medians(df: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """Per variable the median with and without the flag and their difference."""
    q = profile.quantiles(profile.long_form(df, columns, [flag]), ["variable", flag], [0.5])
    out = q.groupBy("variable").agg(F.max(F.when(F.col(flag) == 1, F.col("q"))).alias("with_fire"), F.max(F.when(F.col(flag) == 0, F.col("q"))).alias("without"))
    return out.withColumn("difference", F.col("with_fire") - F.col("without"))


def rankings(sample: DataFrame, scores: list[str], label: str = "fire_label", top: int = 20) -> DataFrame:
    """Three orders of the scores: by the mean of positives, by the share of positives in the top tenth in percent, and by
    the correlation with the label, by its size; ties by name."""
    lifted = profile.lift(sample, scores, label)
    means = lifted.select(F.lit("positive_mean").alias("ranking"), "variable", F.col("positive_mean").alias("value"), F.col("positive_mean").alias("by"))
    share = 100.0 * F.col("top10_capture")
    tops = lifted.select(F.lit("top10_capture").alias("ranking"), "variable", share.alias("value"), share.alias("by"))
    r = profile.correlations(sample, scores, [label]).select(F.lit("label_correlation").alias("ranking"), F.col("x").alias("variable"), F.col("r").alias("value"), F.abs("r").alias("by"))
    every = means.unionByName(tops).unionByName(r)
    # A row per score: an array by ranking holds them all.
    best = every.groupBy("ranking").agg(F.array_sort(F.collect_list(F.struct((-F.col("by")).alias("down"), "variable", "value"))).alias("rows"))
    return best.select("ranking", F.posexplode(F.slice("rows", 1, top)).alias("place", "row")).select("ranking", (F.col("place") + 1).alias("place"), "row.variable", "row.value")


def hashed_sample(df: DataFrame, parts: list[Column], seed: int, rows: int, ties: list[str]) -> DataFrame:
    """The rows with the least portable hash of parts and the seed."""
    return df.withColumn("bucket", E.hash_bucket(parts, seed)).orderBy("bucket", *ties).limit(rows)


def monthly_ranges(indices: DataFrame, scores: list[str]) -> DataFrame:
    return indices.groupBy("month").agg(F.count("*").alias("row_count"), *[f(c).alias(f"{n}_{c}") for c in scores for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))])


def hourly_to_daily(hours: DataFrame, time: str, value: str, degrees: Column, sentinels: tuple[float, ...] = (-9990.0, -9999.0)) -> DataFrame:
    """Per day mean and maximum of value, sentinels being null, and the mean sine and cosine of a direction."""
    v = F.col(value).cast("double")
    for s in sentinels:
        v = F.nullif(v, F.lit(s))
    e = hours.select(F.to_date(time).alias("date"), v.alias("v"), F.radians(degrees).alias("a"))
    return e.groupBy("date").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.avg(F.sin("a")).alias("sin_mean"), F.avg(F.cos("a")).alias("cos_mean"), F.count("*").alias("n"))


def transformed(master: DataFrame, distance: str = "nearest_road_dist", cap: float = 50.0, code: str = "forest_type_code", codes: range = range(5)) -> DataFrame:
    """master with logarithm, cap and robust scale (median and quartiles of all rows) of a distance, and a 0/1 column for
    each code, a missing one being 0."""
    rows = master.select(F.lit(distance).alias("variable"), F.col(distance).cast("double").alias("value"))
    q = profile.quantiles(rows, ["variable"], [0.25, 0.5, 0.75]).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    plain = F.greatest(F.col(distance), F.lit(0.0))
    robust = (F.col(distance) - F.col("q50")) / F.nullif(F.col("q75") - F.col("q25"), F.lit(0.0))
    dummies = {f"type_{k}": (F.coalesce(F.col(code), F.lit(0)) == k).cast("int") for k in codes}
    df = master.crossJoin(F.broadcast(q))  # one row
    return df.withColumns({"road_log": F.log1p(plain), "road_capped": F.least(plain, F.lit(cap)), "road_robust": robust, **dummies}).drop("q25", "q50", "q75")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weights that give each class the same sum."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    both = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(both)).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))  # one row


def city_risk(indices: DataFrame, cells: DataFrame) -> DataFrame:
    """Per city the mean and greatest index. cells: grid_id (once), city."""
    return indices.join(cells, "grid_id").groupBy("city").agg(F.count("*").alias("n"), F.avg("ffdri").alias("avg_ffdri"), F.max("ffdri").alias("max_ffdri"), F.avg("pffdri").alias("avg_pffdri"))
