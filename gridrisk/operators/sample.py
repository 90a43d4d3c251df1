"""Labelled samples: positives by join, negatives by anti join and a portable hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.exprs import hash_bucket

KEY = ["date", "grid_id"]


def positives(final: DataFrame, target: DataFrame) -> DataFrame:
    return final.join(target, KEY)


def threshold(n_final: int, n_positive: int, ratio: int = 10, most: int = 200_000) -> int:
    """Of a million hash buckets, how many make about min(most, ratio * positives) rows."""
    limit = min(most, n_positive * ratio)
    return 0 if limit <= 0 or not n_final else max(1, int(limit / n_final * 1_000_000))


def negatives(final: DataFrame, target: DataFrame, cut: int, seed: int = 42) -> DataFrame:
    bucket: Column = hash_bucket([F.col("grid_id"), F.col("date").cast("string")], seed)
    return final.where(bucket < cut).join(target.select(*KEY), KEY, "left_anti")


def labelled(final: DataFrame, target: DataFrame, ratio: int = 10, most: int = 200_000, seed: int = 42, keys: DataFrame | None = None) -> DataFrame:
    """Positives and sampled negatives; target columns of the negatives are null but for label and count. One pass over
    the keys counts both kinds, one over final joins the target and keeps what is positive or drawn. keys: a table with
    the keys of final's rows that is cheaper to make than final; it must have a key as often as final has it, so where
    static rows of a cell fan out in final, the raw fact would give a greater share of negatives. Only rows of cells with
    events and drawn rows are sent to the join with the target."""
    final = final.drop(*[c for c in target.columns if c not in KEY])
    hit, near = "__hit", "__near"
    marked = target.withColumn(hit, F.lit(True))
    # A row per cell that has events, at most the cells of the grid: other rows have no target and need not be joined.
    cells = F.broadcast(target.select("grid_id").distinct().withColumn(near, F.lit(True)))
    counted = (final if keys is None else keys).select(*KEY).join(cells, "grid_id", "left")
    counted = counted.groupBy(*[F.when(F.col(near), F.col(k)).alias(k) for k in KEY]).agg(F.count("*").alias("n"))
    counted = counted.join(target.groupBy(*KEY).agg(F.count("*").alias("hits")), KEY, "left")
    # A row with several targets is counted for each of them: it is a positive as often.
    n, yes = counted.agg(F.sum(F.col("n") * F.coalesce("hits", F.lit(1))), F.coalesce(F.sum(F.col("n") * F.col("hits")), F.lit(0))).first()
    if not n:
        raise ValueError("no rows of the final dataset in this window")
    drawn = hash_bucket([F.col("grid_id"), F.col("date").cast("string")], seed) < threshold(n, yes, ratio, most)
    out = final.join(cells, "grid_id", "left").where(F.col(near) | drawn).drop(near)
    out = out.join(marked, KEY, "left").where(F.col(hit) | drawn).drop(hit)
    return out.withColumns({"fire_label": F.coalesce("fire_label", F.lit(0)), "fire_count": F.coalesce("fire_count", F.lit(0).cast("long"))})


def kept(rows: DataFrame) -> DataFrame:
    """rows, made now and once, for those who read them more than once: stored in the session's checkpoint folder, or else
    by the executors. A sample is small beside the fact that it is drawn from."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def label_counts(sample: DataFrame, by_month: bool = False) -> DataFrame:
    keys = ["month", "fire_label"] if by_month else ["fire_label"]
    more = [] if by_month else [F.countDistinct("date").alias("date_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date")]
    return sample.groupBy(*keys).agg(F.count("*").alias("row_count"), F.countDistinct("grid_id").alias("grid_count"), *more, F.avg("pffdri").alias("avg_pffdri"), F.avg("ffdri").alias("avg_ffdri"))
