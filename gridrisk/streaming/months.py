"""Months as they arrive: a file stream of weather rows that keeps the month partitions of their features up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridrisk.operators.weather import LOOKBACK
from gridrisk.sources.sinks import write_months


def touched_months(batch: DataFrame) -> list[str]:
    """Months whose features a batch changes: those of its days, and the next one where a day is in its lookback. A batch
    has few months, so they may come to the driver."""
    later = F.date_format(F.date_add(F.col("date").cast("date"), LOOKBACK), "yyyy-MM")
    return sorted({m for r in batch.select("month", later.alias("next")).distinct().collect() for m in r})


def ingest_months(stream: DataFrame, build: Callable[[DataFrame, list[str]], DataFrame], raw: str, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch is kept under its number in raw, then build makes the features of the months that it touches from all
    rows so far, and these replace the months in path. So a month may come in several batches and its first days see the
    month before; a batch that is replayed replaces what it wrote."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("month").parquet(f"{raw}/batch={number}")
        # Read whole, so that partitions of batches and months are both found; the schema is the stream's.
        rows = spark.read.schema(batch.schema).parquet(raw)
        months = touched_months(spark.read.parquet(f"{raw}/batch={number}"))
        write_months(build(rows.drop("batch"), months), path, "months")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

