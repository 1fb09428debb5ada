"""Bars as they arrive: late and repeated ones are dropped by a watermark, the rest is written by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELAY = "7 days"


def daily_bars(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """symbol, date, open, high, low, close, n of streamed rows (symbol, ts, price), once a day is past the watermark."""
    day = F.window("ts", "1 day")
    bars = ticks.withWatermark("ts", delay).groupBy(day.alias("day"), "symbol").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("n")
    )
    return bars.select("symbol", F.to_date("day.start").alias("date"), "open", "high", "low", "close", "n")


def distinct_ticks(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def write_bars(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch replaces the partitions (date) that it has, so a batch that runs again changes nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return bars.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
