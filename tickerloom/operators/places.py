"""Positions in a total order, and running sums along it, without a window over all rows.

Rows are dealt to range partitions of about PART_ROWS rows, which Spark cuts by a sample of the order; each partition numbers its own
rows, and gets the sum of those before it from a table with one row for each partition. A table that fits one partition
isn't sampled. The order must tell all rows apart (end it with a key), or rows that tie come in any order.
"""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir and read from there from now on, so that what is told by partition stays true."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():  # tests; on a cluster spark.checkpoint.dir names it
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickerloom-"))
    return df.checkpoint()


def running(df: DataFrame, order: list[Column], name: str, value: Column | None = None, part_rows: int = PART_ROWS, rows: int | None = None) -> DataFrame:
    """df and name: the sum of value (by default 1, so the position from 1 on) of all rows up to this one in the order. rows:
    how many there are at most, where that is known."""
    value = F.lit(1).cast("long") if value is None else value
    parts = max(1, math.ceil((df.count() if rows is None else rows) / part_rows))
    if parts == 1:
        ranged = df.withColumn("_part", F.lit(0))
    else:
        ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn(name, F.sum(value).over(own))
    if parts == 1:
        return placed.drop("_part")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def placed(df: DataFrame, order: list[Column], name: str, part_rows: int = PART_ROWS, rows: int | None = None) -> DataFrame:
    """df and name, the position from 1 on."""
    return running(df, order, name, None, part_rows, rows)


def tiled(df: DataFrame, n: int, order: list[Column], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """df and name, the tile from 1 to n: runs of the order of equal lengths, the first ones longer by a row if need be."""
    found = placed(df, order, "_place", part_rows)
    rows = found.crossJoin(F.broadcast(df.agg(F.count("*").alias("_rows"))))  # one row
    size, longer = F.floor(F.col("_rows") / n), F.col("_rows") % n
    first = longer * (size + 1)
    place = F.col("_place") - 1
    tile = F.when(place < first, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - first) / F.greatest(size, F.lit(1))))
    return rows.withColumn(name, (tile + 1).cast("int")).drop("_place", "_rows")
