"""Where bars and lists come from and where scans go: files that Spark reads, behind one protocol."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.numbers import finite
from tickerloom.operators.lists import first_wins

PRICES = "symbol string, date date, close double"


class MarketData(Protocol):
    """What a scan needs of a market: prices, OHLC and rates of the symbols asked for, and which are missing."""

    def prices(self, symbols: DataFrame) -> tuple[DataFrame, DataFrame]: ...

    def ohlc(self, symbols: DataFrame) -> tuple[DataFrame, DataFrame]: ...

    def fx(self) -> DataFrame: ...


class Tables:
    """MarketData over tables in long form: (symbol, date, close or adj_close), (symbol, date, high, low, close), fx."""

    def __init__(self, prices: DataFrame, ohlc: DataFrame | None = None, fx: DataFrame | None = None):
        self._prices, self._ohlc, self._fx = prices, ohlc, fx

    @staticmethod
    def _of(rows: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = symbols.select("symbol").distinct()
        return rows.join(wanted, "symbol", "left_semi"), wanted.join(rows.select("symbol"), "symbol", "left_anti")

    def prices(self, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
        close = F.coalesce("adj_close", "close") if {"adj_close", "close"} <= set(self._prices.columns) else F.col("adj_close" if "adj_close" in self._prices.columns else "close")
        rows = self._prices.select("symbol", "date", finite(close).alias("close")).where("close IS NOT NULL").dropDuplicates(["symbol", "date"])
        return self._of(rows, symbols)

    def ohlc(self, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
        if self._ohlc is None:
            raise ValueError("this source has no OHLC")
        return self._of(self._ohlc.dropDuplicates(["symbol", "date"]), symbols)

    def fx(self) -> DataFrame:
        if self._fx is None:
            raise ValueError("this source has no rates")
        return self._fx


#: The lists that make up the universe of each kind of account, the first that has a symbol counting.
MODES = {"FREE": ("usa", "kor", "hkg"), "IRP": ("etf",)}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def purge(spark: SparkSession, path: str) -> None:
    """Deletes a cache; nothing happens if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_watchlist(spark: SparkSession, path: str, default: tuple[str, ...] = ()) -> DataFrame:
    """symbol of a saved list, or the default ones where there is none; that isn't saved."""
    if exists(spark, path):
        return read_list(spark, path).select("symbol")
    return spark.createDataFrame([(s,) for s in default], "symbol string")


def read_universe(spark: SparkSession, paths: dict[str, str], mode: str = "FREE") -> DataFrame:
    """symbol, name, ord of the lists of a kind of account that there are files of; paths by list."""
    found = [read_list(spark, paths[k]) for k in MODES[mode] if k in paths and exists(spark, paths[k])]
    return first_wins(*found) if found else spark.createDataFrame([], "symbol string, name string, ord int")


def update_list(symbols: DataFrame, path: str, now: str) -> None:
    """write_list, and when it was done beside it (path.updated: one line of ISO time)."""
    write_list(symbols, path)
    symbols.sparkSession.createDataFrame([(now,)], "updated string").coalesce(1).write.mode("overwrite").text(f"{path}.updated")


def is_fresh(spark: SparkSession, path: str, now: str, hours: float = 6.0) -> bool:
    """Whether the list was updated less than so many hours before now (both ISO times)."""
    if not exists(spark, f"{path}.updated"):
        return False
    age = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(F.to_timestamp("value"))) / 3600
    return bool(spark.read.text(f"{path}.updated").select((age < hours).alias("fresh")).first()["fresh"])


def write_rates(fx: DataFrame, path: str) -> None:
    """Adds rates (market, date, rate) to the cache of bars, as bars of a kind of their own."""
    write_bars(fx.select(F.col("market").alias("symbol"), "date", F.col("rate").alias("close"), F.lit("fx").alias("kind")), path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """symbol, name (NULL if the file has none), ord of a CSV with a header Symbol[,Name]; in the file's order."""
    rows = spark.read.option("header", True).csv(path)
    named = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    if "symbol" not in named:
        raise ValueError(f"{path} has no column symbol")
    name = F.trim(F.col(f"`{named['name']}`")) if "name" in named else F.lit(None).cast("string")
    return rows.select(F.trim(F.col(f"`{named['symbol']}`")).alias("symbol"), name.alias("name"), F.monotonically_increasing_id().alias("ord")).where("symbol <> ''")


def write_list(symbols: DataFrame, path: str) -> None:
    """A sorted CSV of distinct symbols."""
    symbols.select("symbol").distinct().orderBy("symbol").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Adds to or replaces in the cache the partitions (kind) that bars has; sorted by symbol, so scans skip row groups."""
    bars.repartitionByRange("kind", "symbol").sortWithinPartitions("kind", "symbol", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)


def read_bars(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("kind") == kind).drop("kind")


def save_scan(scan: DataFrame, path: str, mode: str, run_ts: str, least: float = 0.0) -> None:
    """Adds a scan's rows from least on as a partition of its own; the latest is the largest run_ts."""
    kept = scan.where(F.col("fms") >= least).withColumns({"mode": F.lit(mode), "run_ts": F.lit(run_ts)})
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "run_ts").parquet(path)


def save_scans(scans: DataFrame, path: str, least: float = 0.0) -> None:
    """Adds the rows from least on of many scans (mode, run_ts and a scan's columns), each as a partition of its own."""
    kept = scans.where(F.col("fms") >= least)
    kept.repartition("mode", "run_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "run_ts").parquet(path)


def latest_scan(spark: SparkSession, path: str, mode: str, least: float = 0.0) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("mode") == mode)
    last = rows.agg(F.max("run_ts").alias("run_ts"))
    return rows.join(F.broadcast(last), "run_ts", "left_semi").where(F.col("fms") >= least)  # one row


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path).select("mode", F.col("run_ts").cast("string").alias("run_ts"))
    return rows.groupBy("mode", "run_ts").agg(F.count("*").alias("n")).orderBy(F.desc("run_ts"), "mode")
