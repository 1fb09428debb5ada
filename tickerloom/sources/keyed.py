"""Tables kept up to date by symbol: of a large cache, an update rewrites only the hash buckets of the symbols that it brings.

A table is Parquet, partitioned by bucket, with a column for each reader's needs; a symbol's rows lie in one bucket, sorted, so a
read of some symbols opens their buckets alone. An update reads the buckets that it touches, replaces the symbols that it
brings, and overwrites these partitions; the files of the others stay. Bars and names are such tables, read through: what
is missing, too short or too old is taken from a source and written back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.cache import classify
from tickerloom.operators.places import cut
from tickerloom.sources.market import exists

BUCKETS = 256
#: Columns of bars; adjusted closes have no high and low.
BARS = "symbol string, date date, close double, high double, low double"
MANIFEST = "symbol string, period string, n_bars long, last_date date, saved_at timestamp"
NAMES = "symbol string, name string, saved_at timestamp"


class KeyedTable:
    """Rows of a schema by symbol in path. The number of buckets is the table's for good."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _all(self) -> DataFrame:
        schema = f"{self.schema}, bucket int"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def rows(self, symbols: DataFrame | None = None) -> DataFrame:
        """All rows, or those of symbols (one column, symbol), of whose buckets alone files are opened."""
        found = self._all()
        if symbols is not None:
            wanted = symbols.select("symbol").distinct().select("symbol", self._bucket())
            found = found.join(wanted, ["bucket", "symbol"], "left_semi")
        return found.drop("bucket")

    def upsert(self, rows: DataFrame) -> None:
        """Puts rows in the place of all that the table has of their symbols. Rows without a symbol are left out; repeated rows
        stay; no rows change nothing."""
        new = cut(rows.select(*[f.split()[0] for f in self.schema.split(", ")]).where("symbol IS NOT NULL").select("*", self._bucket()))
        touched = new.select("bucket").distinct()
        old = self._all().join(F.broadcast(touched), "bucket", "left_semi").join(new.select("symbol").distinct(), "symbol", "left_anti")  # a row for each bucket
        merged = cut(old.select(*new.columns).unionByName(new))  # before its files are replaced
        if merged.isEmpty():
            return
        placed = merged.repartition("bucket").sortWithinPartitions("bucket", "symbol", *(["date"] if "date" in new.columns else []))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


class BarCache:
    """Bars by kind (adj_close, ohlc), and for each symbol the period that they were asked for, their number and last day."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self._tables = {kind: (KeyedTable(spark, f"{path}/{kind}", BARS, buckets), KeyedTable(spark, f"{path}/{kind}-manifest", MANIFEST, buckets)) for kind in ("adj_close", "ohlc")}

    def bars(self, kind: str, symbols: DataFrame | None = None) -> DataFrame:
        found = self._tables[kind][0].rows(symbols)
        return found.drop("high", "low") if kind == "adj_close" else found

    def manifest(self, kind: str, symbols: DataFrame | None = None) -> DataFrame:
        return self._tables[kind][1].rows(symbols)

    def save(self, kind: str, bars: DataFrame, period: str | Column, now: str) -> None:
        """Replaces the bars of the symbols in bars, all of them read with period (or a column of bars). Days are kept once."""
        more = [F.lit(None).cast("double").alias(c) for c in ("high", "low") if c not in bars.columns]
        known = F.col("close").isNotNull() if kind == "adj_close" else F.coalesce("high", "low", "close").isNotNull()
        rows = cut(bars.select("*", *more, (F.lit(period) if isinstance(period, str) else period).alias("_period")).where(known).dropDuplicates(["symbol", "date"]))
        table, manifest = self._tables[kind]
        table.upsert(rows)
        facts = rows.groupBy("symbol").agg(F.max("_period").alias("period"), F.count("*").alias("n_bars"), F.max("date").alias("last_date"))
        manifest.upsert(facts.withColumn("saved_at", F.to_timestamp(F.lit(now))))

    def refresh(self, kind: str, wanted: DataFrame, probe: DataFrame, source: Callable[[DataFrame], DataFrame], period: str, now: str) -> tuple[DataFrame, DataFrame]:
        """(bars of the wanted symbols, symbol and outcome as classify() tells it). source(symbols) gives bars; it is asked for the
        symbols alone that aren't hits, and what it gives is written back. A symbol that it hasn't keeps its old bars."""
        wanted = wanted.select("symbol").distinct()
        outcomes = cut(classify(wanted, self.manifest(kind, wanted).select("symbol", "period", "n_bars", "last_date"), probe, period))
        missing = outcomes.where(~F.col("outcome").isin("hit", "stale_hit")).select("symbol")
        if not missing.isEmpty():
            self.save(kind, source(missing).join(missing, "symbol", "left_semi"), period, now)
        return self.bars(kind, wanted), outcomes


class NameCache:
    """Names by symbol with the time that they were found at; they expire after ttl_days."""

    def __init__(self, spark: SparkSession, path: str, ttl_days: float = 30.0, buckets: int = 16):
        self._table, self.ttl_days = KeyedTable(spark, path, NAMES, buckets), ttl_days

    def names(self, now: str, symbols: DataFrame | None = None) -> DataFrame:
        """symbol, name of what hasn't expired at now."""
        age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("saved_at")
        return self._table.rows(symbols).where(age < self.ttl_days * 86_400).select("symbol", "name")

    def save(self, names: DataFrame, now: str) -> None:
        """Adds or replaces names; blank ones and null symbols are left out, of several of a symbol the first by name stays."""
        clean = names.select("symbol", F.trim("name").alias("name")).where("symbol IS NOT NULL AND name <> ''")
        self._table.upsert(clean.groupBy("symbol").agg(F.min("name").alias("name")).withColumn("saved_at", F.to_timestamp(F.lit(now))))

    def read_through(self, symbols: DataFrame, source: Callable[[DataFrame], DataFrame], now: str) -> DataFrame:
        """symbol, name of the symbols: from the cache, else from source(symbols), which is then saved; else the symbol itself."""
        wanted = symbols.select("symbol").distinct()
        missing = cut(wanted.join(self.names(now, wanted), "symbol", "left_anti"))
        if not missing.isEmpty():
            self.save(source(missing).join(missing, "symbol", "left_semi"), now)
        return wanted.join(self.names(now, wanted), "symbol", "left").select("symbol", F.coalesce("name", "symbol").alias("name"))
