"""Panels from the test tables: suppliers as symbols, nations' regions as markets. And the SQL of the same panels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes: under spark.checkpoint.dir, or a temporary one where Spark is one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"{shared or tempfile.mkdtemp(prefix='tickerloom-')}/{name}-{uuid.uuid4().hex}"


def money(name: str) -> Column:
    """The sum of a column as decimal(18,2), as a double. Values that are plainly nearest to one hundredth are added as whole numbers of
    them, which is as exact and much less work; decimals are made only of ties, of very large values and of what isn't a number."""
    x = F.col(name)
    cents = F.rint(x * 100)
    plain = (F.abs(x * 100 - cents) < 0.25) & (F.abs(cents) < 1e12)
    whole, rest = F.sum(F.when(plain, cents.cast("long"))), F.sum(F.when(~plain, x.cast("decimal(18,2)")))
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    both = (F.coalesce(rest, F.lit(0)) + F.coalesce(whole, F.lit(0)).cast("decimal(20,0)") * hundredth).cast("double")
    return F.when(rest.isNull() & (F.abs(whole) < 2**53), whole / F.lit(100.0)).when(rest.isNotNull() | whole.isNotNull(), both)


#: Rows of a partition of prices.
PART_ROWS = 500_000


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_id, symbol, date, close: a supplier's mean price a day. Rows are dealt by symbol once, to as many partitions as their
    number asks for, so that what follows by symbol (days, windows, features) needs no further shuffle, and a task's share
    doesn't grow with the table."""
    items = table(spark, sf_dir, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, -(-items.count() // PART_ROWS))  # a count of Parquet rows reads no column
    dealt = items.select(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity").repartition(parts, "symbol")
    daily = dealt.groupBy("symbol", "date").agg(F.try_divide(money("l_extendedprice"), money("l_quantity")).alias("close"))
    return daily.select(F.lit("all").alias("panel_id"), "symbol", "date", "close")


def ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, high, low, close: a mean of 60 days with 1 % around it, in cents."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-60, 0)
    smooth = prices(spark, sf_dir).select("symbol", "date", F.round(F.avg("close").over(w), 2).alias("close"))
    return smooth.select("symbol", "date", F.round(F.col("close") * 1.01, 2).alias("high"), F.round(F.col("close") * 0.99, 2).alias("low"), "close")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, market: a supplier's region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("r_name").alias("market"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, date, rate: a region's mean order, in millions, a day; AFRICA has none."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).where("r_name <> 'AFRICA'")
    days = joined.groupBy(F.col("r_name").alias("market"), F.to_date("o_orderdate").alias("date"))
    return days.agg((money("o_totalprice") / F.count("*") / 1e6).alias("rate"))


def rounded(df: DataFrame, digits: int = 6, finer: tuple[str, ...] = ("slope", "accel", "curv", "recovery_3d", "quality", "21d_trend", "post_spike", "mid_dip")) -> DataFrame:
    """Doubles rounded; those of small size to two digits more; -0 as 0; dates as text."""
    value = lambda f: F.round(F.col(f.name), digits + 2 * any(x in f.name for x in finer)) + F.lit(0.0)
    text = lambda f: F.col(f.name).cast("string") if isinstance(f.dataType, T.DateType) else F.col(f.name)
    return df.select(*[(value(f) if isinstance(f.dataType, T.DoubleType) else text(f)).alias(f.name) for f in df.schema])


def with_dates(sql: str, *dates: str) -> str:
    """sql with these columns as text."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates)}) FROM ({sql})"


PRICES = """prices AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close
  FROM lineitem GROUP BY 1, 2)"""

OHLC = f"""{PRICES}, smooth AS (
  SELECT symbol, date, round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 60 PRECEDING), 2) AS close FROM prices),
ohlc AS (SELECT symbol, date, round(close * 1.01::DOUBLE, 2) AS high, round(close * 0.99::DOUBLE, 2) AS low, close FROM smooth)"""

MARKETS = """markets AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol, r_name AS market FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

RATES = """rates AS (
  SELECT r_name AS market, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000000::DOUBLE AS rate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> 'AFRICA' GROUP BY 1, 2)"""


def aligned(source: str = "prices", coverage: float = 0.9, name: str = "aligned") -> str:
    """SQL of the grid: filled forward, clipped to the symbol's span, coverage at least so much."""
    return f"""{name}_span AS (SELECT min(date) AS lo, max(date) AS hi FROM {source}),
{name}_last AS (SELECT symbol, max(date) FILTER (close IS NOT NULL) AS last_valid FROM {source} GROUP BY 1),
{name}_days AS (SELECT d FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM {name}_span) WHERE isodow(d) < 6),
{name}_fill AS (
  SELECT l.symbol, d AS date, CASE WHEN d <= last_valid THEN last_value(close IGNORE NULLS) OVER (PARTITION BY l.symbol ORDER BY d ROWS UNBOUNDED PRECEDING) END AS close
  FROM {name}_last l CROSS JOIN {name}_days LEFT JOIN {source} s ON s.symbol = l.symbol AND s.date = d),
{name} AS (
  SELECT symbol, date, close FROM (SELECT *, count(close) OVER (PARTITION BY symbol) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM {name}_fill) WHERE k >= {coverage} * n)"""


#: b: valid bars, rn from the end; v: the visible ones with logs and log returns.
BARS = f"""{PRICES}, {aligned()},
b AS (SELECT symbol, date, close AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM aligned WHERE close > 0),
v0 AS (SELECT *, ln(p) AS lp FROM b WHERE rn <= 63),
v AS (SELECT *, lp - lag(lp) OVER w AS r, lp - lag(lp, 3) OVER w AS rise, max(p) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM v0 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
e AS (
  SELECT x.symbol, x.rn, any_value(x.p) AS p,
         sum(y.p * CASE WHEN y.rn = 63 THEN pow(19/21::DOUBLE, 63 - x.rn) ELSE 2/21::DOUBLE * pow(19/21::DOUBLE, y.rn - x.rn) END) AS e20,
         sum(y.p * CASE WHEN y.rn = 63 THEN pow(49/51::DOUBLE, 63 - x.rn) ELSE 2/51::DOUBLE * pow(49/51::DOUBLE, y.rn - x.rn) END) AS e50
  FROM v x JOIN v y ON x.symbol = y.symbol AND y.rn >= x.rn GROUP BY 1, 2)"""
