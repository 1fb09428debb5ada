"""What charts are drawn from: rebased prices, drawdowns, averages, return against volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = {"1M": 21, "3M": 63, "6M": 126, "1Y": 252, "2Y": 504}


def rebased(panel: DataFrame, period: str = "6M") -> DataFrame:
    """symbol, date, rebased (100 at the period's first bar), drawdown, sma5, ema20 weights aside; valid bars only."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    some = panel.where("close > 0").withColumn("rn", back).where(F.col("rn") <= PERIODS.get(period, 126))
    w = Window.partitionBy("symbol").orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    five = w.rowsBetween(-4, 0)
    return some.select(
        "symbol",
        "date",
        (F.col("close") / F.first("close").over(so_far) * 100).alias("rebased"),
        (F.col("close") / F.max("close").over(so_far) - 1).alias("drawdown"),
        F.when(F.count("close").over(five) == 5, F.avg("close").over(five)).alias("sma5"),
    )


def axis_ranges(chart: DataFrame) -> DataFrame:
    """The ranges that all symbols share: log10 of rebased prices, and drawdown with a margin of 5 %."""
    low, high = F.min("drawdown"), F.max("drawdown")
    return chart.agg(F.log10(F.min("rebased")).alias("log_lo"), F.log10(F.max("rebased")).alias("log_hi"), (low - (high - low) * 0.05).alias("dd_lo"), (high + (high - low) * 0.05).alias("dd_hi"))


def scatter(panel: DataFrame, window: int = 63, dates: int = 1) -> DataFrame:
    """symbol, date, vol (annualised, from max(5, window / 3) returns on), y (100 * growth a year + 100, 0.1 at least) for
    each symbol's last dates."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = panel.where("close > 0").select("symbol", "date", "close", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), F.lag("close", window).over(w).alias("base"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))).alias("rn"))
    frame = w.rowsBetween(-(window - 1), 0)
    vol = F.when(F.count("r").over(frame) >= max(5, window // 3), F.stddev_samp("r").over(frame) * 252**0.5)
    grown: Column = F.pow(F.col("close") / F.col("base"), 252 / window) - 1
    return rows.select("symbol", "date", "rn", vol.alias("vol"), F.when(grown.isNotNull(), F.greatest(grown * 100 + 100, F.lit(0.1))).alias("y")).where(F.col("rn") <= dates)


def motion(panel: DataFrame, days: int = 10, tail: int = 5, window: int = 63) -> DataFrame:
    """symbol, date, x (vol in %), y of each symbol's last days + 1 frames, and tail: the known points (x, y) of the frame and of the
    tail rows before it, oldest first. A frame's tail is a range of rows of the same points, so none is worked out twice."""
    points = scatter(panel, window, days + tail + 1).select("symbol", "date", "rn", (F.col("vol") * 100).alias("x"), "y")
    frame = Window.partitionBy("symbol").orderBy("date").rowsBetween(-tail, 0)
    known = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y"))
    return points.withColumn("tail", F.collect_list(known).over(frame)).where(F.col("rn") <= days + 1).drop("rn")


def tail_segments(panel: DataFrame, tail: int = 5, window: int = 63) -> DataFrame:
    """symbol, k (rows back from today), from_x, from_y, x, y, opacity (0.15 for the oldest to 0.5) of each piece between neighbouring
    points that are both known, of the last tail + 1 rows. No tail: no rows."""
    points = scatter(panel, window, tail + 1).select("symbol", "date", (F.col("rn") - 1).alias("k"), (F.col("vol") * 100).alias("x"), "y")
    before = Window.partitionBy("symbol").orderBy("date")
    both = points.select("*", F.lag("x").over(before).alias("from_x"), F.lag("y").over(before).alias("from_y")).dropna()
    opacity = F.greatest(F.lit(0.15), F.least(F.lit(0.5), (tail - F.col("k") + 1) / (tail + 1)))
    return both.select("symbol", "k", "from_x", "from_y", "x", "y", opacity.alias("opacity"))


def badges(found: DataFrame) -> DataFrame:
    """symbol, badges: names of what is positive."""
    mark = lambda c: F.when(F.col(c) > 0, c)
    return found.select("symbol", F.array_join(F.array_compact(F.array(*[mark(c) for c in ("r_1m", "above_ema50", "r_3m", "d1", "d5") if c in found.columns])), ",").alias("badges"))
