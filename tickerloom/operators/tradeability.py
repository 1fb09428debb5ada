"""The true-range filter: symbols whose days are too wild to trade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A day is extreme over this true range; so many severe falls in so many days are too many.
WINDOW, EXTREME, FALL_WINDOW, FALL, FALLS = 63, 0.30, 20, -0.07, 4
#: The status of a symbol with fewer closes than WINDOW, or none.
TOO_FEW = "too few closes"


def ranges(ohlc: DataFrame) -> DataFrame:
    """symbol, date, rn (1: the last), true_range, drop_low: of days with all of high, low, close and the close before. And what they
    are made of: close, last_close, last_date, high and low as they count, raw_high, raw_low, mended.

    A day without range (high and low 0) takes the day before's high and low if these and its close are positive."""
    w = Window.partitionBy("symbol").orderBy("date")
    before = ohlc.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("close", "high", "low", "date")})
    glitch = (F.col("high") == 0) & (F.col("low") == 0) & (F.col("last_close") > 0) & (F.col("last_high") > 0) & (F.col("last_low") > 0)
    high, low = (F.when(glitch, F.col(f"last_{c}")).otherwise(F.col(c)) for c in ("high", "low"))
    whole = high.isNotNull() & low.isNotNull() & (F.col("last_close") > 0)
    widest = F.greatest(high - low, F.abs(high - F.col("last_close")), F.abs(low - F.col("last_close")))
    return before.where("close IS NOT NULL").select(
        "symbol",
        "date",
        F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))).alias("rn"),
        F.when(whole, widest / F.when(whole, F.col("last_close"))).alias("true_range"),
        F.when(whole, low / F.when(whole, F.col("last_close")) - 1).alias("drop_low"),
        "close",
        "last_close",
        "last_date",
        high.alias("high"),
        low.alias("low"),
        F.col("high").alias("raw_high"),
        F.col("low").alias("raw_low"),
        F.coalesce(glitch, F.lit(False)).alias("mended"),
    )


def tradeability(ohlc: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """symbol, n_closes, extreme_days, severe_days, disqualified, filter_status. Symbols without OHLC are disqualified."""
    counts = (
        ranges(ohlc)
        .groupBy("symbol")
        .agg(
            F.count("*").alias("n_closes"),
            F.count_if((F.col("rn") <= WINDOW) & (F.col("true_range") > EXTREME)).alias("extreme_days"),
            F.count_if((F.col("rn") <= FALL_WINDOW) & (F.col("drop_low") < FALL)).alias("severe_days"),
        )
    )
    if symbols is not None:
        counts = symbols.select("symbol").distinct().join(counts, "symbol", "left").na.fill(0, ["n_closes", "extreme_days", "severe_days"])
    short, wild, falling = F.col("n_closes") < WINDOW, F.col("extreme_days") > 0, F.col("severe_days") >= FALLS
    why = F.when(short, F.lit(TOO_FEW)).otherwise(
        F.concat_ws("; ", F.when(wild, F.concat(F.lit("extreme range days: "), "extreme_days")), F.when(falling, F.concat(F.lit("severe falls: "), "severe_days")))
    )
    return counts.withColumn("disqualified", short | wild | falling).withColumn("filter_status", F.when(F.col("disqualified"), why).otherwise("normal"))


def filter_details(ohlc: DataFrame) -> DataFrame:
    """symbol, last_date, last_true_range, extreme (array of date, true_range), severe (array of date, drop_low)."""
    days = lambda keep, value: F.array_sort(F.collect_list(F.when(keep, F.struct("date", value))))
    return (
        ranges(ohlc)
        .where(F.col("rn") <= WINDOW)
        .groupBy("symbol")
        .agg(
            F.max("date").alias("last_date"),
            F.max_by("true_range", "date").alias("last_true_range"),
            days(F.col("true_range") > EXTREME, "true_range").alias("extreme"),
            days((F.col("rn") <= FALL_WINDOW) & (F.col("drop_low") < FALL), "drop_low").alias("severe"),
        )
    )


def filter_components(ohlc: DataFrame) -> DataFrame:
    """Why a symbol passes or not, one row each: n_closes, and of its last day last_date, prev_date, last_close, prev_close, high and low
    as they count and as they came, mended, high_minus_low, high_gap and low_gap (to the close before), true_range (the widest of
    these), true_range_pct; extreme and severe: arrays of date, pct, close, prev_close, low of the days that count against it,
    severe ones only where they are too many. All but the first two are NULL where there are fewer than WINDOW closes."""
    days = ranges(ohlc)
    of = lambda pct: F.struct("date", F.round(pct * 100, 2).alias("pct"), "close", F.col("last_close").alias("prev_close"), F.col("raw_low").alias("low"))
    listed = lambda keep, pct: F.array_sort(F.collect_list(F.when(keep, of(pct))))  # noqa: E731  WINDOW days at most
    last = lambda c: F.max(F.when(F.col("rn") == 1, c))
    found = days.groupBy("symbol").agg(
        F.count("*").alias("n_closes"),
        F.max("date").alias("last_date"),
        last(F.struct(F.col("last_date").alias("prev_date"), F.col("close").alias("last_close"), F.col("last_close").alias("prev_close"), "high", "low", "raw_high", "raw_low", "mended", "true_range")).alias("d"),
        listed((F.col("rn") <= WINDOW) & (F.col("true_range") > EXTREME), F.col("true_range")).alias("extreme"),
        listed((F.col("rn") <= FALL_WINDOW) & (F.col("drop_low") < FALL), F.col("drop_low")).alias("severe"),
    )
    long, d = F.col("n_closes") >= WINDOW, lambda c: F.col(f"d.{c}")
    gaps = {"high_minus_low": d("high") - d("low"), "high_gap": F.abs(d("high") - d("prev_close")), "low_gap": F.abs(d("low") - d("prev_close"))}
    values = {c: d(c) for c in ("prev_date", "last_close", "prev_close", "high", "low", "raw_high", "raw_low", "mended")} | gaps
    values |= {"true_range": d("true_range") * d("prev_close"), "true_range_pct": d("true_range") * 100, "extreme": F.col("extreme"), "severe": F.when(F.size("severe") >= FALLS, F.col("severe"))}
    return found.select("symbol", "n_closes", "last_date", *[F.when(long, c).alias(name) for name, c in values.items()])
