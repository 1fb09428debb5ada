"""The price panel in long form: calendar grid, forward fill, native as-of clip, coverage, currencies.

Rows are (panel_id, symbol, date, close). The grid of a panel is every weekday between its first and last date, so it
depends on which symbols share the panel; symbol is the only key that bars are shuffled by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numbers import finite

KEY = ("panel_id", "symbol")
#: Shares of the grid that a symbol must have: for scans in batches, and for a panel shown to a user.
BATCH_COVERAGE, VIEW_COVERAGE = 0.9, 0.5


def weekday(date: str | Column) -> Column:
    return ~F.dayofweek(date).isin(1, 7)


def clean(prices: DataFrame) -> DataFrame:
    """One row per symbol and date, NaN and infinities as NULL."""
    return prices.withColumn("close", finite(F.col("close"))).dropDuplicates([*KEY, "date"])


def weekdays_to(day: Column) -> Column:
    """A running number of weekdays: how many there are from a Monday in 1970 to day."""
    k = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)) + 1, F.lit(5))


def align(prices: DataFrame, coverage: float = BATCH_COVERAGE) -> DataFrame:
    """panel_id, symbol, date, close on the grid: filled forward, nothing after a symbol's own last price, and symbols
    with a lower share of filled days left out. Weekend prices fall out before the fill.

    A price stands for all days up to the next one, so each row is spread over the days it stands for: one pass over a
    symbol's rows in order, without a join to the grid. Coverage follows from the first and last price."""
    spans = prices.groupBy("panel_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    rows = _uses(prices, True).where("use OR place = 1").join(F.broadcast(spans), "panel_id")  # a row for each panel
    n_days = weekdays_to(F.col("hi")) - weekdays_to(F.date_sub("lo", 1))
    n_bars = F.coalesce(weekdays_to(F.col("last")) - weekdays_to(F.col("first")) + 1, F.lit(0))
    return _spread(rows.where(n_bars >= F.lit(coverage) * n_days), F.col("last"))


def _uses(prices: DataFrame, whole: bool) -> DataFrame:
    """prices and use (a price of a weekday), place among a symbol's (those that count first), next (the date of the next one that
    counts); whole: the symbol's last price and first that counts."""
    use = F.col("close").isNotNull() & weekday("date")
    every, order = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy(F.desc("use"), "date")
    ends = [F.max(F.when(F.col("close").isNotNull(), F.col("date"))).over(every).alias("last"), F.min(F.when(F.col("use"), F.col("date"))).over(every).alias("first")]
    return prices.select(*KEY, "date", "close", use.alias("use")).select(
        "*", F.row_number().over(order).alias("place"), F.when(F.lead("use").over(order), F.lead("date").over(order)).alias("next"), *(ends if whole else [])
    )


def _spread(rows: DataFrame, until: Column) -> DataFrame:
    """A row for each weekday that a row stands for, the first row also for those before it (NULL); nothing after until."""
    # plain numbers of days, so that the spread is one compiled loop
    day = lambda c: F.unix_date(F.col(c))
    lo, hi = F.when(F.col("place") == 1, day("lo")).otherwise(day("date")), F.when(F.col("use"), F.coalesce(day("next") - 1, day("hi"))).otherwise(day("hi"))
    spread = rows.select("*", lo.alias("_lo"), hi.alias("_hi"), until.alias("_until")).where("_lo <= _hi").select("*", F.explode(F.sequence("_lo", "_hi")).alias("_day"))
    dated = spread.select(*KEY, F.date_from_unix_date("_day").alias("_date"), "use", F.col("date").alias("_from"), "_until", "close").where(weekday("_date"))
    held = F.col("use") & (F.col("_date") >= F.col("_from")) & (F.col("_date") <= F.col("_until"))
    return dated.select(*KEY, F.col("_date").alias("date"), F.when(held, F.col("close")).alias("close"))


def coverage_of(prices: DataFrame) -> DataFrame:
    """panel_id, symbol, n_days, n_bars, coverage, last_date, last_close on the grid."""
    return align(prices, 0.0).groupBy(*KEY).agg(
        F.count("*").alias("n_days"),
        F.count("close").alias("n_bars"),
        (F.count("close") / F.count("*")).alias("coverage"),
        F.max(F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_date"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_close"),
    )


def align_market(prices: DataFrame) -> DataFrame:
    """The grid of each market by itself (market is part of panel_id then), filled to its end, no clip, all symbols."""
    spans = prices.groupBy("panel_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    rows = _uses(prices, False).where("use OR place = 1").join(F.broadcast(spans), "panel_id")  # a row for each panel
    return _spread(rows, F.col("hi"))


def fx_crosses(fx: DataFrame) -> DataFrame:
    """market, date, rate from columns date, usdkrw, usdjpy, usdhkd: rates in KRW, each on its weekdays, filled forward."""
    by = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    filled = fx.where(weekday("date")).select("date", *[F.last(c, ignorenulls=True).over(by).alias(c) for c in ("usdkrw", "usdjpy", "usdhkd")])
    rates = F.explode(F.array(*[F.struct(F.lit(m).alias("market"), r.alias("rate")) for m, r in (("USA", F.col("usdkrw")), ("JPN", F.try_divide("usdkrw", "usdjpy")), ("HKG", F.try_divide("usdkrw", "usdhkd")))]))
    return filled.select("date", rates.alias("r")).select("r.market", "date", "r.rate").where("rate IS NOT NULL")


def convert(prices: DataFrame, fx: DataFrame, drop_missing: bool = True, base: str = "KOR", along: str = "market") -> DataFrame:
    """prices (with market) in the base currency. A rate counts on price dates only, those of its own market or (along
    panel_id) of the whole panel, and is filled forward along them; prices before its first are NULL. A market without
    any rate is dropped, or left as it is."""
    keys = ["market"] if along == "market" else [along, "market"]
    days = prices.select(along, "date").distinct()
    if along != "market":
        days = days.join(F.broadcast(prices.select(*keys).distinct()), along)  # a row a panel and market
    by = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rated = days.join(fx.select("market", "date", "rate"), ["market", "date"], "left").select(*keys, "date", F.last("rate", ignorenulls=True).over(by).alias("rate"))
    known = F.broadcast(fx.select("market").distinct().withColumn("known", F.lit(True)))  # a row a market
    out = prices.join(rated, [*keys, "date"]).join(known, "market", "left")
    home, none = F.col("market") == base, F.col("known").isNull()
    if drop_missing:
        out = out.where(home | ~none)
    return out.withColumn("close", F.when(home | none, F.col("close")).otherwise(F.col("close") * F.col("rate"))).select(*prices.columns)
