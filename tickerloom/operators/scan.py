"""Whole scans: from a market's prices, rates and OHLC to ranked scores, in one job however many panels there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.lists import market_of
from tickerloom.operators.panel import BATCH_COVERAGE, KEY, VIEW_COVERAGE, align, align_market, clean, convert
from tickerloom.operators.places import placed
from tickerloom.operators.snapshot import deltas, ranked
from tickerloom.sources.market import MarketData


def chunked(symbols: DataFrame, size: int | None) -> DataFrame:
    """panel_id (the chunk), symbol: the first place of each symbol in the order of ord counts; without a size all are one."""
    first = symbols.groupBy("symbol").agg(F.min("ord").alias("ord"))
    if size is None:
        return first.select(F.lit("0").alias("panel_id"), "symbol")
    found = placed(first, [F.col("ord"), F.col("symbol")], "_place")
    return found.select(F.floor((F.col("_place") - 1) / size).cast("string").alias("panel_id"), "symbol")


def in_base_currency(panel: DataFrame, fx: DataFrame, drop_missing: bool, along: str, base: str, market: Column | None) -> DataFrame:
    rows = panel if "market" in panel.columns else panel.withColumn("market", market_of(F.col("symbol")) if market is None else market)
    return convert(rows, fx, drop_missing, base, along)


def batch_scan(source: MarketData, symbols: DataFrame, size: int | None = None, coverage: float = BATCH_COVERAGE, base: str = "KOR", market: Column | None = None, markets: DataFrame | None = None) -> DataFrame:
    """symbol, fms, d1, d5, r_1w, r_4m, r_ytd, filter_status, best first, of symbols (symbol, ord) in chunks of size.

    A chunk is a panel: rates are filled along its dates, and its grid and coverage are its own. A market without rates stays
    in its own currency. Symbols without prices, or without enough of them, have no row; what goes wrong in a chunk's data
    stays in it, since chunks are keys of one job. A market is told by the ticker's ending, by an expression, or by a table
    markets (symbol, market)."""
    chunks = chunked(symbols, size)
    prices, _ = source.prices(chunks)
    rows = prices.join(chunks, "symbol")
    if markets is not None:
        rows = rows.join(markets, "symbol")
    rows = in_base_currency(rows, source.fx(), False, "panel_id", base, market)
    ohlc, _ = source.ohlc(chunks)
    found = deltas(clean(rows.select(*KEY, "date", "close")), ohlc, coverage)
    first = found.groupBy("symbol").agg(F.min_by(F.struct("fms", "d1", "d5", "r_1w", "r_4m", "r_ytd", "filter_status"), F.col("panel_id").cast("long")).alias("r"))
    return ranked(first.select("symbol", "r.*"))


def base_prices(source: MarketData, symbols: DataFrame, base: str = "KOR", market: Column | None = None, markets: DataFrame | None = None, by_market: bool = False) -> DataFrame:
    """panel_id, symbol, date, close of one panel in the base currency; each market's rates along its own dates, markets
    without rates left out. by_market: each market's weekdays are filled first, as a view of several markets does."""
    wanted = symbols.select("symbol").distinct()
    prices, _ = source.prices(wanted)
    rows = prices.join(markets, "symbol") if markets is not None else prices.withColumn("market", market_of(F.col("symbol")) if market is None else market)
    rows = rows.withColumn("panel_id", F.lit("0"))
    if by_market:
        filled = align_market(clean(rows.withColumn("panel_id", F.col("market")).select(*KEY, "date", "close")))
        rows = filled.select(F.lit("0").alias("panel_id"), F.col("panel_id").alias("market"), "symbol", "date", "close")
    rows = convert(rows, source.fx(), True, base)
    return clean(rows.select(*KEY, "date", "close"))


def base_panel(source: MarketData, symbols: DataFrame, coverage: float = BATCH_COVERAGE, base: str = "KOR", market: Column | None = None, markets: DataFrame | None = None, by_market: bool = False) -> DataFrame:
    """base_prices() on the grid."""
    return align(base_prices(source, symbols, base, market, markets, by_market), coverage)


def view_scan(source: MarketData, symbols: DataFrame, coverage: float = VIEW_COVERAGE, base: str = "KOR", market: Column | None = None, markets: DataFrame | None = None) -> DataFrame:
    """As batch_scan, for what a user looks at: one panel, filled market by market first, with less coverage asked for."""
    prices = base_prices(source, symbols, base, market, markets, by_market=True)
    ohlc, _ = source.ohlc(symbols.select("symbol").distinct())
    return ranked(deltas(prices, ohlc, coverage).drop("panel_id"))


def left_out(source: MarketData, symbols: DataFrame, scan: DataFrame) -> DataFrame:
    """symbol, reason of symbols that a scan has no row for: no prices, or not enough of them."""
    _, missing = source.prices(symbols)
    absent = symbols.select("symbol").distinct().join(scan.select("symbol"), "symbol", "left_anti")
    return absent.join(missing.select("symbol", F.lit("no prices").alias("reason")), "symbol", "left").select("symbol", F.coalesce("reason", F.lit("too few prices")).alias("reason"))


def detail(panel: DataFrame, scan: DataFrame, names: DataFrame, symbol: str) -> DataFrame:
    """One row of one symbol, or none: name, series (array of date, close), and its row of the scan; never another's."""
    series = panel.where((F.col("symbol") == symbol) & F.col("close").isNotNull()).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("series"))
    named = names.where(F.col("symbol") == symbol).select("symbol", "name")
    return series.join(named, "symbol", "left").join(scan.where(F.col("symbol") == symbol), "symbol", "left").withColumn("name", F.coalesce("name", "symbol"))


def selected(scan: DataFrame, symbol: str | None) -> str | None:
    """The symbol to show: the one that was, if the scan still has it, else the best one."""
    if symbol is not None and not scan.where(F.col("symbol") == symbol).isEmpty():
        return symbol
    best = scan.orderBy(F.desc_nulls_last("fms"), "symbol").select("symbol").first()
    return best["symbol"] if best else None


def outliers(panel: DataFrame, move: float = 0.30) -> DataFrame:
    """symbol, n_bars, low, high, n_moves, largest, largest_date of symbols that moved by more than move from one valid price
    to the next."""
    w = Window.partitionBy("symbol").orderBy("date")
    change = F.col("close") / F.lag("close").over(w) - 1
    rows = panel.where("close > 0").select("symbol", "date", "close", change.alias("change"))
    big = F.abs(F.col("change")) > move
    found = rows.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.min("close").alias("low"), F.max("close").alias("high"), F.count_if(big).alias("n_moves"), F.max_by("change", F.when(big, F.struct(F.abs(F.col("change")), F.col("date")))).alias("largest"), F.max_by("date", F.when(big, F.struct(F.abs(F.col("change")), F.col("date")))).alias("largest_date"))
    return found.where("n_moves > 0")
