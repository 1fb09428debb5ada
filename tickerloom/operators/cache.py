"""A cache of bars: what to read again, and fingerprints by which results are known to be the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of periods, and the bars that a period needs, if any.
PERIOD_RANK = {"1d": 1, "5d": 2, "1mo": 3, "3mo": 4, "6mo": 5, "ytd": 5, "1y": 6, "2y": 7, "5y": 8, "10y": 9, "max": 10}
PERIOD_BARS = {"6mo": 80, "1y": 180, "2y": 360, "5y": 900, "10y": 1800, "max": 1800}
#: What a scan of so long a look back asks a source for.
SCAN_PERIOD = {"3M": "6mo", "6M": "1y", "1Y": "2y", "2Y": "5y", "5Y": "10y"}


def least_period(window: int = 63, tail: int = 10) -> str:
    """The period that every feature of a scan and a chart with window and tail has enough bars in, with a tenth to spare."""
    bars = int(max(68, 63, 84, window + tail, 252) * 1.1)
    return "1y" if bars <= 252 else "2y" if bars <= 504 else "5y"


def period_rank(period: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PERIOD_RANK.items() for x in kv]), F.lower(F.trim(period)))


def needs_refresh(last_date: Column, probe_date: Column) -> Column:
    """Whether bars are to be read again: there are none, or the probe has a later day. Without a probe they stay."""
    return last_date.isNull() | F.coalesce(F.to_date(probe_date) > F.to_date(last_date), F.lit(False))


def covers(period: Column, n_bars: Column, wanted: str) -> Column:
    """Whether stored bars do for the period wanted: theirs is no shorter (if both are known), and they are enough."""
    wanted = wanted.strip().lower()
    long = F.lit(True) if wanted not in PERIOD_RANK else F.coalesce(period_rank(period) >= PERIOD_RANK[wanted], F.lit(True))
    return long & (F.coalesce(n_bars, F.lit(0)) >= PERIOD_BARS.get(wanted, 1))


def classify(wanted: DataFrame, cached: DataFrame, probe: DataFrame, period: str) -> DataFrame:
    """symbol, outcome: cold (not cached), period_miss (too short a period or too few bars), miss (the probe has a later
    day), stale_hit (no probe), hit. cached: symbol, period, n_bars, last_date; probe: symbol, probe_date."""
    joined = wanted.select("symbol").join(cached, "symbol", "left").join(probe, "symbol", "left")
    outcome = (
        F.when(F.col("last_date").isNull(), "cold")
        .when(~covers(F.col("period"), F.col("n_bars"), period), "period_miss")
        .when(F.col("probe_date").isNull(), "stale_hit")
        .when(needs_refresh(F.col("last_date"), F.col("probe_date")), "miss")
        .otherwise("hit")
    )
    return joined.select("symbol", outcome.alias("outcome"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row: hits, stale_hits, misses, cold_misses, period_misses, probes (symbols that are asked for their last bar)."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(n("hit").alias("hits"), n("stale_hit").alias("stale_hits"), n("miss").alias("misses"), n("cold").alias("cold_misses"), n("period_miss").alias("period_misses"), n("hit", "stale_hit", "miss").alias("probes"))


def refreshed(cached: DataFrame, fresh: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Bars of hits from the cache, of all others from fresh."""
    hit = outcomes.where(F.col("outcome").isin("hit", "stale_hit")).select("symbol")
    return cached.join(hit, "symbol", "left_semi").unionByName(fresh.join(hit, "symbol", "left_anti"))


def fingerprint(panel: DataFrame, ohlc: DataFrame | None = None) -> DataFrame:
    """One row: symbols, last_date, n_bars, digest; and the same of OHLC if there is one (ohlc_...). The digest is over each
    symbol's last date and count, and doesn't depend on the order of rows: the sum of hashes of a row a symbol."""

    def of(rows: DataFrame, valid: Column, prefix: str) -> DataFrame:
        each = rows.groupBy("symbol").agg(F.max(F.when(valid, F.col("date"))).alias("d"), F.count_if(valid).alias("n"))
        line = F.sha2(F.concat_ws("|", "symbol", F.coalesce(F.col("d").cast("string"), F.lit("")), "n"), 256)
        part = lambda k: F.conv(F.substring(line, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
        digest = F.concat_ws("-", *[F.sum(part(k)).cast("string") for k in range(5)])
        return each.agg(F.count("*").alias(f"{prefix}symbols"), F.max("d").alias(f"{prefix}last_date"), F.sum("n").alias(f"{prefix}n_bars"), digest.alias(f"{prefix}digest"))

    found = of(panel, F.col("close").isNotNull(), "")
    if ohlc is None:
        return found
    return found.crossJoin(F.broadcast(of(ohlc, F.coalesce("high", "low", "close").isNotNull(), "ohlc_")))  # one row each


def ranking_hash(ranking: DataFrame) -> DataFrame:
    """digest: SHA-256 over the symbols, best first; for a ranking that people made."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("true_rank", "symbol"))), lambda r: r["symbol"])
    return ranking.agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))
