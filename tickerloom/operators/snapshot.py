"""A scan: align, filter, features, score; and what the score was one and five rows of the panel ago."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.features import at_lag, features_of, features_of_prices, gathered_prices
from tickerloom.operators.panel import BATCH_COVERAGE, KEY
from tickerloom.operators.score import scored
from tickerloom.operators.tradeability import TOO_FEW, tradeability

LAGS = (0, 1, 5)


def flagged(found: DataFrame, ohlc: DataFrame | None) -> DataFrame:
    """found with disqualified and filter_status; without OHLC nothing is filtered, symbols that it lacks are out.

    Flags are told of all symbols of ohlc, so that found is worked out once, not again for its symbols."""
    if ohlc is None:
        return found.withColumns({"disqualified": F.lit(False), "filter_status": F.lit("normal")})
    joined = found.join(tradeability(ohlc).select("symbol", "disqualified", "filter_status"), "symbol", "left")
    named = F.col("symbol").isNotNull()
    return joined.withColumns({"disqualified": F.coalesce("disqualified", named), "filter_status": F.coalesce("filter_status", F.when(named, TOO_FEW).otherwise("normal"))})


def snapshot(prices: DataFrame, ohlc: DataFrame | None = None, coverage: float = BATCH_COVERAGE) -> DataFrame:
    """Every symbol's features, filter status and fms."""
    return scored(flagged(features_of_prices(prices, coverage), ohlc))


def deltas(prices: DataFrame, ohlc: DataFrame | None = None, coverage: float = BATCH_COVERAGE) -> DataFrame:
    """panel_id, symbol, fms, d1, d5 (fms now less that 1 and 5 grid rows ago), r_1w, r_4m, r_ytd, filter_status.

    The earlier panels are the grid without its last rows, so a symbol that lags its panel may show no change. A symbol's
    bars are gathered once, with a few more, and cut for each lag afterwards. A panel of five rows or fewer has no d5."""
    found = gathered_prices(prices, coverage, max(LAGS))
    lags = found.withColumn("lag", F.explode(F.filter(F.array(*map(F.lit, LAGS)), lambda lag: lag < F.col("n_rows"))))
    every = features_of(at_lag(lags, F.col("lag")), (*KEY, "lag"))
    every = scored(flagged(every, ohlc))
    at = lambda lag: F.max(F.when(F.col("lag") == lag, F.col("fms")))
    now = [F.max(F.when(F.col("lag") == 0, F.col(c))).alias(c) for c in ("r_1w", "r_4m", "r_ytd", "filter_status")]
    out = every.groupBy(*KEY).agg(at(0).alias("fms"), (at(0) - at(1)).alias("d1"), (at(0) - at(5)).alias("d5"), *now)
    return out.select(*KEY, "fms", "d1", "d5", "r_1w", "r_4m", "r_ytd", "filter_status")


def ranked(found: DataFrame, by: str = "fms") -> DataFrame:
    """Best first, missing scores last, ties by symbol."""
    return found.orderBy(F.desc_nulls_last(by), "symbol")
