"""Queries that run a scan from prices, rates and OHLC to scores, and what is read off one; with their SQL. A supplier's
region is its market, ASIA the one whose currency all are turned into; AFRICA has no rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import features as G
from tickerloom.operators import lists as L
from tickerloom.operators import panel as P
from tickerloom.operators import scan as N
from tickerloom.plans import inputs as I
from tickerloom.plans import panel_queries as Q
from tickerloom.sources import market as M

QUERIES, ORACLE = {}, {}
CHUNK = 40


def query(sql: str | None, *dates: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = I.with_dates(sql, *dates) if dates else sql
        return f

    return add


def _source(spark, sf_dir):
    return M.Tables(I.prices(spark, sf_dir).drop("panel_id"), I.ohlc(spark, sf_dir), I.rates(spark, sf_dir))


def _universe(spark, sf_dir):
    return I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_suppkey").alias("ord"))


def _grid(source: str, coverage: float) -> str:
    """SQL of the grid of each panel of source (panel, symbol, date, close), as the table aligned."""
    return f"""g_span AS (SELECT panel, min(date) AS lo, max(date) AS hi FROM {source} GROUP BY 1),
g_last AS (SELECT panel, symbol, max(date) FILTER (close IS NOT NULL) AS last_valid FROM {source} GROUP BY 1, 2),
g_days AS (SELECT panel, d FROM (SELECT panel, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM g_span) WHERE isodow(d) < 6),
g_fill AS (SELECT l.symbol, d AS date, CASE WHEN d <= last_valid THEN last_value(close IGNORE NULLS) OVER (PARTITION BY l.symbol ORDER BY d ROWS UNBOUNDED PRECEDING) END AS close
  FROM g_last l JOIN g_days USING (panel) LEFT JOIN {source} s ON s.symbol = l.symbol AND s.date = d),
aligned AS (SELECT symbol, date, close FROM (SELECT *, count(close) OVER (PARTITION BY symbol) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM g_fill) WHERE k >= {coverage} * n)"""


_BATCH = f"""{I.PRICES}, {I.MARKETS}, {I.RATES},
chunks AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) / {CHUNK}) AS BIGINT) AS panel FROM supplier),
m AS (SELECT panel, market, symbol, date, close FROM prices JOIN chunks USING (symbol) JOIN markets USING (symbol)),
rated AS (SELECT panel, market, date, last_value(rate IGNORE NULLS) OVER (PARTITION BY panel, market ORDER BY date ROWS UNBOUNDED PRECEDING) AS rate
  FROM (SELECT DISTINCT panel, date FROM m) JOIN (SELECT DISTINCT panel, market FROM m) USING (panel) LEFT JOIN rates USING (market, date)),
conv AS (SELECT panel, symbol, date, CASE WHEN market = 'ASIA' OR market NOT IN (SELECT market FROM rates) THEN close ELSE close * rate END AS close FROM m JOIN rated USING (panel, market, date)),
{_grid('conv', 0.9)}"""
_VIEW = f"""{I.PRICES}, {I.MARKETS}, {I.RATES},
m AS (SELECT market, symbol, date, close FROM prices JOIN markets USING (symbol)),
own_span AS (SELECT market, min(date) AS lo, max(date) AS hi FROM m GROUP BY 1),
own_days AS (SELECT market, symbol, d FROM (SELECT market, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM own_span) JOIN (SELECT DISTINCT market, symbol FROM m) USING (market) WHERE isodow(d) < 6),
filled AS (SELECT o.market, o.symbol, d AS date, last_value(close IGNORE NULLS) OVER (PARTITION BY o.symbol ORDER BY d ROWS UNBOUNDED PRECEDING) AS close FROM own_days o LEFT JOIN m ON m.symbol = o.symbol AND m.date = d),
rated AS (SELECT market, date, last_value(rate IGNORE NULLS) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) AS rate FROM (SELECT DISTINCT market, date FROM filled) LEFT JOIN rates USING (market, date)),
conv AS (SELECT 0 AS panel, symbol, date, CASE WHEN market = 'ASIA' THEN close ELSE close * rate END AS close FROM filled JOIN rated USING (market, date) WHERE market = 'ASIA' OR market IN (SELECT market FROM rates)),
{_grid('conv', 0.5)}"""
_WHOLE = f"{I.PRICES}, {I.aligned()}"
assert _WHOLE in Q.SCORES
_FLAGS = Q._TRADE.replace(I.PRICES + ", ", "") + """, counts AS (SELECT symbol, count(*) AS n, count(*) FILTER (rn <= 63 AND tr > 0.30) AS wild, count(*) FILTER (rn <= 20 AND dl < -0.07) AS falls FROM t GROUP BY 1),
flags AS (SELECT symbol, n < 63 OR wild > 0 OR falls >= 4 AS dq, CASE WHEN n < 63 THEN 'too few closes' WHEN wild > 0 OR falls >= 4 THEN concat_ws('; ', CASE WHEN wild > 0 THEN 'extreme range days: ' || wild END, CASE WHEN falls >= 4 THEN 'severe falls: ' || falls END) ELSE 'normal' END AS filter_status FROM counts)"""
_BARS_NOW = "b AS (SELECT symbol, date, close AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM aligned WHERE close > 0)"
assert _BARS_NOW in Q.SCORES


def _scan_sql(panel: str) -> str:
    """Each symbol's score at the end of its panel's grid and less the scores 1 and 5 of the grid's rows before, with its returns."""

    def at(lag: int) -> str:
        cut = f"g_pos AS (SELECT panel, d AS date, row_number() OVER (PARTITION BY panel ORDER BY d DESC) AS pos FROM g_days), b AS (SELECT symbol, date, close AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM aligned JOIN (SELECT DISTINCT panel, symbol FROM g_last) USING (symbol) JOIN g_pos USING (panel, date) WHERE close > 0 AND pos > {lag})"
        return Q.SCORES.replace(_WHOLE, panel).replace(_BARS_NOW, cut)

    returns = ", ".join(f"{Q._RETURNS[c]} AS {c}" for c in ("r_1w", "r_4m", "r_ytd"))
    parts = [f"(WITH {at(lag)} SELECT symbol, fms FROM scores) s{lag}" for lag in (0, 1, 5)]
    ret = f"(WITH {at(0)} SELECT symbol, {returns} FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last_day FROM b) GROUP BY symbol) ret"
    flags = f"(WITH {I.PRICES}, {_FLAGS} SELECT * FROM flags) flags"
    delta = lambda lag: f"round(CASE WHEN dq THEN 0 ELSE s0.fms - s{lag}.fms END, 6) + 0.0"
    return f"""SELECT symbol, round(CASE WHEN dq THEN -999 ELSE s0.fms END, 6) + 0.0 AS fms, {delta(1)} AS d1, {delta(5)} AS d5, round(r_1w, 6) + 0.0 AS r_1w, round(r_4m, 6) + 0.0 AS r_4m, round(r_ytd, 6) + 0.0 AS r_ytd, filter_status
FROM {parts[0]} LEFT JOIN {parts[1]} USING (symbol) LEFT JOIN {parts[2]} USING (symbol) JOIN {ret} USING (symbol) JOIN {flags} USING (symbol)"""


_SCANNED = ("symbol", "fms", "d1", "d5", "r_1w", "r_4m", "r_ytd", "filter_status")


@query(_scan_sql(_BATCH))
def batch_scan(spark, sf_dir):
    found = N.batch_scan(_source(spark, sf_dir), _universe(spark, sf_dir), CHUNK, base="ASIA", markets=I.markets(spark, sf_dir))
    return I.rounded(found.select(*_SCANNED))


@query(_scan_sql(_VIEW))
def view_scan(spark, sf_dir):
    found = N.view_scan(_source(spark, sf_dir), _universe(spark, sf_dir), base="ASIA", markets=I.markets(spark, sf_dir))
    return I.rounded(found.select(*_SCANNED))


@query(f"WITH {_VIEW.replace('filled AS', 'unused AS (SELECT 1), filled AS')}, n AS (SELECT DISTINCT symbol FROM aligned) SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CASE WHEN CAST(s_suppkey AS VARCHAR) IN (SELECT symbol FROM prices) THEN 'too few prices' ELSE 'no prices' END AS reason FROM supplier WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT symbol FROM n)")
def scan_left_out(spark, sf_dir):
    source, universe = _source(spark, sf_dir), _universe(spark, sf_dir)
    prices = N.base_prices(source, universe, "ASIA", markets=I.markets(spark, sf_dir), by_market=True)
    return N.left_out(source, universe, G.gathered_prices(prices, P.VIEW_COVERAGE).select("symbol").distinct())


@query(f"""WITH {I.PRICES}, {I.aligned()}, c AS (SELECT symbol, date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS change FROM aligned WHERE close > 0)
SELECT symbol, count(*) AS n_bars, round(min(close), 6) AS low, round(max(close), 6) AS high, count(*) FILTER (abs(change) > 0.30) AS n_moves, round(max(abs(change)), 6) AS largest FROM c GROUP BY 1 HAVING count(*) FILTER (abs(change) > 0.30) > 0""")
def price_outliers(spark, sf_dir):
    found = N.outliers(P.align(P.clean(I.prices(spark, sf_dir))))
    return I.rounded(found.select("symbol", "n_bars", "low", "high", "n_moves", F.abs("largest").alias("largest")))


@query(f"WITH {I.PRICES}, {I.aligned()}, {I.MARKETS} SELECT market, count(*) AS n, count(close) AS n_valid FROM aligned JOIN markets USING (symbol) WHERE date = (SELECT max(date) FROM aligned) GROUP BY 1")
def last_row_counts(spark, sf_dir):
    panel = P.align(P.clean(I.prices(spark, sf_dir))).join(I.markets(spark, sf_dir), "symbol")
    return L.last_row_counts(panel)


@query(f"""WITH {I.PRICES}, {I.aligned()} SELECT '7' AS symbol, 'Supplier#000000007' AS name, count(close) AS n, round(sum(close), 4) AS total, max(date) FILTER (close IS NOT NULL) AS last_date FROM aligned WHERE symbol = '7'""", "last_date")
def symbol_detail(spark, sf_dir):
    s = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"))
    scan = s.select("symbol", F.lit(1.0).alias("fms"))
    found = N.detail(P.align(P.clean(I.prices(spark, sf_dir))), scan, s, "7")
    total = F.aggregate("series", F.lit(0.0), lambda acc, x: acc + x["close"])
    return I.rounded(found.select("symbol", "name", F.size("series").cast("long").alias("n"), total.alias("total"), F.element_at("series", -1)["date"].alias("last_date")), 4)


@query("SELECT 'FREE' AS mode, strftime(ts, '%Y%m') AS run_ts, count(*) FILTER (value >= 50) AS n FROM events GROUP BY 2 HAVING count(*) FILTER (value >= 50) > 0")
def scan_history(spark, sf_dir):
    """Each month's events are a scan: saved, then listed."""
    folder = I.work_dir(spark, "scans")
    e = I.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMM").alias("run_ts"), F.lit("FREE").alias("mode"), F.col("event_id").cast("string").alias("symbol"), F.col("value").cast("double").alias("fms"))
    M.save_scans(e, folder, 50.0)
    return M.scan_history(spark, folder)


@query("WITH last AS (SELECT max(strftime(ts, '%Y%m')) AS run_ts FROM events WHERE value >= 50) SELECT CAST(event_id AS VARCHAR) AS symbol, round(CAST(value AS DOUBLE), 6) AS fms FROM events, last WHERE strftime(ts, '%Y%m') = run_ts AND value >= 60")
def latest_scan(spark, sf_dir):
    folder = I.work_dir(spark, "scans")
    e = I.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMM").alias("run_ts"), F.lit("FREE").alias("mode"), F.col("event_id").cast("string").alias("symbol"), F.col("value").cast("double").alias("fms"))
    M.save_scans(e, folder, 50.0)
    return I.rounded(M.latest_scan(spark, folder, "FREE", 60.0).select("symbol", "fms"))
