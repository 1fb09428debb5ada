"""Queries on the panel, features and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import features as G
from tickerloom.operators import panel as P
from tickerloom.operators import score as S
from tickerloom.operators import snapshot as K
from tickerloom.operators import tradeability as R
from tickerloom.plans import inputs as I

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, *dates: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = I.with_dates(sql, *dates) if dates else sql
        return f

    return add


@query(f"WITH {I.PRICES}, {I.aligned()} SELECT 'all' AS panel_id, symbol, date, round(close, 6) AS close FROM aligned", "date")
def price_panel(spark, sf_dir):
    return I.rounded(P.align(P.clean(I.prices(spark, sf_dir))))


@query(f"""WITH {I.PRICES}, {I.aligned(coverage=0)} SELECT 'all' AS panel_id, symbol, count(*) AS n_days, count(close) AS n_bars,
  round(count(close) / count(*), 6) AS coverage, max(date) FILTER (close IS NOT NULL) AS last_date, round(arg_max(close, date) FILTER (close IS NOT NULL), 6) AS last_close FROM aligned GROUP BY symbol""", "last_date")
def coverage_report(spark, sf_dir):
    return I.rounded(P.coverage_of(P.clean(I.prices(spark, sf_dir))))


@query(f"""WITH {I.PRICES}, {I.MARKETS}, m AS (SELECT market, symbol, date, close FROM prices JOIN markets USING (symbol)),
span AS (SELECT market, min(date) AS lo, max(date) AS hi FROM m GROUP BY 1),
grid AS (SELECT s.market, s.symbol, s.d AS date FROM (SELECT DISTINCT span.market, symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT market, symbol FROM m) JOIN span USING (market)) s WHERE isodow(s.d) < 6),
f AS (SELECT g.market AS panel_id, g.symbol, g.date, last_value(close IGNORE NULLS) OVER (PARTITION BY g.market, g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS close FROM grid g LEFT JOIN m USING (market, symbol, date))
SELECT panel_id, symbol, count(*) AS n, count(close) AS k, round(sum(close), 4) AS total FROM f GROUP BY 1, 2""")
def market_panel(spark, sf_dir):
    rows = I.prices(spark, sf_dir).drop("panel_id").join(I.markets(spark, sf_dir), "symbol").withColumnRenamed("market", "panel_id")
    return I.rounded(P.align_market(rows).groupBy("panel_id", "symbol").agg(F.count("*").alias("n"), F.count("close").alias("k"), F.sum("close").alias("total")), 4)


_CROSSES = f"""WITH {I.RATES}, wide AS (SELECT date, max(rate) FILTER (market = 'ASIA') AS usdkrw, max(rate) FILTER (market = 'EUROPE') AS usdjpy, max(rate) FILTER (market = 'AMERICA') AS usdhkd FROM rates GROUP BY 1),
f AS (SELECT date, last_value(usdkrw IGNORE NULLS) OVER w AS usdkrw, last_value(usdjpy IGNORE NULLS) OVER w AS usdjpy, last_value(usdhkd IGNORE NULLS) OVER w AS usdhkd FROM wide WHERE isodow(date) < 6 WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT market, date, round(rate, 6) AS rate FROM (
  SELECT 'USA' AS market, date, usdkrw AS rate FROM f UNION ALL SELECT 'JPN', date, usdkrw / usdjpy FROM f UNION ALL SELECT 'HKG', date, usdkrw / usdhkd FROM f) WHERE rate IS NOT NULL"""


@query(_CROSSES, "date")
def fx_crosses(spark, sf_dir):
    wide = I.rates(spark, sf_dir).groupBy("date").agg(*[F.max(F.when(F.col("market") == m, F.col("rate"))).alias(c) for c, m in (("usdkrw", "ASIA"), ("usdjpy", "EUROPE"), ("usdhkd", "AMERICA"))])
    return I.rounded(P.fx_crosses(wide))


def _converted(keep: bool) -> str:
    return f"""WITH {I.PRICES}, {I.MARKETS}, {I.RATES}, m AS (SELECT market, symbol, date, close FROM prices JOIN markets USING (symbol)),
d AS (SELECT market, date, last_value(rate IGNORE NULLS) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) AS rate, count(rate) OVER (PARTITION BY market) AS k FROM (SELECT DISTINCT market, date FROM m) LEFT JOIN rates USING (market, date))
SELECT market, symbol, date, round(CASE WHEN market = 'ASIA' OR k = 0 THEN close ELSE close * rate END, 6) AS close FROM m JOIN d USING (market, date) {'' if keep else "WHERE market = 'ASIA' OR k > 0"}"""


def _convert(spark, sf_dir, drop):
    rows = I.prices(spark, sf_dir).drop("panel_id").join(I.markets(spark, sf_dir), "symbol").select("market", "symbol", "date", "close")
    return I.rounded(P.convert(rows, I.rates(spark, sf_dir), drop, base="ASIA"))


@query(_converted(False), "date")
def fx_convert_panel(spark, sf_dir):
    return _convert(spark, sf_dir, True)


@query(_converted(True), "date")
def fx_convert_batch(spark, sf_dir):
    return _convert(spark, sf_dir, False)


def _bars(spark, sf_dir):
    return G.visible(G.bars_of_prices(P.clean(I.prices(spark, sf_dir))))


def _chosen(spark, sf_dir, columns):
    return I.rounded(_bars(spark, sf_dir).select("symbol", *[c.cast("double").alias(k) for k, c in columns.items()]))


def _at(k: int, value: str = "p") -> str:
    return f"max({value}) FILTER (rn = {k + 1})"


def _sql(columns: dict[str, str], digits: int = 6, source: str = "v") -> str:
    finer = ("slope", "accel", "curv", "recovery_3d", "quality", "21d_trend", "post_spike", "mid_dip")
    items = ", ".join(f"round({c}, {digits + 2 * any(x in k for x in finer)}) + 0.0 AS {k}" for k, c in columns.items())
    return f"WITH {I.BARS} SELECT symbol, {items} FROM {source} GROUP BY symbol"


_RETURNS = {k: f"{_at(0)} / {_at(n)} - 1" for k, n in G.RETURNS.items()} | {
    "r2_3m": "regr_r2(ln(p), -rn) FILTER (rn <= 63)",
    "vol20_ann": "stddev_samp(chg) FILTER (rn <= 20) * sqrt(252)",
    "r_ytd": f"{_at(0)} / arg_min(p, abs(date_diff('day', make_date(year(last_day), 1, 1), date)) * 10 + CASE WHEN date >= make_date(year(last_day), 1, 1) THEN 0 ELSE 1 END) - 1",
}


@query(_sql(_RETURNS, source="(SELECT *, p / lag(p) OVER (PARTITION BY symbol ORDER BY date) - 1 AS chg, max(date) OVER (PARTITION BY symbol) AS last_day FROM b)"))
def window_returns(spark, sf_dir):
    return _chosen(spark, sf_dir, {k: G.full_returns()[k] for k in _RETURNS})


_slope = lambda w, f="slope", y="lp": f"regr_{f}({y}, -rn) FILTER (rn <= {w})"
_TREND = {f"r_{k}d_log": f"{_at(0, 'lp')} - {_at(k, 'lp')}" for k in (3, 5, 10, 21)}
for _w in (10, 15, 21):
    _TREND |= {f"log_slope_{_w}d": _slope(_w), f"trend_r2_{_w}d": _slope(_w, "r2"), f"trend_quality_{_w}d": f"{_slope(_w)} * {_slope(_w, 'r2')}"}
_TREND |= {
    "recovery_3d_vs_prior7": f"({_at(0, 'lp')} - {_at(3, 'lp')}) / 3 - ({_at(3, 'lp')} - {_at(10, 'lp')}) / 7",
    "recent_3d_vs_21d_trend": f"({_at(0, 'lp')} - {_at(3, 'lp')}) / 3 - {_slope(21)}",
    "slope_accel_10_21": f"{_slope(10)} - {_slope(21)}",
}


@query(_sql(_TREND))
def trend_features(spark, sf_dir):
    return _chosen(spark, sf_dir, G.trend())


_ema = lambda w: f"regr_slope(ln(e20), -rn) FILTER (rn <= {w})"
_AVERAGES = {
    "ema20_slope_3d": _ema(4),
    "ema20_slope_10d": _ema(10),
    "ema20_accel": f"{_ema(4)} - {_ema(10)}",
    "ema20_curv_20d": f"{_ema(10)} - regr_slope(ln(e20), -rn) FILTER (rn BETWEEN 11 AND 20)",
    "price_vs_ema20": f"{_at(0)} / {_at(0, 'e20')} - 1",
    "price_vs_ema50": f"{_at(0)} / {_at(0, 'e50')} - 1",
    "under_ema20_depth": "coalesce(min(p / e20 - 1) FILTER (rn <= 60 AND p < e20 * (1 - 1e-12)), 0)",
    "under_ema20_days": "count(*) FILTER (rn <= 60 AND p < e20 * (1 - 1e-12))",
    "under_ema20_streak": "coalesce(min(rn) FILTER (NOT p < e20 * (1 - 1e-12)) - 1, count(*))",
}


@query(_sql(_AVERAGES, source="e"))
def ema_features(spark, sf_dir):
    return _chosen(spark, sf_dir, G.averages())


_STREAKS = f"""WITH {I.BARS}, s AS (SELECT symbol, rn, sign(round(r, 14)) AS s FROM v WHERE rn <= 4),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, s ORDER BY rn) AS island FROM s),
k AS (SELECT symbol, s, count(*) AS n FROM g GROUP BY symbol, s, island)
SELECT symbol, coalesce(max(n) FILTER (s < 0), 0)::DOUBLE AS down_streak_5d, coalesce(max(n) FILTER (s > 0), 0)::DOUBLE AS up_streak_5d FROM k GROUP BY 1"""


@query(_STREAKS)
def streak_features(spark, sf_dir):
    return _chosen(spark, sf_dir, G.streaks())


_eff = lambda w: f"(CASE WHEN sum(abs(r)) FILTER (rn <= {w}) > 0 THEN sum(r) FILTER (rn <= {w}) / sum(abs(r)) FILTER (rn <= {w}) ELSE 0 END)"
_down = lambda w: f"sqrt(avg(pow(least(r, 0), 2)) FILTER (rn <= {w})) * sqrt(252)"
_up = "sqrt(avg(pow(greatest(r, 0), 2)) FILTER (rn <= 20)) * sqrt(252)"
_width = lambda a, b: f"(max(p) FILTER (rn BETWEEN {a} AND {b}) / min(p) FILTER (rn BETWEEN {a} AND {b}) - 1)"
_PATHS = {f"trend_efficiency_{k}d": _eff(k) for k in (10, 15, 20)} | {
    "trend_efficiency_reward_15d": f"greatest({_eff(15)}, 0)",
    "trend_inefficiency_15d": f"greatest(0.2::DOUBLE - {_eff(15)}, 0)",
    "downside_rms_10d": _down(10),
    "downside_rms_20d": _down(20),
    "upside_rms_20d": _up,
    "vol_asymmetry_20d": f"{_up} - {_down(20)}",
    "worst_log_return_20d": "min(r) FILTER (rn <= 20)",
    "post_spike_stall": f"greatest(max(rise) FILTER (rn >= 16), 0) * greatest(arg_max(lp, rise * 1000 + rn * 1e-9) FILTER (rn >= 16 AND rise IS NOT NULL) - {_at(0, 'lp')}, 0)",
    "stale_age": "(max(rn) FILTER (rn <= 21 AND p >= high21 - 1e-12) - 1) * greatest(max(r) FILTER (rn BETWEEN 4 AND 21), 0)",
    "max_dd_pct": "min(p / top - 1) * 100",
    "dd_recovery": f"CASE WHEN min(p / top - 1) >= -0.01 THEN 1 ELSE ({_at(0)} - arg_min(p, p / top)) / (arg_min(top, p / top) - arg_min(p, p / top)) END",
    "range_compression_20d": f"{_width(1, 20)} / nullif({_width(21, 40)}, 0)",
    "jump_discontinuity_3m": f"CASE WHEN sum(greatest(r, 0)) > 0 THEN greatest(max(r3), 0) / sum(greatest(r, 0)) * greatest(0.5::DOUBLE - {_eff(20)}, 0) ELSE 0 END",
}
_PATH_ROWS = """(SELECT *, max(CASE WHEN rn <= 21 THEN p END) OVER (PARTITION BY symbol) AS high21,
  CASE WHEN count(r) OVER w3 = 3 THEN sum(r) OVER w3 END AS r3 FROM v WINDOW w3 AS (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING))"""


@query(_sql(_PATHS, source=_PATH_ROWS))
def path_features(spark, sf_dir):
    return _chosen(spark, sf_dir, G.paths())


_SEGMENTS = {f"seg_ret_{k}": f"{_at(a)} / {_at(min(b, 62))} - 1" for k, (a, b) in G.SEGMENTS.items()}
for _k in ("0_5", "5_21", "21_63"):
    _a, _b = G.SEGMENTS[_k]
    _b = min(_b, 62)
    _SEGMENTS |= {
        f"seg_slope_{_k}": f"regr_slope(lp, -rn) FILTER (rn BETWEEN {_a + 1} AND {_b + 1})",
        f"seg_vol_{_k}": f"stddev_pop(r) FILTER (rn BETWEEN {_a + 1} AND {_b}) * sqrt(252)",
    }
_gain5 = "sum(greatest(r, 0)) FILTER (rn <= 5)"
_SEGMENTS |= {
    "prior_support_sign": f"CASE WHEN {_SEGMENTS['seg_ret_21_63']} > 0 THEN 1 ELSE 0 END",
    "recent_up_days_5d": "count(*) FILTER (rn <= 5 AND r > 0)",
    "recent_jump_share_5d": f"CASE WHEN {_gain5} > 1e-12 THEN greatest(max(r) FILTER (rn <= 5), 0) / {_gain5} END",
    "mid_dip_recovery": f"greatest({_SEGMENTS['seg_ret_0_5']}, 0) * greatest(-({_SEGMENTS['seg_ret_5_21']}), 0)",
}


@query(_sql(_SEGMENTS))
def segment_features(spark, sf_dir):
    return _chosen(spark, sf_dir, G.segments())


#: The inputs of the production score for every symbol, as SQL; then the score by its definition.
_NEED = {k: (_RETURNS | _PATHS | _SEGMENTS)[k] for k in ("stale_age", "trend_efficiency_reward_15d", "seg_ret_0_5", "seg_ret_5_21", "seg_ret_21_63", "prior_support_sign", "recent_up_days_5d", "recent_jump_share_5d", "mid_dip_recovery")}
_sp = lambda x: f"(ln(1 + exp(least(40, greatest(-40, 8 * ({x}))))) / 8)"
_q = S.ALIVE_PULLBACK
FMS = f"""{_sp(f"r_3m - {_q['floor']}::DOUBLE / 2")} * (
  {_q['w_recent']}::DOUBLE * sign(seg_ret_0_5) * pow(abs(seg_ret_0_5), {_q['pow_recent']}::DOUBLE) + {_q['alive_boost']}::DOUBLE * {_sp('seg_ret_0_5')} * prior_support_sign
  + {_q['w_mid_pos']}::DOUBLE * {_sp('seg_ret_5_21')} + {_q['w_mid_neg_forgive']}::DOUBLE * mid_dip_recovery * (0.5::DOUBLE + prior_support_sign)
  + {_q['w_prior']}::DOUBLE * seg_ret_21_63 * (0.5::DOUBLE + prior_support_sign) + {_q['w_abs']}::DOUBLE * {_sp(f"r_3m - {_q['floor']}::DOUBLE")}
  + {_q['w_breadth']}::DOUBLE * recent_up_days_5d / 5 + {_q['w_eff']}::DOUBLE * {_sp('trend_efficiency_reward_15d')}
  + {_q['w_grind']}::DOUBLE * {_sp(f"r_3m - {_q['floor']}::DOUBLE")} * r2_3m * (1 - jump) * {_sp('trend_efficiency_reward_15d + 0.05::DOUBLE')})
  / (1 + {_q['w_stale_run']}::DOUBLE * greatest(stale_age * greatest(seg_ret_21_63, 0) * greatest(0.02::DOUBLE - seg_ret_0_5, 0), 0) + {_q['w_jump_share']}::DOUBLE * {_sp('jump - 0.55::DOUBLE')})"""
SCORES = f"""{I.BARS},
f1 AS (SELECT symbol, {', '.join(f'{c} AS {k}' for k, c in _NEED.items())}, regr_r2(lp, -rn) AS r2_3m FROM {_PATH_ROWS} GROUP BY symbol),
f2 AS (SELECT symbol, {_at(0)} / {_at(63)} - 1 AS r_3m FROM b GROUP BY symbol),
f AS (SELECT *, least(1, greatest(0, coalesce(recent_jump_share_5d, 0))) AS jump FROM f1 JOIN f2 USING (symbol)),
scores AS (SELECT symbol, {FMS} AS fms FROM f)"""


@query(f"WITH {SCORES} SELECT symbol, fms, row_number() OVER (ORDER BY fms DESC, symbol) AS rank FROM (SELECT symbol, round(fms, 6) + 0.0 AS fms FROM scores)")
def score_snapshot(spark, sf_dir):
    found = I.rounded(K.snapshot(P.clean(I.prices(spark, sf_dir))).select("symbol", "fms"))
    return found.withColumn("rank", F.row_number().over(_ranked()))


def _ranked():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("fms"), "symbol")  # a row a symbol


_TRADE = f"""{I.OHLC}, d AS (SELECT *, lag(close) OVER w AS pc, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM ohlc WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t AS (SELECT symbol, date, rn, greatest(high - low, abs(high - pc), abs(low - pc)) / pc AS tr, low / pc - 1 AS dl FROM d)"""


@query(f"""WITH {_TRADE}, c AS (SELECT symbol, count(*) AS n_closes, count(*) FILTER (rn <= 63 AND pc_ok AND tr > 0.30) AS extreme_days, count(*) FILTER (rn <= 20 AND pc_ok AND dl < -0.07) AS severe_days
  FROM (SELECT *, tr IS NOT NULL AND dl IS NOT NULL AS pc_ok FROM t) GROUP BY 1)
SELECT symbol, n_closes, extreme_days, severe_days, n_closes < 63 OR extreme_days > 0 OR severe_days >= 4 AS disqualified,
  CASE WHEN n_closes < 63 THEN 'too few closes' WHEN extreme_days > 0 OR severe_days >= 4 THEN concat_ws('; ', CASE WHEN extreme_days > 0 THEN 'extreme range days: ' || extreme_days END, CASE WHEN severe_days >= 4 THEN 'severe falls: ' || severe_days END) ELSE 'normal' END AS filter_status FROM c""")
def tradeability(spark, sf_dir):
    return R.tradeability(I.ohlc(spark, sf_dir))


@query(f"""WITH {_TRADE} SELECT symbol, max(date) AS last_date, round(max(tr) FILTER (rn = 1), 6) AS last_true_range, count(*) FILTER (tr > 0.30) AS n_extreme, min(date) FILTER (tr > 0.30) AS first_extreme,
  count(*) FILTER (rn <= 20 AND dl < -0.07) AS n_severe, round(min(dl) FILTER (rn <= 20 AND dl < -0.07), 6) AS worst FROM t WHERE rn <= 63 GROUP BY 1""", "last_date", "first_extreme")
def filter_details(spark, sf_dir):
    d = R.filter_details(I.ohlc(spark, sf_dir))
    worst = F.array_min(F.transform("severe", lambda s: s["drop_low"]))
    return I.rounded(d.select("symbol", "last_date", "last_true_range", F.size("extreme").cast("long").alias("n_extreme"), F.get("extreme", F.lit(0))["date"].alias("first_extreme"), F.size("severe").cast("long").alias("n_severe"), worst.alias("worst")))


@query(f"""WITH {I.OHLC}, raw AS (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(date) OVER w AS pd, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ohlc WINDOW w AS (PARTITION BY symbol ORDER BY date)),
d AS (SELECT *, coalesce(high = 0 AND low = 0 AND pc > 0 AND ph > 0 AND pl > 0, false) AS mended FROM raw), e AS (SELECT *, CASE WHEN mended THEN ph ELSE high END AS h, CASE WHEN mended THEN pl ELSE low END AS l FROM d),
g AS (SELECT *, greatest(h - l, abs(h - pc), abs(l - pc)) AS tr FROM e), k AS (SELECT symbol, count(*) FILTER (rn <= 63 AND tr / pc > 0.30) AS n_extreme, count(*) FILTER (rn <= 20 AND l / pc - 1 < -0.07) AS n_severe, round(max(round(tr / pc * 100, 2)) FILTER (rn <= 63 AND tr / pc > 0.30), 2) AS widest FROM g GROUP BY 1)
SELECT symbol, n AS n_closes, date AS last_date, pd AS prev_date, round(close, 6) AS last_close, round(pc, 6) AS prev_close, round(h, 6) AS high, round(l, 6) AS low, mended, round(h - l, 6) AS high_minus_low, round(abs(h - pc), 6) AS high_gap, round(abs(l - pc), 6) AS low_gap,
  round(tr, 6) AS true_range, round(tr / pc * 100, 6) AS true_range_pct, n_extreme, CASE WHEN n_severe >= 4 THEN n_severe END AS n_severe, widest FROM g JOIN k USING (symbol) WHERE rn = 1 AND n >= 63""", "last_date", "prev_date")
def filter_components(spark, sf_dir):
    found = R.filter_components(I.ohlc(spark, sf_dir)).where("n_closes >= 63")
    lists = [F.size("extreme").cast("long").alias("n_extreme"), F.when(F.col("severe").isNotNull(), F.size("severe")).cast("long").alias("n_severe"), F.array_max(F.transform("extreme", lambda x: x["pct"])).alias("widest")]
    return I.rounded(found.drop("raw_high", "raw_low").select("*", *lists).drop("extreme", "severe"))


@query(f"""WITH {SCORES}, {_TRADE.replace(I.PRICES + ', ', '')}, c AS (SELECT symbol, count(*) < 63 OR count(*) FILTER (rn <= 63 AND tr > 0.30) > 0 OR count(*) FILTER (rn <= 20 AND dl < -0.07) >= 4 AS dq FROM t GROUP BY 1)
SELECT symbol, round(CASE WHEN dq THEN -999 ELSE fms END, 6) + 0.0 AS fms, dq AS disqualified FROM scores JOIN c USING (symbol)""")
def filtered_scan(spark, sf_dir):
    return I.rounded(K.snapshot(P.clean(I.prices(spark, sf_dir)), I.ohlc(spark, sf_dir)).select("symbol", "fms", "disqualified"))


def _lagged_scores(lag: int) -> str:
    """The same score with the last rows of the grid cut off."""
    cut = f"b AS (SELECT symbol, date, close AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM aligned WHERE close > 0 AND date IN (SELECT d FROM aligned_days ORDER BY d DESC OFFSET {lag}))"
    whole = "b AS (SELECT symbol, date, close AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM aligned WHERE close > 0)"
    assert whole in SCORES
    return SCORES.replace(whole, cut)


_DELTAS = "SELECT symbol, round(a.fms, 6) + 0.0 AS fms, round(a.fms - b.fms, 6) + 0.0 AS d1, round(a.fms - c.fms, 6) + 0.0 AS d5 FROM " + " JOIN ".join(
    f"(WITH {_lagged_scores(lag)} SELECT symbol, fms FROM scores) {name}" + ("" if name == "a" else " USING (symbol)") for name, lag in (("a", 0), ("b", 1), ("c", 5))
)


@query(_DELTAS)
def score_deltas(spark, sf_dir):
    return I.rounded(K.deltas(P.clean(I.prices(spark, sf_dir))).select("symbol", "fms", "d1", "d5"))
