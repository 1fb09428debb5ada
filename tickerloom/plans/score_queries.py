"""Queries on the archived, sparse and family scores and the short-horizon features, with SQL that spells their definitions
and fixed values out itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import features as G
from tickerloom.operators import panel as P
from tickerloom.operators import score as S
from tickerloom.plans import inputs as I
from tickerloom.plans import panel_queries as Q

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} AS {k}" for k, c in columns.items())


#: Every feature of every symbol.
FEATURES = f"""{I.BARS},
fv AS (SELECT symbol, {_list(Q._TREND | Q._PATHS | Q._SEGMENTS)} FROM {Q._PATH_ROWS} GROUP BY symbol),
fb AS (SELECT symbol, {_list(Q._RETURNS)} FROM (SELECT *, p / lag(p) OVER (PARTITION BY symbol ORDER BY date) - 1 AS chg, max(date) OVER (PARTITION BY symbol) AS last_day FROM b) GROUP BY symbol),
fe AS (SELECT symbol, {_list(Q._AVERAGES)} FROM e GROUP BY symbol),
f1 AS (SELECT symbol, rn, sign(round(r, 14)) AS s FROM v WHERE rn <= 4), f2 AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, s ORDER BY rn) AS island FROM f1),
f3 AS (SELECT symbol, s, count(*) AS n FROM f2 GROUP BY symbol, s, island),
fs AS (SELECT symbol, coalesce(max(n) FILTER (s < 0), 0) AS down_streak_5d, coalesce(max(n) FILTER (s > 0), 0) AS up_streak_5d FROM f3 GROUP BY 1),
features AS (SELECT *, price_vs_ema50 AS above_ema50, stale_age * greatest(seg_ret_21_63, 0) * greatest(0.02::DOUBLE - seg_ret_0_5, 0) AS stale_after_run
  FROM fv JOIN fb USING (symbol) JOIN fe USING (symbol) JOIN fs USING (symbol))"""


def _features(spark, sf_dir):
    """A row a symbol, kept for the statistics over all of them that a score compares each with."""
    return G.features_of_prices(P.clean(I.prices(spark, sf_dir))).cache()


def _ss(x: str, low: str, high: str) -> str:
    t = f"least(1, greatest(0, (({x}) - {low}) / ({high} - {low})))"
    return f"({t} * {t} * (3 - 2 * {t}))"


_sp = lambda x: f"(ln(1 + exp(least(40, greatest(-40, 8 * ({x}))))) / 8)"
_spow = lambda x, p: f"(sign({x}) * pow(abs({x}), {p}))"
_z = lambda c: f"(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE {c} * 0 END)"

_FIT, _G4, _L4, _S4 = "least(1, greatest(0, r2_3m))", "(pow(1.08::DOUBLE, 84.0::DOUBLE / 126) - 1)", "(pow(1.430268::DOUBLE, 84.0::DOUBLE / 126) - 1)", "(pow(1.5::DOUBLE, 84.0::DOUBLE / 126) - 1)"
_W4 = "(0.006355::DOUBLE * sqrt(84.0::DOUBLE / 126))"
_GATE = f"{_ss('r_3m', '(0.05::DOUBLE - 0.019359::DOUBLE)', '(0.05::DOUBLE + 0.019359::DOUBLE)')} * {_ss('r_4m', f'({_G4} - {_W4})', f'({_G4} + {_W4})')}"
_LEVEL = f"{_ss('r_3m', '0.05::DOUBLE', '0.205305::DOUBLE')} * {_ss('r_4m', _G4, _L4)}"
_AROUND = lambda c: _ss(_FIT, f"({c}::DOUBLE - 0.04552::DOUBLE)", f"({c}::DOUBLE + 0.04552::DOUBLE)")
LEGACY = f"""{FEATURES}, cap AS (SELECT quantile_cont(greatest(vol20_ann, 0), 0.7) AS cap FROM features),
q AS (SELECT *, {_AROUND('0.80')} * (r_3m > 0.3::DOUBLE AND r_4m > {_S4})::INTEGER AS quality, greatest(-max_dd_pct, 0) AS fall, greatest(vol20_ann, 0) AS vol0 FROM features, cap),
t AS (SELECT symbol, r_3m AS r3, r_4m AS r4, above_ema50 AS ema, (0.2::DOUBLE + 0.4::DOUBLE * {_AROUND('0.70')} + 0.6::DOUBLE * {_AROUND('0.90')}) * {_FIT} * {_GATE} * (0.734629::DOUBLE + (1 - 0.734629::DOUBLE) * {_LEVEL}) AS r2,
  r_1m * quality AS r1_pos, least(fall, 30) + pow(greatest(fall - 30, 0), 2) / (70 * 70) * 70 AS dd, least(vol0, cap) + pow(greatest(vol0 - cap, 0), 1.5::DOUBLE) AS vol,
  CASE WHEN quality < 0.5::DOUBLE AND r_1m > 0.3::DOUBLE AND NOT (r_10d > 0 AND ema20_slope_10d > 0) THEN r_1m ELSE 0 END AS r1_neg, ema20_slope_10d AS slope, greatest(-ema20_curv_20d, 0) AS reward, greatest(ema20_curv_20d, 0) AS penalty,
  r_10d + 0.5::DOUBLE * r_5d AS recent, CASE WHEN quality >= 0.5::DOUBLE AND r_10d < 0 THEN -r_10d ELSE 0 END AS brk, down_streak_5d AS down5, under_ema20_depth AS depth, under_ema20_days AS days FROM q)
SELECT symbol, round(0.46869::DOUBLE * {_z('r3')} + 0.417409::DOUBLE * {_z('r4')} + 0.505669::DOUBLE * {_z('r2')} + 0.323264::DOUBLE * {_z('ema')}
  + 0.445971::DOUBLE * (0.7::DOUBLE * {_z('slope')} + 0.3::DOUBLE * {_z('reward')} - 0.3::DOUBLE * {_z('penalty')}) + 0.228769::DOUBLE * {_z('recent')} + 0.270777::DOUBLE * {_z('r1_pos')}
  - 0.28298::DOUBLE * {_z('dd')} - 0.291973::DOUBLE * {_z('vol')} - 0.212139::DOUBLE * {_z('r1_neg')} - 0.228832::DOUBLE * {_z('brk')} - 0.186758::DOUBLE * {_z('down5')} - 0.19622::DOUBLE * {_z('depth')} - 0.097883::DOUBLE * {_z('days')}, 6) + 0.0 AS legacy_fms FROM t"""


@query(f"WITH {LEGACY}")
def legacy_score(spark, sf_dir):
    return I.rounded(S.legacy_score(_features(spark, sf_dir)).select("symbol", "legacy_fms"))


_CASH = f"((1 - {_ss('r_3m', '0.01::DOUBLE', '0.05::DOUBLE')}) * (1 - {_ss('vol20_ann', '0.005::DOUBLE', '0.03::DOUBLE')}) * {_ss('r2_3m', '0.95::DOUBLE', '0.99::DOUBLE')})"
#: Weight and direction of each axis.
_AXES = {
    "r2_3m": "0.8464267343631183::DOUBLE",
    "dd_recovery": "0.6013072809914602::DOUBLE",
    "trend_quality_21d": "0.35431695139125063::DOUBLE",
    "jump_discontinuity_3m": "-0.2790170661950331::DOUBLE",
    "under_ema20_days": "-0.19660351882982424::DOUBLE",
    "r_3m": "0.18698290479370505::DOUBLE",
    "stale_age": "-0.18175252387780497::DOUBLE",
    "up_streak_5d": "0.1079152553498922::DOUBLE",
    "trend_efficiency_reward_15d": "0.10776592373907062::DOUBLE",
    "range_compression_20d": "-0.10416888196208451::DOUBLE",
}
_zs = lambda c: f"least(4, greatest(-4, (coalesce({c}, median({c}) OVER ()) - avg({c}) OVER ()) / stddev_pop({c}) OVER ()))"
SPARSE = f"""{FEATURES}, raw AS (SELECT symbol, coalesce({_CASH}, 0) AS cash, {', '.join(f"CASE WHEN count({c}) OVER () >= 2 AND stddev_pop({c}) OVER () > 1e-12 THEN {w} * {_zs(c)} ELSE 0 END AS {c}" for c, w in _AXES.items())} FROM features),
parts AS (SELECT symbol, cash, {', '.join(c if c == 'r_3m' else f"CASE WHEN {c} > 0 THEN {c} * (1 - cash) ELSE {c} END AS {c}" for c in _AXES)} FROM raw)"""


@query(f"WITH {SPARSE} SELECT symbol, round({' + '.join(_AXES)}, 6) + 0.0 AS sparse_fms FROM parts")
def sparse_score(spark, sf_dir):
    return I.rounded(S.sparse_score(_features(spark, sf_dir)).select("symbol", "sparse_fms"))


@query(f"WITH {SPARSE} SELECT symbol, {', '.join(f'round({c}, 6) + 0.0 AS part_{c}' for c in _AXES)} FROM parts")
def sparse_axis_parts(spark, sf_dir):
    found = S.sparse_parts(_features(spark, sf_dir))
    return I.rounded(found.select("symbol", *[c for c in found.columns if c.startswith("part_")]), finer=())


#: Each family's score by its definition; :name stands for a parameter.
_X = {
    "recent": "seg_ret_0_5", "mid": "seg_ret_5_21", "prior": "seg_ret_21_63", "support": "prior_support_sign", "jump": "greatest(jump_discontinuity_3m, 0)", "stale": "greatest(stale_age, 0)",
    "run": "greatest(stale_after_run, 0)", "share": "least(1, greatest(0, coalesce(recent_jump_share_5d, 0)))", "eff": "trend_efficiency_reward_15d", "breadth": "recent_up_days_5d / 5", "dip": "mid_dip_recovery",
}
_INPUT = f"x AS (SELECT symbol, r_3m AS r3m, r2_3m AS fit, vol20_ann AS vol, {', '.join(f'({c})::DOUBLE AS {k}' for k, c in _X.items())} FROM features)"
FORMULAS = {
    "floor_gated": f"{_sp('r3m - :r3m_floor')} * (1 + :w_r2 * fit) * (:w_recent * {_spow('recent', ':recent_pow')} + :w_mid * mid + :w_prior * prior * (1 + :support_boost * support) + :w_abs * {_ss('r3m', ':r3m_floor', ':r3m_full')} * r3m) / (1 + :w_jump * jump + :w_stale * stale)",
    "regime_switch": f"""{_sp('r3m - 0.005::DOUBLE')} * ((1 - {_ss('r3m', '(:weak_edge / 2)', ':weak_edge')}) * :a_recent_weak * {_spow('recent', ':pow_recent')}
  + {_ss('r3m', ':weak_edge', ':strong_edge')} * (:a_recent_strong * {_spow('recent', ':pow_recent')} + :a_prior_strong * prior * (0.5::DOUBLE + support) + 0.5::DOUBLE * mid) + :a_smooth * fit * {_ss('r3m', ':weak_edge', ':strong_edge')})
  / (1 + :b_vol * (1 - {_ss('r3m', '0.005::DOUBLE', '0.03::DOUBLE')}) * (1 - {_ss('vol', '0.005::DOUBLE', '0.04::DOUBLE')}) + :c_jump * jump)""",
    "product_confirmation": f"pow({_sp('recent')} + :eps, :a_recent) * pow({_sp('mid')} + :eps, :a_mid) * pow({_sp('prior * support')} + :eps, :a_prior) * pow({_sp('r3m - :floor')} + :eps, :a_abs) * (1 + :w_eff * {_sp('eff')}) / ((1 + :w_jump * jump) * (1 + :w_stale * stale))",
    "hybrid_sqrt_log": f"{_sp('r3m - :floor / 2')} * (:c0 * recent * recent * sign(recent) + sqrt(greatest(:c1 + mid, 1e-8)) * prior * (0.5::DOUBLE + support) + :c2 * {_sp('r3m - :floor')} - :c3 * ln(1 + 1.23::DOUBLE * jump)) / pow(1 + :c4 * stale, :pow_den)",
    "pullback_continuation": f"""{_sp('r3m - :floor / 2')} * (:w_recent * {_spow('recent', ':pow_recent')} + :w_mid_pos * {_sp('mid')} + :w_mid_neg_forgive * dip * support + :w_prior * prior * (0.5::DOUBLE + support)
  + :w_abs * {_sp('r3m - :floor')} + :w_breadth * breadth + :w_eff * {_sp('eff')}) / (1 + :w_stale_run * run + :w_jump_share * {_sp('share - 0.55::DOUBLE')})""",
    "anti_stale_run": f"""pow({_sp('r3m - :floor')}, :a_abs) * pow({_sp('recent')}, :a_recent) * pow({_sp('prior')} * (0.5::DOUBLE + support) + :eps, :a_prior) * (1 + :w_mid * {_sp('mid')}) * (1 + :a_r2 * fit) * (0.4::DOUBLE + 0.6::DOUBLE * breadth)
  * (0.25::DOUBLE + 0.75::DOUBLE * (1 - {_ss('run', ':stale_edge0', ':stale_edge1')})) * (0.25::DOUBLE + 0.75::DOUBLE * (1 - {_ss('share', ':jump_edge0', ':jump_edge1')}))""",
}


def _filled(name: str) -> str:
    out = FORMULAS[name]
    for k, v in sorted(S.FAMILIES[name].middle.items(), key=lambda kv: -len(kv[0])):
        out = out.replace(f":{k}", f"{v!r}::DOUBLE")
    return out


def _family(name: str):
    def run(spark, sf_dir):
        one = S.family(name)
        return I.rounded(_features(spark, sf_dir).select("symbol", one.score(one.middle).alias("score")), 8, finer=())

    QUERIES[f"family_{name}"] = run
    ORACLE[f"family_{name}"] = f"WITH {FEATURES}, {_INPUT} SELECT symbol, round({_filled(name)}, 8) + 0.0 AS score FROM x"


for _name in FORMULAS:
    _family(_name)


#: Averages and runs over the whole series; the last 120 bars of them.
_WHOLE = f"""{I.PRICES}, {I.aligned()},
b AS (SELECT symbol, date, close AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM aligned WHERE close > 0),
v AS (SELECT *, lp - lag(lp) OVER w AS r, lp - lag(lp, 3) OVER w AS rise, max(CASE WHEN rn <= 21 THEN p END) OVER (PARTITION BY symbol) AS high21 FROM (SELECT *, ln(p) AS lp FROM b WHERE rn <= 64) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
e AS (SELECT x.symbol, x.rn, any_value(x.p) AS p, sum(y.p * CASE WHEN y.rn = y.n THEN pow(19/21::DOUBLE, y.n - x.rn) ELSE 2/21::DOUBLE * pow(19/21::DOUBLE, y.rn - x.rn) END) AS e20 FROM b x JOIN b y ON x.symbol = y.symbol AND y.rn >= x.rn WHERE x.rn <= 120 GROUP BY 1, 2)"""
_slope = lambda w, f="slope": f"regr_{f}(lp, -rn) FILTER (rn <= {w})"
_SHORT = {}
for _w in (10, 15, 20):
    _SHORT |= {f"log_slope_{_w}d": _slope(_w), f"trend_r2_{_w}d": _slope(_w, "r2"), f"trend_quality_{_w}d": f"{_slope(_w)} * {_slope(_w, 'r2')}"}
_SHORT |= {
    "r_3d_log": Q._TREND["r_3d_log"],
    "recovery_3d_vs_prior7": Q._TREND["recovery_3d_vs_prior7"],
    **{f"trend_efficiency_{k}d": Q._eff(k) for k in (10, 15, 20)},
    "trend_efficiency_reward_15d": f"greatest({Q._eff(15)}, 0)",
    "trend_inefficiency_15d": f"greatest(0.2::DOUBLE - {Q._eff(15)}, 0)",
    "downside_rms_10d": Q._down(10),
    "downside_rms_20d": Q._down(20),
    "worst_log_return_20d": "min(r) FILTER (rn <= 20)",
    "post_spike_stall_3m": f"greatest(max(rise) FILTER (rn >= 16), 0) * greatest(arg_max(lp, rise * 1000 + rn * 1e-9) FILTER (rn >= 16 AND rise IS NOT NULL) - {Q._at(0, 'lp')}, 0)",
    "stale_age": Q._PATHS["stale_age"],
}
_AVERAGED = {
    "ema20_slope_3d": "regr_slope(ln(e20), -rn) FILTER (rn <= 4)",
    "ema20_accel_3d_vs_10d": "regr_slope(ln(e20), -rn) FILTER (rn <= 4) - regr_slope(ln(e20), -rn) FILTER (rn <= 10)",
    "price_vs_ema20": f"{Q._at(0)} / {Q._at(0, 'e20')} - 1",
    "under_ema20_streak": "coalesce(min(rn) FILTER (NOT p < e20 * (1 - 1e-12)) - 1, count(*))",
}
_FINER = ("slope", "accel", "recovery_3d", "quality", "post_spike")
_round = lambda k: f"round({k}, {6 + 2 * any(x in k for x in _FINER)}) + 0.0 AS {k}"


@query(f"WITH {_WHOLE}, one AS (SELECT symbol, {_list(_SHORT)} FROM v GROUP BY symbol), two AS (SELECT symbol, {_list(_AVERAGED)} FROM e GROUP BY symbol) SELECT symbol, {', '.join(map(_round, [*_SHORT, *_AVERAGED]))} FROM one JOIN two USING (symbol)")
def short_horizon_features(spark, sf_dir):
    found = G.short_horizon(P.align(P.clean(I.prices(spark, sf_dir))))
    return I.rounded(found.drop("panel_id"), finer=_FINER)


@query(f"""WITH {FEATURES}, c AS (SELECT symbol, {_CASH} AS strength FROM features) SELECT count(*) AS n, count(*) FILTER (strength > 0) AS n_cash, round(max(coalesce(strength, 0)), 6) + 0.0 AS most FROM c""")
def cash_like(spark, sf_dir):
    found = _features(spark, sf_dir).select(S.cash_strength().alias("strength"))
    return I.rounded(found.agg(F.count("*").alias("n"), F.count_if(F.col("strength") > 0).alias("n_cash"), F.max("strength").alias("most")))
