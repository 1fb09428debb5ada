"""The panel, features, scores and filter, against plain Python and the properties that a scan must have."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import features as G
from tickerloom.operators import panel as P
from tickerloom.operators import snapshot as K
from tickerloom.operators.score import DISQUALIFIED, LegacyParams, alive_pullback, cash_strength, family, legacy_score, sparse_score
from tickerloom.operators.tradeability import filter_details, tradeability

MONDAY = dt.date(2024, 1, 1)


def weekdays(n, start=MONDAY):
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(1)
    return out


def prices(spark, paths, start=MONDAY, panel="p"):
    rows = [(panel, s, d, None if c is None else float(c)) for s, path in paths.items() for d, c in zip(weekdays(len(path), start), path)]
    return spark.createDataFrame(rows, "panel_id string, symbol string, date date, close double")


def walk(drift, noise, n=180, seed=1, crashes=()):
    rng, p, out = random.Random(seed), 100.0, []
    for k in range(n):
        p *= math.exp(drift + rng.gauss(0, noise)) * (1 + dict(crashes).get(k, 0))
        out.append(p)
    return out


PATHS = {
    "TREND_UP": walk(0.004, 0.002),
    "MILD_UP": walk(0.0015, 0.002, seed=2),
    "FLAT": walk(0.0, 0.002, seed=3),
    "CRASHY": walk(0.001, 0.01, seed=4, crashes=((165, -0.35), (168, -0.32), (170, -0.1), (172, -0.09), (174, -0.11), (176, -0.08))),
}


def candles(spark, paths):
    rows = [(s, d, c * 1.01, (min(c, prev) if s == "CRASHY" else c) * 0.99, c) for s, path in paths.items() for d, c, prev in zip(weekdays(len(path)), path, [path[0], *path])]
    return spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double")


def test_golden_order(spark):
    found = K.ranked(K.snapshot(prices(spark, PATHS), candles(spark, PATHS))).collect()
    assert [r.symbol for r in found] == ["TREND_UP", "MILD_UP", "FLAT", "CRASHY"]
    assert found[-1].fms == DISQUALIFIED and found[-1].filter_status != "normal"
    assert all(r.filter_status == "normal" for r in found[:-1])


def test_alignment(spark):
    rows = [("p", "A", d, 1.0 + k) for k, d in enumerate(weekdays(8)) if k != 3] + [("p", "A", dt.date(2024, 1, 6), 99.0)]
    rows += [("p", "B", d, 5.0) for d in weekdays(10)] + [("p", "C", weekdays(10)[9], 7.0)]
    df = spark.createDataFrame(rows, "panel_id string, symbol string, date date, close double")
    got = {(r.symbol, r.date): r.close for r in P.align(df, 0.5).collect()}
    days = weekdays(10)
    assert {s for s, _ in got} == {"A", "B"}  # C has a tenth of the grid
    assert [got["A", d] for d in days] == [1, 2, 3, 3, 5, 6, 7, 8, None, None]  # filled inside, clipped at its end, no weekend
    assert P.align(df.where("false")).count() == 0


def test_another_market_does_not_move_scores(spark):
    a = {"A": walk(0.002, 0.01, 120, 5)}
    alone = K.snapshot(prices(spark, a)).first().fms
    longer = prices(spark, a).unionByName(prices(spark, {"B": walk(0.001, 0.01, 121, 6)}))
    assert {r.symbol: r.fms for r in K.snapshot(longer).collect()}["A"] == pytest.approx(alone, abs=1e-12)


def plain(p):
    """A few features by their definitions."""
    v = [x for x in p if x is not None and x > 0][-63:]
    n = len(v)
    back = lambda k: v[n - 1 - k] if n > k else None
    lp = [math.log(x) for x in v]
    r = [b - a for a, b in zip(lp, lp[1:])]
    out = {f"r_{k}d_log": math.log(back(0) / back(k)) if n > k else None for k in (3, 5, 10, 21)}
    for name, (a, b) in G.SEGMENTS.items():
        far = min(b, n - 1)
        out[f"seg_ret_{name}"] = back(a) / back(far) - 1 if n >= 3 and far > a else None
    e = [v[0]] if n else []
    for x in v[1:]:
        e.append(x if x == e[-1] else 2 / 21 * x + 19 / 21 * e[-1])
    below = [x < y * (1 - 1e-12) for x, y in zip(v, e)]
    run = 0
    for b in below:
        run = run + 1 if b else 0
    out["under_ema20_streak"] = run if n else None
    for w in (10, 15, 20):
        some = r[-w:]
        path = sum(map(abs, some))
        out[f"trend_efficiency_{w}d"] = (sum(some) / path if path else 0.0) if n > w else None
    high = max(v[-21:], default=None)
    touch = next((k for k, x in enumerate(v[-21:]) if x >= high - 1e-12), None) if n else None
    out["stale_age"] = (len(v[-21:]) - 1 - touch) * max(max(r[-21:-3]), 0) if n >= 25 else None
    out["worst_log_return_20d"] = min(r[-20:], default=None)
    ups = [x for x in r[-5:] if x > 0]
    out["recent_up_days_5d"] = len(ups) if len(r) >= 3 else None
    out["recent_jump_share_5d"] = max(ups) / sum(ups) if len(r) >= 3 and sum(ups) > 1e-12 else None
    diffs = [b - a for a, b in zip(v, v[1:])][-4:]
    best = now = 0
    for x in diffs:
        now = now + 1 if x > 0 else 0
        best = max(best, now)
    out["up_streak_5d"] = best if n >= 6 else 0
    top, falls = 0.0, []
    for x in v:
        top = max(top, x)
        falls.append(x / top - 1)
    out["max_dd_pct"] = min(falls, default=None) * 100 if n else None
    return out


def test_features_of_short_and_odd_histories(spark):
    paths = {f"S{n}": walk(0.001, 0.02, n, n) for n in (1, 2, 3, 4, 6, 11, 22, 24, 25, 40, 41, 62, 63, 64, 90)}
    paths |= {"FLAT": [5.0] * 70, "STAIR": [5.0 + k // 9 for k in range(70)], "NONE": [None] * 30, "BAD": [3.0, -1.0, 4.0, 0.0, 5.0, float("nan"), 6.0, float("inf")]}
    df = prices(spark, paths).withColumn("panel_id", F.col("symbol"))
    got = {r.symbol: r for r in G.features(df).collect()}
    assert set(got) == set(paths)
    for s, path in paths.items():
        for name, want in plain([x for x in path if x is None or math.isfinite(x)]).items():
            have = got[s][name]
            assert have is None if want is None else have == pytest.approx(want, abs=1e-12), (s, name)
    flat = got["FLAT"]
    assert flat.trend_r2_10d == 1 and flat.log_slope_10d == 0 and flat.r2_3m == 0 and flat.trend_efficiency_10d == 0
    assert got["NONE"].n_bars == 0 and got["NONE"].r_3m is None
    scores = {r.symbol: r.fms for r in G.features(df).withColumn("fms", alive_pullback()).select("symbol", "fms").collect()}
    assert all(math.isfinite(x) for x in scores.values())


def test_deltas_are_the_scores_of_shorter_panels(spark):
    a = {"A": walk(0.002, 0.01, 120, 5), "B": walk(0.0, 0.01, 120, 6)}
    got = {r.symbol: r for r in K.deltas(prices(spark, a)).collect()}
    for cut, name in ((1, "d1"), (5, "d5")):
        then = {r.symbol: r.fms for r in K.snapshot(prices(spark, {s: p[:-cut] for s, p in a.items()})).collect()}
        for s in a:
            assert got[s][name] == pytest.approx(got[s].fms - then[s], abs=1e-12)


def test_tradeability_branches(spark):
    quiet = [100.0 + k % 3 * 0.1 for k in range(80)]
    days = weekdays(80)
    rows = lambda s, change: [(s, d, *change(k, c * 1.01, c * 0.99, c)) for k, (d, c) in enumerate(zip(days, quiet))]
    data = rows("QUIET", lambda k, h, lo, c: (h, lo, c)) + rows("SPIKE", lambda k, h, lo, c: (h * 1.4 if k == 70 else h, lo, c))
    data += rows("OLD_SPIKE", lambda k, h, lo, c: (h * 1.4 if k == 5 else h, lo, c)) + rows("FALLS", lambda k, h, lo, c: (h, c * 0.9 if k >= 76 else lo, c))
    data += rows("THREE", lambda k, h, lo, c: (h, c * 0.9 if k >= 77 else lo, c)) + rows("ZERO", lambda k, h, lo, c: (0.0, 0.0, c) if k == 70 else (h, lo, c))
    data += rows("SHORT", lambda k, h, lo, c: (h, lo, c))[:40] + rows("NULLS", lambda k, h, lo, c: (None, lo, c) if k == 70 else (h, lo, c))
    ohlc = spark.createDataFrame(data, "symbol string, date date, high double, low double, close double")
    wanted = spark.createDataFrame([(s,) for s in ("QUIET", "ABSENT", "SPIKE")], "symbol string")
    got = {r.symbol: r.disqualified for r in tradeability(ohlc).collect()}
    assert got == {"QUIET": False, "SPIKE": True, "OLD_SPIKE": False, "FALLS": True, "THREE": False, "ZERO": False, "SHORT": True, "NULLS": False}
    assert {r.symbol: r.disqualified for r in tradeability(ohlc, wanted).collect()} == {"QUIET": False, "ABSENT": True, "SPIKE": True}
    details = {r.symbol: r for r in filter_details(ohlc).collect()}
    assert len(details["SPIKE"].extreme) == 1 and len(details["FALLS"].severe) == 4 and not details["QUIET"].extreme


def test_fx(spark):
    days = weekdays(6)
    fx = spark.createDataFrame([(d, 1300.0 + k, 130.0, None if k == 0 else 7.8) for k, d in enumerate(days)] + [(dt.date(2024, 1, 6), 9.0, 9.0, 9.0)], "date date, usdkrw double, usdjpy double, usdhkd double")
    got = {(r.market, r.date): r.rate for r in P.fx_crosses(fx).collect()}
    assert got["JPN", days[2]] == pytest.approx(1302 / 130) and got["HKG", days[2]] == pytest.approx(1302 / 7.8)
    assert ("HKG", days[0]) not in got and ("USA", dt.date(2024, 1, 6)) not in got
    rows = spark.createDataFrame([("USA", "A", days[0], 1.0), ("USA", "A", days[2], 2.0), ("KOR", "K", days[0], 3.0), ("JPN", "J", days[0], 4.0)], "market string, symbol string, date date, close double")
    rates = spark.createDataFrame([("USA", days[0], 10.0), ("USA", days[1], 20.0)], "market string, date date, rate double")
    keep = {(r.symbol, r.date): r.close for r in P.convert(rows, rates, drop_missing=False).collect()}
    assert keep == {("A", days[0]): 10.0, ("A", days[2]): 20.0, ("K", days[0]): 3.0, ("J", days[0]): 4.0}
    assert {r.symbol for r in P.convert(rows, rates).collect()} == {"A", "K"}


def test_other_scores(spark):
    found = G.features(prices(spark, PATHS)).cache()
    assert LegacyParams().with_values(w_dd=2.0).w_dd == 2.0
    with pytest.raises(TypeError):
        LegacyParams().with_values(nothing=1.0)
    with pytest.raises(KeyError):
        family("nothing")
    legacy = {r.symbol: r.legacy_fms for r in legacy_score(found).collect()}
    assert legacy["TREND_UP"] > legacy["CRASHY"]
    gated, free = ({r.symbol: r.sparse_fms for r in sparse_score(found, gate=g).collect()} for g in (True, False))
    assert all(gated[s] <= free[s] + 1e-12 for s in gated)
    cash = spark.createDataFrame([(0.0, 0.001, 0.999), (0.2, 0.3, 0.5), (0.0, None, 0.999)], "r_3m double, vol20_ann double, r2_3m double")
    assert [round(r[0], 6) for r in cash.select(cash_strength()).collect()] == [1.0, 0.0, 0.0]
