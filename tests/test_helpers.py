"""Small helpers of fits, lists and scans, and the filter's components."""

import datetime as dt

import pytest
from tickerloom.operators import calibrate as C
from tickerloom.operators import lists as L
from tickerloom.operators import scan as N
from tickerloom.operators import tradeability as T
from tickerloom.operators.score import FAMILIES


def test_columns_that_a_fit_may_use(spark):
    assert C.candidate_columns(["r_1m", "rank", "true_rank", "r_4m", "symbol", "mine", "vol20_ann", "seg_ret_0_5", "r_6m"], ("mine",)) == ["mine", "r_1m", "seg_ret_0_5", "vol20_ann"]
    frame = spark.createDataFrame([(1.0, None, 2.0), (2.0, 3.0, None)], "a double, b double, c double")
    assert C.base_columns(frame, ["a", "b", "c"], 2) == ["a"] and C.base_columns(frame, ["a", "b", "c"], 1) == ["a", "b", "c"]


def test_older_names(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4)], "`Vol20(ann)` int, R_6M int, r_4m int, MaxDD_Pct int")
    assert C.with_known_names(frame).columns == ["vol20_ann", "r_6m", "r_4m", "max_dd_pct"]


def test_draws_stay_in_their_ranges():
    for family in FAMILIES.values():
        ranges = family.even | family.logarithmic
        for q in [family.middle, *family.draw(200, 3)]:
            assert set(q) == set(ranges) and all(ranges[k][0] <= v <= ranges[k][1] for k, v in q.items())
        assert family.draw(5, 3) == family.draw(5, 3) != family.draw(5, 4)


def test_the_shown_symbol(spark):
    scan = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "symbol string, fms double")
    assert N.selected(scan, "a") == "a" and N.selected(scan, "z") == "b" and N.selected(scan, None) == "b"
    assert N.selected(scan.where("false"), "a") is None


def test_limits_and_samples(spark):
    rows = spark.createDataFrame([("Too Many Requests",), ("Rate limited. Try later",), ("HTTP 429",), ("not found",), (None,)], "message string")
    assert rows.where(L.rate_limited(rows["message"])).count() == 3
    symbols = spark.createDataFrame([(f"s{k}",) for k in range(50)] * 2, "symbol string")
    one = [r["symbol"] for r in L.drawn(symbols, 10).collect()]
    assert len(set(one)) == 10 and one == [r["symbol"] for r in L.drawn(symbols.repartition(5), 10).collect()] and L.drawn(symbols, 99).count() == 50


def test_filter_components(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("a", day(k), 11.0, 9.0, 10.0) for k in range(70)]
    rows[40], rows[66], rows[69] = ("a", day(40), 14.0, 9.0, 10.0), ("a", day(66), 10.0, 8.0, 10.0), ("a", day(69), 0.0, 0.0, 10.5)
    rows += [("b", day(k), 11.0, 9.0, 10.0) for k in range(5)]
    rows += [("c", day(k), 11.0, 9.2 if k % 3 else 9.95, 10.0) for k in range(64)]
    got = {r["symbol"]: r for r in T.filter_components(spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double")).collect()}
    a = got["a"]
    assert (a["n_closes"], a["last_date"], a["prev_date"], a["last_close"], a["prev_close"]) == (70, day(69), day(68), 10.5, 10.0)
    assert (a["high"], a["low"], a["raw_high"], a["mended"]) == (11.0, 9.0, 0.0, True)
    assert (a["high_minus_low"], a["high_gap"], a["low_gap"], a["true_range"], a["true_range_pct"]) == pytest.approx((2.0, 1.0, 1.0, 2.0, 20.0))
    assert [(x["date"], x["pct"], x["prev_close"]) for x in a["extreme"]] == [(day(40), 50.0, 10.0)]
    assert a["severe"] is not None and len(a["severe"]) >= 4
    assert got["b"]["n_closes"] == 5 and got["b"]["true_range"] is None and got["b"]["extreme"] is None
    assert len(got["c"]["severe"]) == sum(1 for k in range(44, 64) if k % 3) and all(x["pct"] == -8.0 for x in got["c"]["severe"])
