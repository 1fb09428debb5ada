"""Patterns of a ranking, and the paths of a chart."""

import datetime as dt

import pytest
from tickerloom.operators import charts as H
from tickerloom.operators import patterns as N


def test_thirds_leave_the_rest_out(spark):
    for n, want in ((8, {"TOP": 2, "MID": 2, "BOT": 2, None: 2}), (1, {"TOP": 1}), (2, {"TOP": 1, "BOT": 1})):
        rows = spark.createDataFrame([(f"s{k}", k + 1, float(k)) for k in range(n)], "symbol string, true_rank int, f double")
        assert {r["grp"]: r["count"] for r in N.in_thirds(rows).groupBy("grp").count().collect()} == want


def test_contrasts_and_rules(spark):
    rows = [(f"s{k}", k + 1, 9.0 - k, float(k % 3) if k != 4 else None, None) for k in range(9)]
    frame = spark.createDataFrame(rows, "symbol string, true_rank int, f double, g double, none double")
    got = {r["feature"]: r for r in N.contrasts(frame).collect()}
    assert set(got) == {"f", "g"} and got["f"]["shape"] == "rising" and (got["f"]["top"], got["f"]["mid"], got["f"]["bot"], got["f"]["contrast"]) == (8.0, 5.0, 2.0, 6.0)
    rules = N.rules_table(spark, (("low", "f", "<=", 3.0, "BOT", 1.0), ("none", "f", ">", 99.0, "TOP", 0.0), ("g", "g", ">=", 2.0, "MID", 0.5), ("unknown", "h", "<", 1.0, "MID", 0.5)))
    found = {r["rule"]: (r["n"], r["n_met"], r["n_both"], r["holds"]) for r in N.rule_evidence(frame, rules).collect()}
    assert found == {"low": (9, 3, 3, True), "none": (9, 0, 0, False), "g": (8, 3, 1, False)}
    with pytest.raises(ValueError):
        N.rules_table(spark, (("bad", "f", "=", 1.0, "TOP", 0.1),))


def test_motion_follows_the_points(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    rows = [("a", d, 100.0 + (k * 7 % 11)) for k, d in enumerate(days)] + [("b", days[0], 5.0), ("b", days[1], 6.0)]
    panel = spark.createDataFrame(rows, "symbol string, date date, close double")
    points = {(r["symbol"], r["date"]): (r["vol"], r["y"]) for r in H.scatter(panel, 15, 40).collect()}
    frames = H.motion(panel, 4, 3, 15).collect()
    assert sorted(r["date"] for r in frames if r["symbol"] == "a") == days[-5:]
    for r in frames:
        at = [d for d in days if (r["symbol"], d) in points and d <= r["date"]][-4:]
        want = [(100 * points[r["symbol"], d][0], points[r["symbol"], d][1]) for d in at if None not in points[r["symbol"], d]]
        assert len(r["tail"]) == len(want) and all(tuple(p) == pytest.approx(w) for p, w in zip(r["tail"], want))
    pieces = {r["k"]: r for r in H.tail_segments(panel, 3, 15).where("symbol = 'a'").collect()}
    assert sorted(pieces) == [0, 1, 2] and all((pieces[k]["x"], pieces[k]["y"]) == (pieces[k - 1]["from_x"], pieces[k - 1]["from_y"]) for k in (1, 2))
    assert [pieces[k]["opacity"] for k in (0, 1, 2)] == pytest.approx([0.5, 0.5, 0.5])
    assert H.tail_segments(panel, 0, 15).count() == 0
