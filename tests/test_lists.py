"""Lists, ranks, fits, sources, streams, and what the package must and must not import."""

import ast
import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import cache as C
from tickerloom.operators import calibrate
from tickerloom.operators import lists as L
from tickerloom.operators import ranking as R
from tickerloom.operators.score import FAMILIES
from tickerloom.sources import market
from tickerloom.streaming import bars

ROOT = Path(__file__).parent.parent


def test_only_the_entry_point_knows_the_llm_subpackage():
    for path in [*ROOT.glob("tickerloom/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_screens(spark):
    rows = [("A", "$1,200.5", "300,000", "5%", "1000"), ("B", "9", "400000", "5%", "1"), ("C", "20", "x", "5%", "1"), ("D", "20", "400000", "-1%", "1"), ("E", "20", "400000", "1%", "21")]
    df = spark.createDataFrame(rows, "ticker string, price string, avg_volume string, perf_quarter string, sma50 string")
    assert [r.ticker for r in L.screened(df).collect()] == ["A"]
    assert {r.ticker for r in L.screened(df.drop("perf_quarter", "sma50", "avg_volume")).collect()} == {"A", "C", "D", "E"}
    tickers = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    assert [r.ticker for r in L.repaired(tickers("AAAPL", "MMSFT", "IBM", "11X")).collect()] == ["AAPL", "MSFT", "IBM", "11X"]
    assert [r.ticker for r in L.repaired(tickers("AAAPL", "AAPL", "MMM")).collect()] == ["AAAPL", "AAPL", "MMM"]
    html = spark.createDataFrame([("#1 / 1,090 Total",), ("1 of 45",), ("none",)], "h string")
    assert [r[0] for r in html.select(L.page_total(F.col("h"))).collect()] == [1090, 45, None]
    assert spark.range(1).select(L.effective_pages(F.lit(3), F.lit(1090)), L.effective_pages(F.lit(0), F.lit(45)), L.effective_pages(F.lit(4), F.lit(None).cast("long"))).first()[:] == (3, 3, 4)


def test_lists(spark):
    frame = lambda *rows: spark.createDataFrame([(s, n, k) for k, (s, n) in enumerate(rows)], "symbol string, name string, ord int")
    union = L.first_wins(frame(("B", "b"), ("A", "a"), ("B", "later")), frame(("C", "c"), ("A", "other")))
    assert [(r.symbol, r.name) for r in union.orderBy("ord").collect()] == [("B", "b"), ("A", "a"), ("C", "c")]
    names = L.with_aliases(frame(("005930.KS", " S "), ("000660.KS", "H"), ("000660.KQ", "Q"), ("", "x")))
    assert {(r.symbol, r.name) for r in names.collect()} == {("005930.KS", "S"), ("005930.KQ", "S"), ("000660.KS", "H"), ("000660.KQ", "Q")}
    assert {r.symbol for r in L.imported(frame((" A ", ""), ("nan", ""), ("", ""), ("A", ""))).collect()} == {"A"}
    with pytest.raises(ValueError):
        L.imported(names.drop("symbol"))


def test_rank_metrics_by_hand(spark):
    scores = lambda *s: spark.createDataFrame([(chr(65 + k), k + 1, float(x)) for k, x in enumerate(s)], "symbol string, true_rank int, score double")
    r = R.rank_metrics(scores(4, 3, 2, 1)).first()
    assert (r.inversion, r.pair_error, r.rho) == (0.0, 0.0, 1.0)
    r = R.rank_metrics(scores(1, 2, 3)).first()
    assert (r.inversion, r.rho) == (1.0, -1.0) and r.pair_error == pytest.approx((2 + 2 + 4) / 3)
    assert R.top_recall(scores(1, 9, 8, 7, 6)).first()[:] == (5, 1, 0.0)
    assert [r.rank_average for r in R.rank_methods(scores(5, 5, 1)).orderBy("symbol").collect()] == [1.5, 1.5, 3.0]


def test_pairwise_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    rank = np.argsort(np.argsort(-(x @ np.array([2.0, 1.0, 0.0, 0.0])))) + 1
    w = calibrate.fit_pairwise(x, rank, 0.01)
    assert w[0] > w[1] > 0.3 and w[2:].max() < 0.2 and R.metrics_of(rank, x @ w)[0] < 0.05
    # at the bounds the gradient points outward, inside it vanishes
    i, j = np.triu_indices(60, 1)
    swap = rank[i] > rank[j]
    d = x[np.where(swap, j, i)] - x[np.where(swap, i, j)]
    g = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 0.01 + 2 * calibrate.RIDGE * w
    assert all(abs(a) < 5e-3 if 0 < b < calibrate.MOST else a > -5e-3 if b == 0 else a < 5e-3 for a, b in zip(g, w))
    z = np.column_stack([x[:, 0] + 0.05 * x[:, 2], x[:, 0], x[:, 1], np.ones(60)])
    assert calibrate.pruned(z, rank) in ([0, 2], [1, 2])  # one of two that are nearly the same, and no constant
    model = calibrate.fit_model(np.where(x > 3, np.nan, x), rank, ["a", "b", "c", "d"], np.ones(4), "monotone_gam", 0.01)
    assert R.metrics_of(rank, model(x))[0] < 0.1 and len(model.weights) <= calibrate.TERMS


def test_rank_metrics_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 60):
        score, rank = rng.integers(0, n + 1, n).astype(float), rng.permutation(n) + 1
        inversion, error, rho = R.metrics_of(rank, score)
        if n < 2:
            assert (inversion, error, rho) == (0, 0, 1)
            continue
        order = np.argsort(rank)
        s, model = score[order], np.empty(n)
        model[np.argsort(-s, kind="stable")] = np.arange(1, n + 1)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert inversion == pytest.approx(np.mean([s[i] < s[j] for i, j in pairs]))
        assert error == pytest.approx(np.mean([abs((j - i) - (model[j] - model[i])) for i, j in pairs]))
        assert rho == pytest.approx(np.corrcoef(np.arange(n), model)[0, 1])
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 2, None), ("c", 30, 0.5)], "symbol string, true_rank int, score double")
    assert R.rank_metrics(rows).first()[:] == (0.0, 0.0 + abs(29 - 1), 1.0)
    assert R.rank_metrics(rows.where("false")).count() == 0


def test_nested_validation_finds_what_ranks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    features = spark.createDataFrame([(f"s{k:02}", *map(float, r)) for k, r in enumerate(x)], "symbol string, f double, g double, h double")
    ranking = spark.createDataFrame([(f"s{k:02}", int(r) + 1) for r, k in enumerate(np.argsort(-x[:, 0]))], "symbol string, true_rank int")
    found = calibrate.nested_validation(features, ranking, {"f": 1, "g": 1, "h": -1}, repeats=1)
    summary = calibrate.validation_summary(found)
    rows = {r.kind: r for r in summary.collect()}
    assert set(rows) == set(calibrate.DESIGNS) and all(r.splits == 5 and r.inversion_median < 0.1 for r in rows.values())
    assert calibrate.chosen_kind(summary, band=1.0).first().kind == "sparse_linear"


def test_legacy_sweep_is_the_score_of_each_set(spark):
    from tickerloom.operators import score as S

    rng = np.random.default_rng(9)
    rows = [(f"s{k:02}", *map(float, rng.normal(0.1, 0.2, len(S.LEGACY_COLUMNS)))) for k in range(30)]
    features = spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{c} double" for c in S.LEGACY_COLUMNS))
    sets = [S.LegacyParams(), S.LegacyParams().jittered(np.random.default_rng(1)), S.LegacyParams().with_values(vol_q_pct=50.0)]
    swept = {(r.param_id, r.symbol): r.score for r in S.legacy_sweep(features, sets).collect()}
    for k, q in enumerate(sets):
        for r in S.legacy_score(features, q=q).collect():
            assert swept[k, r.symbol] == pytest.approx(r.legacy_fms, abs=1e-9)
    ranking = features.select("symbol").orderBy("symbol").withColumn("true_rank", F.substring("symbol", 2, 2).cast("int") + 1)
    found = calibrate.legacy_search(features, ranking, sets).collect()
    assert len(found) == 3 and not [r for r in found if r.param_id == 0][0].dominates


def test_validation_and_variants(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(24, 2))
    order = np.argsort(-x[:, 0])
    z = spark.createDataFrame([(f"s{k:02}", float(a), float(b)) for k, (a, b) in enumerate(x)], "symbol string, f double, g double")
    ranking = spark.createDataFrame([(f"s{k:02}", r + 1) for r, k in enumerate(order)], "symbol string, true_rank int")
    validated = calibrate.cross_validated(z, ranking, [0.0, 0.5])
    rows = validated.collect()
    assert len(rows) == 8 and np.mean([r.test for r in rows if r.l1 == 0]) < 0.1
    assert calibrate.choose_l1(validated.where("l1 = 0")).first().l1 == 0
    found = {r.feature: r for r in calibrate.stability(calibrate.weights(z, ranking, 0.0, 3)).collect()}
    assert found["f"].chosen == 1 and found["f"].weight > found["g"].weight
    assert calibrate.leave_one_out(z, ranking, 0.0).count() == 24
    variants = calibrate.label_variants(ranking, [("s00", "s01")]).groupBy("variant").agg(F.countDistinct("symbol").alias("n")).collect()
    assert {(r.variant, r.n) for r in variants} == {(0, 24), (1, 24)}
    family = FAMILIES["product_confirmation"]
    rows = calibrate.parameter_sets(spark, family, 50, 1).collect()
    assert len(rows) == 50 and all(lo <= r[f"q_{k}"] <= hi for r in rows for k, (lo, hi) in (family.even | family.logarithmic).items())
    with pytest.raises(ValueError):
        calibrate.label_variants(ranking, [("s00", "s01")] * 13)


def test_cache(spark):
    day = dt.date(2024, 1, 10)
    wanted = spark.createDataFrame([(c,) for c in "ABCDEFG"], "symbol string")
    cached = spark.createDataFrame([("A", "1y", 180, day), ("B", "6mo", 300, day), ("C", "1y", 300, day), ("D", "2y", 300, day), ("E", "1y", 179, day), ("G", None, 200, day)], "symbol string, period string, n_bars int, last_date date")
    probe = spark.createDataFrame([("A", day), ("C", day + dt.timedelta(1)), ("B", day), ("G", day)], "symbol string, probe_date date")
    got = C.classify(wanted, cached, probe, "1y")
    assert {r.symbol: r.outcome for r in got.collect()} == {"A": "hit", "B": "period_miss", "C": "miss", "D": "stale_hit", "E": "period_miss", "F": "cold", "G": "hit"}
    assert C.outcome_counts(got).first().asDict() == {"hits": 2, "stale_hits": 1, "misses": 1, "cold_misses": 1, "period_misses": 2, "probes": 4}
    assert {r.symbol for r in C.classify(wanted, cached, probe, "3mo").where("outcome = 'period_miss'").collect()} == set()
    bars_ = lambda v: spark.createDataFrame([(s, v) for s in "AC"], "symbol string, v int")
    assert {(r.symbol, r.v) for r in C.refreshed(bars_(1), bars_(2), got).collect()} == {("A", 1), ("C", 2)}
    assert [C.least_period(), C.least_period(400, 30), C.least_period(600)] == ["2y", "2y", "5y"]


def test_fixed_tables(spark):
    t = lambda *rows: spark.createDataFrame(rows, "t string, n string")
    funds = t(("TQQQ", "x"), ("llyx", None), ("A", "Direxion Daily 3X"), ("A", "ProShares"), ("A", "Leverage fund"), ("ABCX", "plain"), ("KO", "Coca"), ("A", None))
    assert [r[0] for r in funds.select(L.leveraged(F.col("t"), F.col("n"))).collect()] == [True, True, True, True, True, False, False, False]
    tickers = lambda *x: [r.ticker for r in L.repaired(spark.createDataFrame([(v,) for v in x], "ticker string")).collect()]
    assert tickers("MMSFT", " AA ", "IBM", "") == ["MSFT", "A", "IBM"]
    assert tickers("MMSFT", "NVDA", "AA") == ["MMSFT", "NVDA", "AA"]
    assert L.label_floor(" Half +10% ") == 0.10
    L.check_labels({"perf_quarter": "Quarter Up"})
    with pytest.raises(KeyError):
        L.label_floor("Week Up")
    with pytest.raises(ValueError):
        L.check_labels({"perf_half": "Half +10%"})
    assert L.ordered_columns(["z", "fms", "symbol", "r_1m", "a", "mom"], formula="Z(mom) + 1") == ["symbol", "fms", "mom", "r_1m", "a", "z"]


def test_sources(spark, tmp_path):
    (tmp_path / "list.csv").write_text("﻿Symbol,Name\nB,b\nA,\n ,x\n", encoding="utf-8")
    assert [(r.symbol, r.name) for r in market.read_list(spark, f"{tmp_path}/list.csv").orderBy("ord").collect()] == [("B", "b"), ("A", None)]
    market.write_list(spark.createDataFrame([("B",), ("A",), ("B",)], "symbol string"), f"{tmp_path}/out")
    assert [r.symbol for r in market.read_list(spark, f"{tmp_path}/out").collect()] == ["A", "B"]
    scan = spark.createDataFrame([("A", 2.0), ("B", -1.0)], "symbol string, fms double")
    for ts in ("20240101", "20240102"):
        market.save_scan(scan, f"{tmp_path}/scans", "FREE", ts)
    assert [r.symbol for r in market.latest_scan(spark, f"{tmp_path}/scans", "FREE").collect()] == ["A"]
    assert market.scan_history(spark, f"{tmp_path}/scans").count() == 2
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, None), ("A", dt.date(2024, 1, 1), 1.0, None), ("B", dt.date(2024, 1, 1), 1.0, 2.0)], "symbol string, date date, close double, adj_close double")
    got, missing = market.Tables(rows).prices(spark.createDataFrame([("B",), ("X",)], "symbol string"))
    assert [(r.symbol, r.close) for r in got.collect()] == [("B", 2.0)] and [r.symbol for r in missing.collect()] == ["X"]
    assert [r.symbol for r in market.read_watchlist(spark, f"{tmp_path}/none", ("X", "Y")).collect()] == ["X", "Y"]
    market.update_list(scan, f"{tmp_path}/updated", "2024-01-01T10:00:00")
    assert market.is_fresh(spark, f"{tmp_path}/updated", "2024-01-01T15:59:00") and not market.is_fresh(spark, f"{tmp_path}/updated", "2024-01-01T16:01:00")
    assert not market.is_fresh(spark, f"{tmp_path}/never", "2024-01-01T16:01:00")
    both = market.read_universe(spark, {"usa": f"{tmp_path}/updated", "kor": f"{tmp_path}/list.csv", "hkg": f"{tmp_path}/none"})
    assert [r.symbol for r in both.orderBy("ord").collect()] == ["A", "B"] and market.read_universe(spark, {}, "IRP").count() == 0
    kinds = rows.select("symbol", "date", "close", F.lit("adj").alias("kind"))
    market.write_bars(kinds, f"{tmp_path}/bars")
    assert market.read_bars(spark, f"{tmp_path}/bars", "adj").count() == 3
    market.write_rates(spark.createDataFrame([("USA", dt.date(2024, 1, 1), 1300.0)], "market string, date date, rate double"), f"{tmp_path}/bars")
    assert market.read_bars(spark, f"{tmp_path}/bars", "adj").count() == 3 and market.read_bars(spark, f"{tmp_path}/bars", "fx").count() == 1
    market.purge(spark, f"{tmp_path}/bars")
    assert not market.exists(spark, f"{tmp_path}/bars")
    market.purge(spark, f"{tmp_path}/bars")


def test_streamed_bars(spark, tmp_path):
    ts = lambda day, hour: dt.datetime(2024, 1, day, hour)
    ticks = [("A", ts(1, 9), 1.0), ("A", ts(1, 12), 3.0), ("A", ts(1, 17), 2.0), ("A", ts(1, 17), 2.0), ("A", ts(20, 9), 5.0)]
    spark.createDataFrame(ticks, "symbol string, ts timestamp, price double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(f"{tmp_path}/in")
    query = bars.write_bars(bars.daily_bars(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.symbol, r.open, r.high, r.low, r.close) for r in got] == [("A", 1.0, 3.0, 1.0, 2.0)]
