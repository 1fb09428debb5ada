"""Flags of a scan's symbols, and sums of money."""

import datetime as dt

from pyspark.sql import functions as F
from tickerloom.operators import snapshot as K
from tickerloom.plans import inputs as I


def test_a_scan_is_worked_out_once(spark):
    """Flagging doesn't gather the prices again for their symbols: they are read for spans and for bars, ohlc once."""
    prices = spark.createDataFrame([("a", "s", dt.date(2020, 1, 1), 1.0)], "panel_id string, symbol string, date date, close double")
    ohlc = spark.createDataFrame([("s", dt.date(2020, 1, 1), 1.0, 1.0, 1.0)], "symbol string, date date, high double, low double, close double")
    for scan in (K.snapshot(prices, ohlc), K.deltas(prices, ohlc)):
        plan = scan._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") == 3


def test_flags_of_known_unknown_and_missing_symbols(spark):
    found = spark.createDataFrame([("GOOD",), ("SHORT",), ("ABSENT",), (None,)], "symbol string")
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(80)]
    rows = [("GOOD", d, 10.1, 9.9, 10.0) for d in days] + [("SHORT", d, 10.1, 9.9, 10.0) for d in days[:9]] + [("OTHER", d, 30.0, 1.0, 10.0) for d in days]
    ohlc = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double")
    got = {r["symbol"]: (r["disqualified"], r["filter_status"]) for r in K.flagged(found, ohlc).collect()}
    assert got == {"GOOD": (False, "normal"), "SHORT": (True, "too few closes"), "ABSENT": (True, "too few closes"), None: (False, "normal")}


def test_money_is_the_sum_of_decimals(spark):
    rows = [(1, 1.005), (1, 2.675), (2, -0.125), (2, 0.1), (3, None), (4, 9e14), (4, 1.5), (5, 1e11), (5, 0.01), (6, None), (6, 12.34), (7, -0.001), (8, 1e9 / 3), (8, 2e9 / 7)]
    frame = spark.createDataFrame(rows, "g int, x double").groupBy("g").agg(I.money("x").alias("got"), F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("want"))
    assert all(r["got"] == r["want"] for r in frame.collect())
