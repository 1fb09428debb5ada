"""Prices are dealt by symbol once, to partitions of bounded length."""

from pyspark.sql import functions as F
from tickerloom.operators import panel as P
from tickerloom.plans import inputs as I


def test_prices_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(I, "PART_ROWS", 1000)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    prices = I.prices(spark, "/root/testdata/sf0.001")
    panel = P.align(P.clean(prices))
    plan = prices.groupBy("symbol").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and panel.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-rows // 1000))
