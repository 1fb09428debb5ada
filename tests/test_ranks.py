"""Positions, tiles and rank metrics across partitions and blocks."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tickerloom.operators import ranking as R
from tickerloom.operators.places import placed, running, tiled


def scored(spark, n: int, distinct: int, seed: int = 1, parts: int = 3):
    rng = np.random.default_rng(seed)
    score = rng.integers(0, distinct, n).astype(float)
    rank = np.argsort(np.argsort(-(score + rng.normal(size=n) * distinct / 5))) + 1
    return rank, score, spark.createDataFrame(pd.DataFrame({"symbol": [f"s{k:07d}" for k in range(n)], "true_rank": rank, "score": score})).repartition(parts)


@pytest.mark.parametrize("part_rows", [7, 50, 1000])
def test_positions_and_sums(spark, part_rows):
    _, _, rows = scored(spark, 200, 9)
    order = [F.desc("score"), F.col("symbol")]
    found = placed(rows, order, "place", part_rows).withColumn("want", F.row_number().over(Window.orderBy(*order)))
    assert found.where("place <> want").count() == 0 and found.count() == 200
    summed = running(rows, order, "upto", F.col("score"), part_rows).withColumn("want", F.sum("score").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    assert summed.where("upto <> want").count() == 0
    for n in (1, 3, 7, 199, 200, 300):
        assert tiled(rows, n, order, "tile", part_rows).withColumn("want", F.ntile(n).over(Window.orderBy(*order))).where("tile <> want").count() == 0
    assert placed(rows.where("score < 0"), order, "place", part_rows).count() == 0


@pytest.mark.parametrize(("block_rows", "part_rows"), [(10_000, 10_000), (130, 300), (17, 90)])
@pytest.mark.parametrize("distinct", [1, 5, 100_000])
def test_metrics_of_any_length(spark, block_rows, part_rows, distinct):
    rank, score, rows = scored(spark, 600, distinct)
    inversion, error, rho = R.metrics_of(rank, score)
    got = R.long_rank_metrics(rows.unionByName(rows.limit(3).withColumn("score", F.lit(None).cast("double"))), block_rows, part_rows).first()
    assert (got["inversion"], got["pair_error"]) == pytest.approx((inversion, error)) and got["rho"] == pytest.approx(rho)


def test_few_rows(spark):
    _, _, rows = scored(spark, 3, 2)
    for n in (0, 1):
        got = R.long_rank_metrics(rows.limit(n)).collect()
        assert [tuple(r) for r in got] == [(0.0, 0.0, 1.0)] * n


def test_200_000_rows_in_seconds(spark):
    rank, score, rows = scored(spark, 200_000, 1_000_000)
    start = time.monotonic()
    got = R.long_rank_metrics(rows, 30_000, 60_000).first()
    assert time.monotonic() - start < 120  # some seconds; the limit is for busy machines
    assert (got["inversion"], got["pair_error"], got["rho"]) == pytest.approx(R.metrics_of(rank, score))


def test_ranks_with_ties_and_nulls(spark):
    _, _, rows = scored(spark, 60, 4)
    rows = rows.withColumn("score", F.when(F.col("score") > 0, F.col("score")))
    found = R.rank_methods(rows).toPandas().sort_values("rank_first")
    assert found["rank_first"].tolist() == list(range(1, 61))
    want = found["score"].fillna(-1).rank(ascending=False, method="min")
    assert (found["rank_min"] == want).all() and (found["rank_average"] == found["score"].fillna(-1).rank(ascending=False, method="average")).all()
