"""Subsamples that are drawn and measured by tasks, against those that are drawn as rows and measured as splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickerloom.operators import addons as A


@pytest.mark.parametrize("n", [3, 9, 203])
def test_the_same_are_drawn(spark, n):
    ranking = spark.range(n).select(F.concat(F.lit("s"), F.col("id") * 7 % 1009).alias("symbol"), (F.col("id") * 3 + 1).alias("true_rank"))
    rows = A.subsamples(ranking, 4).orderBy("true_rank").collect()
    for repeat in range(4):
        assert A._kept([r["symbol"].encode() for r in rows], repeat).tolist() == [not r["folds"][repeat] for r in rows]


@pytest.mark.parametrize("missing", [False, True])
def test_subsamples_as_splits(spark, monkeypatch, missing):
    monkeypatch.setattr(A, "SUBSAMPLE_TASKS", 3)
    score = (F.col("id") * 7919 % 11 / 10).alias("score")
    one = F.when(~F.lit(missing) | (F.col("id") % 9 > 0), F.col("id") * 37 % 11 / 10).alias("one")
    rows = spark.range(120).select(F.concat(F.lit("s"), "id").alias("symbol"), score, (F.col("id") * 0.01).alias("turn"), one, (F.col("id") * 53 % 7 / 10).alias("two"), (F.col("id") * 2 + 1).alias("true_rank")).cache()
    features, ranking = rows.drop("true_rank"), rows.select("symbol", "true_rank")
    candidate = {"turned": 1.0, "reward": 0.7, "penalty": 0.2}
    found = A.measured(features, A.subsamples(ranking, 7), [A.combinations()[0], candidate]).where("fold = 1").collect()
    want = {(r["repeat"], r["param_id"]): np.array([r["inversion"], r["rho"], r["pair_error"]]) for r in found}
    got = A.subsampled(features, ranking, candidate, 7).collect()
    assert sorted(r["repeat"] for r in got) == list(range(7))
    for r in got:
        assert [r[f"{c}_delta"] for c in ("inversion", "rho", "pair_error")] == pytest.approx(want[r["repeat"], 1] - want[r["repeat"], 0], abs=1e-12)
    plan = A.subsampled(features, ranking, candidate, 500)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "Window" not in plan  # no row for each symbol and subsample
    rows.unpersist()
