"""The widest disagreeing pairs against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickerloom.operators import ranking as R


@pytest.mark.parametrize("ends", [1, 5, 40, 500])
def test_widest_disagreements(spark, ends):
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", int(r), float(s) if k % 17 else None) for k, (r, s) in enumerate(zip(rng.permutation(200), rng.integers(0, 9, 200)))]
    scores = spark.createDataFrame(rows, "symbol string, true_rank long, score double")
    model = {r["symbol"]: r["model_rank"] for r in R.with_model_rank(scores).collect()}
    want = sorted((-(b[1] - a[1] + model[a[0]] - model[b[0]]), a[0], b[0]) for a in rows for b in rows if None not in (a[2], b[2]) and a[1] < b[1] and a[2] < b[2])
    assert [(-r["gap"], r["symbol_a"], r["symbol_b"]) for r in R.disagreements(scores, 30, ends).collect()] == want[:30]
    agreeing = spark.range(100).select(F.col("id").cast("string").alias("symbol"), F.col("id").alias("true_rank"), (-F.col("id")).cast("double").alias("score"))
    assert R.disagreements(agreeing, 30, ends).count() == 0
