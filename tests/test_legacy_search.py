"""The archived score's search by tasks against the sweep by rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickerloom.operators import calibrate as C
from tickerloom.operators import ranking as R
from tickerloom.operators import score as S


def test_search_is_the_sweep(spark, monkeypatch):
    monkeypatch.setattr(C, "SEARCH_TASKS", 3)
    rng = np.random.default_rng(12)
    values = rng.normal(0.1, 0.3, (150, len(S.LEGACY_COLUMNS))).round(3)
    values[rng.random(values.shape) < 0.01] = np.nan
    values[:, S.LEGACY_COLUMNS.index("above_ema50")] = 1.0
    values[:, S.LEGACY_COLUMNS.index("r2_3m")] += 0.6
    rows = [(f"s{k:03}", *[None if np.isnan(x) else float(x) for x in v]) for k, v in enumerate(values)]
    features = spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{c} double" for c in S.LEGACY_COLUMNS)).cache()
    ranking = features.select("symbol", (F.substring("symbol", 2, 3).cast("int") * 7 % 151).alias("true_rank")).where("true_rank > 5")
    sets = [*C.legacy_weights(4), *C.legacy_volatility()[60:63]]
    want = {r["param_id"]: r for r in R.rank_metrics(S.legacy_sweep(features, sets).join(ranking, "symbol"), ("param_id",)).collect()}
    plan = C.legacy_search(features, ranking, sets)
    got = {r["param_id"]: r for r in plan.collect()}
    swept = {(r["param_id"], r["symbol"]): r["score"] for r in S.legacy_sweep(features, sets).collect()}
    for k, scores in enumerate(S.legacy_scores(dict(zip(S.LEGACY_COLUMNS, values.T)), sets)):
        for row, score in zip(rows, scores):
            assert score == pytest.approx(np.nan if swept[k, row[0]] is None else swept[k, row[0]], abs=1e-9, nan_ok=True)
    assert set(got) == set(want) == set(range(len(sets)))
    for k, r in want.items():
        assert got[k][:4] == pytest.approx(r[:4], abs=1e-12)
    features.unpersist()
