"""Pairs that fall, and metrics of many sets whose scores travel packed, against plain counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickerloom.operators import addons as A
from tickerloom.operators import families as S
from tickerloom.operators import ranking as R


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 100])
def test_falls(n):
    model = np.array([np.random.default_rng([n, k]).permutation(n) for k in range(3)])
    for m, total, each in zip(model, R.falls(model), R.falls(model, each=True)):
        fall = np.triu(m[:, None] > m[None, :], 1)
        want = np.zeros(n, int)
        want[m] = fall.sum(axis=0) + fall.sum(axis=1)
        assert total == fall.sum() and each.tolist() == want.tolist()


@pytest.mark.parametrize("anew", [True, False])
@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_splits_from_one_sort(n, anew):
    rng = np.random.default_rng(n)
    scores, ranks, folds = rng.integers(0, 20, (5, n)).astype(float), np.sort(rng.choice(3 * n, n, False)).astype(float), rng.integers(0, 3, (n, 2))
    for holes in (False, True):
        if holes:
            scores[1, 0] = np.nan
        for (r, f), found in S._split_metrics(scores, ranks, folds, anew, True).items():
            test = folds[:, r] == f if r >= 0 else np.zeros(n, bool)
            for got, some in zip(found, (~test, test)):
                assert got == pytest.approx(S.metrics_of_sets(scores[:, some], None if anew else ranks[some]))


def test_many_tasks_and_slices(spark, monkeypatch):
    """Sets, rows and repeats dealt to many tasks give what one task gives."""
    rows = spark.range(60).select(F.concat(F.lit("s"), "id").alias("symbol"), (F.col("id") * 7919 % 101 / 10).alias("score"), (F.col("id") * 0.01).alias("turn"), (F.col("id") * 37 % 11 / 10).alias("one"), (F.col("id") * 53 % 7 / 10).alias("two"), (F.col("id") + 1).alias("true_rank"))
    found, ranked = rows.drop("true_rank"), S.splits(rows, 5)
    order = ["param_id", "repeat", "fold"]
    want = A.measured(found, ranked, A.combinations()[:9]).orderBy(*order).collect()
    for name, value in (("TASK_ROWS", 130), ("TASK_REPEATS", 2), ("MEASURED", 60)):
        monkeypatch.setattr(S, name, value)
    assert A.measured(found, ranked, A.combinations()[:9]).orderBy(*order).collect() == want and len(want) == 9 * 26


def test_packed_groups(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("true_rank"), F.when(F.col("id") > 3, F.col("id") * 31 % 17 + 0.5).alias("score"))
    arrays = R.packed(rows, ("k",), ("true_rank", "score"), 10)
    assert arrays.select("k", F.explode(F.arrays_zip("true_rank", "score")).alias("x")).select("k", "x.*").exceptAll(rows).count() == 0
    assert arrays.agg(F.sum(F.size("score"))).first()[0] == 1000
