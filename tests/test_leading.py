"""The best sets of families whose scores take arrays, without the scores of all sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickerloom.operators import families as S
from tickerloom.operators import ranking as R
from tickerloom.operators.score import FAMILIES, READ


def test_scores_of_arrays(spark):
    """Each family gives columns and arrays the same scores, missing features included."""
    rng = np.random.default_rng(4)
    values = rng.normal(0, 0.3, (50, len(READ))).round(3)
    values[rng.random(values.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(k, *[None if np.isnan(x) else float(x) for x in row]) for k, row in enumerate(values)], "k long, " + ", ".join(f"{c} double" for c in READ)).cache()
    for name, family in FAMILIES.items():
        for q in [family.middle, *family.draw(2, 9)]:
            want = [r[0] for r in rows.orderBy("k").select(family.score(q)).collect()]
            got = family.score(q, S.Inputs(dict(zip(READ, values.T))))
            assert got == pytest.approx(np.array([np.nan if x is None else x for x in want]), rel=1e-9, abs=1e-12, nan_ok=True), name
    rows.unpersist()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 200, 700])
def test_no_utility_is_higher_than_told(monkeypatch, n):
    monkeypatch.setattr(S, "COARSE", 8)
    rng, cases = np.random.default_rng(n), S._Cases(np.empty((n, 0), np.int32))
    for k in range(100):
        along = (rng.permutation(n) if k % 2 else np.argsort(np.arange(n) + rng.normal(0, 10.0 ** rng.uniform(-2, 3), n))).astype(np.int32)
        inversion, error, rho, utility = S.metrics_of_sets(-np.argsort(along)[None, :].astype(float))[0]
        assert cases.metrics(0, along) == pytest.approx((inversion, error, rho))
        assert utility <= cases.most(0, along) <= utility + 10 * (3 / 8 if n > 20 else 1) + 1e-6


@pytest.mark.parametrize("n", [255, 256, 257, 5000])
def test_falls_by_blocks(n):
    for model in (np.random.default_rng(n).permutation(n), np.arange(n), np.arange(n)[::-1]):
        model = model.astype(np.int32)
        assert R._falls_by_blocks(model) == R.falls(model[None, :], each=True).sum() // 2
    ties = np.random.default_rng(n).integers(0, 9, n).astype(float)
    assert R.descending(ties).tolist() == np.argsort(-ties, kind="stable").tolist()


def test_leading_sets_are_the_best(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 0)
    monkeypatch.setattr(S, "TASKS", 3)
    monkeypatch.setattr(S, "SCORED", 17)
    monkeypatch.setattr(S, "ORDERS", 200)
    rng = np.random.default_rng(6)
    rows = [(f"s{k:02d}", int(k + 1), *map(float, x)) for k, x in enumerate(rng.normal(0.05, 0.2, (60, len(READ))))]
    rows[5] = (*rows[5][:2], *[None] * len(READ))
    frame = spark.createDataFrame(rows, "symbol string, true_rank long, " + ", ".join(f"{c} double" for c in READ)).cache()
    features, ranked = frame.drop("true_rank"), S.splits(frame, 2, 3)
    sets = S.sets_table(spark, S.drawn(FAMILIES, 12, (1, 2)))
    led, every = S.leading(features, ranked, sets, FAMILIES).cache(), S.set_metrics(features, ranked, sets, FAMILIES).cache()
    assert led.count() < every.count() == 12 * 2 * 7 * 7
    for by in (("family", "repeat", "fold"), ("family", "seed", "repeat", "fold")):
        got, want = (S.best_sets(m, by).orderBy(*by).collect() for m in (led, every))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        for a, b in zip(got, want):
            for c in a.asDict():
                assert a[c] == (pytest.approx(b[c]) if isinstance(b[c], float) else b[c]), c
    for m in (led, every, frame):
        m.unpersist()


def test_leading_with_missing_scores():
    rng = np.random.default_rng(7)
    scores, folds = rng.integers(0, 30, (9, 40)).astype(float), rng.integers(0, 3, (40, 2))
    scores[2, 3] = scores[4, :] = np.nan
    groups = [[0, 1, 2], [3, 4, 5, 6, 7, 8], [4]]
    every = S._split_metrics(scores[:2], np.arange(1.0, 41), folds, True, True)
    got = {(group, r, f): (k, own) for (k, r, f, *own), group in zip(S._leaders(lambda k: scores[k], groups, folds), np.repeat(range(3), len(every)))}
    for group, members in enumerate(groups):
        for key in every:
            one = {k: S._split_metrics(scores[k : k + 1], np.arange(1.0, 41), folds, True, True)[key] for k in members}
            best = min(members, key=lambda k: (-round(one[k][0][0, 3], 12), k))
            assert got[(group, *key)][0] == best
            assert got[(group, *key)][1] == pytest.approx([*one[best][0][0, :3], *one[best][1][0, :3]])
