"""Families of scores: metrics of sets, splits, validation and choice against plain Python; refinement."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickerloom.operators import calibrate as C
from tickerloom.operators import families as S
from tickerloom.operators import ranking as R
from tickerloom.operators.score import Family

N = 30
TWO = {
    "sum": Family("sum", lambda q: q["w"] * F.col("x") + q["v"] * F.col("y"), {"w": (0.0, 1.0), "v": (-1.0, 1.0)}, {}),
    "bend": Family("bend", lambda q: F.when(F.col("x") > q["floor"], F.col("y") * q["w"]), {"floor": (0.01, 0.4)}, {"w": (0.5, 2.0)}),
}


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 1, (2, N))
    rank = np.argsort(np.argsort(-(x + 0.4 * y + rng.normal(0, 0.1, N)))) + 1
    rows = [(f"s{k:02d}", float(x[k]), float(y[k]), int(rank[k])) for k in range(N)]
    frame = spark.createDataFrame(rows, "symbol string, x double, y double, true_rank long")
    return rows, frame.select("symbol", "x", "y").cache(), frame.select("symbol", "true_rank").cache()


def plain_score(family: str, q: dict, row) -> float:
    _, x, y, _ = row
    return q["w"] * x + q["v"] * y if family == "sum" else y * q["w"] if x > q["floor"] else float("nan")


def plain_metrics(family, q, rows) -> tuple:
    rows = sorted(rows, key=lambda r: r[3])
    score = np.array([plain_score(family, q, r) for r in rows])
    score = np.where(np.isnan(score), np.nanmedian(score), score)
    inversion, error, rho = R.metrics_of(np.arange(1, len(rows) + 1), score)
    return inversion, error, rho, -10 * inversion + 3 * rho - 0.05 * error


def test_splits_are_stratified(inputs):
    rows, _, ranking = inputs
    found = {r["symbol"]: r["folds"] for r in S.splits(ranking, 3, 5).collect()}
    ordered = sorted(rows, key=lambda r: r[3])
    for repeat in range(3):
        for run in range(5):
            assert sorted(found[r[0]][repeat] for r in ordered[6 * run : 6 * run + 6]) == [0, 0, 1, 2, 3, 4]
    assert {tuple(f) for f in found.values()} != {(f[0],) * 3 for f in found.values()}
    assert found == {r["symbol"]: r["folds"] for r in S.splits(ranking.repartition(5), 3, 5).collect()}


@pytest.mark.parametrize(("held", "few"), [(4_000_000, 256), (100, 256), (100, 3)])
def test_metrics_of_sets(monkeypatch, held, few):
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "FEW", few)
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, (7, 25)).astype(float)
    scores[3, :5] = np.nan
    for s, got in zip(scores, S.metrics_of_sets(scores)):
        full = np.where(np.isnan(s), np.nanmedian(s), s)
        assert tuple(got[:3]) == pytest.approx(R.metrics_of(np.arange(1, 26), full))
    ranks = np.sort(rng.choice(100, 25, replace=False)).astype(float)
    assert tuple(S.metrics_of_sets(scores[:1], ranks)[0, :3]) == pytest.approx(R.metrics_of(ranks, scores[0]))
    assert S.metrics_of_sets(np.full((2, 3), np.nan))[:, 0].tolist() == [0.0, 0.0]
    assert S.metrics_of_sets(np.zeros((2, 1)))[:, :3].tolist() == [[0.0, 0.0, 1.0]] * 2


@pytest.mark.parametrize("task_rows", [200_000, 500])
def test_validation_and_choice(spark, inputs, monkeypatch, task_rows):
    monkeypatch.setattr(S, "TASK_ROWS", task_rows)
    rows, features, ranking = inputs
    sets = S.drawn(TWO, 25, (1, 2))
    ranked = S.splits(ranking, 2, 5)
    folds = {r["symbol"]: r["folds"] for r in ranked.collect()}
    measured = S.set_metrics(features, ranked, S.sets_table(spark, sets), TWO).cache()
    assert measured.count() == len(sets) * 11
    want, nested = {}, {}
    for repeat, fold in [(-1, -1), *((r, f) for r in range(2) for f in range(5))]:
        train = [r for r in rows if repeat < 0 or folds[r[0]][repeat] != fold]
        for name in TWO:
            found = [(-round(plain_metrics(f, q, train)[3], 12), s, k, q) for f, s, k, q in sets if f == name]
            _, seed, k, q = min(found, key=lambda x: x[:3])
            if repeat < 0:
                want[name] = (seed, k, plain_metrics(name, q, train))
            else:
                test = [r for r in rows if folds[r[0]][repeat] == fold]
                nested[name, repeat, fold] = (seed, k, plain_metrics(name, q, test)[0])
    got = {(r["family"], r["repeat"], r["fold"]): (r["seed"], r["param_id"], r["inversion"]) for r in S.validated(measured).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in nested.items()}
    assert [got[k][2] for k in sorted(got)] == pytest.approx([nested[k][2] for k in sorted(nested)])
    means = {name: np.mean([v[2] for k, v in nested.items() if k[0] == name]) for name in TWO}
    for band in (0.0, 10.0):
        for r in (found := S.chosen(measured, band).collect()):
            assert (r["seed"], r["param_id"]) == want[r["family"]][:2] and r["inversion"] == pytest.approx(want[r["family"]][2][0])
            assert r["nested_mean"] == pytest.approx(means[r["family"]]) and r["eligible"] == (band > 1 or means[r["family"]] == min(means.values()))
        best = min((n for n in TWO if band > 1 or means[n] == min(means.values())), key=lambda n: want[n][2][0])
        assert [r["family"] for r in found if r["chosen"]] == [best]
    measured.unpersist()


def test_refinement_never_loses_and_repeats(inputs):
    _, features, ranking = inputs
    found, state = S.refined(features, ranking, TWO, 10, (1, 2), 2, 12)
    rows = found.collect()
    assert len(rows) == 4 and all(r["utility"] >= r["drawn_utility"] for r in rows) and any(r["utility"] > r["drawn_utility"] for r in rows)
    again, same = S.refined(features, ranking, TWO, 10, (1, 2), 2, 12)
    assert again.collect() == rows and same == state
    assert all(S.BOUNDS[0] <= q["floor"] <= S.BOUNDS[1] for (name, _), q in state.items() if name == "bend")


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_pairwise_fit_needs_no_rows_of_pairs(monkeypatch, block):
    """The same weights as by every pair's difference."""
    monkeypatch.setattr(C, "PAIR_BLOCK", block)
    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=(40, 4)), rng.normal(size=40)
    rank = np.argsort(np.argsort(-(x @ [1.0, 0.5, 0.0, -0.3] + noise))) + 1.0
    x, rank = x[[*range(40), 3, 3, 7]], rank[[*range(40), 3, 3, 7]]
    i, j = np.triu_indices(len(rank), 1)
    swap = rank[i] > rank[j]
    d = x[np.where(swap, j, i)] - x[np.where(swap, i, j)]
    w = v = np.zeros(4)
    step, t = 1.0 / (0.25 * np.linalg.norm(d.T @ d, 2) / len(d) + 2 * C.RIDGE), 1.0
    for _ in range(C.STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ v, -40, 40)))
        new = np.clip(v - step * (-(d.T @ p) / len(d) + 0.01 + 2 * C.RIDGE * v), 0, C.MOST)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    assert C.fit_pairwise(x, rank, 0.01) == pytest.approx(w, abs=1e-6)
    assert C.fit_pairwise(x[:1], rank[:1], 0.01).tolist() == [0.0] * 4
