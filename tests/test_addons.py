"""Additive weights against plain Python."""

import numpy as np
import pytest
from tickerloom.operators import addons as A
from tickerloom.operators import ranking as R

N, KEYS = 40, ("inversion", "rho", "pair_error")


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(8)
    score, one, two, curve = rng.normal(size=(4, N)).round(3)
    rank = np.argsort(np.argsort(-(score + 0.7 * one - 0.4 * two + rng.normal(0, 0.2, N)))) + 1
    rows = [(f"s{k:02d}", float(score[k]), float(one[k]), float(two[k]), float(curve[k]) if k else None, int(rank[k])) for k in range(N)]
    frame = spark.createDataFrame(rows, "symbol string, score double, one double, two double, curve double, true_rank long")
    turned = A.curvature_turn(frame, "curve").cache()
    return {r["symbol"]: r.asDict() for r in turned.collect()}, turned.drop("true_rank", "curve"), turned.select("symbol", "true_rank")


def plain(rows: list[dict], q: dict) -> dict:
    rows = sorted(rows, key=lambda r: r["true_rank"])
    score = np.array([r["score"] + q["turned"] * r["turn"] + q["reward"] * r["one"] - q["penalty"] * r["two"] for r in rows])
    inversion, error, rho = R.metrics_of(np.array([r["true_rank"] for r in rows], float), score)
    return {"inversion": inversion, "pair_error": error, "rho": rho}


def key(m: dict, k: int) -> tuple:
    return round(m["inversion"], 12), round(-m["rho"], 12), round(m["pair_error"], 12), k


def test_turn(inputs):
    rows = [r for r in inputs[0].values()]
    curve = np.array([np.nan if r["curve"] is None else r["curve"] for r in rows])
    z = lambda x: (np.where(np.isnan(x), np.nanmedian(x), x) - np.where(np.isnan(x), np.nanmedian(x), x).mean()) / np.where(np.isnan(x), np.nanmedian(x), x).std()
    half = lambda x: np.where(np.isnan(x), np.nan, np.maximum(x, 0))
    assert [r["turn"] for r in rows] == pytest.approx(0.445971 * 0.6 * (z(half(curve)) - z(half(-curve))))


def test_grid_and_best(inputs):
    rows, features, ranking = inputs
    got = {r["param_id"]: r for r in A.grid(features, ranking).collect()}
    want = {k: plain(list(rows.values()), q) for k, q in enumerate(A.combinations())}
    assert len(got) == len(want) == 286
    for k, m in want.items():
        assert {c: got[k][c] for c in KEYS} == pytest.approx(m)
    assert A.best_of(A.grid(features, ranking)).first()["param_id"] == min(want, key=lambda k: key(want[k], k))


def test_nested(inputs):
    rows, features, ranking = inputs
    found = A.nested(features, ranking, 2)
    folds = {r["symbol"]: r["folds"] for r in A.S.splits(ranking, 2, seed=A.SEED).collect()}
    got = found.collect()
    assert len(got) == 10
    for r in got:
        train = [x for s, x in rows.items() if folds[s][r["repeat"]] != r["fold"]]
        test = [x for s, x in rows.items() if folds[s][r["repeat"]] == r["fold"]]
        trained = {k: plain(train, q) for k, q in enumerate(A.combinations())}
        best = min(trained, key=lambda k: key(trained[k], k))
        own, base = plain(test, A.combinations()[best]), plain(test, A.combinations()[0])
        assert r["param_id"] == best and [r[f"{c}_delta"] for c in KEYS] == pytest.approx([own[c] - base[c] for c in KEYS])
        assert r["strict_win"] == (own["inversion"] < base["inversion"] and own["rho"] > base["rho"] + 1e-12 and own["pair_error"] < base["pair_error"] - 1e-12)
    one = A.nested_summary(found).first()
    assert one["splits"] == 10 and one["reward"] == pytest.approx(np.median([r["reward"] for r in got])) and one["win_rate"] == pytest.approx(np.mean([r["strict_win"] for r in got]))


def test_subsamples(inputs):
    rows, features, ranking = inputs
    drawn = {r["symbol"]: r["folds"] for r in A.subsamples(ranking, 7).collect()}
    order = sorted(rows, key=lambda s: rows[s]["true_rank"])
    for repeat in range(7):
        assert all(sum(drawn[s][repeat] for s in order[8 * k : 8 * k + 8]) == 2 for k in range(5))  # round(8 * 0.8) = 6 stay
    candidate = {"turned": 0.0, "reward": 0.7, "penalty": 0.4}
    got = {r["repeat"]: r for r in A.subsampled(features, ranking, candidate, 7).collect()}
    for repeat, r in got.items():
        some = [rows[s] for s in order if not drawn[s][repeat]]
        own, base = plain(some, candidate), plain(some, A.combinations()[0])
        assert [r[f"{c}_delta"] for c in KEYS] == pytest.approx([own[c] - base[c] for c in KEYS])
    assert len(got) == 7 and A.subsample_summary(A.subsampled(features, ranking, candidate, 7)).first()["subsamples"] == 7
