"""Ranking sessions, snapshots and manifests."""

import datetime as dt
import random

import pytest

from tickerloom.operators.sorting import Session, most_comparisons
from tickerloom.sources import documents as D


def ranked(n: int, seed: int) -> tuple[Session, list[str]]:
    symbols = [f"s{k:03}" for k in range(n)]
    random.Random(seed).shuffle(symbols)
    return Session("id", "snap", symbols, seed), sorted(symbols)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 32, 61])
def test_merging_ranks_by_choices(n):
    session, want = ranked(n, n)
    while session.phase == "sorting":
        session.choose(min(session.next_pair))
    assert session.final_ranking == want and len(session.choices) <= most_comparisons(n)
    while session.phase == "review":
        session.choose(min(session.next_pair))
    assert session.phase == "done" and session.next_pair is None and not session.inconsistencies
    again = Session("id", "snap", session.symbols, session.seed, session.choices, session.reviews)
    assert again.phase == "done" and again.final_ranking == want
    with pytest.raises(ValueError):
        session.choose("s000")


def test_reviews_change_neighbours_round():
    session, want = ranked(40, 3)
    while session.phase == "sorting":
        session.choose(min(session.next_pair))
    pair = session.next_pair
    session.choose(pair[1])
    got = session.final_ranking
    if session.inconsistencies:  # the pair was chosen from before
        assert got.index(pair[1]) + 1 == got.index(pair[0])
    assert sorted(got) == want
    with pytest.raises(ValueError):
        session.choose("nobody")


def test_most_comparisons():
    assert [most_comparisons(n) for n in (0, 1, 2, 3, 4, 5, 8)] == [0, 0, 1, 3, 5, 8, 17]


def test_saved_sessions(spark, tmp_path):
    one, _ = ranked(6, 1)
    two, _ = ranked(6, 2)
    one.session_id, two.session_id = "one", "two"
    while two.next_pair:
        two.choose(min(two.next_pair))
    one.choose(one.next_pair[0])
    D.save_session(spark, two, str(tmp_path), "2024-01-01T00:00:00")
    D.save_session(spark, one, str(tmp_path), "2024-01-02T00:00:00")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/x.json").write_text("{not json")
    assert [r.session_id for r in D.sessions(spark, str(tmp_path)).collect()] == ["one", "two"]
    done = D.latest_completed(D.sessions(spark, str(tmp_path))).collect()
    assert [(r.session_id, r.final_ranking) for r in done] == [("two", two.final_ranking)]
    back = D.load_session(spark, str(tmp_path), "one")
    assert back.next_pair == one.next_pair and back.choices == one.choices
    with pytest.raises(FileNotFoundError):
        D.load_session(spark, str(tmp_path / "one"), "nothing")


def test_snapshots_and_manifests(spark, tmp_path):
    rows = [(f"s{k}", dt.date(2024, 1, 1 + d), float(k + d)) for k in range(10) for d in range(5)]
    panel = spark.createDataFrame(rows, "symbol string, date date, close double")
    D.save_snapshot(panel, None, str(tmp_path), "a", saved_at="2024-01-01T00:00:00")
    D.save_snapshot(panel, panel.withColumnRenamed("close", "high"), str(tmp_path), "b", saved_at="2024-01-02T00:00:00")
    assert [(r.snapshot_id, len(r.symbols)) for r in D.snapshots(spark, str(tmp_path)).collect()] == [("b", 10), ("a", 10)]
    prices, ohlc = D.load_snapshot(spark, str(tmp_path), "a")
    assert prices.count() == 50 and ohlc is None and D.load_snapshot(spark, str(tmp_path), "b")[1].count() == 50
    ranking = spark.createDataFrame([(f"s{k}", k + 1) for k in range(10)], "symbol string, true_rank int")
    made = D.manifest(ranking, prices, "x", "a")
    r = made.first()
    assert r.n_symbols == 10 and len(r.audit_symbols) == 2 and sorted(r.audit_symbols + r.development_symbols) == [f"s{k}" for k in range(10)]
    D.check_fresh(made, ranking, panel)
    with pytest.raises(ValueError, match="panel_hash"):
        D.check_fresh(made, ranking, panel.where("date > '2024-01-01'"))
    with pytest.raises(ValueError, match="lacks"):
        D.manifest(ranking, panel.where("symbol <> 's3'"), "x", "a")
