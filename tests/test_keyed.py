"""Tables by symbol: updates, untouched files, read-through, expiry."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F
from tickerloom.sources.keyed import BarCache, KeyedTable, NameCache


def files(path) -> dict[str, set[str]]:
    return {d: {os.path.basename(f) for f in glob.glob(f"{path}/{d}/*.parquet")} for d in os.listdir(path) if d.startswith("bucket=")}


def bars(spark, symbols, days, level=1.0):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), level + d) for s in symbols for d in range(days)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_updates_touch_their_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "symbol string, v int", 8)
    assert table.rows().collect() == []
    table.upsert(spark.createDataFrame([(f"s{k}", k) for k in range(40)] + [(None, 1)], "symbol string, v int"))
    before = files(f"{tmp_path}/t")
    table.upsert(spark.createDataFrame([("s3", -3), ("s3", -4), ("new", 7)], "symbol string, v int"))
    after = files(f"{tmp_path}/t")
    touched = {d for d in after if before.get(d) != after[d]}
    assert 1 <= len(touched) <= 2 and all(before[d].isdisjoint(after[d]) for d in touched if d in before)
    got = sorted((r["symbol"], r["v"]) for r in table.rows().collect())
    assert got == sorted([(f"s{k}", k) for k in range(40) if k != 3] + [("s3", -3), ("s3", -4), ("new", 7)])
    table.upsert(table.rows().where("v > 1000"))
    assert files(f"{tmp_path}/t") == after
    some = table.rows(spark.createDataFrame([("s3",), ("s5",), ("none",)], "symbol string"))
    assert sorted(r["v"] for r in some.collect()) == [-4, -3, 5]


def test_two_writers_of_one_bucket(spark, tmp_path):
    one, two = (NameCache(spark, f"{tmp_path}/n", buckets=1) for _ in range(2))
    one.save(spark.createDataFrame([("a", "A"), ("b", "B")], "symbol string, name string"), "2024-01-01")
    two.save(spark.createDataFrame([("c", "C"), ("b", " "), ("a", "A2"), ("a", "A3")], "symbol string, name string"), "2024-01-20")
    assert {r["symbol"]: r["name"] for r in one.names("2024-01-21").collect()} == {"a": "A2", "b": "B", "c": "C"}
    assert {r["symbol"] for r in two.names("2024-02-10").collect()} == {"a", "c"}  # b has expired


def test_names_are_read_through(spark, tmp_path):
    cache, asked = NameCache(spark, f"{tmp_path}/n", 10, 4), []

    def source(symbols):
        asked.append(sorted(r["symbol"] for r in symbols.collect()))
        return symbols.where("symbol <> 'z'").withColumn("name", F.upper("symbol"))

    wanted = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "symbol string")
    for now, more in (("2024-01-01", ["a", "b", "z"]), ("2024-01-05", ["z"]), ("2024-01-12", ["a", "b", "z"])):
        assert {r["symbol"]: r["name"] for r in cache.read_through(wanted, source, now).collect()} == {"a": "A", "b": "B", "z": "z"}
        assert asked[-1] == more


@pytest.mark.parametrize("kind", ["adj_close", "ohlc"])
def test_bars_are_refreshed(spark, tmp_path, kind):
    cache, asked = BarCache(spark, f"{tmp_path}/c", 4), []
    wide = lambda df: df if kind == "adj_close" else df.withColumns({"high": F.col("close") + 1, "low": F.when(F.col("close") > 3, F.col("close") - 1)})
    cache.save(kind, wide(bars(spark, ["hit", "old", "stale", "gone"], 100)), "1y", "2024-05-01")
    cache.save(kind, wide(bars(spark, ["few"], 10)), "1y", "2024-05-01")
    cache.save(kind, wide(bars(spark, ["short"], 100)), "1mo", "2024-05-01")
    cache.save("ohlc" if kind == "adj_close" else "adj_close", bars(spark, ["hit"], 3), "1y", "2024-05-01")
    last = dt.date(2024, 1, 1) + dt.timedelta(days=99)
    probe = spark.createDataFrame([("hit", last), ("old", last + dt.timedelta(days=1)), ("gone", last + dt.timedelta(days=5))], "symbol string, probe_date date")

    def source(symbols):
        asked.extend(r["symbol"] for r in symbols.collect())
        return wide(bars(spark, ["old", "few", "short", "cold", "other"], 120, 5.0))

    wanted = spark.createDataFrame([(s,) for s in ("hit", "old", "stale", "gone", "few", "short", "cold", "nowhere")], "symbol string")
    found, outcomes = cache.refresh(kind, wanted, probe, source, "6mo", "2024-05-02")
    assert {r["symbol"]: r["outcome"] for r in outcomes.collect()} == {
        "hit": "hit", "old": "miss", "stale": "stale_hit", "gone": "miss", "few": "period_miss", "short": "period_miss", "cold": "cold", "nowhere": "cold",
    }
    assert sorted(asked) == ["cold", "few", "gone", "nowhere", "old", "short"]
    n = {r["symbol"]: r["count"] for r in found.groupBy("symbol").count().collect()}
    assert n == {"hit": 100, "stale": 100, "gone": 100, "old": 120, "few": 120, "short": 120, "cold": 120}
    assert {r["symbol"]: (r["period"], r["n_bars"]) for r in cache.manifest(kind, wanted).collect()}["short"] == ("6mo", 120)
    assert found.where("symbol = 'cold'").agg(F.min("close")).first()[0] == 5.0 and cache.bars(kind).where("symbol = 'other'").count() == 0
    other = "ohlc" if kind == "adj_close" else "adj_close"
    assert cache.bars(other).count() == 3 and ("high" in cache.bars("ohlc").columns) and ("high" not in cache.bars("adj_close").columns)
