"""Sessions, snapshots and manifests: JSON and Parquet that Spark reads and writes.

A session is a JSON document in a folder of its own. A snapshot is a panel (and OHLC) in Parquet beside a JSON document of
what it was made of. A manifest ties a ranking to a snapshot by hashes and parts its symbols."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.cache import fingerprint, ranking_hash
from tickerloom.operators.sorting import Session
from tickerloom.sources.market import exists

SESSION = """session_id string, snapshot_id string, saved_at string, phase string, symbols array<string>, seed long,
choices array<struct<a:string,b:string,choice:string>>, reviews array<struct<a:string,b:string,choice:string>>,
inconsistencies array<struct<a:string,b:string,first_choice:string,second_choice:string>>, final_ranking array<string>"""
META = "snapshot_id string, saved_at string, chart_period string, symbols array<string>"
#: The share of a ranking that is kept aside, and the seed that it is told by.
AUDIT_SHARE, AUDIT_SEED = 0.20, 20260729


def stamp(now: dt.datetime | None = None) -> str:
    """Local time to the second, as ISO text."""
    return (now or dt.datetime.now()).isoformat(timespec="seconds")


def save_session(spark: SparkSession, session: Session, path: str, saved_at: str | None = None) -> None:
    row = (session.session_id, session.snapshot_id, saved_at or stamp(), session.phase, session.symbols, session.seed, session.choices, session.reviews, session.inconsistencies, session.final_ranking)
    spark.createDataFrame([row], SESSION).coalesce(1).write.mode("overwrite").json(f"{path}/{session.session_id}")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Every session that can be read, the latest first."""
    rows = spark.read.schema(SESSION).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    return rows.where("session_id IS NOT NULL").orderBy(F.desc("saved_at"), F.desc("session_id"))


def load_session(spark: SparkSession, path: str, session_id: str) -> Session:
    r = sessions(spark, f"{path}/{session_id}").first() if exists(spark, f"{path}/{session_id}") else None
    if r is None:
        raise FileNotFoundError(f"no session {session_id} in {path}")
    return Session(r.session_id, r.snapshot_id, r.symbols, r.seed, [tuple(x) for x in r.choices], [tuple(x) for x in r.reviews])


def latest_completed(found: DataFrame) -> DataFrame:
    """The one row of the session that was done last and has a ranking, or none."""
    return found.where("phase = 'done' AND size(final_ranking) > 0").orderBy(F.desc("saved_at"), F.desc("session_id")).limit(1)


def save_snapshot(panel: DataFrame, ohlc: DataFrame | None, path: str, snapshot_id: str, chart_period: str = "3M", saved_at: str | None = None) -> None:
    """panel and ohlc, sorted by symbol so that one symbol's rows lie together, and the document of the snapshot."""
    spark, folder = panel.sparkSession, f"{path}/{snapshot_id}"
    for name, rows in (("prices", panel), ("ohlc", ohlc)):
        if rows is not None:
            rows.repartitionByRange("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").parquet(f"{folder}/{name}")
    symbols = panel.select("symbol").distinct().agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))  # a snapshot's symbols, as people rank
    meta = symbols.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(saved_at or stamp()).alias("saved_at"), F.lit(chart_period).alias("chart_period"), "symbols")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def load_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> tuple[DataFrame, DataFrame | None]:
    """(prices, OHLC or None)."""
    folder = f"{path}/{snapshot_id}"
    return spark.read.parquet(f"{folder}/prices"), spark.read.parquet(f"{folder}/ohlc") if exists(spark, f"{folder}/ohlc") else None


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all snapshots, the latest first."""
    rows = spark.read.schema(META).option("mode", "DROPMALFORMED").json(f"{path}/*/meta")
    return rows.where("snapshot_id IS NOT NULL").orderBy(F.desc("saved_at"), F.desc("snapshot_id"))


def audit_split(ranking: DataFrame, share: float = AUDIT_SHARE, seed: int = AUDIT_SEED) -> DataFrame:
    """ranking (symbol, true_rank from 1 on) and audit: of each run of neighbours one symbol, that with the least hash of seed
    and symbol; as many as make up the share, one at least."""
    n = F.count("*")
    most = F.greatest(F.bround(n * F.lit(share), 0), F.lit(1)).cast("long")
    sized = ranking.crossJoin(F.broadcast(ranking.agg(n.alias("_n"), most.alias("_most"))))  # one row
    bucket = F.floor((F.col("true_rank") - 1) / F.greatest(F.floor(F.col("_n") / F.col("_most")), F.lit(1)))
    draw = F.sha2(F.concat(F.lit(f"{seed} "), F.col("symbol")), 256)
    placed = sized.select(*ranking.columns, "_most", bucket.alias("_bucket"), draw.alias("_draw"))
    least = placed.groupBy("_bucket").agg(F.min("_draw").alias("_least"))
    audit = (F.col("_draw") == F.col("_least")) & (F.col("_bucket") < F.col("_most"))
    return placed.join(least, "_bucket").select(*ranking.columns, audit.alias("audit"))


def manifest(ranking: DataFrame, panel: DataFrame, session_id: str, snapshot_id: str) -> DataFrame:
    """One row: n_symbols, the hashes of ranking and panel, and which symbols are kept aside. Raises if the panel lacks one."""
    missing = ranking.join(panel.select("symbol").distinct(), "symbol", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"the snapshot lacks {[r['symbol'] for r in missing]}")
    parts = audit_split(ranking)
    names = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("symbol"))))
    sides = parts.agg(F.count("*").alias("n_symbols"), names(F.col("audit")).alias("audit_symbols"), names(~F.col("audit")).alias("development_symbols"))  # a ranking that people made
    of_panel = fingerprint(panel.join(F.broadcast(ranking.select("symbol")), "symbol", "left_semi")).select(F.col("digest").alias("panel_hash"))
    joined = sides.crossJoin(ranking_hash(ranking).select(F.col("digest").alias("ranking_hash"))).crossJoin(of_panel)  # one row each
    return joined.select(F.lit(session_id).alias("session_id"), F.lit(snapshot_id).alias("snapshot_id"), "*")


def check_fresh(known: DataFrame, ranking: DataFrame, panel: DataFrame) -> None:
    """Raises if the ranking or the panel isn't what the manifest known was made of."""
    old, new = (m.select("n_symbols", "ranking_hash", "panel_hash").first() for m in (known, manifest(ranking, panel, "", "")))
    for name in ("n_symbols", "ranking_hash", "panel_hash"):
        if old[name] != new[name]:
            raise ValueError(f"{name} has changed: make the manifest again before a fit")
