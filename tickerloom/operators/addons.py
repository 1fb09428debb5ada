"""Two additive weights, and a turned sign, on top of a score: the grid, its choice in repeated splits, and subsamples.

Each combination (sign turned or not, weight of the reward, weight of the penalty) is a set of families.py's table, so all of
them are scored once and measured over all rows and every split in one pass. The baseline is set 0.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators import families as S
from tickerloom.operators.places import cut, placed, tiled
from tickerloom.operators.ranking import batched, descending, falls, for_tasks, unpacked
from tickerloom.operators.score import Family, LegacyParams, z_scores

#: The weights that are tried; repeats of the splits, subsamples and their share; the seeds of both.
REWARDS, PENALTIES = tuple(k / 10 for k in range(13)), tuple(k / 10 for k in range(11))
REPEATS, SUBSAMPLES, SHARE, SEED, SUBSAMPLE_SEED = 40, 500, 0.8, 20260729, 20260730
#: Tasks that share the subsamples.
SUBSAMPLE_TASKS = 96
NAME = "addons"
_ADDONS = {NAME: Family(NAME, lambda q: F.col("score") + q["turned"] * F.col("turn") + q["reward"] * F.col("one") - q["penalty"] * F.col("two"), {"turned": (0.0, 1.0), "reward": (0.0, 1.2), "penalty": (0.0, 1.0)}, {})}


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df and z_<column>: missing values as the median, then against mean and population deviation; 0 where that is 0."""
    medians = df.agg(*[F.median(c).alias(f"_d_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(medians)).select(*[c for c in df.columns if c not in columns], *[F.coalesce(c, f"_d_{c}").alias(c) for c in columns])  # one row
    return z_scores(filled, columns)


def curvature_turn(features: DataFrame, column: str = "ema20_curv_20d", params: LegacyParams = LegacyParams()) -> DataFrame:
    """features and turn: what the archived score gains where upward curvature counts for it rather than against it, by z-scores
    of the curvature's positive and negative halves."""
    halves = {"_up": F.col(column), "_down": -F.col(column)}
    halves = {c: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))) for c, x in halves.items()}
    scored = standardised(features.withColumns(halves), list(halves))
    weight = params.w_ema_shape * (params.w_ema_curv_reward_base + params.w_ema_curv_penalty_base)
    return scored.select(*features.columns, (weight * (F.col("z__up") - F.col("z__down"))).alias("turn"))


def combinations() -> list[dict[str, float]]:
    """Set 0 is the baseline."""
    return [{"turned": t, "reward": r, "penalty": p} for t in (0.0, 1.0) for r in REWARDS for p in PENALTIES]


def _sets(spark, some: list[dict[str, float]]) -> DataFrame:
    return S.sets_table(spark, [(NAME, 0, k, q) for k, q in enumerate(some)])


def measured(features: DataFrame, ranked: DataFrame, some: list[dict[str, float]]) -> DataFrame:
    """The metrics of sets (features: symbol, score, turn, one, two) over all rows and ranked's splits; ranks stay as they are."""
    return S.set_metrics(features, ranked, _sets(features.sparkSession, some), _ADDONS, anew=False).drop("family", "seed", "utility")


def grid(features: DataFrame, ranking: DataFrame) -> DataFrame:
    """turned, reward, penalty, inversion, pair_error, rho of each combination."""
    found = measured(features, S.splits(ranking, 0), combinations()).select("param_id", "inversion", "pair_error", "rho")
    sets = _sets(features.sparkSession, combinations()).select("param_id", *[F.col(f"q_{c}").alias(c) for c in ("turned", "reward", "penalty")])
    return sets.join(found, "param_id")


def _order() -> Column:
    return F.struct(*[F.round(c, 12) for c in (F.col("inversion"), -F.col("rho"), F.col("pair_error"))], F.col("param_id"))


def best_of(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The row of each by with the lowest inversion, then the highest rho, then the lowest pair_error, then the first set."""
    rest = [c for c in metrics.columns if c not in by]
    return metrics.groupBy(*by).agg(F.min_by(F.struct(*rest), _order()).alias("r")).select(*by, "r.*")


def _deltas(prefix: str, base: str) -> list[Column]:
    found = {c: F.col(f"{prefix}{c}") - F.col(f"{base}{c}") for c in ("inversion", "rho", "pair_error")}
    exact = {c: F.round(d, 12) for c, d in found.items()}
    win = (exact["inversion"] < 0) & (exact["rho"] > 0) & (exact["pair_error"] < 0)
    return [*[d.alias(f"{c}_delta") for c, d in found.items()], win.alias("strict_win")]


def nested(features: DataFrame, ranking: DataFrame, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """repeat, fold, param_id (the set that is best on the split's training rows), turned, reward, penalty, and by how much its
    metrics on the other rows differ from the baseline's; strict_win: all three are better."""
    found = measured(features, S.splits(ranking, repeats, seed=seed), combinations()).where("repeat >= 0")
    base = found.where("param_id = 0").select("repeat", "fold", *[F.col(f"test_{c}").alias(f"base_{c}") for c in ("inversion", "rho", "pair_error")])
    sets = _sets(features.sparkSession, combinations()).select("param_id", *[F.col(f"q_{c}").alias(c) for c in ("turned", "reward", "penalty")])
    rows = best_of(found, ("repeat", "fold")).join(base, ["repeat", "fold"]).join(F.broadcast(sets), "param_id")  # as many as combinations
    return rows.select("repeat", "fold", "param_id", "turned", "reward", "penalty", *_deltas("test_", "base_"))


def nested_summary(rows: DataFrame) -> DataFrame:
    """One row: splits, rates of strict wins and turned signs, median weights, and each delta's median, p10 and p90."""
    spread = [F.percentile(f"{c}_delta", p).alias(f"{c}_{n}") for c in ("inversion", "rho", "pair_error") for n, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))]
    return rows.agg(F.count("*").alias("splits"), F.avg(F.col("strict_win").cast("double")).alias("win_rate"), F.avg("turned").alias("turned_rate"), F.median("reward").alias("reward"), F.median("penalty").alias("penalty"), *spread)


def subsamples(ranking: DataFrame, repeats: int = SUBSAMPLES, share: float = SHARE, seed: int = SUBSAMPLE_SEED) -> DataFrame:
    """symbol, true_rank, folds: for each repeat 1 for rows that are left out. Of each fifth of the ranking the share stays,
    rounded half to even, two rows at least, in the order of a seeded hash."""
    fifths = tiled(ranking.select("symbol", "true_rank"), 5, [F.col("true_rank"), F.col("symbol")], "_fifth")
    sized = fifths.withColumn("_n", F.count("*").over(Window.partitionBy("_fifth")))
    each = sized.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_repeat"))
    draw = F.row_number().over(Window.partitionBy("_fifth", "_repeat").orderBy(F.sha2(F.concat_ws(" ", F.lit(str(seed)), "_repeat", "symbol"), 256), "symbol"))
    out = (draw > F.greatest(F.bround(F.col("_n") * share, 0), F.lit(2))).cast("int")
    rows = each.select("symbol", "true_rank", "_repeat", out.alias("_out"))
    folds = F.array_sort(F.collect_list(F.struct("_repeat", "_out")))  # as many as repeats
    return rows.groupBy("symbol", "true_rank").agg(F.transform(folds, lambda x: x["_out"]).alias("folds"))


def _kept(symbols: list[bytes], repeat: int, share: float = SHARE, seed: int = SUBSAMPLE_SEED) -> np.ndarray:
    """Which of the symbols, in the order of the ranking, stay in a subsample: those that subsamples() has as 0."""
    head = f"{seed} {repeat} ".encode()
    digests = [hashlib.sha256(head + s).digest() for s in symbols]
    first = np.frombuffer(b"".join(digests), ">u8")[::4].astype(np.uint64)
    out, at = np.ones(len(symbols), bool), 0
    for size in (len(symbols) // 5 + (k < len(symbols) % 5) for k in range(5)):
        most, own = max(round(size * share), 2), first[at : at + size]
        if most < size:
            last = np.partition(own, most - 1)[most - 1]
            out[at : at + size] = own < last
            rest = sorted(at + np.flatnonzero(own == last), key=lambda k: (digests[k], symbols[k]))
            out[rest[: most - int((own < last).sum())]] = True
        at += size
    return out


def _of_subsample(kept: np.ndarray, score: np.ndarray, order: np.ndarray | None, ranks: np.ndarray) -> np.ndarray:
    """inversion, pair_error, rho of the rows that stay; order: all rows by score, or None where scores are missing."""
    if order is None:
        return S.metrics_of_sets(score[None, kept], ranks[kept])[0, :3]
    along = (np.cumsum(kept, dtype=np.int32) - 1)[order[kept[order]]]
    model = np.empty((1, len(along)))
    model[0, along] = np.arange(1.0, len(along) + 1)
    return S._measured(model, falls(along[None, :]), ranks[kept])[0, :3]


def subsampled(features: DataFrame, ranking: DataFrame, candidate: dict[str, float], repeats: int = SUBSAMPLES) -> DataFrame:
    """repeat, the candidate's metrics less the baseline's in each subsample, strict_win. A task draws and measures some of the
    subsamples; no row is made for a symbol in a subsample."""
    own, base = (_ADDONS[NAME].score(q).cast("double").alias(n) for n, q in (("own", candidate), ("base", combinations()[0])))
    rows = placed(features.join(ranking.select("symbol", "true_rank"), "symbol"), [F.col("true_rank"), F.col("symbol")], "place")
    each = cut(rows.select(F.col("place").cast("int"), "symbol", F.col("true_rank").cast("double"), own, base))
    tasks = min(repeats, SUBSAMPLE_TASKS)
    names = [f"{p}_{c}" for p in ("own", "base") for c in ("inversion", "pair_error", "rho")]

    def measure(table: pa.Table) -> pa.Table:
        by_place = np.argsort(unpacked(table, "place"))
        symbols = [s.encode() for s in pc.list_flatten(table["symbol"]).take(pa.array(by_place)).to_pylist()]
        ranks, *scores = (unpacked(table, c)[by_place] for c in ("true_rank", "own", "base"))
        orders = [descending(s) if np.isfinite(s).all() else None for s in scores]
        some, found = range(table["task"][0].as_py(), repeats, tasks), []
        for repeat in some:
            kept = _kept(symbols, repeat)
            found.append(np.concatenate([_of_subsample(kept, s, o, ranks) for s, o in zip(scores, orders)]))
        return pa.table([pa.array(some, pa.int32()), *(pa.array(v) for v in np.array(found).T)], names=["repeat", *names])

    dealt = for_tasks(batched(each), tasks).repartitionByRange(tasks, "task")
    return dealt.groupBy("task").applyInArrow(measure, "repeat int, " + ", ".join(f"{c} double" for c in names)).select("repeat", *_deltas("own_", "base_"))


def subsample_summary(rows: DataFrame) -> DataFrame:
    """One row: subsamples, win_rate, and the middle 95 % of each delta."""
    spread = [F.percentile(f"{c}_delta", p).alias(f"{c}_{n}") for c in ("inversion", "rho", "pair_error") for n, p in (("low", 0.025), ("high", 0.975))]
    return rows.agg(F.count("*").alias("subsamples"), F.avg(F.col("strict_win").cast("double")).alias("win_rate"), *spread)
