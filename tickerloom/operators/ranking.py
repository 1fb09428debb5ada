"""Ranks, rank metrics against a reference order, folds, and choices among parameter sets.

Positions along a ranking of any length are told by range partitions (places.py). The metrics of one score over a ranking of
any length come from blocks of both orders: pairs within a block are counted there, pairs across blocks by a histogram.
Metrics of many scores of one ranking (by parameter set, fold, resample) are a group each, in n log n; their rows travel packed.
The widest disagreeing pairs are looked for among the rows that the two orders place most differently.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.places import PART_ROWS, cut, placed, running, tiled


def rank_methods(scores: DataFrame, by: str = "score", key: str = "symbol") -> DataFrame:
    """scores and rank_first (ties by key), rank_min, rank_average; the best is 1."""
    first = placed(scores, [F.desc_nulls_last(by), F.col(key)], "rank_first")
    ties = first.groupBy(F.col(by).alias("_value")).agg(F.min("rank_first").cast("int").alias("rank_min"), F.avg("rank_first").alias("rank_average"))
    return first.join(ties, F.col(by).eqNullSafe(F.col("_value"))).drop("_value")


def with_model_rank(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    order = [F.desc_nulls_last("score"), F.col("true_rank")]
    if not by:
        return placed(scores, order, "model_rank")
    return scores.withColumn("model_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


#: Numbers of a permutation from which on its falls are counted by blocks; the least length of a block, and the most blocks.
BY_BLOCKS, BLOCK, BLOCKS = 4096, 256, 2048


def _falls_by_blocks(model: np.ndarray) -> int:
    """falls() of one permutation. Both orders are cut into blocks: pairs of different blocks in either are counted by a table of
    how many numbers each pair of blocks shares, pairs of one block by comparing its places with those so many behind."""
    n = len(model)
    size = BLOCK
    while size * BLOCKS < n:
        size *= 2
    blocks = -(-n // size)
    full = np.arange(blocks * size, dtype=np.int32)
    full[:n] = model
    place = np.empty_like(full)
    place[full] = np.arange(len(full), dtype=np.int32)
    small = np.uint16 if blocks * size <= 1 << 16 else np.int32
    of_number, of_place = ((x // size).astype(np.uint8 if blocks <= 256 else np.uint16) for x in (full, place))
    shared = np.bincount(np.repeat(np.arange(blocks) * blocks, size) + of_number, minlength=blocks * blocks).reshape(blocks, blocks)
    before = np.cumsum(shared, axis=0) - shared
    total = int((shared * (np.cumsum(before[:, ::-1], axis=1)[:, ::-1] - before)).sum())
    # pairs of one block of places; then those of one block of numbers whose blocks of places differ
    for values in (full.astype(small), of_place):
        lying = np.ascontiguousarray(values.reshape(blocks, size).T)
        found = np.empty(lying.shape, bool)
        total += sum(int(np.count_nonzero(np.less(lying[k:], lying[:-k], out=found[k:]))) for k in range(1, size))
    return total


def falls(model: np.ndarray, each: bool = False) -> np.ndarray:
    """Of each row, a permutation of 0.. n - 1, how many pairs i < j have model[i] > model[j]; each: for each number, of how many
    of these it is one. Bit by bit from the highest: rows lie by the bits above, in their order, and are dealt by the next one.
    Sums alone of long rows are counted by blocks."""
    many, n = model.shape
    if n >= BY_BLOCKS and not each:
        return np.array([_falls_by_blocks(m) for m in model], np.int64)
    at, part, total = model.astype(np.int32).ravel(), np.zeros(many * n, np.int32), np.zeros(many, np.int64)
    place = np.tile(np.arange(n, dtype=np.int32), many)
    row = np.repeat(np.arange(many, dtype=np.int64) * n, n)
    for bit in reversed(range(max(n - 1, 0).bit_length())):
        start = at >> (bit + 1) << (bit + 1)
        one = (at >> bit & 1).astype(bool)
        ones = np.cumsum(one.reshape(many, n), axis=1, dtype=np.int32).ravel() - one
        ones -= ones[row + start]
        zeros = place - start - ones
        more = np.where(one, 0, ones)
        total += more.reshape(many, n).sum(axis=1, dtype=np.int64)
        to = row + start + np.where(one, (1 << bit) + ones, zeros)
        if each:
            after = np.empty_like(part)
            after[to] = part + np.where(one, (1 << bit) - zeros, more)
            part = after
        after = np.empty_like(at)
        after[to] = at
        at = after
    return part.reshape(many, n) if each else total


def descending(values: np.ndarray) -> np.ndarray:
    """The places of finite values from the highest on, equal ones in their order."""
    order = np.argsort(-values)  # faster than a stable one; equal values are put in order next
    along = values[order]
    tied = np.r_[False, along[1:] == along[:-1], False]
    if tied.any():
        run, some = np.cumsum(~tied[:-1]), np.flatnonzero(tied[1:] | tied[:-1])
        key = run[some] * len(values) + order[some]
        key.sort()
        order[some] = key % len(values)
    return order


def rising_pairs(values: np.ndarray) -> int:
    """How many pairs i < j have values[i] < values[j]."""
    model = np.empty(len(values), np.int32)
    if values.dtype.kind == "f" and np.isfinite(values).all():
        model[descending(values)] = np.arange(len(values), dtype=np.int32)
        return int(falls(model[None, :])[0]) if len(values) else 0
    _, code = np.unique(values, return_inverse=True)
    model[np.argsort(-code, kind="stable")] = np.arange(len(values))
    return int(falls(model[None, :])[0]) if len(values) else 0


def metrics_of(rank: np.ndarray, score: np.ndarray) -> tuple[float, float, float]:
    """(inversion, pair_error, rho) of distinct ranks and scores, as rank_metrics() has them."""
    n = len(rank)
    if n <= 1:
        return 0.0, 0.0, 1.0
    order = np.argsort(rank, kind="stable")
    rank, score = rank[order].astype(float), score[order]
    model = np.empty(n)
    model[descending(score) if np.isfinite(score).all() else np.argsort(-score, kind="stable")] = np.arange(1, n + 1)
    apart = np.sort(rank - model)  # the mean difference of two of these is that of the rank gaps
    error = float((apart * (2 * np.arange(n) - n + 1)).sum() / (n * (n - 1) / 2))
    rho = float(np.corrcoef(rank, model)[0, 1]) if np.ptp(rank) > 0 else float("nan")
    return rising_pairs(score) / (n * (n - 1) / 2), error, rho


#: Values that a task of packed() holds.
PACKED = 1_000_000


def packed(rows: DataFrame, by: tuple[str, ...], values: tuple[str, ...], held: int = PACKED) -> DataFrame:
    """by, and an array of each of values: rows as they come, PACKED at a time, so that a shuffle by by moves arrays."""
    rows = rows.select(*by, *values)

    def pack(batches):
        some, n = [], 0

        def flush():
            table = pa.Table.from_batches(some).group_by(list(by), use_threads=False).aggregate([(v, "list") for v in values])
            return table.select([*by, *[f"{v}_list" for v in values]]).rename_columns([*by, *values]).combine_chunks().to_batches()

        for batch in batches:
            some, n = [*some, batch], n + len(batch)
            if n >= held:
                yield from flush()
                some, n = [], 0
        if n:
            yield from flush()

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(pack, ", ".join([f"`{c}` {types[c]}" for c in by] + [f"`{v}` array<{types[v]}>" for v in values]))


def batched(rows: DataFrame) -> DataFrame:
    """Each column as an array, flat where it held arrays: a row for each batch, so that many tasks can be given all rows."""

    def pack(batches):
        for batch in batches:
            flat = [pc.list_flatten(c) if pa.types.is_list(c.type) else c for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(c)], c) for c in flat], names=batch.schema.names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)  # or one task would copy them for all tasks
    return spread.mapInArrow(pack, ", ".join(f"`{c}` {k if k.startswith('array') else f'array<{k}>'}" for c, k in kinds.items()))


def for_tasks(batches: DataFrame, tasks: int) -> DataFrame:
    """batches and task: all of them for each task from 0 on."""
    return batches.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))


def unpacked(table: pa.Table, column: str) -> np.ndarray:
    return pc.list_flatten(table[column]).to_numpy()


#: Rows of a block of either order.
BLOCK_ROWS = 100_000


def _rising(blocks: DataFrame) -> DataFrame:
    """n: of each block, the pairs of which the one with the lower number has the lower value."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [rising_pairs(rows.sort_values("number")["value"].to_numpy())]})

    return blocks.groupBy("kind", "block").applyInPandas(count, "n long")


def long_rank_metrics(scores: DataFrame, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """rank_metrics() of one score, of any length. No rows: no row.

    t and m are a row's positions by true rank and by score. A pair is inverted if t rises where m falls. Both orders are cut
    into blocks of block_rows: pairs of one block of t are counted in it; of the others, pairs of one block of m in that; the
    rest follows from how many rows each pair of blocks shares, by sums over the blocks before and behind. The difference of
    two rows' rank gaps is that of their true_rank - m, so its sum over pairs is one along the order of these numbers.
    """
    rows = scores.select(F.col("true_rank").cast("double").alias("true_rank"), F.col("score").cast("double").alias("score")).where("true_rank IS NOT NULL AND score IS NOT NULL")
    many = rows.count()
    by_rank = placed(rows, [F.col("true_rank"), F.desc("score")], "t", part_rows, many)
    ranked = placed(by_rank, [F.desc("score"), F.col("t")], "m", part_rows, many)
    block = lambda c: F.floor((F.col(c) - 1) / block_rows)
    ranked = cut(ranked.select("true_rank", "t", "m", block("t").alias("tb"), block("m").alias("mb")))
    # within blocks of t, then within blocks of m between blocks of t: what falls by m there rises by -m
    one = [F.lit("t").alias("kind"), F.col("tb").alias("block"), F.col("t").alias("number"), (-F.col("m")).alias("value")]
    two = [F.lit("m").alias("kind"), F.col("mb").alias("block"), (-F.col("m")).alias("number"), F.col("tb").alias("value")]
    inside = _rising(ranked.select(*one).unionByName(ranked.select(*two)))
    cells = ranked.groupBy("tb", "mb").agg(F.count("*").alias("n"))
    # rows of earlier blocks of t by block of m, then of these the later blocks of m
    names = cells.select("tb").distinct().crossJoin(F.broadcast(cells.select("mb").distinct()))  # a block has block_rows rows, so these are few
    dense = names.join(cells, ["tb", "mb"], "left").na.fill(0, ["n"])
    earlier = F.sum("n").over(Window.partitionBy("mb").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1))
    later = F.sum("earlier").over(Window.partitionBy("tb").orderBy(F.desc("mb")).rowsBetween(Window.unboundedPreceding, -1))
    across = dense.withColumn("earlier", F.coalesce(earlier, F.lit(0))).withColumn("above", F.coalesce(later, F.lit(0))).select((F.col("n") * F.col("above")).alias("n"))
    inverted = inside.unionByName(across).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inverted"))
    totals = ranked.agg(F.count("*").alias("n"), F.corr("true_rank", "m").alias("rho"))
    # of c rows with the number d, b rows having lower ones: d counts (2 b + c - n) times for each
    apart = ranked.groupBy((F.col("true_rank") - F.col("m")).alias("d")).agg(F.count("*").alias("c"))
    along = running(apart, [F.col("d")], "upto", F.col("c"), part_rows, many)
    both = along.crossJoin(F.broadcast(totals)).agg(F.sum(F.col("d") * F.col("c") * (2 * F.col("upto") - F.col("c") - F.col("n"))).alias("gaps"))  # one row
    found = totals.where("n > 0").crossJoin(F.broadcast(inverted)).crossJoin(F.broadcast(both))  # one row each
    pairs_ = F.col("n") * (F.col("n") - 1) / 2
    few = F.col("n") <= 1
    inversion, error = F.when(few, 0.0).otherwise(F.try_divide("inverted", pairs_)), F.when(few, 0.0).otherwise(F.try_divide("gaps", pairs_))
    return found.select(inversion.alias("inversion"), error.alias("pair_error"), F.when(few, 1.0).otherwise(F.when(~F.isnan("rho"), F.col("rho"))).alias("rho"))


def rank_metrics(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, inversion (share of pairs that the score orders the other way), pair_error (mean difference of the two
    orders' rank gaps), rho (correlation of true ranks and positions by score; NULL if constant). Rows without a score or
    rank are left out. One row: no inversion and no error, rho 1; none: no row."""
    if not by:
        return long_rank_metrics(scores)
    named = scores.select(*by, F.col("true_rank").cast("double").alias("true_rank"), F.col("score").cast("double").alias("score")).where("true_rank IS NOT NULL AND score IS NOT NULL")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name in by] + ["inversion double", "pair_error double", "rho double"])

    def one(rows: pa.Table) -> pa.Table:
        found = metrics_of(unpacked(rows, "true_rank"), unpacked(rows, "score"))
        return pa.table([*[rows[c].slice(0, 1) for c in by], *[pa.array([x], pa.float64()) for x in found]], names=[*by, "inversion", "pair_error", "rho"])

    found = packed(named, by, ("true_rank", "score")).groupBy(*by).applyInArrow(one, schema)
    return found.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


#: Rows of either end that are paired first.
ENDS = 1000


def disagreements(scores: DataFrame, limit: int = 30, ends: int = ENDS) -> DataFrame:
    """The pairs that the score orders the other way, the widest first; ties by symbols.

    A pair's gap is the later row's true_rank - model_rank less the earlier one's. So the rows with the largest and those with the
    least difference are paired, and more of them, until no pair with another row can be as wide as the last one that is kept;
    a disagreeing pair's gap is over 0."""
    ranked = with_model_rank(scores).select("symbol", "true_rank", "score", (F.col("true_rank") - F.col("model_rank")).alias("d"))
    ranked = cut(ranked.where("true_rank IS NOT NULL AND score IS NOT NULL"))
    n, low, high = ranked.agg(F.count("*"), F.min("d"), F.max("d")).first()
    while True:
        down, up = ranked.orderBy("d", "symbol").limit(ends), ranked.orderBy(F.desc("d"), "symbol").limit(ends)
        a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in ranked.columns]) for s, rows in (("a", down), ("b", up)))
        two = a.repartition(max(1, min(ends, n) // 1000), "symbol_a").join(F.broadcast(b), (F.col("true_rank_a") < F.col("true_rank_b")) & (F.col("score_a") < F.col("score_b")))  # ends rows at most
        found = two.select("symbol_a", "symbol_b", (F.col("d_b") - F.col("d_a")).alias("gap")).orderBy(F.desc("gap"), "symbol_a", "symbol_b").limit(limit)
        if n <= ends:
            return found
        found = cut(found)
        kept, least = found.agg(F.count("*"), F.min("gap")).first()
        beyond = max(high - down.agg(F.max("d")).first()[0], up.agg(F.min("d")).first()[0] - low)
        if beyond <= 0 or (kept == limit and beyond < least):
            return found.orderBy(F.desc("gap"), "symbol_a", "symbol_b")
        ends *= 4


def residuals(scores: DataFrame, limit: int = 25) -> DataFrame:
    ranked = with_model_rank(scores)
    return ranked.select("symbol", "true_rank", "model_rank", F.abs(F.col("true_rank") - F.col("model_rank")).alias("gap")).orderBy(F.desc("gap"), "symbol").limit(limit)


def top_recall(scores: DataFrame, share: float = 0.2) -> DataFrame:
    """n, k (round half to even of n * share, 1 at least), recall of the true top k in the model's."""
    ranked = with_model_rank(scores)
    k = F.greatest(F.bround(F.count("*") * F.lit(share), 0).cast("long"), F.lit(1))
    sized = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n"), k.alias("k"))))  # one row
    hit = (F.col("true_rank") <= F.col("k")) & (F.col("model_rank") <= F.col("k"))
    return sized.groupBy("n", "k").agg((F.count_if(hit) / F.when(F.col("k") > 0, F.col("k"))).alias("recall"))


def folds(ranking: DataFrame, n: int, by: str = "true_rank") -> DataFrame:
    """ranking and fold 1..n: rank-stratified buckets, the larger ones first."""
    return tiled(ranking, n, [F.col(by)], "fold")


def resequenced(ranking: DataFrame, keep: Column) -> DataFrame:
    """The rows that keep holds for, with true_rank from 1 on again."""
    kept = ranking.where(keep).withColumnRenamed("true_rank", "_before")
    return placed(kept, [F.col("_before")], "true_rank").select(*ranking.columns)


def best(metrics: DataFrame, key: str) -> DataFrame:
    """The key with the lowest inversion, then the highest rho, then the lowest pair error, then the lowest key."""
    return metrics.agg(F.min_by(key, F.struct("inversion", -F.col("rho"), "pair_error", key)).alias(key))


def dominating(metrics: DataFrame, than: DataFrame) -> DataFrame:
    """metrics that are better than the one row than in all three."""
    base = than.select(*[F.col(c).alias(f"_{c}") for c in ("inversion", "rho", "pair_error")])
    return metrics.crossJoin(F.broadcast(base)).where("inversion < _inversion AND rho > _rho AND pair_error < _pair_error").drop("_inversion", "_rho", "_pair_error")


def thirds(scores: DataFrame, columns: list[str]) -> DataFrame:
    """bucket (TOP, MID, BOT by true_rank) and the columns' means."""
    found = tiled(scores, 3, [F.col("true_rank")], "third")
    name = F.when(F.col("third") == 1, "TOP").when(F.col("third") == 2, "MID").otherwise("BOT")
    return found.groupBy(name.alias("bucket")).agg(*[F.avg(c).alias(c) for c in columns])


def summary(df: DataFrame, column: str, before: str | None = None) -> DataFrame:
    """One row: n, mean, median, p10, p90, min, max; with before, how many differ from that column (n_changed)."""
    c = F.col(column)
    changed = [F.count_if(~c.eqNullSafe(F.col(before))).alias("n_changed")] if before else []
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.percentile(c, 0.1).alias("p10"), F.percentile(c, 0.9).alias("p90"), F.min(c).alias("min"), F.max(c).alias("max"), *changed)


def share_of(df: DataFrame, condition: Column, among: Column) -> DataFrame:
    """One row: n (rows that among holds for), share of these that condition holds for too; NULL if there are none."""
    return df.agg(F.count_if(among).alias("n"), F.try_divide(F.count_if(among & condition), F.count_if(among)).alias("share"))


def extremes(df: DataFrame, column: str, k: int, key: str = "symbol") -> DataFrame:
    """The k rows with the largest and the k with the smallest values (end: top, bottom); ties by key."""
    known = df.where(F.col(column).isNotNull())
    top = known.orderBy(F.desc(column), key).limit(k).withColumn("end", F.lit("top"))
    return top.unionByName(known.orderBy(column, key).limit(k).withColumn("end", F.lit("bottom")))


def win_rates(comparisons: DataFrame) -> DataFrame:
    """Of rows of param_id, inversion, base_inversion: each param_id's win_rate (share of strictly fewer inversions), mean
    inversion; the best rate first, then the lowest inversion."""
    each = comparisons.groupBy("param_id").agg(F.avg((F.col("inversion") < F.col("base_inversion")).cast("double")).alias("win_rate"), F.avg("inversion").alias("inversion"))
    return each.orderBy(F.desc("win_rate"), "inversion", "param_id")


def compare_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two tables of symbol, fms: n, only_a, only_b, the largest, median and mean difference, how many differ by 0.1,
    and the correlation of their ranks (rho; NULL if constant)."""
    both = a.select("symbol", F.col("fms").alias("x")).join(b.select("symbol", F.col("fms").alias("y")), "symbol", "full")
    d = F.abs(F.col("x") - F.col("y"))
    ranked = rank_methods(both.where("x IS NOT NULL AND y IS NOT NULL").select("symbol", "x", "y"), "x").select("symbol", "y", F.col("rank_min").cast("double").alias("x"))
    ranked = rank_methods(ranked, "y").select("x", F.col("rank_min").cast("double").alias("y"))
    spread = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    rho = ranked.agg(F.when(spread, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("rho"))
    found = both.agg(F.count(d).alias("n"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.max(d).alias("max_diff"), F.percentile(d, 0.5).alias("median_diff"), F.avg(d).alias("mean_diff"), F.count_if(F.round(d, 9) >= 0.1).alias("n_large"))
    return found.crossJoin(F.broadcast(rho))  # one row each
