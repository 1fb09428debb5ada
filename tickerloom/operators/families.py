"""Search, refinement, nested validation and choice of score families, for all families, seeds and folds at once.

A set of parameters is a row of one table with a column family; Spark scores every symbol under every set in one projection.
Scores travel packed, by arrays. A task gets whole sets (about TASK_ROWS scores, some splits), and works out their metrics
together: over all rows, and over the training and the test rows of each split, so a set is scored and sorted once however
many splits there are. Pairs that fall are counted once, by row; a split counts only those of its test rows anew. Where only the best
sets are asked for and the scores also take arrays (leading()), no scores travel: a task gets some sets and the rows' features, and
pairs that fall are counted only of sets that could still be the best if none fell but those that a coarse table tells. What follows
(the best set of each split's training rows, its metrics on the test rows, means and the band) are aggregations and joins
of rows of sets and splits. Sets are as many as are drawn, so they are broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.operators.places import cut, placed, tiled
from tickerloom.operators.ranking import batched, descending, falls, for_tasks, packed, rising_pairs, unpacked
from tickerloom.operators.score import Family, Inputs

#: Budgets: draws of each family and seed, steps of a refinement and their rounds, repeats of the splits and their folds.
DRAWS, REFINEMENTS, ROUNDS, REPEATS, FOLDS = 2500, 250, 5, 3, 5
#: The seeds; a multiplied parameter's spread; bounds of floors, edges and eps; families whose mean inversion in the
#: splits is within the band of the best one's are chosen among; weights of inversion, correlation and rank gaps.
SEEDS, SPREAD, BOUNDS, BAND, UTILITY = (20260802, 20260803, 20260811), 0.15, (1e-4, 0.5), 0.05, (-10.0, 3.0, -0.05)
#: Scores of a task, its repeats of splits, the least number of tasks, scores that are measured at once; compared numbers that
#: are held at once, and rows up to which all pairs are compared.
TASK_ROWS, TASK_REPEATS, TASKS, MEASURED = 4_000_000, 32, 32, 500_000
HELD, FEW = 4_000_000, 256
#: Of leading(): scores of a task, rows that are scored at once, scores of orders that are held, blocks of the coarse table.
LED_ROWS, SCORED, ORDERS, COARSE = 128_000_000, 8192, 32_000_000, 128
KEYS = ("family", "seed", "param_id")


def sets_table(spark: SparkSession, sets: list[tuple[str, int, int, dict[str, float]]]) -> DataFrame:
    """family, seed, param_id and a column q_... for each parameter of any family, null for the others'."""
    names = sorted({k for *_, q in sets for k in q})
    schema = "family string, seed long, param_id long" + "".join(f", q_{k} double" for k in names)
    return spark.createDataFrame([(f, s, k, *(q.get(x) for x in names)) for f, s, k, q in sets], schema)


def drawn(families: dict[str, Family], n: int = DRAWS, seeds: tuple[int, ...] = SEEDS) -> list[tuple[str, int, int, dict[str, float]]]:
    """For each family and seed the middle of the ranges, then n - 1 draws."""
    return [(name, seed, k, q) for name, one in families.items() for seed in seeds for k, q in enumerate([one.middle, *one.draw(n - 1, seed)])]


def splits(ranking: DataFrame, repeats: int = REPEATS, folds: int = FOLDS, seed: int = SEEDS[0]) -> DataFrame:
    """symbol, true_rank, folds: the fold of each repeat. Of each run of neighbours by rank (as many as folds) about as many go
    to each fold, in the order of a seeded hash."""
    runs = tiled(ranking.select("symbol", "true_rank"), folds, [F.col("true_rank"), F.col("symbol")], "_run")
    draw = lambda r: Window.partitionBy("_run").orderBy(F.sha2(F.concat(F.lit(f"{seed} {r} "), "symbol"), 256), "symbol")  # noqa: E731  one run's rows
    each = [((F.row_number().over(draw(r)) - 1) % folds).cast("int") for r in range(repeats)]
    return runs.select("symbol", "true_rank", (F.array(*each) if each else F.array().cast("array<int>")).alias("folds"))


def scores_of(rows: DataFrame, sets: DataFrame, families: dict[str, Family], columns: list[Column]) -> DataFrame:
    """columns and score of every row under every set. Each family is scored by itself: all in one expression make a method that
    is too large to be compiled."""
    named = {n: one for n, one in families.items() if all(f"q_{k}" in sets.columns for k in one.middle)}
    parts = [(F.col("family") == n, one.score({k: F.col(f"q_{k}") for k in one.middle})) for n, one in named.items()]
    parts.append((F.col("family").isNull() | ~F.col("family").isin(list(named)), F.lit(None).cast("double")))
    # as many sets as are drawn
    return functools.reduce(DataFrame.unionByName, [rows.crossJoin(F.broadcast(sets.where(own))).select(*columns, score.alias("score")) for own, score in parts])


def metrics_of_sets(scores: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
    """inversion, pair_error, rho, utility of each row of scores, whose columns are in the order of the true ranks: from 1 on, or
    ranks. Missing scores are the row's median. Fewer than two columns: 0, 0, 1."""
    many, n = scores.shape
    out = np.tile(np.array([0.0, 0.0, 1.0]), (many, 1))
    if n > 1 and many:
        known = np.isfinite(scores)
        middle = np.array([np.median(s[k]) if k.any() else 0.0 for s, k in zip(scores, known)])
        scores = np.where(known, scores, middle[:, None])
        model = np.empty((many, n))
        np.put_along_axis(model, np.argsort(-scores, axis=1, kind="stable"), np.arange(1.0, n + 1)[None, :].repeat(many, 0), axis=1)
        ranks = np.arange(1.0, n + 1) if ranks is None else ranks
        if n <= FEW:
            step = max(1, HELD // (n * n))
            upper = np.triu(np.ones((n, n), bool), 1)
            inverted = np.concatenate([((m[:, :, None] > m[:, None, :]) & upper).sum(axis=(1, 2)) for m in (model[at : at + step] for at in range(0, many, step))])
        else:
            inverted = np.array([rising_pairs(-m) for m in model])
        return _measured(model, inverted, ranks)
    return np.column_stack([out, out[:, [0, 2, 1]] @ np.array(UTILITY)])


def _measured(model: np.ndarray, inverted: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """inversion, pair_error, rho, utility of rows of positions from 1 on, of which so many pairs are inverted."""
    many, n = model.shape
    out = np.tile(np.array([0.0, 0.0, 1.0]), (many, 1))
    if n > 1:
        pairs, gaps, apart = n * (n - 1) / 2, ranks - model, ranks - ranks.mean()
        out[:, 0] = inverted / pairs
        out[:, 1] = (np.sort(gaps, axis=1) * (2 * np.arange(n) - n + 1)).sum(axis=1) / pairs
        out[:, 2] = (model - (n + 1) / 2) @ apart / np.sqrt(max((apart**2).sum(), 1e-300) * n * (n * n - 1.0) / 12)
    return np.column_stack([out, out[:, [0, 2, 1]] @ np.array(UTILITY)])


def _split_metrics(scores: np.ndarray, ranks: np.ndarray, folds: np.ndarray, anew: bool, whole: bool) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By column of folds and fold, metrics_of_sets() of the rows that aren't in the fold and of those that are; whole: of all
    and of none by (-1, -1). All of a set's cases come from one sort of its scores."""
    (many, n), found = scores.shape, {}
    cases = [(r, int(f)) for r in range(folds.shape[1]) for f in np.unique(folds[:, r])]
    if not np.isfinite(scores).all():  # medians stand in for missing scores, case by case
        for r, f in [(-1, -1)] * whole + cases:
            test = folds[:, r] == f if r >= 0 else np.zeros(n, bool)
            found[r, f] = tuple(metrics_of_sets(scores[:, some], None if anew else ranks[some]) for some in (~test, test))
        return found
    order, model = np.argsort(-scores, axis=1, kind="stable"), np.empty((many, n), np.int32)
    np.put_along_axis(model, order, np.arange(n, dtype=np.int32)[None, :], axis=1)
    part = falls(model, each=True)
    total = part.sum(axis=1, dtype=np.int64) // 2
    of = lambda some: np.arange(1.0, some.sum() + 1) if anew else ranks[some]
    if whole:
        every = np.ones(n, bool)
        found[-1, -1] = _measured(model + 1, total, of(every)), _measured(model[:, :0], total, ranks[:0])
    for r, f in cases:
        test = folds[:, r] == f
        held = test[order]
        before = np.cumsum(held, axis=1, dtype=np.int32)
        own = np.take_along_axis(before, model[:, test], 1)
        rest = model[:, ~test]
        rest = rest + 1 - np.take_along_axis(before, rest, 1)
        inside = falls(own - 1)
        found[r, f] = _measured(rest, total - np.where(held, part, 0).sum(axis=1, dtype=np.int64) + inside, of(~test)), _measured(own, inside, of(test))
    return found


_MEASURED = "number long, repeat int, fold int, inversion double, pair_error double, rho double, utility double, test_inversion double, test_pair_error double, test_rho double"


def set_metrics(features: DataFrame, ranked: DataFrame, sets: DataFrame, families: dict[str, Family], anew: bool = True) -> DataFrame:
    """KEYS, repeat, fold, inversion, pair_error, rho, utility, test_inversion, test_pair_error, test_rho: over all rows (repeat
    and fold -1, no tests), and for each repeat and fold of ranked's folds over the rows that aren't in the fold, the tests over
    those that are. anew: ranks count from 1 on among the rows that are looked at."""
    spark, n_sets = features.sparkSession, sets.count()
    each = cut(placed(features.join(ranked, "symbol"), [F.col("true_rank"), F.col("symbol")], "place"))
    n_rows, repeats = each.agg(F.count("*"), F.coalesce(F.max(F.size("folds")), F.lit(0))).first()
    per = max(1, min(TASK_ROWS // max(n_rows, 1), -(-n_sets // TASKS)))
    slices = max(1, -(-repeats // TASK_REPEATS))
    numbered = placed(sets, [F.col(k) for k in KEYS], "number", rows=n_sets)
    # a thousand rows a task or so, so that all cores score
    spread = each.drop("folds", "symbol", "true_rank").repartition(max(1, min(1000, n_rows * n_sets // TASK_ROWS)), "place")
    columns = [F.floor((F.col("number") - 1) / per).cast("int").alias("task"), F.pmod(F.col("number") - 1, F.lit(per)).cast("int").alias("number"), F.col("place").cast("int")]
    scored = scores_of(spread, cut(numbered), families, columns)
    scores = packed(scored, ("task",), ("number", "place", "score")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def rows_of(batches):
        for batch in batches:
            folds = batch.column("folds").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), repeats)
            some = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
            for k in range(slices):
                own = np.ascontiguousarray(folds[:, k * TASK_REPEATS : (k + 1) * TASK_REPEATS])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), some(batch.column("place")), some(batch.column("true_rank")), some(pa.array(own.ravel()))], names=["slice", "place", "true_rank", "folds"])

    rows = each.select(F.col("place").cast("int"), F.col("true_rank").cast("double"), F.col("folds").cast("array<int>"))
    rows = rows.mapInArrow(rows_of, "slice int, place array<int>, true_rank array<double>, folds array<int>")
    rows = rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(-(-n_sets // per) - 1))))

    def measure(key: tuple, scores: pa.Table, rows: pa.Table) -> pa.Table:
        task, own = (k.as_py() for k in key)
        place = unpacked(rows, "place") - 1
        n, k = len(place), min(TASK_REPEATS, repeats - own * TASK_REPEATS)
        ranks, folds = np.empty(n), np.empty((n, k), np.int32)
        ranks[place], folds[place] = unpacked(rows, "true_rank"), unpacked(rows, "folds").reshape(n, k)
        number = unpacked(scores, "number")
        score = np.empty((int(number.max()) + 1, n))
        score[number, unpacked(scores, "place") - 1] = unpacked(scores, "score")
        parts, step = [], max(1, MEASURED // n)
        for at in range(0, len(score), step):
            for (repeat, fold), (train, held) in _split_metrics(score[at : at + step], ranks, folds, anew, own == 0).items():
                some = np.arange(at, at + len(train)) + task * per + 1
                repeat += own * TASK_REPEATS if repeat >= 0 else 0
                names = [("number", some), ("repeat", np.full(len(some), repeat, np.int32)), ("fold", np.full(len(some), fold, np.int32)), *zip(("inversion", "pair_error", "rho", "utility"), train.T)]
                tests = [pa.array(values, mask=np.full(len(some), repeat < 0)) for values in held.T[:3]]
                parts.append(pa.table([*[pa.array(v) for _, v in names], *tests], names=[*[c for c, _ in names], "test_inversion", "test_pair_error", "test_rho"]))
        return pa.concat_tables(parts)

    found = scores.groupBy("task", "slice").cogroup(rows.groupBy("task", "slice")).applyInArrow(measure, _MEASURED)
    return found.join(F.broadcast(numbered.select("number", *KEYS)), "number").select(*KEYS, *[c for c in found.columns if c != "number"])  # as many sets as are drawn


def _gaps(along: np.ndarray) -> tuple[float, float]:
    """pair_error, rho of ranks from 0 on, in the order of the scores."""
    n = len(along)
    if n < 2:
        return 0.0, 1.0
    place = np.arange(n, dtype=along.dtype)
    apart = np.sort(along - place)
    error = float(apart.astype(float) @ np.arange(1.0 - n, n, 2.0)) / (n * (n - 1) / 2)
    return error, float((along - (n - 1) / 2) @ (place - (n - 1) / 2)) / (n * (n * n - 1.0) / 12)


def _least_falls(along: np.ndarray) -> int:
    """How many pairs of a permutation fall whose places and whose numbers lie in different blocks; no more pairs than those in one
    block fall besides."""
    n = len(along)
    shift = max(0, (n // COARSE).bit_length())
    blocks = ((n - 1) >> shift) + 1
    shared = np.bincount(((np.arange(n, dtype=np.int32) >> shift) * blocks) + (along >> shift), minlength=blocks * blocks).reshape(blocks, blocks)
    before = np.cumsum(shared, axis=0) - shared
    return int((shared * (np.cumsum(before[:, ::-1], axis=1)[:, ::-1] - before)).sum())


class _Cases:
    """The rows of all, and of the training rows of each repeat and fold; ranks count from 0 on among them."""

    def __init__(self, folds: np.ndarray):
        self.keys = [(-1, -1), *((r, int(f)) for r in range(folds.shape[1]) for f in np.unique(folds[:, r]))]
        self.tests = [None, *(folds[:, r] == f for r, f in self.keys[1:])]
        self.ranks = [None, *(self._ranks(~test) for test in self.tests[1:])]

    @staticmethod
    def _ranks(some: np.ndarray) -> np.ndarray:
        return np.where(some, np.cumsum(some) - 1, -1).astype(np.int32)

    def along(self, case: int, order: np.ndarray, held: bool = False) -> np.ndarray:
        """The case's ranks in the order of the scores; held: those of the other rows."""
        if self.tests[case] is None:
            return order[:0] if held else order
        ranks = (self._ranks(self.tests[case]) if held else self.ranks[case])[order]
        return ranks[ranks >= 0]

    def most(self, case: int, order: np.ndarray) -> float:
        """What the utility is at most."""
        along = self.along(case, order)
        error, rho = _gaps(along)
        pairs = len(along) * (len(along) - 1) / 2
        return float(np.dot((_least_falls(along) / pairs if pairs else 0.0, rho, error), UTILITY)) + 1e-9

    def metrics(self, case: int, order: np.ndarray, held: bool = False) -> tuple[float, float, float]:
        along = self.along(case, order, held)
        n = len(along)
        # falls along the order of scores are those along the ranks
        return float(falls(along[None, :])[0]) / (n * (n - 1) / 2) if n > 1 else 0.0, *_gaps(along)


def _leaders(score: Callable[[int], np.ndarray], groups: list[list[int]], folds: np.ndarray) -> Iterator[tuple]:
    """(set, repeat, fold, inversion, pair_error, rho, and these three of the other rows) of the best set of each group (numbers that
    score() takes) over all rows, and over each split's training rows: the first one of equal ones."""
    cases, held = _Cases(folds), {}
    holes: dict[int, dict] = {}

    def order(k: int) -> np.ndarray | None:
        """Rows by the scores of set k; None where some are missing, which medians stand in for, case by case."""
        if k not in held:
            one = score(k)
            if not np.isfinite(one).all():
                holes[k] = {key: (a[0], b[0]) for key, (a, b) in _split_metrics(one[None, :], np.arange(1.0, len(one) + 1), folds, True, True).items()}
                return None
            if len(held) >= max(1, ORDERS // len(one)):
                held.pop(next(iter(held)))
            held[k] = descending(one).astype(np.int32)
        return held[k]

    for group in groups:
        most = np.full((len(group), len(cases.keys)), np.inf)
        for at, k in enumerate(group):
            if (rows := order(k)) is not None:
                most[at] = [cases.most(case, rows) for case in range(len(cases.keys))]
        for case, key in enumerate(cases.keys):
            best = None
            for at in np.argsort(-most[:, case], kind="stable"):
                if best is not None and most[at, case] < -best[0] - 1e-9:
                    break
                k = group[at]
                own = holes[k][key][0][:3] if k in holes else cases.metrics(case, order(k))
                rank = (-round(float(np.dot(np.array(own)[[0, 2, 1]], UTILITY)), 12), k)
                if best is None or rank < best[:2]:
                    best = *rank, own
            _, k, own = best
            yield k, *key, *own, *(holes[k][key][1][:3] if k in holes else cases.metrics(case, order(k), True))


def leading(features: DataFrame, ranked: DataFrame, sets: DataFrame, families: dict[str, Family]) -> DataFrame:
    """The rows of set_metrics() of the sets that are the best of their family and seed among some of these, so that best_sets() finds
    the same. A task gets a run of sets and all rows' features, which it scores some rows at a time."""
    spark, n_sets = features.sparkSession, sets.count()
    known = {n: one for n, one in families.items() if one.reads}
    n_rows = ranked.count()
    if len(known) < len(families) or n_rows <= FEW:
        return set_metrics(features, ranked, sets, families)
    each = cut(placed(features.join(ranked, "symbol"), [F.col("true_rank"), F.col("symbol")], "place", rows=n_rows))
    repeats = each.agg(F.coalesce(F.max(F.size("folds")), F.lit(0))).first()[0]
    tasks = min(n_sets, max(TASKS, -(-n_rows * n_sets // LED_ROWS)))
    numbered = cut(placed(sets, [F.col(k) for k in KEYS], "number", rows=n_sets))
    read = sorted({c for one in known.values() for c in one.reads})
    rows = each.select(F.col("place").cast("int"), F.col("folds").cast("array<int>"), *[F.col(c).cast("double").alias(c) for c in read])
    runs = numbered.withColumn("task", F.floor((F.col("number") - 1) * tasks / n_sets).cast("int")).drop("param_id")
    names = [c for c in sets.columns if c.startswith("q_")]

    def lead(some: pa.Table) -> pa.Table:
        own, table = (some.filter(pc.field("number").is_valid() == flag) for flag in (True, False))
        place = unpacked(table, "place") - 1
        n = len(place)
        folds = np.empty((n, repeats), np.int32)
        folds[place] = unpacked(table, "folds").reshape(n, repeats)
        by_place = np.empty(n, np.int64)
        by_place[place] = np.arange(n)
        values = {c: unpacked(table, c)[by_place] for c in read}
        inputs = [Inputs({c: v[at : at + SCORED] for c, v in values.items()}) for at in range(0, n, SCORED)]
        del values
        listed = sorted(own.to_pylist(), key=lambda r: r["number"])
        q = [{c[2:]: r[c] for c in names if r[c] is not None} for r in listed]

        def score(k: int) -> np.ndarray:
            if listed[k]["family"] not in known:
                return np.full(n, np.nan)
            with np.errstate(all="ignore"):
                return np.concatenate([known[listed[k]["family"]].score(q[k], x) for x in inputs])

        groups: dict[tuple, list[int]] = {}
        for k, r in enumerate(listed):
            groups.setdefault((r["family"], r["seed"]), []).append(k)
        found = list(_leaders(score, list(groups.values()), folds))
        columns = list(zip(*found))
        whole = [r < 0 for r in columns[1]]
        out = [pa.array([listed[k]["number"] for k in columns[0]], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:3]), *(pa.array(c, pa.float64()) for c in columns[3:6])]
        out.append(pa.array([float(np.dot((m[3], m[5], m[4]), UTILITY)) for m in found], pa.float64()))
        out += [pa.array(c, pa.float64(), mask=np.array(whole)) for c in columns[6:9]]
        return pa.Table.from_arrays(out, names=[f.split()[0] for f in _MEASURED.split(", ")])

    both = for_tasks(batched(rows), tasks).unionByName(runs, allowMissingColumns=True).repartitionByRange(tasks, "task")
    found = both.groupBy("task").applyInArrow(lead, _MEASURED)
    return found.join(F.broadcast(numbered.select("number", *KEYS)), "number").select(*KEYS, *[c for c in found.columns if c != "number"])  # as many sets as are drawn


def best_sets(measured: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The row with the highest utility of each combination of by; of equal ones the first seed and param_id."""
    order = F.struct(-F.round("utility", 12), "seed", "param_id")
    return measured.groupBy(*by).agg(F.min_by(F.struct(*[c for c in measured.columns if c not in by]), order).alias("r")).select(*by, "r.*")


def _bounded(name: str) -> bool:
    return name.endswith("floor") or "edge" in name or name == "eps"


def moved(q: dict[str, float], rng: np.random.Generator) -> dict[str, float]:
    """q with each parameter multiplied by a draw near 1; floors, edges and eps stay within BOUNDS."""
    out = {k: float(v * np.exp(rng.normal(0, SPREAD if abs(v) > 1e-8 else 0.05))) for k, v in q.items()}
    return {k: float(np.clip(v, *BOUNDS)) if _bounded(k) else v for k, v in out.items()}


def refined(features: DataFrame, ranking: DataFrame, families: dict[str, Family], n: int = DRAWS, seeds: tuple[int, ...] = SEEDS, rounds: int = ROUNDS, steps: int = REFINEMENTS) -> tuple[DataFrame, dict[tuple[str, int], dict[str, float]]]:
    """(family, seed, drawn_utility, inversion, pair_error, rho, utility; the sets). From the best draw of each family and seed
    on, each round is one job over steps / rounds moved copies of every best set so far, which itself competes: never worse.
    The best sets, one for each family and seed, are what passes from round to round."""
    spark, ranked = features.sparkSession, cut(splits(ranking, 0))
    tried = {(f, s, k): q for f, s, k, q in drawn(families, n, seeds)}
    found = best_sets(leading(features, ranked, sets_table(spark, [(*k, q) for k, q in tried.items()]), families), ("family", "seed")).collect()
    start = {(r["family"], r["seed"]): r for r in found}
    state = {key: tried[(*key, r["param_id"])] for key, r in start.items()}
    last = dict(start)
    for k in range(rounds):
        tried = {}
        for number, (key, q) in enumerate(sorted(state.items())):
            rng = np.random.default_rng([key[1], number, k])
            tried |= {(*key, 0): q} | {(*key, j): moved(q, rng) for j in range(1, steps // rounds + 1)}
        found = best_sets(leading(features, ranked, sets_table(spark, [(*x, q) for x, q in tried.items()]), families), ("family", "seed")).collect()
        last = {(r["family"], r["seed"]): r for r in found}
        state = {key: tried[(*key, r["param_id"])] for key, r in last.items()}
    rows = [(*key, start[key]["utility"], r["inversion"], r["pair_error"], r["rho"], r["utility"]) for key, r in sorted(last.items())]
    return spark.createDataFrame(rows, "family string, seed long, drawn_utility double, inversion double, pair_error double, rho double, utility double"), state


def validated(measured: DataFrame) -> DataFrame:
    """family, repeat, fold, seed, param_id, train_inversion, inversion: the set that is best on a split's training rows, and
    its inversion on the others."""
    best = best_sets(measured.where("repeat >= 0"), ("family", "repeat", "fold"))
    return best.select("family", "repeat", "fold", "seed", "param_id", F.col("inversion").alias("train_inversion"), F.col("test_inversion").alias("inversion"))


def chosen(measured: DataFrame, band: float = BAND) -> DataFrame:
    """family, nested_mean, nested_sd (over the splits), and of the best set over all rows seed, param_id, inversion, rho,
    pair_error; eligible: nested_mean within band of the lowest; chosen: of these the one with the lowest inversion, then the
    highest rho, then the lowest nested_mean."""
    nested = validated(measured).groupBy("family").agg(F.avg("inversion").alias("nested_mean"), F.stddev_pop("inversion").alias("nested_sd"))
    whole = best_sets(measured.where("repeat < 0"), ("family",)).select("family", "seed", "param_id", "inversion", "rho", "pair_error")
    rows = nested.join(whole, "family")
    lowest = rows.agg(F.min("nested_mean").alias("_low"))
    rows = rows.crossJoin(F.broadcast(lowest)).withColumn("eligible", F.round(F.col("nested_mean") - F.col("_low"), 12) <= band)  # one row
    key = lambda: F.struct(*[F.round(c, 12).alias(n) for n, c in (("a", F.col("inversion")), ("b", -F.col("rho")), ("c", F.col("nested_mean")))], "family")
    first = rows.where("eligible").agg(F.min_by("family", key()).alias("_first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("chosen", F.col("family") == F.col("_first")).drop("_low", "_first")  # one row
