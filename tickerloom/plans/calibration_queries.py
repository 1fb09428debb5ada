"""Queries that fit: beyond SQL but for the grids; tests hold them against conditions of optimality and brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import addons as A
from tickerloom.operators import calibrate as C
from tickerloom.operators import families as S
from tickerloom.operators import panel as P
from tickerloom.operators.features import features_of_prices
from tickerloom.operators.places import cut
from tickerloom.operators.score import FAMILIES, LEGACY_COLUMNS, direction
from tickerloom.plans import inputs as I
from tickerloom.plans.list_queries import SCORES, _scores

COLUMNS = (
    "r_3m", "r_1m", "r2_3m", "trend_quality_21d", "seg_ret_0_5", "stale_age", "downside_rms_20d", "dd_recovery", "r_3d_log", "log_slope_15d",
    "trend_r2_15d", "recovery_3d_vs_prior7", "ema20_accel", "r_21d_log", "trend_efficiency_15d", "downside_rms_10d", "log_slope_21d", "under_ema20_days",
)
DIRECTIONS = {c: direction(c) for c in COLUMNS}


def _inputs(spark, sf_dir):
    found = features_of_prices(P.clean(I.prices(spark, sf_dir))).select("symbol", "r_4m", "vol20_ann", "seg_ret_5_21", "seg_ret_21_63", "prior_support_sign", "mid_dip_recovery", "recent_up_days_5d", "recent_jump_share_5d", "jump_discontinuity_3m", "stale_after_run", "trend_efficiency_reward_15d", *COLUMNS)
    return cut(found), _scores(spark, sf_dir).select("symbol", "true_rank")


def family_search(spark, sf_dir):
    """The best of 2500 draws of each family's parameters."""
    found, ranking = _inputs(spark, sf_dir)
    measured = S.leading(found, S.splits(ranking, 0), S.sets_table(spark, S.drawn(FAMILIES, seeds=(20260729,))), FAMILIES)
    return I.rounded(S.best_sets(measured, ("family",)).select("family", "param_id", "inversion", "pair_error", "rho", "utility"))


def family_refined(spark, sf_dir):
    """The best of 2500 draws of each family by each of three seeds, refined in 250 steps."""
    found, ranking = _inputs(spark, sf_dir)
    return I.rounded(S.refined(found, ranking, FAMILIES)[0])


def _measured(spark, sf_dir):
    found, ranking = _inputs(spark, sf_dir)
    return cut(S.leading(found, S.splits(ranking), S.sets_table(spark, S.drawn(FAMILIES, seeds=S.SEEDS[:1])), FAMILIES))


def family_validation(spark, sf_dir):
    """Three times five splits of each family: 2500 sets are scored once, the best on the training rows is tried on the others."""
    return I.rounded(S.validated(_measured(spark, sf_dir)))


def family_chosen(spark, sf_dir):
    """Each family's splits and best set, and the family that is chosen within the band."""
    return I.rounded(S.chosen(_measured(spark, sf_dir)))


def validation_folds(spark, sf_dir):
    folds = S.splits(_scores(spark, sf_dir))
    return folds.select("symbol", "true_rank", *[F.col("folds")[k].alias(f"fold_{k}") for k in range(S.REPEATS)])


def fit_validation(spark, sf_dir):
    """Four times five outer splits of each kind of model."""
    found, ranking = _inputs(spark, sf_dir)
    return I.rounded(C.validation_summary(C.nested_validation(found, ranking, DIRECTIONS)))


def fit_stability(spark, sf_dir):
    """120 resamples."""
    found, ranking = _inputs(spark, sf_dir)
    return I.rounded(C.stability(C.weights(C.normalised(found, DIRECTIONS), ranking, 0.01, C.RESAMPLES)))


def legacy_weight_search(spark, sf_dir):
    """The ten best of 1500 sets of the archived score's parameters."""
    found = C.legacy_search(_whole(spark, sf_dir), _scores(spark, sf_dir), C.legacy_weights())
    return I.rounded(found.orderBy("inversion", F.desc("rho"), "pair_error", "param_id").limit(10))


def _whole(spark, sf_dir):
    return cut(features_of_prices(P.clean(I.prices(spark, sf_dir))).select("symbol", *LEGACY_COLUMNS))


def legacy_volatility_grid(spark, sf_dir):
    """The archived score's metrics under each of 125 treatments of volatility."""
    return I.rounded(C.legacy_search(_whole(spark, sf_dir), _scores(spark, sf_dir), C.legacy_volatility()))


def weight_grid(spark, sf_dir):
    scores = _scores(spark, sf_dir).select("symbol", "true_rank", "score", (F.col("true_rank") * 37 % 11 / 10).alias("one"), (F.col("true_rank") * 53 % 7 / 10).alias("two"))
    return I.rounded(C.weight_grid(scores, "one", "two", [k / 10 for k in range(13)], [k / 10 for k in range(11)]))


def _addons(spark, sf_dir):
    """symbol, true_rank, score, and stand-ins for a reward, a penalty and a curvature."""
    rank = F.col("true_rank")
    scores = _scores(spark, sf_dir).select("symbol", "true_rank", "score", (rank * 37 % 11 / 10).alias("one"), (rank * 53 % 7 / 10).alias("two"), ((rank * 29 % 13 - 6) / 10).alias("curve"))
    turned = cut(A.curvature_turn(scores, "curve"))
    return turned.drop("true_rank", "curve"), turned.select("symbol", "true_rank")


def addon_turn(spark, sf_dir):
    return I.rounded(_addons(spark, sf_dir)[0].select("symbol", "turn"))


def addon_grid(spark, sf_dir):
    return I.rounded(A.grid(*_addons(spark, sf_dir)))


def addon_validation(spark, sf_dir):
    """Forty times five splits, each with the best of 286 combinations of its training rows."""
    return I.rounded(A.nested_summary(A.nested(*_addons(spark, sf_dir))))


def addon_subsamples(spark, sf_dir):
    """The best combination against the baseline in 500 subsamples."""
    found, ranking = _addons(spark, sf_dir)
    best = A.best_of(A.grid(found, ranking)).first()
    return I.rounded(A.subsample_summary(A.subsampled(found, ranking, {c: best[c] for c in ("turned", "reward", "penalty")})))


def alpha_screen(spark, sf_dir):
    scores = _scores(spark, sf_dir).select("symbol", "true_rank", "score", (F.col("true_rank") * 37 % 11).alias("extra"))
    return I.rounded(C.alpha_grid(scores, "extra", spark.range(81).select((F.col("id") / 20 - 2).alias("alpha"))))


def label_variants(spark, sf_dir):
    return C.label_variants(_scores(spark, sf_dir).select("symbol", "true_rank"), [("1", "2"), ("2", "3"), ("4", "5")])


def choice_accuracy(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    choices = scores.select(F.col("symbol").alias("winner"), ((F.col("symbol").cast("int") % 5) + 1).cast("string").alias("loser"))
    return I.rounded(C.choice_accuracy(choices, scores))


QUERIES = {f.__name__: f for f in (family_search, family_refined, family_validation, family_chosen, validation_folds, addon_turn, addon_grid, addon_validation, addon_subsamples, fit_validation, fit_stability, legacy_weight_search, legacy_volatility_grid, weight_grid, alpha_screen, label_variants, choice_accuracy)}
_SWAPPED = "symbol"
for _k, (_a, _b) in enumerate([("1", "2"), ("2", "3"), ("4", "5")]):
    _SWAPPED = f"CASE WHEN v >> {_k} & 1 = 1 AND ({_SWAPPED}) = '{_a}' THEN '{_b}' WHEN v >> {_k} & 1 = 1 AND ({_SWAPPED}) = '{_b}' THEN '{_a}' ELSE ({_SWAPPED}) END"
_FOLDS = ", ".join(f"((row_number() OVER (PARTITION BY run ORDER BY sha256('{S.SEEDS[0]} {k} ' || symbol), symbol) - 1) % 5)::INTEGER AS fold_{k}" for k in range(S.REPEATS))
_TURN = f"""{SCORES}, raw AS (SELECT symbol, true_rank, score, (true_rank * 37 % 11) / 10::DOUBLE AS one, (true_rank * 53 % 7) / 10::DOUBLE AS two, (true_rank * 29 % 13 - 6) / 10::DOUBLE AS curve FROM scores),
h AS (SELECT *, greatest(curve, 0) AS up, greatest(-curve, 0) AS down FROM raw),
turned AS (SELECT *, 0.445971::DOUBLE * (0.3::DOUBLE + 0.3::DOUBLE) * ((up - avg(up) OVER ()) / stddev_pop(up) OVER () - (down - avg(down) OVER ()) / stddev_pop(down) OVER ()) AS turn FROM h)"""
ORACLE = {
    "addon_turn": f"WITH {_TURN} SELECT symbol, round(turn, 6) AS turn FROM turned",
    "addon_grid": f"""WITH {_TURN}, s AS (SELECT t::DOUBLE AS turned, r / 10::DOUBLE AS reward, p / 10::DOUBLE AS penalty, t * 143 + r * 11 + p AS param_id, true_rank, score + t::DOUBLE * turn + r / 10::DOUBLE * one - p / 10::DOUBLE * two AS score FROM turned, range(2) a(t), range(13) b(r), range(11) c(p)),
r AS (SELECT *, row_number() OVER (PARTITION BY param_id ORDER BY score DESC, true_rank) AS model_rank FROM s),
m AS (SELECT x.param_id, avg((x.score < y.score)::INTEGER) AS inversion, avg(abs((y.true_rank - x.true_rank) - (y.model_rank - x.model_rank))) AS pair_error FROM r x JOIN r y ON x.param_id = y.param_id AND x.true_rank < y.true_rank GROUP BY 1),
c AS (SELECT param_id, turned, reward, penalty, corr(true_rank, model_rank) AS rho FROM r GROUP BY ALL)
SELECT param_id, turned, reward, penalty, round(inversion, 6) AS inversion, round(pair_error, 6) AS pair_error, round(rho, 6) AS rho FROM m JOIN c USING (param_id)""",
    "validation_folds": f"WITH {SCORES}, runs AS (SELECT symbol, true_rank, ntile(5) OVER (ORDER BY true_rank, symbol) AS run FROM scores) SELECT symbol, true_rank, {_FOLDS} FROM runs",
    "alpha_screen": f"""WITH {SCORES}, s AS (SELECT k / 20::DOUBLE - 2 AS alpha, symbol, true_rank, score + (k / 20::DOUBLE - 2) * (true_rank * 37 % 11) AS score FROM scores, range(81) t(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY score DESC, true_rank) AS model_rank FROM s),
m AS (SELECT a.alpha, avg((a.score < b.score)::INTEGER) AS inversion, avg(abs((b.true_rank - a.true_rank) - (b.model_rank - a.model_rank))) AS pair_error FROM r a JOIN r b ON a.alpha = b.alpha AND a.true_rank < b.true_rank GROUP BY 1),
c AS (SELECT alpha, corr(true_rank, model_rank) AS rho FROM r GROUP BY 1) SELECT alpha, round(inversion, 6) AS inversion, round(pair_error, 6) AS pair_error, round(rho, 6) AS rho FROM m JOIN c USING (alpha)""",
    "weight_grid": f"""WITH {SCORES}, s AS (SELECT a / 10::DOUBLE AS a, b / 10::DOUBLE AS b, true_rank, score + a / 10::DOUBLE * ((true_rank * 37 % 11) / 10::DOUBLE) - b / 10::DOUBLE * ((true_rank * 53 % 7) / 10::DOUBLE) AS score FROM scores, range(13) t(a), range(11) u(b)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, true_rank) AS model_rank FROM s),
m AS (SELECT x.a, x.b, avg((x.score < y.score)::INTEGER) AS inversion, avg(abs((y.true_rank - x.true_rank) - (y.model_rank - x.model_rank))) AS pair_error FROM r x JOIN r y ON x.a = y.a AND x.b = y.b AND x.true_rank < y.true_rank GROUP BY 1, 2),
c AS (SELECT a, b, corr(true_rank, model_rank) AS rho FROM r GROUP BY 1, 2) SELECT a, b, round(inversion, 6) AS inversion, round(pair_error, 6) AS pair_error, round(rho, 6) AS rho FROM m JOIN c USING (a, b)""",
    "label_variants": f"WITH {SCORES} SELECT v AS variant, {_SWAPPED} AS symbol, true_rank FROM scores, range(8) t(v)",
    "choice_accuracy": f"WITH {SCORES} SELECT round(avg((a.score > b.score)::INTEGER), 6) AS accuracy FROM scores a JOIN scores b ON b.symbol = CAST(a.symbol::INTEGER % 5 + 1 AS VARCHAR)",
}
