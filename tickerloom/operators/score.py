"""Scores as expressions over a feature table: the production score, its sister families, and the archived ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.numbers import clip, finite, horizon_return, horizon_width, maths, ratio, signed_power, smoothstep, softplus

DISQUALIFIED = -999.0
#: Fixed values of the production score.
ALIVE_PULLBACK = {
    "floor": 0.012329795708609646,
    "w_recent": 1.081707572804269,
    "w_mid_pos": 91.66678635615453,
    "w_mid_neg_forgive": 0.27885902251782624,
    "w_prior": 0.020871093558278476,
    "w_abs": 0.03815477307854205,
    "w_breadth": 0.0905801299387842,
    "w_grind": 2.094465447805374,
    "w_stale_run": 201.76265960869708,
    "w_jump_share": 0.11205412188752384,
    "w_eff": 0.462436875074884,
    "pow_recent": 0.7912749674716275,
    "alive_boost": 3.130448039775118,
}


def feature(name: str, otherwise: float = 0.0) -> Column:
    return F.coalesce(finite(F.col(name)), F.lit(otherwise))


Params = dict[str, float | Column]


#: The features that the families' scores read.
READ = (
    "r_3m", "r2_3m", "vol20_ann", "seg_ret_0_5", "seg_ret_5_21", "seg_ret_21_63", "prior_support_sign", "mid_dip_recovery",
    "trend_efficiency_reward_15d", "recent_up_days_5d", "recent_jump_share_5d", "jump_discontinuity_3m", "stale_age", "stale_after_run",
)


class Inputs:
    """What the scores read of a feature table, with what counts where a feature is missing: columns, or where the features of
    some rows are given by name, arrays."""

    def __init__(self, of: dict[str, np.ndarray] | None = None):
        def read(name: str, otherwise: float = 0.0) -> Column | np.ndarray:
            return np.where(np.isfinite(of[name]), of[name], otherwise) if of is not None else feature(name, otherwise)

        self._kept: dict[str, Column | np.ndarray] = {}
        self.r3m, self.fit, self.vol = read("r_3m"), read("r2_3m", 0.5), read("vol20_ann", 0.2)
        self.recent, self.mid, self.prior = read("seg_ret_0_5"), read("seg_ret_5_21"), read("seg_ret_21_63")
        self.support, self.dip, self.eff = read("prior_support_sign"), read("mid_dip_recovery"), read("trend_efficiency_reward_15d")
        self.breadth, self.share = read("recent_up_days_5d") / 5.0, clip(read("recent_jump_share_5d"), 0.0, 1.0)
        f = maths(self.r3m)
        self.jump, self.stale, self.stale_run = (f.greatest(read(c), f.lit(0.0)) for c in ("jump_discontinuity_3m", "stale_age", "stale_after_run"))

    def once(self, name: str, value: Callable[[], Column | np.ndarray]) -> Column | np.ndarray:
        """What no parameter changes; worked out once for these rows."""
        if name not in self._kept:
            self._kept[name] = value()
        return self._kept[name]

    def soft(self, name: str) -> Column | np.ndarray:
        return self.once(name, lambda: softplus(getattr(self, name)))


def alive_pullback(q: Params = ALIVE_PULLBACK, x: Inputs | None = None) -> Column | np.ndarray:
    """Recent and older legs of a move, with credit for a pullback in a move that is alive, over penalties for jumps and
    for runs that went stale. Missing features count as 0, a missing fit as 0.5."""
    x = x or Inputs()
    above = softplus(x.r3m - q["floor"])
    grind = above * x.fit * (1.0 - x.share) * x.once("eff 0.05", lambda: softplus(x.eff + 0.05))
    body = (
        q["w_recent"] * signed_power(x.recent, q["pow_recent"])
        + q["alive_boost"] * x.soft("recent") * x.support
        + q["w_mid_pos"] * x.soft("mid")
        + q["w_mid_neg_forgive"] * x.dip * (0.5 + x.support)
        + q["w_prior"] * x.prior * (0.5 + x.support)
        + q["w_abs"] * above
        + q["w_breadth"] * x.breadth
        + q["w_grind"] * grind
        + q["w_eff"] * x.soft("eff")
    )
    return softplus(x.r3m - q["floor"] / 2.0) * body / (1.0 + q["w_stale_run"] * x.stale_run + q["w_jump_share"] * x.once("share 0.55", lambda: softplus(x.share - 0.55)))


def scored(features: DataFrame, score: Column | None = None) -> DataFrame:
    """features and fms; DISQUALIFIED where a column disqualified says so."""
    fms = alive_pullback() if score is None else score
    return features.withColumn("fms", F.when(F.col("disqualified"), DISQUALIFIED).otherwise(fms) if "disqualified" in features.columns else fms)


def z_scores(df: DataFrame, columns: list[str], excluded: Column | None = None) -> DataFrame:
    """df and z_<column>: against mean and population deviation of the rows that aren't excluded; 0 where that is 0."""
    counted = (lambda c: F.when(~excluded, F.col(c))) if excluded is not None else F.col
    stats = df.agg(*[f(counted(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.select("*", *[F.when(F.col(f"_s_{c}") > 0, ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))).otherwise(F.lit(0.0)).alias(f"z_{c}") for c in columns]).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def cash_strength() -> Column:
    """1 for a path like cash's (low return and volatility, straight), 0 for others; missing volatility: 0."""
    r, v, fit = F.col("r_3m"), F.col("vol20_ann"), F.col("r2_3m")
    strength = (1 - smoothstep(r, 0.01, 0.05)) * (1 - smoothstep(v, 0.005, 0.03)) * smoothstep(fit, 0.95, 0.99)
    return F.coalesce(strength, F.lit(0.0))


#: Fixed values of the archived sparse score: each axis's weight. Which way an axis counts is in DIRECTIONS.
SPARSE_AXES = {
    "r2_3m": 0.8464267343631183,
    "dd_recovery": 0.6013072809914602,
    "trend_quality_21d": 0.35431695139125063,
    "jump_discontinuity_3m": 0.2790170661950331,
    "under_ema20_days": 0.19660351882982424,
    "r_3m": 0.18698290479370505,
    "stale_age": 0.18175252387780497,
    "up_streak_5d": 0.1079152553498922,
    "trend_efficiency_reward_15d": 0.10776592373907062,
    "range_compression_20d": 0.10416888196208451,
}
#: Features of which less is better. Of every other one more is.
FALLING = (
    "under_ema20_depth", "under_ema20_days", "under_ema20_streak", "down_streak_5d", "trend_inefficiency_15d", "downside_rms_10d",
    "downside_rms_20d", "worst_log_return_20d", "post_spike_stall", "stale_age", "vol20_ann", "range_compression_20d",
    "jump_discontinuity_3m", "seg_vol_0_5", "seg_vol_5_21", "seg_vol_21_63", "recent_jump_share_5d", "stale_after_run",
)


def direction(name: str) -> int:
    """1 where more of the feature is better, -1 where less is."""
    return -1 if name in FALLING else 1


def sparse_parts(features: DataFrame, reference: DataFrame | None = None, gate: bool = True, clip_at: float = 4.0) -> DataFrame:
    """features and part_<axis>: weight * direction * z, with z against mean and population deviation of the reference (the
    rows of features that aren't disqualified, if none is given), clipped. A missing value counts as the reference's
    median; an axis with fewer than two values or no spread as 0. With gate, what an axis other than r_3m adds is scaled
    by 1 - cash_strength; what it takes away isn't."""
    known = features if reference is None else reference
    if "disqualified" in known.columns:
        known = known.where(~F.col("disqualified"))
    stats = known.agg(*[f(finite(F.col(c).cast("double"))).alias(f"_{n}_{c}") for c in SPARSE_AXES for n, f in (("md", F.median), ("m", F.avg), ("s", F.stddev_pop), ("n", F.count))])
    joined = features.crossJoin(F.broadcast(stats)).withColumn("_cash", cash_strength() if gate else F.lit(0.0))  # one row
    parts = []
    for c, weight in SPARSE_AXES.items():
        spread = F.when((F.col(f"_n_{c}") >= 2) & (F.col(f"_s_{c}") > 1e-12), F.col(f"_s_{c}"))
        z = clip((F.coalesce(finite(F.col(c).cast("double")), F.col(f"_md_{c}")) - F.col(f"_m_{c}")) / spread, -clip_at, clip_at)
        part = F.coalesce(weight * direction(c) * z, F.lit(0.0))
        parts.append((F.when(part > 0, part * (1.0 - F.col("_cash"))).otherwise(part) if gate and c != "r_3m" else part).alias(f"part_{c}"))
    return joined.select(*features.columns, *parts)


def sparse_score(features: DataFrame, reference: DataFrame | None = None, gate: bool = True) -> DataFrame:
    """features and sparse_fms, the sum of sparse_parts; DISQUALIFIED where a column disqualified says so."""
    total = sum((F.col(f"part_{c}") for c in SPARSE_AXES), F.lit(0.0))
    if "disqualified" in features.columns:
        total = F.when(F.col("disqualified"), F.lit(DISQUALIFIED)).otherwise(total)
    return sparse_parts(features, reference, gate).select(*features.columns, total.alias("sparse_fms"))


#: Fixed values of the archived score: hurdles of returns over three and four months (the latter mapped from six), centre and
#: hard floor of the fit's quality, hurdles of a strong return, and the cap of a drawdown.
GATE_R3M, GATE_R4M = 0.05, horizon_return(0.08, 126, 84)
STRONG_R3M, STRONG_R4M, STRONG_R1M = 0.3, horizon_return(0.50, 126, 84), 0.3
QUALITY_CENTRE, QUALITY_FLOOR, DRAWDOWN_CAP = 0.80, 0.5, 30.0


@dataclass(frozen=True)
class LegacyParams:
    """Weights and widths of the archived score; the defaults are its fixed values."""

    w_r3: float = 0.46869
    w_r4: float = 0.417409
    w_r2: float = 0.505669
    w_ema: float = 0.323264
    w_ema_shape: float = 0.445971
    w_recent: float = 0.228769
    w_r1_pos: float = 0.270777
    w_dd: float = 0.28298
    w_vol: float = 0.291973
    w_r1_neg: float = 0.212139
    w_break: float = 0.228832
    w_down5: float = 0.186758
    w_under_depth: float = 0.19622
    w_under_days: float = 0.097883
    r2_transition_w: float = 0.04552
    gate_r3_w: float = 0.019359
    gate_r4_w: float = horizon_width(0.006355, 126, 84)
    level_r3_hi: float = 0.205305
    level_r4_hi: float = horizon_return(0.430268, 126, 84)
    r2_floor: float = 0.734629
    w_ema_slope_base: float = 0.7
    w_ema_curv_reward_base: float = 0.3
    w_ema_curv_penalty_base: float = 0.3
    vol_q_pct: float = 70.0
    vol_hard_power: float = 1.5
    vol_hard_scale: float = 1.0

    def with_values(self, **values: float) -> LegacyParams:
        """The same with other values; raises on names that there aren't."""
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, **values)


    def columns(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def jittered(self, rng: np.random.Generator) -> LegacyParams:
        """Weights multiplied by noise within their bounds, widths and hurdles drawn evenly."""
        moved = {k: float(np.clip(getattr(self, k) * np.exp(rng.normal(0.0, sd)), lo, hi)) for k, (sd, lo, hi) in JITTER.items()}
        return replace(self, **moved, **{k: float(rng.uniform(lo, hi)) for k, (lo, hi) in EVEN.items()})


#: Fixed values of the archived score's search: of each weight the deviation of its logarithm, and its bounds; ranges of the
#: rest; the values of volatility's three that are tried.
JITTER = {
    "w_r3": (0.15, 0.15, 0.80), "w_r4": (0.15, 0.10, 0.70), "w_r2": (0.15, 0.10, 0.90), "w_ema": (0.20, 0.05, 0.60), "w_ema_shape": (0.20, 0.05, 0.60),
    "w_recent": (0.20, 0.00, 0.60), "w_r1_pos": (0.25, 0.00, 0.40), "w_dd": (0.15, 0.10, 0.80), "w_vol": (0.15, 0.05, 0.70), "w_r1_neg": (0.25, 0.00, 0.40),
    "w_break": (0.20, 0.00, 0.60), "w_down5": (0.20, 0.00, 0.60), "w_under_depth": (0.20, 0.00, 0.60), "w_under_days": (0.20, 0.00, 0.60),
}
EVEN = {"r2_transition_w": (0.005, 0.05), "gate_r3_w": (0.005, 0.03), "gate_r4_w": (0.005, 0.04), "level_r3_hi": (0.10, 0.25), "level_r4_hi": (0.18, 0.60), "r2_floor": (0.60, 0.90)}
VOLATILITY = {"vol_q_pct": (50.0, 55.0, 60.0, 65.0, 70.0), "vol_hard_power": (1.5, 1.75, 2.0, 2.25, 2.5), "vol_hard_scale": (0.25, 0.5, 0.75, 1.0, 1.25)}


def _legacy_terms(q: Params, of: Callable[[str], Column | np.ndarray] = F.col) -> dict[str, Column | np.ndarray]:
    """What is made a z-score of, by term; of: a feature, by default a column; the cap of volatility is one more, _cap."""
    r3, r4, r1, r10, slope, curve = (of(c) for c in ("r_3m", "r_4m", "r_1m", "r_10d", "ema20_slope_10d", "ema20_curv_20d"))
    fit, fall, vol = clip(of("r2_3m"), 0.0, 1.0), clip(-of("max_dd_pct"), 0.0), clip(of("vol20_ann"), 0.0)
    f = maths(r3)
    around = lambda x, centre, width: _step(x, f.lit(centre) - width, f.lit(centre) + width)
    gate = around(r3, GATE_R3M, q["gate_r3_w"]) * around(r4, GATE_R4M, q["gate_r4_w"])
    level = _step(r3, GATE_R3M, q["level_r3_hi"]) * _step(r4, GATE_R4M, q["level_r4_hi"])
    steps = 0.2 + 0.4 * around(fit, 0.70, q["r2_transition_w"]) + 0.6 * around(fit, 0.90, q["r2_transition_w"])
    strong = f.true((r3 > STRONG_R3M) & (r4 > STRONG_R4M))
    quality = around(fit, QUALITY_CENTRE, q["r2_transition_w"]) * f.where(strong, f.lit(1.0), f.lit(0.0))
    goes_on = f.true((r10 > 0) & (slope > 0))
    over = clip(fall - DRAWDOWN_CAP, 0.0)
    return {
        "r3": r3,
        "r4": r4,
        "r2": steps * fit * gate * (q["r2_floor"] + (1.0 - q["r2_floor"]) * level),
        "ema": of("above_ema50"),
        "r1_pos": r1 * quality,
        "dd": clip(fall, None, DRAWDOWN_CAP) + over * over / 70.0,
        "vol": f.where(f.known(vol), f.least(vol, of("_cap")) + q["vol_hard_scale"] * f.pow(f.greatest(vol - of("_cap"), f.lit(0.0)), q["vol_hard_power"]), f.missing),
        "r1_neg": f.where((quality < QUALITY_FLOOR) & (r1 > STRONG_R1M) & ~goes_on, r1, f.lit(0.0)),
        "slope": slope,
        "curve_reward": clip(-curve, 0.0),
        "curve_penalty": clip(curve, 0.0),
        "recent": r10 + 0.5 * of("r_5d"),
        "break": f.where((quality >= QUALITY_FLOOR) & (r10 < 0), -r10, f.lit(0.0)),
        "down5": of("down_streak_5d"),
        "under_depth": of("under_ema20_depth"),
        "under_days": of("under_ema20_days"),
    }


#: The terms that are compared with the reference; the others are with the symbols that aren't disqualified.
OF_REFERENCE = ("r3", "r4", "r2", "ema", "r1_pos", "dd", "vol", "r1_neg")


def _caps(df: DataFrame, percentiles: list[float], name: str) -> DataFrame:
    """One row: name, a map of volatility's percentiles."""
    v = clip(F.col("vol20_ann"), 0.0)
    return df.agg(F.create_map(*[x for p in percentiles for x in (F.lit(p), F.percentile(v, p / 100.0))]).alias(name))


def _legacy(features: DataFrame, reference: DataFrame | None, q: Params, percentiles: list[float], by: tuple[str, ...], once: DataFrame | None = None) -> DataFrame:
    """features and legacy_fms; by are columns of sets of parameters, each compared within itself; once: the features without the
    sets, since a percentile of rows that come once for each set lies between other rows."""
    once = features if once is None else once
    caps = _caps(once if reference is None else reference, percentiles, "_ref").crossJoin(F.broadcast(_caps(once, percentiles, "_own")))  # one row each
    at = F.lit(q["vol_q_pct"]) if not isinstance(q["vol_q_pct"], Column) else q["vol_q_pct"]
    cap = F.coalesce(F.try_element_at("_ref", at), F.try_element_at("_own", at), F.lit(0.0))
    names = list(_legacy_terms(q))

    def derived(df: DataFrame) -> DataFrame:
        capped = df.crossJoin(F.broadcast(caps)).withColumn("_cap", cap)
        return capped.select(*df.columns, *[c.cast("double").alias(f"_{n}") for n, c in _legacy_terms(q).items()])

    def compared(df: DataFrame, to: DataFrame, some: list[str], keep: Column | None = None) -> DataFrame:
        value = lambda n: F.col(f"_{n}") if keep is None else F.when(keep, F.col(f"_{n}"))
        stats = to.groupBy(*by).agg(*[f(value(n)).alias(f"_{k}_{n}") for n in some for k, f in (("m", F.avg), ("s", F.stddev_pop))])
        return df.join(F.broadcast(stats), list(by)) if by else df.crossJoin(F.broadcast(stats))  # a row for each set of parameters

    own = derived(features)
    joined = compared(own, own if reference is None else derived(reference), list(OF_REFERENCE))
    joined = compared(joined, own, [n for n in names if n not in OF_REFERENCE], ~F.col("disqualified") if "disqualified" in features.columns else None)

    def z(name: str) -> Column:
        spread = F.col(f"_s_{name}")
        return F.when(spread > 0, (F.col(f"_{name}") - F.col(f"_m_{name}")) / F.when(spread > 0, spread)).otherwise(F.col(f"_{name}") * 0.0)

    return joined.select(*features.columns, _legacy_sum(q, z).alias("legacy_fms"))


def _legacy_sum(q: Params, z: Callable[[str], Column | np.ndarray]) -> Column | np.ndarray:
    """The archived score of its terms' z-scores."""
    shape = q["w_ema_slope_base"] * z("slope") + q["w_ema_curv_reward_base"] * z("curve_reward") - q["w_ema_curv_penalty_base"] * z("curve_penalty")
    gain = q["w_r3"] * z("r3") + q["w_r4"] * z("r4") + q["w_r2"] * z("r2") + q["w_ema"] * z("ema") + q["w_ema_shape"] * shape + q["w_recent"] * z("recent") + q["w_r1_pos"] * z("r1_pos")
    loss = q["w_dd"] * z("dd") + q["w_vol"] * z("vol") + q["w_r1_neg"] * z("r1_neg") + q["w_break"] * z("break") + q["w_down5"] * z("down5") + q["w_under_depth"] * z("under_depth") + q["w_under_days"] * z("under_days")
    return gain - loss


def legacy_score(features: DataFrame, reference: DataFrame | None = None, q: LegacyParams = LegacyParams()) -> DataFrame:
    """features and legacy_fms: z-scored returns, gated fit, averages and recent moves, less drawdown, volatility over the
    reference's percentile, spikes, breaks and weakness. NULL where a feature is. Without a reference, features are it."""
    return _legacy(features, reference, q.columns(), [q.vol_q_pct], ())


#: The features that the archived score reads.
LEGACY_COLUMNS = ("r_1m", "r_3m", "r_4m", "r2_3m", "above_ema50", "vol20_ann", "max_dd_pct", "r_10d", "r_5d", "ema20_slope_10d", "ema20_curv_20d", "under_ema20_depth", "under_ema20_days", "down_streak_5d")


#: The parameters that a term depends on besides its weight; the other terms on none.
_TERM_PARAMS = {
    "r2": ("r2_transition_w", "gate_r3_w", "gate_r4_w", "level_r3_hi", "level_r4_hi", "r2_floor"),
    "r1_pos": ("r2_transition_w",),
    "r1_neg": ("r2_transition_w",),
    "break": ("r2_transition_w",),
    "vol": ("vol_q_pct", "vol_hard_power", "vol_hard_scale"),
}


def legacy_scores(values: dict[str, np.ndarray], sets: list[LegacyParams]) -> Iterator[np.ndarray]:
    """legacy_sweep() of arrays, NaN where it has NULL: the scores under each set. A term's z-scores are kept while its parameters stay."""
    vol = clip(values["vol20_ann"], 0.0)
    known = vol[~np.isnan(vol)]
    kept: dict[str, tuple] = {}
    for one in sets:
        q = one.columns()
        cap = np.full_like(vol, np.percentile(known, q["vol_q_pct"]) if len(known) else 0.0)
        terms = _legacy_terms(q, lambda c: cap if c == "_cap" else values[c])

        def z(name: str) -> np.ndarray:
            key = tuple(q[p] for p in _TERM_PARAMS.get(name, ()))
            if name not in kept or kept[name][0] != key:
                x = terms[name]
                some = x[~np.isnan(x)]
                even = not len(some) or some.min() == some.max()
                kept[name] = key, x * 0.0 if even else (x - some.mean()) / some.std()
            return kept[name][1]

        yield _legacy_sum(q, z)


def legacy_sweep(features: DataFrame, sets: list[LegacyParams]) -> DataFrame:
    """param_id (a place in sets), symbol, score under each set of parameters, in one job."""
    names = list(LegacyParams().columns())
    params = features.sparkSession.createDataFrame([(k, *[float(v) for v in q.columns().values()]) for k, q in enumerate(sets)], "param_id long, " + ", ".join(f"q_{n} double" for n in names))
    each = features.select("symbol", *LEGACY_COLUMNS).crossJoin(F.broadcast(params))  # as many rows as sets
    found = _legacy(each, None, {n: F.col(f"q_{n}") for n in names}, sorted({q.vol_q_pct for q in sets}), ("param_id",), features)
    return found.select("param_id", "symbol", F.col("legacy_fms").alias("score"))


def _floor_gated(q: Params, x: Inputs | None = None) -> Column | np.ndarray:
    """Returns of three legs, gated by a floor of the absolute return and divided by jumps and staleness."""
    x = x or Inputs()
    legs = q["w_recent"] * signed_power(x.recent, q["recent_pow"]) + q["w_mid"] * x.mid + q["w_prior"] * x.prior * (1.0 + q["support_boost"] * x.support)
    core = legs + q["w_abs"] * _step(x.r3m, q["r3m_floor"], q["r3m_full"]) * x.r3m
    return softplus(x.r3m - q["r3m_floor"]) * (1.0 + q["w_r2"] * x.fit) * core / (1.0 + q["w_jump"] * x.jump + q["w_stale"] * x.stale)


def _step(x: Column, low: float | Column, high: float | Column) -> Column:
    """smoothstep with edges that may be columns."""
    if isinstance(x, np.ndarray):
        if low == high:
            return np.zeros_like(x)
        t = np.fmin(np.fmax((x - low) / (high - low), 0.0), 1.0)
        return t * t * (3.0 - 2.0 * t)
    low, high = (e if isinstance(e, Column) else F.lit(e) for e in (low, high))
    t = F.least(F.greatest(F.try_divide(x - low, high - low), F.lit(0.0)), F.lit(1.0))
    return F.when(low != high, t * t * (3.0 - 2.0 * t)).otherwise(F.lit(0.0))


def _regime_switch(q: Params, x: Inputs | None = None) -> Column | np.ndarray:
    """The recent leg where the absolute return is weak, the older ones too where it is strong; less for paths like cash's."""
    x = x or Inputs()
    weak, strong = 1.0 - _step(x.r3m, q["weak_edge"] * 0.5, q["weak_edge"]), _step(x.r3m, q["weak_edge"], q["strong_edge"])
    turn = signed_power(x.recent, q["pow_recent"])
    held = q["a_recent_strong"] * turn + q["a_prior_strong"] * x.prior * (0.5 + x.support) + 0.5 * x.mid
    body = weak * q["a_recent_weak"] * turn + strong * held + q["a_smooth"] * x.fit * strong
    cash = x.once("cash", lambda: (1.0 - smoothstep(x.r3m, 0.005, 0.03)) * (1.0 - smoothstep(x.vol, 0.005, 0.04)))
    return x.once("r3m 0.005", lambda: softplus(x.r3m - 0.005)) * body / (1.0 + q["b_vol"] * cash + q["c_jump"] * x.jump)


def _product(q: Params, x: Inputs | None = None) -> Column | np.ndarray:
    """The product of powers of all legs, so that each has to confirm the others."""
    x = x or Inputs()
    legs = ((x.soft("recent"), "a_recent"), (x.soft("mid"), "a_mid"), (x.once("backed", lambda: softplus(x.prior * x.support)), "a_prior"), (softplus(x.r3m - q["floor"]), "a_abs"))
    out = 1.0 + q["w_eff"] * x.soft("eff")
    for leg, power in legs:
        out = out * maths(leg).pow(leg + q["eps"], q[power])
    return out / ((1.0 + q["w_jump"] * x.jump) * (1.0 + q["w_stale"] * x.stale))


def _hybrid(q: Params, x: Inputs | None = None) -> Column | np.ndarray:
    """A signed square of the recent leg, a root of the middle one times the older one, less the logarithm of jumps."""
    x = x or Inputs()
    f = maths(x.mid)
    root = f.sqrt(f.greatest(q["c1"] + x.mid, f.lit(1e-8)))
    body = q["c0"] * x.once("recent 2", lambda: signed_power(x.recent, 2.0)) + root * x.prior * (0.5 + x.support) + q["c2"] * softplus(x.r3m - q["floor"]) - q["c3"] * x.once("jump 1.23", lambda: f.log1p(1.23 * x.jump))
    return softplus(x.r3m - q["floor"] * 0.5) * body / f.pow(1.0 + q["c4"] * x.stale, q["pow_den"])


def _continuation(q: Params, x: Inputs | None = None) -> Column | np.ndarray:
    """A dip of the middle leg is forgiven where older and recent ones hold."""
    x = x or Inputs()
    mid = q["w_mid_pos"] * x.soft("mid") + q["w_mid_neg_forgive"] * x.dip * x.support
    body = q["w_recent"] * signed_power(x.recent, q["pow_recent"]) + mid + q["w_prior"] * x.prior * (0.5 + x.support) + q["w_abs"] * softplus(x.r3m - q["floor"]) + q["w_breadth"] * x.breadth + q["w_eff"] * x.soft("eff")
    return softplus(x.r3m - q["floor"] * 0.5) * body / (1.0 + q["w_stale_run"] * x.stale_run + q["w_jump_share"] * x.once("share 0.55", lambda: softplus(x.share - 0.55)))


def _anti_stale(q: Params, x: Inputs | None = None) -> Column | np.ndarray:
    """A large return counts as far as the path is alive and isn't one day's."""
    x = x or Inputs()
    alive, spread = 1.0 - _step(x.stale_run, q["stale_edge0"], q["stale_edge1"]), 1.0 - _step(x.share, q["jump_edge0"], q["jump_edge1"])
    f = maths(x.r3m)
    legs = f.pow(softplus(x.r3m - q["floor"]), q["a_abs"]) * f.pow(x.soft("recent"), q["a_recent"]) * f.pow(x.soft("prior") * (0.5 + x.support) + q["eps"], q["a_prior"])
    return legs * (1.0 + q["w_mid"] * x.soft("mid")) * (1.0 + q["a_r2"] * x.fit) * (0.4 + 0.6 * x.breadth) * (0.25 + 0.75 * alive) * (0.25 + 0.75 * spread)


@dataclass(frozen=True)
class Family:
    """A score with parameters: the range that each is drawn from, evenly, or evenly in its logarithm. reads: the features that
    score(q, Inputs(features)) reads where it also takes arrays."""

    name: str
    score: Callable[..., Column | np.ndarray]
    even: dict[str, tuple[float, float]]
    logarithmic: dict[str, tuple[float, float]]
    reads: tuple[str, ...] = ()

    def draw(self, n: int, seed: int) -> list[dict[str, float]]:
        """n sets of parameters."""
        rng = np.random.default_rng(seed)
        drawn = {k: rng.uniform(*r, n) for k, r in self.even.items()} | {k: np.exp(rng.uniform(*np.log(r), n)) for k, r in self.logarithmic.items()}
        return [{k: float(v[i]) for k, v in drawn.items()} for i in range(n)]

    @property
    def middle(self) -> dict[str, float]:
        """The middle of each range."""
        return {k: (a + b) / 2 for k, (a, b) in self.even.items()} | {k: (a * b) ** 0.5 for k, (a, b) in self.logarithmic.items()}


#: The ranges of each family's parameters.
FAMILIES = {
    f.name: replace(f, reads=READ)
    for f in (
        Family(
            "floor_gated",
            _floor_gated,
            {"r3m_floor": (0.005, 0.04), "r3m_full": (0.04, 0.15), "recent_pow": (0.6, 1.8), "support_boost": (0.5, 2.0)},
            {"w_recent": (0.3, 3.0), "w_mid": (0.1, 2.0), "w_prior": (0.05, 1.5), "w_abs": (0.2, 2.5), "w_r2": (0.05, 1.2), "w_jump": (0.2, 3.0), "w_stale": (0.1, 2.0)},
        ),
        Family(
            "regime_switch",
            _regime_switch,
            {"weak_edge": (0.02, 0.08), "strong_edge": (0.12, 0.35), "pow_recent": (0.5, 1.6)},
            {"a_recent_weak": (0.8, 4.0), "a_recent_strong": (0.2, 2.0), "a_prior_strong": (0.3, 2.5), "a_smooth": (0.1, 1.5), "b_vol": (0.2, 3.0), "c_jump": (0.2, 3.0)},
        ),
        Family(
            "product_confirmation",
            _product,
            {"floor": (0.005, 0.03), "a_recent": (0.4, 1.8), "a_mid": (0.2, 1.2), "a_prior": (0.2, 1.4), "a_abs": (0.3, 1.6), "eps": (0.01, 0.08)},
            {"w_jump": (0.3, 4.0), "w_stale": (0.2, 3.0), "w_eff": (0.1, 2.0)},
        ),
        Family(
            "hybrid_sqrt_log",
            _hybrid,
            {"c0": (0.2, 2.0), "c1": (0.2, 2.5), "c2": (0.1, 2.0), "c3": (0.1, 1.5), "c4": (0.2, 2.0), "floor": (0.005, 0.03), "pow_den": (0.5, 1.5)},
            {},
        ),
        Family(
            "pullback_continuation",
            _continuation,
            {"floor": (0.008, 0.035), "pow_recent": (0.6, 1.7)},
            {"w_recent": (0.5, 3.5), "w_mid_pos": (0.2, 2.0), "w_mid_neg_forgive": (0.1, 2.5), "w_prior": (0.2, 2.0), "w_abs": (0.2, 2.0), "w_breadth": (0.05, 1.5), "w_stale_run": (0.3, 4.0), "w_jump_share": (0.3, 4.0), "w_eff": (0.1, 2.0)},
        ),
        Family(
            "anti_stale_run",
            _anti_stale,
            {"floor": (0.01, 0.04), "a_abs": (0.4, 1.6), "a_recent": (0.6, 2.0), "a_prior": (0.2, 1.2), "a_r2": (0.1, 1.0), "stale_edge0": (0.15, 0.45), "stale_edge1": (0.6, 1.4), "jump_edge0": (0.45, 0.65), "jump_edge1": (0.75, 0.98), "eps": (0.01, 0.06)},
            {"w_mid": (0.1, 1.5)},
        ),
        Family(
            "alive_pullback",
            alive_pullback,
            {"floor": (0.008, 0.035), "pow_recent": (0.55, 1.6), "alive_boost": (0.3, 1.8)},
            {"w_recent": (0.5, 3.5), "w_mid_pos": (0.15, 1.8), "w_mid_neg_forgive": (0.2, 3.0), "w_prior": (0.2, 2.2), "w_abs": (0.15, 1.8), "w_breadth": (0.05, 1.8), "w_grind": (0.05, 1.5), "w_stale_run": (0.5, 5.0), "w_jump_share": (0.5, 5.0), "w_eff": (0.05, 1.5)},
        ),
    )
}


def family(name: str) -> Family:
    """Raises KeyError for an unknown name."""
    return FAMILIES[name]
