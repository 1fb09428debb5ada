"""Scalar expressions. Missing numbers are NULL throughout: finite() turns NaN and infinities into NULL at each edge.

clip(), smoothstep(), softplus() and signed_power() also take numpy arrays, in which NaN is missing, so that a formula can be worked
out inside a task for many sets of parameters."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What maths() gives for arrays, by F's names.
_ARRAYS = SimpleNamespace(
    abs=np.abs, exp=np.exp, greatest=np.fmax, least=np.fmin, lit=lambda x: x, log1p=np.log1p, pow=np.power, signum=np.sign, sqrt=np.sqrt,
    where=np.where, known=lambda x: ~np.isnan(x), true=lambda condition: condition, missing=np.nan,
)
_COLUMNS = SimpleNamespace(
    abs=F.abs, exp=F.exp, greatest=F.greatest, least=F.least, lit=F.lit, log1p=F.log1p, pow=F.pow, signum=F.signum, sqrt=F.sqrt,
    where=lambda condition, x, other: F.when(condition, x).otherwise(other), known=lambda x: x.isNotNull(),
    true=lambda condition: F.coalesce(condition, F.lit(False)), missing=None,
)


def maths(x: Column | np.ndarray) -> SimpleNamespace:
    """Functions of columns, or of arrays."""
    return _ARRAYS if isinstance(x, np.ndarray) else _COLUMNS


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def positive(x: Column) -> Column:
    """A price, or NULL where it isn't positive."""
    return F.when(x > 0, x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """NULL stays NULL."""
    if isinstance(x, np.ndarray):
        return x if low is None and high is None else np.clip(x, low, high)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def smoothstep(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, a cubic between; 0 if both are equal."""
    if low == high:
        return x * 0.0 if isinstance(x, np.ndarray) else F.when(x.isNotNull(), F.lit(0.0))
    t = clip((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def softplus(x: Column, beta: float = 8.0) -> Column:
    f = maths(x)
    return f.log1p(f.exp(clip(x * beta, -40.0, 40.0))) / beta


def signed_power(x: Column, power: Column | float) -> Column:
    f = maths(x)
    return f.signum(x) * f.pow(f.abs(x), power)


def log_add_one(x: Column) -> Column:
    """ln(exp(x) + 1)."""
    return F.log1p(F.exp(x))


def horizon_return(r: float, from_days: int, to_days: int) -> float:
    """A return over from_days at the same rate over to_days."""
    return (1.0 + r) ** (to_days / from_days) - 1.0


def horizon_width(width: float, from_days: int, to_days: int) -> float:
    return width * (to_days / from_days) ** 0.5


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b, or otherwise where b is 0."""
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.when(b == 0, F.lit(otherwise)))
