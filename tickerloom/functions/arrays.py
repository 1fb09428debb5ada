"""Expressions over short arrays of doubles, oldest first: a symbol's visible bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def tail(a: Column, n: int | Column) -> Column:
    """The last n elements, or all."""
    n = F.least(F.lit(n) if isinstance(n, int) else n, F.size(a))
    return F.when(n > 0, F.slice(a, F.size(a) - n + 1, n)).otherwise(F.array().cast(DOUBLES))


def span(a: Column, start: Column, length: Column) -> Column:
    """length elements from the 0-based start; none if length isn't positive."""
    return F.when(length > 0, F.slice(a, start + 1, length)).otherwise(F.array().cast(DOUBLES))


def back(a: Column, k: int | Column) -> Column:
    """The element k before the last, or NULL."""
    at = F.size(a) - 1 - k
    return F.when(at >= 0, F.get(a, at))


def diffs(a: Column, step: int = 1) -> Column:
    n = F.size(a)
    return F.when(n > step, F.transform(F.sequence(F.lit(step), n - 1), lambda i: F.get(a, i) - F.get(a, i - step))).otherwise(F.array().cast(DOUBLES))


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def variance(a: Column, ddof: int = 0) -> Column:
    squares = lambda a, m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return let(a, lambda a: F.when(F.size(a) > ddof, let(mean(a), lambda m: squares(a, m)) / (F.size(a) - ddof)))


def _moments(y: Column) -> Column:
    """n, sxy, sxx, syy of y on 0, 1, 2, ..."""

    def about(y: Column, m: Column) -> Column:
        n = F.size(y)
        middle = (n - 1) / 2.0
        products = F.transform(y, lambda v, k: (k - middle) * (v - m))
        flat = F.array_max(y) == F.array_min(y)
        squares = F.aggregate(y, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
        return F.struct(n.alias("n"), F.when(flat, 0.0).otherwise(total(products)).alias("sxy"), (n * (n * n - 1) / 12.0).alias("sxx"), F.when(flat, 0.0).otherwise(squares).alias("syy"))

    return let(y, lambda y: let(mean(y), lambda m: about(y, m)))


def line(y: Column) -> Column:
    """A struct of slope and fit (R2) of y on 0, 1, 2, ...; a flat or single value: 0 and 1; none: NULLs."""

    def of(s: Column) -> Column:
        two, some = s["n"] > 1, (s["n"] > 1) & (s["syy"] > 0)
        slope = F.when(two, s["sxy"] / F.when(two, s["sxx"])).otherwise(F.when(s["n"] == 1, 0.0))
        fit = F.when(some, s["sxy"] * s["sxy"] / F.when(some, s["sxx"] * s["syy"])).otherwise(F.when(s["n"] > 0, 1.0))
        return F.struct(slope.alias("slope"), fit.alias("fit"))

    return let(_moments(y), of)


def ema(a: Column, days: int) -> Column:
    """The recursive average seeded with the first element; where an element equals the average, that stays as it is."""
    alpha = 2.0 / (days + 1)
    step = lambda acc, x: F.array_append(acc, F.when(x == F.element_at(acc, -1), x).otherwise(alpha * x + (1 - alpha) * F.element_at(acc, -1)))
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1), step)).otherwise(F.array().cast(DOUBLES))


def efficiency(returns: Column) -> Column:
    """The sum over the sum of absolute values; 0 if all are 0, NULL without any."""
    path = lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + F.abs(x))
    share = lambda r, p: F.when(p > 0, total(r) / F.when(p > 0, p)).otherwise(0.0)
    return let(returns, lambda r: F.when(F.size(r) > 0, let(path(r), lambda p: share(r, p))))


def running_max(a: Column) -> Column:
    return F.aggregate(a, F.array().cast(DOUBLES), lambda acc, x: F.array_append(acc, F.greatest(F.coalesce(F.try_element_at(acc, F.lit(-1)), x), x)))


def first_at(a: Column, value: Column) -> Column:
    """The 0-based position of the first element that is value."""
    return F.array_position(a, value) - 1


def longest_run(flags: Column) -> Column:
    """The length of the longest run of true."""
    return F.aggregate(
        flags,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, x: F.struct(F.when(x, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(x, s["now"] + 1).otherwise(0)).alias("best")),
        lambda s: s["best"],
    )


def trailing_run(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda s, x: F.when(x, s + 1).otherwise(0))
