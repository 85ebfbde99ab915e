"""Intervals and tests as columns; the two that have no closed form are vectorised helpers over result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959964
Z_RANKING = 1.96


def as_double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def share(n: Column, of: Column) -> Column:
    """n / of; null where there is nothing to divide by."""
    return F.try_divide(n.cast("double"), of.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95, empty: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Struct (lo, hi) of Wilson's score interval; k may be fractional. Without trials: ``empty``."""
    k, n = k.cast("double"), n.cast("double")
    some = F.when(n > 0, n)
    p = k / some
    zz = z * z
    centre = (p + zz / (2 * some)) / (1 + zz / some)
    half = z * F.sqrt(p * (1 - p) / some + zz / (4 * some * some)) / (1 + zz / some)
    return F.struct(
        F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(empty[0]).alias("lo"),
        F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(empty[1]).alias("hi"),
    )


def wilson_ranking(k: Column, n: Column) -> Column:
    """The convention of rankings: z = 1.96 and (0, 0) without trials."""
    return wilson(k, n, Z_RANKING, (0.0, 0.0))


def time_bound(timed_out: Column, failed: Column) -> Column:
    """Most failures ran out of time (three at least), so the rate is a floor."""
    return (timed_out >= 3) & (2 * timed_out >= failed)


def standing(lo: Column, hi: Column, margin: float = 0.10) -> Column:
    """Where the gap (other side minus this one) with interval [lo, hi] stands against a margin."""
    return F.when(hi < 0, "ahead").when(hi < margin, "caught up").when(lo > margin, "behind").otherwise("open")


def half_up(x: Column, digits: int) -> Column:
    """Rounds as a reader does: half away from zero on the decimal text of the double."""
    return F.round(x.cast("string").cast("decimal(38,15)"), digits)


@F.pandas_udf(T.DoubleType())
def mcnemar_exact(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    """Two-sided exact p of a split of discordant pairs at least this uneven; 1 without any."""

    def p(a: int, b: int) -> float:
        n, k = a + b, min(a, b)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(math.exp(x - n * math.log(2)) for x in logs)) if n else 1.0

    return pd.Series([p(int(a), int(b)) for a, b in zip(only_a, only_b, strict=True)], dtype="float64")


def _score(a: np.ndarray, b: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Score statistic of the paired difference d; the free cell probability is its constrained maximum-likelihood
    value, the larger root of a quadratic."""
    linear = (2 * n - a + b) * d - a - b
    root = (np.sqrt(np.maximum(linear**2 + 8 * n * b * d * (1 - d), 0)) - linear) / (4 * n)
    top, var = a - b - n * d, n * (2 * root + d * (1 - d))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = top / np.sqrt(var)
    return np.where(var > 0, z, np.where(top == 0, 0.0, np.copysign(np.inf, top)))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("gap", "lo", "hi")]))
def paired_difference(only_a: pd.Series, only_b: pd.Series, pairs: pd.Series) -> pd.DataFrame:
    """Difference of two paired rates with its 95 % score interval: both ends of all rows are bisected side by side."""
    a, b, n = (s.to_numpy(float) for s in (only_a, only_b, pairs))
    m = np.maximum(n, 1)
    gap = (a - b) / m
    ends = []
    for sign in (-1.0, 1.0):
        inside, outside = gap.copy(), np.full(len(gap), sign)
        open_end = _score(a, b, m, outside) * -sign <= Z95
        for _ in range(100):
            mid = (inside + outside) / 2
            beyond = _score(a, b, m, mid) * -sign > Z95
            outside, inside = np.where(beyond, mid, outside), np.where(beyond, inside, mid)
        ends.append(np.where(open_end, sign, (inside + outside) / 2))
    empty = n <= 0
    return pd.DataFrame({"gap": np.where(empty, 0.0, gap), "lo": np.where(empty, -1.0, ends[0]), "hi": np.where(empty, 1.0, ends[1])})


def pearson(x: Column, y: Column, least: int = 10, floor: float = 1e-9) -> Column:
    """Population correlation of complete pairs; null below ``least`` pairs, standard deviations floored."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when(F.count(a) >= least, F.covar_pop(a, b) / (F.greatest(F.stddev_pop(a), F.lit(floor)) * F.greatest(F.stddev_pop(b), F.lit(floor))))
