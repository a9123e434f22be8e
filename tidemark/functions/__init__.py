"""Scalar functions as column expressions, and the inverse Student distribution."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def sanitize(name: Column) -> Column:
    """Runs of white space to one hyphen."""
    return F.regexp_replace(name, r"\s+", "-")


def metric_of(topic: Column) -> Column:
    return F.element_at(F.split(topic, r"\."), 1)


def month_key(ts: Column) -> Column:
    return F.year(ts) * 100 + F.month(ts)


def season_bin(ms: Column, wavelength_ms: int, bins: int) -> Column:
    """Bin of a time within its wavelength; times before the epoch wrap."""
    return F.floor(F.pmod(ms, F.lit(wavelength_ms)) * bins / wavelength_ms).cast("bigint")


def day_hour_key(ts: Column) -> Column:
    """Day of the week and hour, as Monday:13."""
    return F.concat_ws(":", F.date_format(ts, "EEEE"), F.hour(ts).cast("string"))


def same_month(ts: Column, as_of: Column) -> Column:
    return month_key(ts) == month_key(as_of)


def scope_id(plan: Column, topic: Column) -> Column:
    return F.concat_ws(":", plan, topic)


def scope_parts(scope: Column) -> tuple[Column, Column]:
    """Plan and topic of a scope id; a topic may hold colons."""
    parts = F.split(scope, ":", 2)
    return F.get(parts, 0), F.get(parts, 1)


#: <plan name>@<plan id>:<topic or group>:<span>
ALGORITHM_ID = r"^(.*)@(.*):(topic|group):(.*)$"


def algorithm_id_parts(text: Column) -> Column:
    """Struct (plan_name, plan_id, span_type, span) of an algorithm's id; null where it doesn't have that form."""
    parts = [F.regexp_extract(text, ALGORITHM_ID, k).alias(n) for k, n in enumerate(("plan_name", "plan_id", "span_type", "span"), 1)]
    return F.when(text.rlike(ALGORITHM_ID), F.struct(*parts))


def lookup(values: Column, key: Column, default: Column) -> Column:
    """A map's value for a key, or the default."""
    return F.coalesce(F.try_element_at(values, key), default)


def cell(topic: Column, cells: int) -> Column:
    return F.pmod(F.hash(topic), F.lit(cells))


def alpha_of_half_life(half_life: float) -> float:
    return 1 - math.exp(math.log(0.5) / half_life)


def alpha_of_centre_of_mass(com: float) -> float:
    return 1 / (1 + com / 100)


def common_prefix(low: Column, high: Column, delimiters: str = r"._+:\-/\\") -> Column:
    """The longest common prefix of a group, from its least and greatest member, without delimiters at its end."""
    n = F.least(F.length(low), F.length(high))
    hits = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k))
    return F.regexp_replace(F.substring(low, F.lit(1), F.array_max(hits)), rf"[{delimiters}]+$", "")


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


@lru_cache(maxsize=100_000)
def inverse_t(p: float, df: float) -> float:
    """The p-quantile of Student's distribution, by bisection on its tail."""
    if p > 0.5:
        return -inverse_t(1 - p, df)
    low, high = -1.0, 0.0
    tail = lambda t: 0.5 * _beta(df / 2, 0.5, df / (df + t * t))
    while tail(low) > p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if tail(mid) > p:
            high = mid
        else:
            low = mid
        if high - low < 1e-13 * abs(low):
            break
    return (low + high) / 2


def grubbs_critical(n: int, alpha: float = 0.05) -> float | None:
    """Critical value of Grubbs' test for n values; none under 3."""
    if n < 3:
        return None
    df = max(n - 2, 1)
    t2 = inverse_t(alpha / (2 * n), df) ** 2
    return (n - 1) / math.sqrt(n) * math.sqrt(t2 / (df + t2))


def _beta_many(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """The continued fraction of ``_beta`` for many arguments, each with x <= (a + 1) / (a + b + 2)."""
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((gamma(a + b) - gamma(a) - math.lgamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones(len(a)), 1 / (1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
        if np.abs(c * d - 1).max() < 1e-15:
            break
    return front * out


def _tail_t(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for t well over 0."""
    return 0.5 * _beta_many(df / 2, 0.5, df / (df + t * t))


def _grubbs_large(n: np.ndarray, alpha: float) -> np.ndarray:
    """Critical values of counts over about 100, by Newton steps from a normal start."""
    p, df = alpha / (2 * n), n - 2
    # fixed values: a rational approximation of the normal quantile's upper tail
    u = np.sqrt(-2 * np.log(p))
    z = u - (2.515517 + 0.802853 * u + 0.010328 * u * u) / (1 + 1.432788 * u + 0.189269 * u * u + 0.001308 * u**3)
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    scale = (gamma((df + 1) / 2) - gamma(df / 2)).astype(float) - 0.5 * np.log(df * math.pi)
    for _ in range(20):
        tail = _tail_t(t, df)
        step = tail * np.log(tail / p) / np.exp(scale - (df + 1) / 2 * np.log1p(t * t / df))
        t = t + step
        if np.abs(step).max() < 1e-12 * t.max():
            break
    return (n - 1) / np.sqrt(n) * np.sqrt(t * t / (df + t * t))


def grubbs_criticals(n: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """``grubbs_critical`` of many counts; NaN under 3.

    From 100 on values are a smooth function of log n: many of them are read off a Chebyshev polynomial through 64
    computed ones, which agrees to 9 digits.
    """
    n = np.asarray(n, np.int64)
    kinds, which = np.unique(n, return_inverse=True)
    small = kinds < 100
    out = np.full(len(kinds), np.nan)
    out[small] = [grubbs_critical(int(k), alpha) or np.nan for k in kinds[small]]
    big = kinds[~small].astype(float)
    if len(big) > 200:
        ends = np.log(big[[0, -1]])
        out[~small] = np.polynomial.Chebyshev.interpolate(lambda x: _grubbs_large(np.exp(x), alpha), 63, domain=ends)(np.log(big))
    elif len(big):
        out[~small] = _grubbs_large(big, alpha)
    return out[which]
