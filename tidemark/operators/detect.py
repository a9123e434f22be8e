"""Detection algorithms: each gives every point a band and a flag.

A point is scored against the state before it and compared by its tail-averaged value, while the state advances with
the original one.  Too few values, or a band without width, skip the point: no band, not flagged, state advances.
Series are told apart by (plan, topic) where points have a plan, else by topic.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grubbs_criticals, month_key, season_bin
from .series import prior, sd, tail_average
from .stretch import STRETCH, all_moments, carried, contained, keys_of, last_moments, numbered, over

BAND = ("floor", "expected", "ceiling")
DAY = 86_400_000
#: Points of history that analyses look back on, and the share of a start that a recursion may still hold.
HISTORY = 8640
FORGOTTEN = 2.0**-60


def banded(df: DataFrame, centre: Column, distance: Column, n: Column | None = None, minimum: int = 0, scored: str = "scored") -> DataFrame:
    """Add floor, expected, ceiling and is_outlier; distance is taken without its sign."""
    enough = F.lit(True) if n is None else n >= minimum
    d = F.abs(distance)
    known = enough & centre.isNotNull() & d.isNotNull() & ~F.isnan(centre) & ~F.isnan(d) & (d > 0)
    bands = [F.when(known, x) for x in (centre - d, centre, centre + d)]
    out = F.when(known, (F.col(scored) < bands[0]) | (F.col(scored) > bands[2])).otherwise(F.lit(False))
    return df.select("*", *[b.alias(k) for b, k in zip(bands, BAND)], out.alias("is_outlier"))


def _result(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*keys_of(df), *more, "t", "v", *BAND, "is_outlier")


def _scored(points: DataFrame, tail: int) -> tuple[DataFrame, int]:
    """Numbered points, and the halo that their tail average needs."""
    return numbered(points), max(tail - 1, 0)


def _tail(v: np.ndarray, tail: int) -> np.ndarray:
    """Each value by the mean of itself and the tail-1 before it."""
    if tail <= 1:
        return v
    sums = np.concatenate([np.full(tail - 1, np.nan), v])
    return np.nanmean(np.lib.stride_tricks.sliding_window_view(sums, tail), axis=1)


def _score(points: DataFrame, moments: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]], halo: int, tail: int, minimum: int = 0, state: DataFrame | None = None) -> DataFrame:
    """Band and flags by a kernel that gives centre and distance of each point."""

    @contained
    def centred(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        centre, distance = moments(columns)
        return {"centre": centre, "distance": distance}

    def kernel(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {**centred(columns), "scored": _tail(columns["v"], tail)}

    got = over(points, kernel, "centre double, distance double, scored double", max(halo, tail - 1), state=state)
    return _result(banded(got, F.col("centre"), F.col("distance"), F.col("n"), minimum))


# --- live algorithms ---------------------------------------------------------------------------------------------


def moving_average(points: DataFrame, window: int | None = None, tolerance: float = 3.0, tail: int = 1, minimum: int = 2) -> DataFrame:
    """Mean and sample deviation of all earlier values, or of the last ``window``."""
    every = numbered(points)
    if window is not None:
        return _score(every, lambda c: (lambda m: (m[1], tolerance * m[2]))(last_moments(c["v"], window)), window, tail, minimum)

    def cumulative(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        past = int(c["_late"].sum())  # the tail average's halo is part of the state before
        v = c["v"][past:]
        n0 = int(np.nan_to_num(c["n0"][-1])) if len(v) else 0
        start = (n0, *(float(c[k][-1]) for k in ("mean0", "m0", "low0", "high0"))) if n0 else ()
        _, mean, deviation = all_moments(v, *start)
        before = np.full(past, np.nan)
        return np.concatenate((before, mean)), np.concatenate((before, tolerance * deviation))

    return _score(every, cumulative, 0, tail, minimum, carried(every))


def grubbs(points: DataFrame, window: int = 60, tolerance: float = 3.0, tail: int = 1, minimum: int = 7, alpha: float = 0.05) -> DataFrame:
    """Band by Grubbs' critical value: the count is of all values seen, mean and deviation of the last ``window``."""

    def critical(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, mean, deviation = last_moments(c["v"], window)
        return mean, tolerance * grubbs_criticals(c["n"], alpha) * deviation

    return _score(numbered(points), critical, window, tail, max(7, minimum))


def past_period(points: DataFrame, window: int = 3, tolerance: float = 3.0, minimum: int = 1, tail: int = 1, as_of_ms: int | None = None) -> DataFrame:
    """Mean and deviation of the latest values of the last ``window`` earlier months (in the session's time zone).

    as_of_ms: values of that time's month feed no score, as those of a running month.
    """
    keys = keys_of(points)
    keyed = tail_average(points, tail).withColumn("month", month_key(F.timestamp_millis("t")))
    months = keyed.groupBy(*keys, "month").agg(F.max_by("v", "t").alias("last"))
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(-window, -1)
    if as_of_ms is not None:
        months = months.withColumn("last", F.when(F.col("month") != month_key(F.timestamp_millis(F.lit(as_of_ms))), F.col("last")))
    stats = months.select(*keys, "month", F.avg("last").over(w).alias("mean"), sd("last", w).alias("sd"), F.count("last").over(w).alias("n"))
    return _result(banded(keyed.join(stats, [*keys, "month"]), F.col("mean"), F.col("sd") * tolerance, F.col("n"), minimum))


def _halo(alpha: float) -> int:
    """Points after which the start of a recursion with this weight doesn't show in a double."""
    return 1 if alpha in (0.0, 1.0) else math.ceil(math.log(FORGOTTEN) / math.log(max(alpha, 1 - alpha)))


def ewma_series(v: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation after each value: both start at 0, and the old variance weighs alpha."""
    start = np.concatenate(([0.0], v))
    mean = pd.Series(start).ewm(alpha=alpha, adjust=False).mean().to_numpy() if alpha > 0 else np.zeros(len(start))
    square = np.concatenate(([0.0], (v - mean[:-1]) ** 2))
    variance = pd.Series(square).ewm(alpha=1 - alpha, adjust=False).mean().to_numpy() if alpha < 1 else np.zeros(len(start))
    return mean[1:], np.sqrt(variance[1:])


def _ewma(points: DataFrame, alpha: float, tolerance: float, tail: int) -> DataFrame:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")

    def before(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        mean, deviation = ewma_series(c["v"], alpha)
        none = np.full(min(1, len(mean)), np.nan)
        return np.concatenate((none, mean[:-1])), tolerance * np.concatenate((none, deviation[:-1]))

    return _score(numbered(points), before, _halo(alpha), tail, 1)


def ewma(points: DataFrame, alpha: float = 0.05, tolerance: float = 3.0, tail: int = 1) -> DataFrame:
    """Exponentially weighted mean, started at 0, and deviation, whose old variance weighs alpha.

    A stretch starts its recursion so far before its first point that the start weighs under 2**-60.
    """
    return _ewma(points, alpha, tolerance, tail)


def moments(points: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Summary of each series' exponentially weighted state at its end: n, mean, sd, variance, sum (n times mean), ends."""
    keys = keys_of(points)

    def after(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return dict(zip(("mean", "sd"), ewma_series(c["v"], alpha)))

    got = over(numbered(points), after, "mean double, sd double", _halo(alpha))
    last = got.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("mean", "n").alias("mean"), F.max_by("sd", "n").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))
    return last.select(*keys, "n", "mean", "sd", F.pow("sd", F.lit(2)).alias("variance"), (F.col("n") * F.col("mean")).alias("total"), "low", "high")


def seasonal_ewma(points: DataFrame, alpha: float = 0.05, tolerance: float = 3.0, wavelength_ms: int = DAY, bins: int = 24) -> DataFrame:
    """One such mean for each bin of the season."""
    keys = keys_of(points)
    keyed = points.withColumn("season", season_bin(F.col("t"), wavelength_ms, bins)).withColumn("_own", F.col("topic"))
    got = _ewma(keyed.withColumn("topic", F.concat_ws("\u0001", "topic", F.col("season").cast("string"))).drop("season", "_own"), alpha, tolerance, 1)
    split = F.split("topic", "\u0001")
    return got.withColumn("season", F.element_at(split, -1).cast("bigint")).withColumn("topic", F.array_join(F.slice(split, F.lit(1), F.size(split) - 1), "\u0001")).select(*keys, "season", "t", "v", *BAND, "is_outlier")


# --- algorithms over history -------------------------------------------------------------------------------------


def first_hour_average(points: DataFrame, tolerance: float = 3.0, hour_ms: int = 3_600_000) -> DataFrame:
    """Mean and deviation of the points within an hour of a series' first."""
    keys = keys_of(points)
    first = points.groupBy(*keys).agg(F.min("t").alias("t0"))
    early = points.join(first, keys).where(F.col("t") < F.col("t0") + hour_ms)
    stats = early.groupBy(*keys).agg(F.avg("v").alias("mean"), F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_samp("v")).alias("sd"))
    return _result(banded(points.withColumn("scored", F.col("v")).join(stats, keys), F.col("mean"), F.col("sd") * tolerance))


def mean_subtraction(points: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Mean and population deviation of the whole input of a series."""
    keys = keys_of(points)
    stats = points.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return _result(banded(points.withColumn("scored", F.col("v")).join(stats, keys), F.col("mean"), F.col("sd") * tolerance))


def median_absolute_deviation(points: DataFrame, window: int = HISTORY, tolerance: float = 3.0) -> DataFrame:
    """Median of the earlier values, give or take the median of their deviations from the median of their own time."""

    def medians(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v = pd.Series(c["v"])
        median = v.rolling(window, min_periods=1).median()
        away = (v - median).abs()
        if len(v) and c["n"][0] > 0:  # a halo's first deviations are from medians that lack earlier values
            away[: window - 1] = np.nan
        return median.shift().to_numpy(), tolerance * away.rolling(window, min_periods=1).median().shift().to_numpy()

    return _score(numbered(points), medians, 2 * window, 1)


def filled(points: DataFrame, batch_ms: int | None, least: int) -> DataFrame:
    """Rows of each batch, and of the points before it as many as bring it to least + 1 (``past``).

    A batch is a tumbling window of batch_ms, or the whole series (None).  Adds batch and n.
    """
    keys = keys_of(points)
    batch = F.lit(0) if batch_ms is None else F.floor(F.col("t") / batch_ms)
    every = numbered(points).withColumn("batch", batch.cast("bigint"))
    sizes = every.groupBy(*keys, "batch").agg(F.count("*").alias("size"), F.min("n").alias("n0"))
    need = F.least(F.lit(least + 1) - F.col("size"), F.col("n0"))
    wanted = sizes.where((F.col("size") <= least) & (need > 0)).select(*keys, F.col("batch").alias("to"), F.explode(F.sequence(F.col("n0") - need, F.col("n0") - 1)).alias("n"))
    past = every.join(wanted, [*keys, "n"]).withColumn("batch", F.col("to")).drop("to")
    return every.withColumn("past", F.lit(False)).unionByName(past.withColumn("past", F.lit(True)))


def histogram_bins(points: DataFrame, bins: int = 16, least: int = 5, batch_ms: int | None = None, fill: int = 360) -> DataFrame:
    """A point is an outlier if its bin of the batch's range holds under ``least`` points; no band.

    Batches of batch_ms (None: the whole series) are filled from history; a value under the range is an outlier.
    """
    keys = [*keys_of(points), "batch"]
    every = filled(points, batch_ms, fill)
    ends = every.groupBy(*keys).agg(F.min("v").alias("low"), ((F.max("v") + 1e-13 - F.min("v")) / bins).alias("width"))
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / F.col("width"))).cast("bigint")
    placed = every.join(ends, keys).withColumn("bin", F.when(F.col("width") > 0, bin_).otherwise(F.lit(0).cast("bigint")))
    held = placed.groupBy(*keys, "bin").agg(F.count("*").alias("held"))
    return placed.where("not past").join(held, [*keys, "bin"]).select(*keys_of(points), "t", "v", "bin", "held", ((F.col("held") < least) | (F.col("v") < F.col("low"))).alias("is_outlier"))


def least_squares(points: DataFrame, tolerance: float = 3.0, tail: int = 3) -> DataFrame:
    """Regression of each series' earlier values over time, and the last values' mean distance from its line.

    Times are counted in hours from the series' first.  A point is an outlier if the last ``tail`` values, itself
    included, lie on average over ``tolerance`` of their deviations from the line at its time, unless distance or
    deviation round to 0; the band is about the value plus that distance.  Three earlier values are needed.
    """
    keys = keys_of(points)
    start = points.groupBy(*keys).agg(F.min("t").alias("t0"))
    timed = points.join(start, keys).withColumn("h", (F.col("t") - F.col("t0")) / 3_600_000.0)
    w = prior(None, *keys)
    last = Window.partitionBy(*keys).orderBy("t").rowsBetween(-(tail - 1), 0)
    got = timed.select("*", F.count("*").over(w).alias("n"), F.regr_slope("v", "h").over(w).alias("m"), F.regr_intercept("v", "h").over(w).alias("b"), F.avg("v").over(last).alias("mean"), sd("v", last).alias("sd"))
    got = got.withColumns({"slope": F.when(F.col("n") >= 3, F.col("m")), "intercept": F.when(F.col("n") >= 3, F.col("b"))})
    error = F.col("mean") - (F.col("slope") * F.col("h") + F.col("intercept"))
    got = got.withColumn("error", error).withColumn("distance", F.abs(F.col("sd") * tolerance))
    known = F.col("error").isNotNull()
    rounds = (F.floor(F.col("sd") + 0.5) != 0) & (F.floor(F.col("error") + 0.5) != 0)
    bands = [F.when(known, F.col("v") + F.col("error") + k * F.col("distance")).alias(name) for k, name in zip((-1, 0, 1), BAND)]
    return got.select(*keys, "t", "v", "slope", "intercept", "error", *bands, F.coalesce((F.abs("error") > F.col("distance")) & rounds, F.lit(False)).alias("is_outlier"))


def distance_eps(points: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Reach for density clustering: mean and deviation of the distances between neighbours in time."""
    keys = keys_of(points)
    near = _stepped(points).withColumn("d", F.sqrt(F.pow(F.col("v") - F.col("v0"), 2) + F.pow((F.col("t") - F.col("t0")).cast("double"), 2)))
    return near.where("d is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), (F.avg("d") + tolerance * F.stddev_samp("d")).alias("eps"))


def _stepped(points: DataFrame) -> DataFrame:
    """Points with their predecessor (t0, v0)."""
    w = Window.partitionBy(*keys_of(points)).orderBy("t")
    return points.withColumns({"t0": F.lag("t").over(w), "v0": F.lag("v").over(w)})


# --- distributions -----------------------------------------------------------------------------------------------


def ks_statistic(points: DataFrame, split_ms: int) -> DataFrame:
    """Largest gap between the distributions of a series' values before and from split_ms on."""
    keys = keys_of(points)
    side = points.withColumn("late", (F.col("t") >= split_ms).cast("bigint"))
    # ties step together: one row for each value
    steps = side.groupBy(*keys, "v").agg(F.sum(1 - F.col("late")).alias("a"), F.sum("late").alias("b"))
    w, whole = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(whole) - F.sum("b").over(w) / F.sum("b").over(whole))
    return steps.withColumn("gap", gap).groupBy(*keys).agg(F.sum("a").alias("n_before"), F.sum("b").alias("n_after"), F.max("gap").alias("d"))


#: Product of two sample sizes up to which the p-value is counted exactly.
EXACT_KS = 10_000


def ks_distance(a: np.ndarray, b: np.ndarray) -> float:
    every = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(np.sort(a), every, "right") / len(a) - np.searchsorted(np.sort(b), every, "right") / len(b)).max())


def ks_p_value(d: float, n: int, m: int) -> float:
    """Probability of a larger distance of two samples of one distribution: counted over lattice paths, or the limit."""
    if n * m < EXACT_KS:
        reach = math.floor(d * n * m + 1e-9)  # paths that stay within the distance
        inside = np.zeros(m + 1)
        for i in range(n + 1):
            ok = np.abs(i * m - np.arange(m + 1) * n) <= reach
            if i == 0:
                inside = np.cumprod(ok).astype(float)
                continue
            row = np.zeros(m + 1)
            left = 0.0
            for j in range(m + 1):  # shares of all paths to (i, j), so numbers stay small
                left = (inside[j] * i + left * j) / (i + j) if ok[j] else 0.0
                row[j] = left
            inside = row
        return float(1 - inside[m])
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)).sum(), 0, 1))


def ks_test(points: DataFrame, batch_ms: int = DAY, offset_ms: int = DAY, tolerance: float = 0.05) -> DataFrame:
    """Each batch against the points one offset earlier: a row (keys, batch, n, n_reference, d, p, statistic, unlike).

    A batch is a tumbling window; its reference are the points from its first to before its last time, offset_ms
    earlier.  Unlike: p under ``tolerance``, distance over one half, and the reference's Dickey-Fuller statistic under
    0.05.  A batch or reference without points is never unlike; all its earlier points are history.
    """
    keys = keys_of(points)
    now = points.select(*keys, F.floor(F.col("t") / batch_ms).cast("bigint").alias("batch"), "t", "v", F.lit(False).alias("reference"))
    ends = now.groupBy(*keys, "batch").agg(F.min("t").alias("from"), F.max("t").alias("to"))
    moved = points.select(*keys, F.floor((F.col("t") + offset_ms) / batch_ms).cast("bigint").alias("batch"), (F.col("t") + offset_ms).alias("t"), "v", F.lit(True).alias("reference"))
    earlier = moved.join(ends, [*keys, "batch"]).where("t >= from and t < to").drop("from", "to")
    schema = ", ".join(f"{k} string" for k in keys) + ", batch bigint, n bigint, n_reference bigint, d double, p double, statistic double, unlike boolean"

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        a, b = pdf.v[pdf.reference].to_numpy(float), pdf.v[~pdf.reference].to_numpy(float)
        d = ks_distance(a, b) if len(a) and len(b) else None
        p = ks_p_value(d, len(a), len(b)) if d is not None else None
        s = adf_statistic(a) if len(a) else float("nan")
        unlike = p is not None and p < tolerance and d > 0.5 and s < 0.05
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), pdf.batch.iloc[0], len(b), len(a), d, p, None if math.isnan(s) else s, unlike]], columns=[c.split(" ")[0] for c in schema.split(", ")])

    return now.unionByName(earlier).groupBy(*keys, "batch").applyInPandas(compare, schema)


def ks_outliers(points: DataFrame, batch_ms: int = DAY, offset_ms: int = DAY, tolerance: float = 0.05) -> DataFrame:
    """Every point of a batch that is unlike its reference is an outlier; no band."""
    tested = ks_test(points, batch_ms, offset_ms, tolerance).select(*keys_of(points), "batch", "unlike")
    got = points.withColumn("batch", F.floor(F.col("t") / batch_ms).cast("bigint")).join(tested, [*keys_of(points), "batch"], "left")
    return _unbanded(got.withColumn("is_outlier", F.coalesce("unlike", F.lit(False))))


def _unbanded(df: DataFrame) -> DataFrame:
    return df.select(*keys_of(df), "t", "v", *[F.lit(None).cast("double").alias(b) for b in BAND], "is_outlier")


# --- kernels over bounded windows --------------------------------------------------------------------------------


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a ridge regression by singular values, and their variances."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    z = (vt.T * (s / (s * s + penalty))) @ u.T
    beta = z @ y
    error = ((y - x @ beta) ** 2).sum() / (x.shape[0] - x.shape[1])
    return beta, error * (z * z).sum(axis=1)


def padded_difference(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, with a 0 in front."""
    return np.concatenate(([0.0], np.diff(values)))[: len(values)]


def adf_statistic(values: np.ndarray, penalty: float = 1e-4) -> float:
    """Augmented Dickey-Fuller statistic: the lagged level's coefficient over its variance, by ridge regression."""
    n = len(values)
    lag = math.floor(np.cbrt(max(n - 1, 0)) + 1e-12)
    d = np.diff(values)
    y = d[lag:]
    if lag < 1 or len(y) <= 3 + lag:
        return float("nan")
    x = np.column_stack([values[lag - 1 : n - 2], np.ones(len(y)), np.arange(lag + 1, n), *[d[lag - k : len(d) - k] for k in range(1, lag + 1)]])
    beta, variance = ridge(x, y, penalty)
    return float(beta[0] / variance[0]) if variance[0] > 0 else float("nan")


def adf(points: DataFrame, window: int = HISTORY) -> DataFrame:
    """The statistic of each stretch of ``window`` points; at most -3.45 says that a series needs differencing."""
    keys = keys_of(points)
    cut = numbered(points).withColumn("stretch", F.floor(F.col("n") / window).cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = adf_statistic(pdf.sort_values("t").v.to_numpy(float))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), pdf.stretch.iloc[0], None if math.isnan(s) else s, bool(s <= -3.45)]], columns=[*keys, "stretch", "statistic", "needs_diff"])

    return cut.groupBy(*keys, "stretch").applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", stretch bigint, statistic double, needs_diff boolean")


def differenced(points: DataFrame) -> DataFrame:
    """Each value less the one before it, 0 for a series' first."""
    return _stepped(points).select(*keys_of(points), "t", F.coalesce(F.col("v") - F.col("v0"), F.lit(0.0)).alias("v"))


def robust_pca(x: np.ndarray, rounds: int = 228) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x = low rank + sparse + error by alternating soft thresholds, until the objective stands."""
    m, n = x.shape
    mu = m * n / (4 * max(np.abs(x).sum(), 1e-300))
    sparse, last = np.zeros_like(x), np.inf
    penalty = 1.4 / np.sqrt(max(m, n))
    shrink = lambda a, t: np.sign(a) * np.maximum(np.abs(a) - t, 0)
    for _ in range(rounds):
        u, s, vt = np.linalg.svd(x - sparse, full_matrices=False)
        s = shrink(s, mu)
        low = u * s @ vt
        sparse = shrink(x - low, penalty * mu)
        error = x - low - sparse
        objective = 0.5 * (error**2).sum() + mu * s.sum() + penalty * mu * np.abs(sparse).sum()
        if abs(last - objective) <= 1e-8 * 0.5 * (x**2).sum():
            break
        last = objective
        mu = max(0.01, error.std(ddof=1) * np.sqrt(2 * max(m, n)))
    return low, sparse, error


def rpca(points: DataFrame, period: int, window: int = 8400) -> DataFrame:
    """Split of each stretch of a series, folded into periods, into low rank, sparse and error.

    Points after a stretch's last whole period get their parts from the same number of whole periods folded back from its
    end; a last stretch shorter than a period goes with the one before, and all parts of a series that short are null.
    """
    keys = keys_of(points)
    every = numbered(points)
    sizes = every.groupBy(*keys).agg(F.count("*").alias("size"))
    stretch = F.least(F.floor(F.col("n") / window), F.greatest(F.floor((F.col("size") - period) / window), F.lit(0)))
    cut = every.join(sizes, keys).withColumn("stretch", stretch)

    def split(v: np.ndarray) -> np.ndarray:
        return np.stack([p.T.ravel() for p in robust_pca(v.reshape(-1, period).T)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = pdf.v.to_numpy(float)
        rest = len(v) % period
        whole = len(v) - rest
        parts = np.full((3, len(v)), np.nan)
        if whole:
            parts[:, :whole] = split(v[:whole])
            if rest:
                parts[:, whole:] = split(v[rest:])[:, whole - rest :]
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "t": pdf.t, "v": pdf.v, "low_rank": parts[0], "sparse": parts[1], "error": parts[2]})

    return cut.groupBy(*keys, "stretch").applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", t bigint, v double, low_rank double, sparse double, error double")


ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "simple-moving-average": moving_average,
    "ewma": ewma,
    "grubbs": grubbs,
    "past-period": past_period,
    "first-hour-average": first_hour_average,
    "mean-subtraction-cumulation": mean_subtraction,
    "median-absolute-deviation": median_absolute_deviation,
    "least-squares": lambda points, **config: _result(least_squares(points, **config)),
    "histogram-bins": lambda points, **config: _unbanded(histogram_bins(points, **config)),
    "ks-test": ks_outliers,
}
