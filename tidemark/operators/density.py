"""Density clustering of series: points outside the largest cluster are outliers.

A batch is a tumbling window of a series (or the whole series); it is what one task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detect import DAY, HISTORY, filled
from .series import cohort_matrix
from .stretch import keys_of, last_moments, numbered, over

PRECISION, STEPS = 1e-3, 20


#: Pairs of points that are compared at once.
PAIRS = 1 << 20


def _spans(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, p) for each k and every place p in start[k] : start[k] + size[k], some PAIRS at a time."""
    work, lo = np.concatenate(([0], np.cumsum(size))), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + PAIRS, side="right")) - 1)
        k = np.repeat(np.arange(lo, hi), size[lo:hi])
        yield k, start[k] + np.arange(len(k)) + work[lo] - work[k]
        lo = hi


def _touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of a and one of b lie within eps of each other; those nearest the other's box are tried first."""
    for _ in range(2):
        away = (np.maximum(np.maximum(b.min(axis=0) - a, a - b.max(axis=0)), 0) ** 2).sum(axis=1)
        near = away <= eps * eps * (1 + 1e-9)
        if not near.any():
            return False
        a, b = b, a[near][np.argsort(away[near])]
    lo, step = 0, 64
    while lo < len(a):
        wide = max(1, PAIRS // step)
        if any((((a[lo : lo + step, None] - b[None, k : k + wide]) ** 2).sum(axis=2) <= eps * eps).any() for k in range(0, len(b), wide)):
            return True
        lo, step = lo + step, min(2 * step, 4096)
    return False


def clusters(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clusters of points (rows, 1 or 2 axes); -1 is noise.  Neighbours do not count the point itself.

    Clusters are numbered by their first core point; a point at the edge of several belongs to the first of them.
    Points are put into cells so small that all of one are neighbours.  A cell of over ``least`` points is core as it
    is; only points of other cells are compared with those of the cells around, so a dense batch costs no square.
    """
    n = len(x)
    if not n or not eps >= 0 or np.isnan(x).any():
        return np.full(n, -1)
    low = x.min(axis=0)
    side = eps / np.sqrt(x.shape[1]) * (1 - 1e-9)
    if eps == 0:  # only equal points are near
        _, first, of, size = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(np.where(size > least, first, n), kind="stable")] = np.arange(len(first))
        return np.where(size > least, rank, -1)[of.ravel()]
    if not (side > 0 and ((x.max(axis=0) - low) / side < 2.0**31).all()):  # cells beyond what a double tells apart
        return _clusters_by_order(x, eps, least)
    place = np.floor((x - low) / side).astype(np.int64)
    place = place if place.shape[1] == 2 else np.column_stack((place[:, 0], np.zeros(n, np.int64)))
    code = (place[:, 0] << 32) + place[:, 1]
    order = np.argsort(code, kind="stable")
    x = x[order]
    cell, first, of, size = np.unique(code[order], return_index=True, return_inverse=True, return_counts=True)
    across = range(-2, 3) if x.shape[1] == 2 else (0,)
    around = sorted(((i, j) for i in range(-2, 3) for j in across if (i, j) != (0, 0)), key=lambda d: d[0] * d[0] + d[1] * d[1])

    def beside(d: tuple[int, int]) -> np.ndarray:
        """Index of each cell's neighbour in direction d, -1 where there is none."""
        to = cell + (d[0] << 32) + d[1]
        at = np.minimum(np.searchsorted(cell, to), len(cell) - 1)
        inside = (cell & 0xFFFFFFFF) + d[1] >= 0
        return np.where((cell[at] == to) & inside, at, -1)

    def pairs(mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Neighbours (p, q) of the points ``mine`` in the cells around their own."""
        for d in around:
            to = beside(d)[of[mine]]
            have = mine[to >= 0]
            to = to[to >= 0]
            for k, q in _spans(first[to], size[to]):
                p = have[k]
                hit = ((x[p] - x[q]) ** 2).sum(axis=1) <= eps * eps
                yield p[hit], q[hit]

    core = size[of] > least
    sparse = np.flatnonzero(~core)
    count = size[of] - 1
    for p, _ in pairs(sparse):
        count += np.bincount(p, minlength=n)
    core[sparse] = count[sparse] >= least

    up = np.arange(len(cell))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    alive = np.bincount(of[core], minlength=len(cell)) > 0
    own = lambda c: x[first[c] : first[c] + size[c]][core[first[c] : first[c] + size[c]]]
    for d in around:
        if d < (0, 0):
            continue
        to = beside(d)
        for c in np.flatnonzero((to >= 0) & alive & alive[to]).tolist():
            a, b = root(c), root(int(to[c]))
            if a != b and _touch(own(c), own(int(to[c])), eps):
                up[max(a, b)] = min(a, b)
    # number the clusters by the first of their core points, in the order given
    group = np.array([root(k) for k in range(len(cell))])[of]
    earliest = np.full(len(cell), n)
    np.minimum.at(earliest, group[core], order[core])
    ranks = np.argsort(earliest, kind="stable")
    number = np.empty(len(cell), np.int64)
    number[ranks] = np.arange(len(cell))
    label = np.where(core, number[group], n)
    edge = np.flatnonzero(~core)
    for p, q in pairs(edge):
        np.minimum.at(label, p[core[q]], number[group[q[core[q]]]])
    if len(edge):  # core points of a point's own cell
        inner = np.full(len(cell), n)
        np.minimum.at(inner, of[core], number[group[core]])
        label[edge] = np.minimum(label[edge], inner[of[edge]])
    out = np.empty(n, np.int64)
    out[order] = np.where(label < n, label, -1)
    return out


def _clusters_by_order(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """The same for a reach so small that few points lie within it along the first axis."""
    order = np.argsort(x[:, 0], kind="stable")
    along = x[order, 0]
    lo, hi = np.searchsorted(along, x[:, 0] - eps), np.searchsorted(along, x[:, 0] + eps, side="right")
    near = lambda k: order[lo[k] : hi[k]][((x[order[lo[k] : hi[k]]] - x[k]) ** 2).sum(axis=1) <= eps * eps]
    label, at = np.full(len(x), -1), 0
    for k in range(len(x)):
        if label[k] >= 0 or len(near(k)) - 1 < least:
            continue
        todo = [k]
        label[k] = at
        while todo:
            around = near(todo.pop())
            if len(around) - 1 >= least:
                fresh = around[label[around] < 0]
                label[fresh] = at
                todo.extend(fresh.tolist())
        at += 1
    return label


def outside(label: np.ndarray) -> np.ndarray:
    """Whether a point lies outside the largest (of equal ones the first) cluster; without clusters none does."""
    return label != np.bincount(label[label >= 0]).argmax() if (label >= 0).any() else np.zeros(len(label), bool)


def whitening(tt: float, tv: float, vv: float) -> np.ndarray:
    """W with |W (a - b)| the Mahalanobis distance under this covariance, its first row a multiple of time; NaN without inverse."""
    if not tt * vv - tv * tv > 0:
        return np.full((2, 2), np.nan)
    return np.linalg.inv(np.linalg.cholesky(np.array([[tt, tv], [tv, vv]])))


def seek(fn: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> np.ndarray:
    """Secant steps towards fn = 0, for many starts at once; they begin at fn(start) and fn(start + 1)."""
    now, last = fn(start), fn(start + 1)
    for _ in range(STEPS):
        moving = np.abs(now - last) > PRECISION
        if not moving.any():
            break
        with np.errstate(all="ignore"):
            step = now - fn(now) * (now - last) / (fn(now) - fn(last))
        now, last = np.where(moving, step, now), np.where(moving, now, last)
    return now


def _covariance(points: DataFrame, distance: str) -> DataFrame:
    """Points with the covariance of (t, v) over their series, which turns distances into Mahalanobis' ones."""
    if distance == "euclidean":
        return points.withColumns({"tt": F.lit(1.0), "tv": F.lit(0.0), "vv": F.lit(1.0)})
    if distance != "mahalanobis":
        raise ValueError(f"no distance {distance}")
    keys = keys_of(points)
    t = F.col("t").cast("double")
    own = points.groupBy(*keys).agg(F.var_pop(t).alias("tt"), F.covar_pop(t, "v").alias("tv"), F.var_pop("v").alias("vv"))
    return points.join(own, keys)


def stepped(points: DataFrame, distance: str = "euclidean", history: int = HISTORY) -> DataFrame:
    """Points with n, predecessor (t0, v0), and mean and deviation of their last ``history`` steps' distances."""

    def steps(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        t, v = c["t"].astype(float), c["v"]
        nan = np.full(min(1, len(v)), np.nan)
        w = whitening(c["tt"][0], c["tv"][0], c["vv"][0])
        d = np.sqrt(((np.stack([np.diff(t), np.diff(v)], axis=1) @ w.T) ** 2).sum(axis=1))
        _, mean, sd = last_moments(np.append(d, 0.0), history)
        return {"t0": np.concatenate((nan, t[:-1])), "v0": np.concatenate((nan, v[:-1])), "d_mean": np.concatenate((nan, mean[1:]))[: len(v)], "d_sd": np.concatenate((nan, sd[1:]))[: len(v)]}

    return over(numbered(_covariance(points, distance)), steps, "t0 double, v0 double, d_mean double, d_sd double", history + 1)


def _batch(batch_ms: int | None):
    return (F.lit(0) if batch_ms is None else F.floor(F.col("t") / batch_ms)).cast("bigint")


def series_density(points: DataFrame, tolerance: float = 3.0, least: int = 3, batch_ms: int | None = DAY, distance: str = "euclidean", history: int = HISTORY, fill: int = 30, seed_eps: float = 1.0, thresholds: bool = False) -> DataFrame:
    """Points of a batch outside the largest density cluster of (time, value).

    Reach: mean + tolerance deviations of the distances between neighbours in time, over the last ``history`` of them up
    to the batch's end; seed_eps where there are none.  A batch of up to ``fill`` points is clustered with the points
    before it.  thresholds: bands of values whose distance from the point before is expected, by secant steps.
    A covariance without inverse gives no clusters and so no outliers.
    """
    keys = keys_of(points)
    every = stepped(points, distance, history).withColumn("batch", _batch(batch_ms))
    facts = every.groupBy(*keys, "batch").agg(F.max_by(F.struct("d_mean", "d_sd"), "n").alias("d"))
    facts = facts.select(*keys, "batch", F.col("d.d_mean").alias("b_mean"), F.col("d.d_sd").alias("b_sd"))
    data = filled(every.drop("n", "batch"), batch_ms, fill).join(facts, [*keys, "batch"])
    schema = ", ".join(f"{k} string" for k in keys) + ", t bigint, v double, cluster bigint, floor double, expected double, ceiling double, is_outlier boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        one = pdf.iloc[0]
        mean, deviation = float(one.b_mean if one.b_mean is not None else np.nan), float(one.b_sd if one.b_sd is not None else np.nan)
        w = whitening(one.tt, one.tv, one.vv)
        eps = seed_eps if np.isnan(mean) or np.isnan(deviation) else mean + tolerance * deviation
        label = clusters(np.stack([pdf.t.to_numpy(float) - float(one.t), pdf.v.to_numpy(float)], axis=1) @ w.T, eps, least)
        out = outside(label)
        bands = np.full((3, len(pdf)), np.nan)
        if thresholds:
            dt, v0 = pdf.t.to_numpy(float) - pdf.t0.to_numpy(float), pdf.v0.to_numpy(float)

            def away(target: float) -> Callable[[np.ndarray], np.ndarray]:
                return lambda v: np.sqrt(((np.stack([dt, v - v0], axis=1) @ w.T) ** 2).sum(axis=1)) - target

            expected = seek(away(mean), pdf.v.to_numpy(float))
            reach = np.abs(seek(away(mean + tolerance * deviation), expected) - expected)
            bands = np.stack([expected - reach, expected, expected + reach])
        got = pd.DataFrame({**{k: pdf[k] for k in keys}, "t": pdf.t, "v": pdf.v, "cluster": label, "floor": bands[0], "expected": bands[1], "ceiling": bands[2], "is_outlier": out})
        return got[~pdf.past.to_numpy(bool)]

    return data.groupBy(*keys, "batch").applyInPandas(run, schema)


def centroid_density(points: DataFrame, tolerance: float = 1.0, least: int = 3, batch_ms: int | None = DAY, distance: str = "euclidean", seed_eps: float = 1.0) -> DataFrame:
    """Points of a batch outside the largest density cluster of (time, value less the mean so far).

    Mean and reach (mean + tolerance population deviations, of values) are over all points up to the batch's end; a
    negative reach gives no clusters and so no outliers.
    """
    keys = keys_of(points)
    every = _covariance(points, distance).withColumn("batch", _batch(batch_ms))
    parts = every.groupBy(*keys, "batch").agg(F.count("*").alias("c"), F.avg("v").alias("m"), F.var_pop("v").alias("q"))
    upto, whole = Window.partitionBy(*keys).orderBy("batch"), Window.partitionBy(*keys)
    parts = parts.withColumn("g", F.sum(F.col("c") * F.col("m")).over(whole) / F.sum("c").over(whole))
    gap = F.col("m") - F.col("g")
    n, s, q = (F.sum(x).over(upto) for x in (F.col("c"), F.col("c") * gap, F.col("c") * (F.col("q") + gap * gap)))
    facts = parts.select(*keys, "batch", (F.col("g") + s / n).alias("mean"), F.sqrt(F.greatest(q / n - s * s / n / n, F.lit(0.0))).alias("sd"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        one = pdf.iloc[0]
        eps = one["mean"] + tolerance * one.sd
        eps = seed_eps if np.isnan(eps) else eps
        x = np.stack([pdf.t.to_numpy(float) - float(one.t), pdf.v.to_numpy(float) - one["mean"]], axis=1) @ whitening(one.tt, one.tv, one.vv).T
        label = clusters(x, eps, least)
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "t": pdf.t, "v": pdf.v, "cluster": label, "is_outlier": outside(label)})

    return every.join(facts, [*keys, "batch"]).groupBy(*keys, "batch").applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", t bigint, v double, cluster bigint, is_outlier boolean")


def cohort_density(points: DataFrame, unit_ms: int, tolerance: float = 3.0, least: int = 2) -> DataFrame:
    """Members of a cohort outside the largest cluster of their frame: (topic, frames, outside, is_outlier).

    A frame's values are taken less its median and clustered; reach: mean + tolerance deviations of these differences'
    sizes over all frames.  A member ever outside is an outlier.
    """
    cells = cohort_matrix(points, unit_ms)
    middle = cells.groupBy("frame_ms").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    away = cells.join(middle, "frame_ms").withColumn("d", F.col("value") - F.col("median"))
    reach = away.agg((F.avg(F.abs("d")) + tolerance * F.coalesce(F.stddev_samp(F.abs("d")), F.lit(0.0))).alias("eps"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", ignore_index=True)
        label = clusters(pdf.d.to_numpy(float)[:, None], float(pdf.eps.iloc[0]), least)
        return pd.DataFrame({"topic": pdf.topic, "frame_ms": pdf.frame_ms, "out": outside(label)})

    flags = away.crossJoin(F.broadcast(reach)).groupBy("frame_ms").applyInPandas(run, "topic string, frame_ms bigint, out boolean")
    return flags.groupBy("topic").agg(F.count("*").alias("frames"), F.count_if("out").alias("outside"), F.max("out").alias("is_outlier"))
