"""Published and golden values, and plain implementations, of the detection algorithms."""

import math

import numpy as np
import pytest

from tidemark.functions import common_prefix, grubbs_critical, grubbs_criticals
from tidemark.operators import density as N
from tidemark.operators import detect as D
from tidemark.operators import series as G
from tidemark.operators import stretch as S
from tidemark.operators import vote as V

# fixed values: a curve of 34 points, a second apart
CURVE = [9.46, 9.9, 11.6, 14.5, 17.3, 19.2, 18.4, 14.5, 12.2, 10.8, 8.58, 8.36, 8.58, 7.5, 7.1, 7.3, 7.71, 8.14, 8.14, 7.1, 7.5, 7.1, 7.1, 7.3, 7.71, 8.8, 9.9, 14.2, 18.8, 25.2, 31.5, 22, 24.1, 39.2]
FAR = [18.8, 25.2, 31.5, 22.0, 24.1, 39.2]


def points(spark, values, topic="s", start=0, step=1):
    return spark.createDataFrame([(topic, start + k * step, float(v)) for k, v in enumerate(values)], "topic string, t bigint, v double")


def rows(df):
    return sorted(df.collect(), key=lambda r: r.t)


def test_grubbs_critical_value():
    assert grubbs_critical(8) == pytest.approx(2.1266465543, abs=1e-5)
    # published two-sided values at 5 %
    for n, g in ((10, 2.290), (20, 2.709), (50, 3.128), (100, 3.384)):
        assert grubbs_critical(n) == pytest.approx(g, abs=2e-3)
    many = grubbs_criticals(np.arange(0, 5000))
    assert np.isnan(many[:3]).all()
    for n in (3, 8, 99, 100, 101, 777, 4999):
        assert many[n] == pytest.approx(grubbs_critical(n), rel=1e-9)


def test_moving_average_bands(spark):
    """Each point's band is that of the mean and deviation of those before it."""
    values = [96, 86, 76, 106, 89, 86, 143, 117, 123, 74, 76, 58, 72, 170, 87, 0]
    got = rows(D.moving_average(points(spark, values)))
    assert got[2].expected == pytest.approx(91.0) and got[2].floor == pytest.approx(69.78679656440357) and got[2].ceiling == pytest.approx(112.21320343559643)
    assert (got[7].floor, got[7].expected, got[7].ceiling) == pytest.approx((30.978805224532536, 97.42857142857143, 163.87833763261034))
    assert (got[15].floor, got[15].expected, got[15].ceiling) == pytest.approx((7.391992019927926, 97.26666666666667, 187.1413413134054))
    assert got[0].expected is None and got[1].expected is None and got[15].is_outlier


def test_flat_signal_has_no_band(spark):
    for window in (None, 3):
        got = rows(D.moving_average(points(spark, [1, 1, 1, 1, 1000]), window=window))
        assert all(r.expected is None and not r.is_outlier for r in got)


@pytest.mark.parametrize("size", [7, 100_000])
def test_stretches_do_not_show(spark, monkeypatch, size):
    """Short stretches give what one long one gives."""
    rng = np.random.default_rng(3)
    values = rng.normal(10, 2, 120)
    values[40] = 1e9
    monkeypatch.setattr(S, "STRETCH", size)
    monkeypatch.setattr(S, "BUCKET_MS", 10)
    p = points(spark, values, step=3)
    got = rows(D.moving_average(p, tail=3))
    for k, r in enumerate(got):
        x = values[:k]
        if k >= 2:
            assert (r.expected, r.ceiling - r.expected) == pytest.approx((x.mean(), 3 * x.std(ddof=1)), rel=1e-9)
            scored = values[max(0, k - 2) : k + 1].mean()
            assert r.is_outlier == bool(scored < r.floor or scored > r.ceiling)
    mean, sd = 0.0, 0.0
    for k, r in enumerate(rows(D.ewma(p, alpha=0.3))):
        if k:
            assert (r.expected, r.ceiling - r.expected) == pytest.approx((mean, 3 * sd), rel=1e-9)
        mean, sd = 0.3 * values[k] + 0.7 * mean, math.sqrt(0.3 * sd**2 + 0.7 * (values[k] - mean) ** 2)
    for k, r in enumerate(rows(D.median_absolute_deviation(p, window=9))):
        if k >= 2:
            away = [abs(values[j] - np.median(values[max(0, j - 8) : j + 1])) for j in range(k)]
            distance = 3 * np.median(away[max(0, k - 9) : k])
            assert distance == 0 and r.expected is None or (r.expected, r.ceiling - r.expected) == pytest.approx((np.median(values[max(0, k - 9) : k]), distance), rel=1e-5)


def test_two_plans_do_not_mix(spark):
    p = points(spark, CURVE)
    both = p.selectExpr("'a' as plan", "*").unionByName(p.selectExpr("'b' as plan", "*"))
    want = [(r.t, r.floor, r.is_outlier) for r in rows(D.moving_average(p))]
    for plan in "ab":
        assert [(r.t, r.floor, r.is_outlier) for r in rows(D.moving_average(both).where(f"plan = '{plan}'"))] == want


def test_a_failing_kernel_flags_nothing(spark):
    def broken(columns):
        raise ValueError("no")

    got = D._score(S.numbered(points(spark, CURVE)), broken, 0, 1).collect()
    assert len(got) == 34 and not any(r.is_outlier or r.expected is not None for r in got)


def test_density_golden(spark):
    p = points(spark, CURVE, start=440)
    got = rows(N.series_density(p, tolerance=0.756574715, batch_ms=None, thresholds=True))
    assert [r.v for r in got if r.is_outlier] == FAR
    golden = {441: (4.561020454283958, 6.901121606999746, 9.241222759715534), 444: (9.601020363752442, 11.94112160559595, 14.281222847439457), 450: (5.901020430684881, 8.241121606738828, 10.581222782792775), 456: (2.401020487624715, 4.7411216079626115, 7.081222728300508)}
    for r in got:
        if r.t in golden:
            assert (r.floor, r.expected, r.ceiling) == pytest.approx(golden[r.t], abs=1e-6)
    assert got[0].expected is None


def test_density_fills_from_history(spark):
    """A short second batch is clustered with the points before it."""
    p = points(spark, [5.0] * 40 + [5.0, 900.0, 5.0], step=10)
    got = rows(N.series_density(p, tolerance=0.0, batch_ms=400))
    assert [r.t for r in got if r.is_outlier] == [410] and len(got) == 43


def test_centroid_density_golden(spark):
    p = points(spark, CURVE, start=440)
    got = rows(N.centroid_density(p, tolerance=-1.063505513, batch_ms=None))
    assert [r.v for r in got if r.is_outlier] == FAR
    assert not any(r.is_outlier for r in N.centroid_density(p, tolerance=-5.0, batch_ms=None).collect())


def test_density_against_plain_clustering(spark):
    rng = np.random.default_rng(9)
    x = np.stack([np.sort(rng.choice(2000, 150, replace=False)).astype(float), rng.normal(0, 30, 150)], axis=1)
    eps, least = 40.0, 3
    near = [set(np.flatnonzero(np.hypot(*(x - a).T) <= eps)) - {k} for k, a in enumerate(x)]
    core = {k for k in range(150) if len(near[k]) >= least}
    seen, groups = set(), []
    for k in range(150):
        if k in core and k not in seen:
            group, todo = {k}, [k]
            while todo:
                for j in near[todo.pop()] - seen - group:
                    group.add(j)
                    if j in core:
                        todo.append(j)
            seen |= group
            groups.append(group)
    label = N.clusters(x, eps, least)
    assert [set(np.flatnonzero(label == k)) for k in range(label.max() + 1)] == groups
    assert N.outside(np.full(4, -1)).sum() == 0
    w = N.whitening(4.0, 1.0, 9.0)
    d = np.array([3.0, -2.0])
    assert np.linalg.norm(w @ d) == pytest.approx(math.sqrt(d @ np.linalg.inv([[4, 1], [1, 9]]) @ d)) and w[0, 1] == 0


def test_cohort_density(spark):
    p = points(spark, [1] * 8, "a").union(points(spark, [1.1] * 8, "b")).union(points(spark, [0.9] * 8, "c")).union(points(spark, [1, 1, 1, 90, 1, 1, 1, 1], "d"))
    got = {r.topic: (r.is_outlier, r.outside) for r in N.cohort_density(p, 1, tolerance=0.5).collect()}
    assert got["d"] == (True, 1) and not any(got[k][0] for k in "abc")


def test_ks_p_values():
    # by enumeration: of the C(8, 4) orders of two samples of 4, those with a larger distance
    from itertools import combinations

    for d in (0.25, 0.5, 0.75):
        larger = sum(D.ks_distance(np.array(c, float), np.array([x for x in range(8) if x not in c], float)) > d + 1e-9 for c in combinations(range(8), 4))
        assert D.ks_p_value(d, 4, 4) == pytest.approx(larger / 70)
    assert D.ks_p_value(0.1, 200, 200) == pytest.approx(0.2705, abs=2e-3)


def test_ks_flags_a_changed_day(spark):
    rng = np.random.default_rng(4)
    day = 86_400_000
    rows_ = [("s", k * 60_000 * 30, float(rng.normal(0 if k < 96 else 50, 1))) for k in range(144)]
    p = spark.createDataFrame(rows_, "topic string, t bigint, v double")
    got = sorted(D.ks_test(p).collect(), key=lambda r: r.batch)
    assert [r.unlike for r in got] == [False, False, True] and got[0].n_reference == 0 and got[1].n_reference == 47
    flags = D.ks_outliers(p).collect()
    assert len(flags) == 144 and {r.t // day for r in flags if r.is_outlier} == {2}


def test_dickey_fuller():
    rng = np.random.default_rng(2)
    v = noise = rng.normal(0, 1, 300)
    n, lag = 300, 6
    d = np.diff(v)
    y = d[lag:]
    x = np.array([[v[i + lag - 1], 1, lag + 1 + i, *[d[i + lag - k] for k in range(1, lag + 1)]] for i in range(n - 1 - lag)])
    z = np.linalg.inv(x.T @ x + 1e-4 * np.eye(x.shape[1])) @ x.T
    beta = z @ y
    variance = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1]) * (z @ z.T)[0, 0]
    assert D.adf_statistic(v) == pytest.approx(beta[0] / variance, rel=1e-6)
    assert D.adf_statistic(noise) < -3.45 and math.isnan(D.adf_statistic(noise[:3]))
    assert D.padded_difference(np.array([3.0, 5, 4])).tolist() == [0, 2, -1]


def test_robust_pca_finds_planted_parts():
    rng = np.random.default_rng(1)
    low = np.outer(rng.normal(0, 5, 12), rng.normal(0, 5, 20))
    spikes = np.zeros((12, 20))
    spikes[3, 4], spikes[8, 15] = 300, -250
    a, s, e = D.robust_pca(low + spikes)
    assert np.allclose(a + s + e, low + spikes)
    assert set(zip(*np.unravel_index(np.argsort(-np.abs(s).ravel())[:2], s.shape))) == {(3, 4), (8, 15)}


def test_votes(spark):
    """Points {0}, {0, 1}, {2, 1} and {2} by algorithm."""

    def labelled(sets):
        return spark.createDataFrame([("s", t, float(t), f"algo{k}", t in s, None, None, None) for k, s in enumerate(sets) for t in range(3)], "topic string, t bigint, v double, algorithm string, is_outlier boolean, floor double, expected double, ceiling double")

    def kept(sets, **rule):
        return {r.t for r in V.reduce(labelled(sets), **rule).where("is_outlier").collect()}

    assert kept([{0}], at_least=1) == {0}
    assert kept([{0, 1}, {2, 1}], at_least=2) == {1}
    assert kept([{0, 1}, {2, 1}, {2}], percent=50) == {1, 2}
    assert kept([{0}], at_least=5) == {0} and kept([set()], at_least=1) == set()
    one = labelled([{0, 1}, {1}])
    assert V.quorum(one, at_least=2, total=3).first().reached and not V.quorum(one, at_least=3, total=3).first().reached
    assert V.quorum(one, at_least=3, total=2).first().reached
    # a majority is strict, and of all that were issued
    assert V.quorum(one, majority=50, total=3).first().reached and not V.quorum(one, majority=50, total=4).first().reached
    bands = V.combined_bands(one).first().thresholds
    assert set(bands) == {"algo0", "algo1"}


def test_marks_and_fill(spark):
    times = [100_000, 103_000, 117_000, 9_821_000]
    df = spark.createDataFrame([("foo", t, float(k), k == 1) for k, t in enumerate(times)], "topic string, t bigint, v double, is_outlier boolean")
    assert [(r.metric, r.t, r.value) for r in rows(V.marks(df, "p"))] == [("p.foo", t, float(k == 1)) for k, t in enumerate(times)]
    clean = df.withColumn("is_outlier", df.v < 0)
    assert V.marks(clean).collect() == []
    assert [r.t for r in rows(V.dense_fill(clean.where("t < 110000"), 1000))] == [100_000, 101_000, 102_000, 103_000]
    assert V.dense_fill(df, 1000).collect() == []


def test_common_prefix(spark):
    from pyspark.sql import functions as F

    for names, want in ((["hyperactive", "hyperbolic", "hyperacuity", "hyperaesthesias"], "hyper"), (["hyper.active", "hyper.bolic", "hyper.acuity"], "hyper"), (["foo", "bar", "zed"], ""), (["one/a", "one/b"], "one"), (["ab", "abc"], "ab")):
        got = spark.createDataFrame([(n,) for n in names], "n string").agg(common_prefix(F.min("n"), F.max("n")).alias("p")).first().p
        assert got == want


def test_past_period_plain(spark):
    import datetime

    rng = np.random.default_rng(8)
    t0 = datetime.datetime(2016, 8, 1, tzinfo=datetime.UTC)
    days = [t0 + datetime.timedelta(days=k) for k in range(150) if k != 77]
    values = rng.normal(50, 5, len(days))
    p = spark.createDataFrame([("s", int(d.timestamp() * 1000), float(v)) for d, v in zip(days, values)], "topic string, t bigint, v double")
    for r, day in zip(rows(D.past_period(p, tolerance=2)), days):
        last = {d.year * 100 + d.month: v for d, v in zip(days, values)}
        past = [v for m, v in sorted(last.items()) if m < day.year * 100 + day.month][-3:]
        if len(past) >= 2:
            assert (r.expected, r.ceiling - r.expected) == pytest.approx((np.mean(past), 2 * np.std(past, ddof=1)))
        else:
            assert r.expected is None


def test_filled(spark):
    p = points(spark, range(10), step=10)
    got = D.filled(p, 40, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append((r.v, r.past))
    assert sorted(by[0]) == [(float(k), False) for k in range(4)]
    assert sorted(by[1]) == [(3.0, True)] + [(float(k), False) for k in range(4, 8)]
    assert sorted(by[2]) == [(5.0, True), (6.0, True), (7.0, True), (8.0, False), (9.0, False)]


def test_empty(spark):
    none = points(spark, [])
    for f in (D.moving_average, D.ewma, D.grubbs, D.median_absolute_deviation, D.least_squares, D.histogram_bins, D.ks_test, D.adf, N.series_density, N.centroid_density, D.past_period, D.seasonal_ewma, D.moments, G.distance_profile):
        assert f(none).collect() == []
