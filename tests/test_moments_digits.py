"""Moments of long series hold the digits that their SQL has."""

from decimal import Decimal, getcontext

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators.stretch import STRETCH, all_moments, carried

getcontext().prec = 50


def exact(v):
    own = [Decimal(x) for x in v.tolist()]
    mean = sum(own) / len(own)
    return mean, sum((x - mean) ** 2 for x in own)


def far(got, want):
    """Units of the last place."""
    return abs(Decimal(float(got)) - want) / Decimal(float(np.spacing(abs(float(got)))))


def test_running_sums_cost_no_digits():
    v = np.round(np.random.default_rng(1).exponential(50, STRETCH), 2)
    _, mean, sd = all_moments(v)
    for k in (10, 5000, 30_000, 70_331, STRETCH - 1):
        m, q = exact(v[:k])
        assert far(mean[k], m) <= 1 and far(sd[k], (q / (k - 1)).sqrt()) <= 1


def test_earlier_stretches_cost_no_digits(spark):
    v = np.round(np.random.default_rng(2).exponential(50, 3 * STRETCH), 2)
    points = spark.createDataFrame(list(enumerate(v.tolist())), "n bigint, v double").withColumns({"topic": F.lit("a"), "t": F.col("n")})
    got = {r._stretch: r for r in carried(points).collect()}
    assert sorted(got) == [0, 1, 2] and got[0].n0 == 0
    for k in (1, 2):
        m, q = exact(v[: k * STRETCH])
        r = got[k]
        assert (r.n0, r.low0, r.high0) == (k * STRETCH, v[: k * STRETCH].min(), v[: k * STRETCH].max())
        assert far(r.mean0, m) <= 4 and far(r.m0, q) <= 8
