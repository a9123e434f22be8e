"""Queries over whole series, against brute force on small tables."""

import numpy as np
import pandas as pd

import __spark_entry__ as entry
from tidemark.functions import grubbs_critical
from tidemark.operators.detect import robust_pca, rpca


def test_grubbs_over_all_customers(spark, tmp_path):
    rng = np.random.default_rng(5)
    sizes = {("A", 1): 150, ("A", 2): 61, ("B", 1): 9}
    keys = [k for k, n in sizes.items() for _ in range(n)]
    order = rng.permutation(len(keys))
    rows = [(i, keys[k][0], keys[k][1], float(rng.normal(0, 100) * (8 if i % 17 == 0 else 1))) for i, k in enumerate(order)]
    pd.DataFrame(rows, columns=["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"]).to_parquet(tmp_path / "customer.parquet")
    want = {}
    for (segment, nation), size in sizes.items():
        mine = [r for r in rows if r[1:3] == (segment, nation)]
        assert len(mine) == size
        for n, (i, _, _, v) in enumerate(mine):
            last = [r[3] for r in mine[max(0, n - 60) : n]]
            d = 0.5 * grubbs_critical(n) * np.std(last, ddof=1) if n >= 7 else None
            m = np.mean(last) if last else None
            want[f"customer.{segment}{nation}", i] = (None, None, None, False) if d is None else (m - d, m, m + d, bool(v < m - d or v > m + d))
    got = {(r.topic, r.t): (r.floor, r.expected, r.ceiling, r.is_outlier) for r in entry.queries()["grubbs"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][3] == w[3] and all((a is None) == (b is None) and (a is None or abs(a - b) < 2e-5) for a, b in zip(got[k][:3], w[:3])), k


def test_rpca_has_a_row_for_every_point(spark):
    rng = np.random.default_rng(6)
    sizes = {"long": 100, "short": 7, "whole": 48, "longer": 125}  # the last has stretches of 60, 60 and 5
    values = {k: np.sin(np.arange(n) * np.pi / 6) * 10 + rng.normal(0, 1, n) for k, n in sizes.items()}
    points = spark.createDataFrame([(k, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "topic string, t bigint, v double")
    got = {k: [] for k in sizes}
    for r in sorted(rpca(points, 12, window=60).collect()):
        got[r.topic].append(r)
    fold = lambda v: [p.T.ravel() for p in robust_pca(v.reshape(-1, 12).T)]
    for k, n in sizes.items():
        assert [(r.t, r.v) for r in got[k]] == list(enumerate(values[k]))
        assert all((r.low_rank is None and r.sparse is None and r.error is None) if n < 12 else abs(r.low_rank + r.sparse + r.error - r.v) < 1e-9 for r in got[k])
    last = values["long"][60:]
    assert np.allclose([r.low_rank for r in got["long"][60:96]], fold(last[:36])[0])
    assert np.allclose([r.low_rank for r in got["long"][96:]], fold(last[4:])[0][-4:])
    last = values["longer"][60:]
    assert np.allclose([r.low_rank for r in got["longer"][120:]], fold(last[5:])[0][-5:])
