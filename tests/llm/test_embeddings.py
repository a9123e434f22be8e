"""Operator 3 against brute force."""

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm.embeddings import near_duplicates

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.98):
    ok = [k for k, (_, e, l) in enumerate(rows) if l is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in {(len(rows[k][1]), rows[k][2]) for k in ok}:
        mine = [k for k in ok if (len(rows[k][1]), rows[k][2]) == d]
        x = np.array([rows[k][1] for k in mine], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        for a in range(len(mine)):
            for b in np.flatnonzero(near[a]):
                if a != b:
                    n[mine[a]] += 1
                    p, q = root(mine[a]), root(mine[b])
                    up[max(p, q)] = min(p, q)
    return sorted((rows[k][0], n[k], rows[root(k)][0]) for k in range(len(rows)))


def check(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(frame).collect())
    rows = sorted([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], l) for i, e, l in rows])
    assert got == brute(rows)


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    check(spark, [(r["vec_id"], r["embedding"], r["label"]) for r in t])


def test_dense_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(3):  # straddling the threshold, larger than a block
        centre = rng.standard_normal(32)
        rows += [(0, (centre + rng.standard_normal(32) * s).tolist(), c % 2) for s in rng.uniform(0.05, 0.2, 400)]
    rows += [(0, rng.standard_normal(32).tolist(), int(rng.integers(0, 3))) for _ in range(600)]
    rows += [(0, [1.0, 0.0], 1)] * 50 + [(0, [2.0, 0.0], 1), (0, [1.0, 0.0], None), (0, None, 1), (0, [0.0, 0.0], 1), (0, [], 1), (0, [1.0, None], 1), (0, [float("nan"), 1.0], 1), (0, [float("inf"), 1.0], 1)]
    check(spark, [(k, e, l) for k, (_, e, l) in enumerate(rows)])


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []
