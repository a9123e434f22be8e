"""Density clusters by cells, against plain comparison of all pairs, and on a batch that lies within its reach."""

import time

import numpy as np

from tidemark.operators.density import clusters


def plain(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) - 1 >= least
    label, at = np.full(len(x), -1), 0
    for k in np.flatnonzero(core):
        if label[k] >= 0:
            continue
        todo = [k]
        label[k] = at
        while todo:
            j = todo.pop()
            if core[j]:
                fresh = np.flatnonzero(near[j] & (label < 0))
                label[fresh] = at
                todo += fresh.tolist()
        at += 1
    return label


def test_clusters_by_plain_comparison():
    rng = np.random.default_rng(1)
    for k in range(600):
        n, axes = int(rng.integers(0, 90)), int(rng.integers(1, 3))
        x = rng.normal(0, 1, (n, axes)) if k % 2 else rng.integers(0, 8, (n, axes)).astype(float)
        x = x[np.argsort(x[:, 0], kind="stable")]
        eps, least = float(rng.choice([0, 0.05, 0.2, 0.5, 1, 1.5, 2, 3, 50, 1e-12])), int(rng.integers(0, 6))
        assert clusters(x, eps, least).tolist() == plain(x, eps, least).tolist(), (k, eps, least)


def test_a_dense_batch_costs_no_square():
    rng = np.random.default_rng(2)
    x = np.column_stack((np.sort(rng.uniform(0, 0.1, 40_000)), rng.exponential(1, 40_000)))
    began = time.time()
    assert (clusters(x, 4.2, 3) == 0).mean() > 0.99
    assert time.time() - began < 10
