"""Operator 3: links between groups that fill their neighbour lists with themselves."""

import numpy as np
import pytest

from tidemark.llm import embeddings

from .test_embeddings import check


def groups(rng, sizes, dim=32, angle=np.arccos(0.985), spread=1e-4):
    """Tight groups along a circle, each about 0.985 from the next."""
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    return [(np.cos(k * angle) * a + np.sin(k * angle) * b + rng.standard_normal(dim) * spread).tolist() for k, n in enumerate(sizes) for _ in range(n)]


@pytest.mark.parametrize("sizes", [(20, 20), (300, 40, 20, 500)])
def test_links_between_tight_groups(spark, sizes):
    rng = np.random.default_rng(11)
    rows = [(e, 1) for e in groups(rng, sizes)] + [(rng.standard_normal(32).tolist(), 1) for _ in range(300)]
    check(spark, [(int(k), *rows[j]) for k, j in enumerate(rng.permutation(len(rows)))])


def test_whole_labels_when_the_audit_fails(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "_audit", lambda *a: 0.0)
    monkeypatch.setattr(embeddings, "_chunked", lambda *a: lambda batches: (b.select([]) for b in batches if False))
    rng = np.random.default_rng(12)
    rows = [(e, k % 2) for k, e in enumerate(groups(rng, (30, 300, 30)))]
    check(spark, [(k, e, l) for k, (e, l) in enumerate(rows)])
