"""Every pair of Jaccard 0.8 or more links, whether or not 512 bits tell it."""

import numpy as np

from tidemark.llm import nearcopies as nc

from .test_nearcopies import changed


def jaccard(x, y):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (x, y))
    return len(a & b) / len(a | b)


def test_all_pairs_at_the_limit_link(spark):
    """300 pairs of 30 to 400 words a little above 0.8, of which 512 bits alone leave out every sixth or so."""
    rng, texts, want = np.random.default_rng(11), [], 0
    while want < 300:
        size = int(rng.integers(30, 400))
        words = [f"w{v}" for v in rng.integers(0, 5000, size)]
        other = changed(rng, words, max(1, size // 50))
        if 0.8 <= jaccard(words, other) < 0.86:
            texts += [" ".join(words), " ".join(other)]
            want += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()}
    assert all(got[k] == k - k % 2 for k in got) and len(got) == 600


def test_candidates_are_all_that_may_be_alike():
    rng = np.random.default_rng(4)
    heavy = np.sort(rng.choice(400, 30, replace=False)).astype(np.uint64)
    weight = rng.integers(3, 50, 30)
    sets = []
    for k in range(120):
        base = rng.choice(400, int(rng.integers(1, 60)), replace=False) if k % 3 == 0 else np.append(sets[-1][int(rng.integers(0, 5)) :], rng.integers(0, 400))
        sets.append(np.unique(base).astype(np.uint64))
    at, token, key = [], [], []
    for k, own in enumerate(sets):
        prefix = nc.prefix_of(own, 0.8, heavy, weight)
        token.append(prefix), at.append(np.arange(len(prefix))), key.append(np.full(len(prefix), k))
    token, at, key = (np.concatenate(x).astype(np.int64) for x in (token, at, key))
    n = np.array([len(x) for x in sets])[key]
    want = {(i, j) for i in range(120) for j in range(i) if i // 10 != j // 10 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    for cells in (1, 1 << 20):
        got = {(max(a, b), min(a, b)) for a, _, b, _ in (x for part in nc.candidates(token, key, key // 10, n, at, 0.8, cells) for x in zip(*part))}
        assert want <= got and all(i // 10 != j // 10 for i, j in got)
    assert want
