"""What a task holds beside its block: counts of a few bytes for each of the block's."""

import tracemalloc

import numpy as np

from tidemark.llm import nearcopies as nc
from tidemark.llm import suffixdedup as sd


def peak(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_covered_bytes_by_plain_count():
    rng = np.random.default_rng(2)
    at = np.array([0, 400_000, 1_000_000, 4_000_000])
    ids = np.array([5, 9, 7])
    place = np.sort(rng.choice(3_999_000, 120_000, replace=False))
    number = rng.integers(0, 5000, len(place)).astype(np.uint32)
    runs = rng.integers(1, 4, 5000).astype(np.uint8)
    run, owner = rng.integers(1, 9, runs.sum()).astype(np.uint8), rng.integers(3, 10, runs.sum())
    want, edge = np.zeros(4_000_000, bool), np.concatenate(([0], np.cumsum(runs.astype(int))))
    for p, k in zip(place.tolist(), number.tolist()):
        own = ids[np.searchsorted(at, p, side="right") - 1]
        for j in range(edge[k], edge[k + 1]):
            if owner[j] < own:
                want[p : p + int(run[j]) + sd.LENGTH - 1] = True
            p += int(run[j])
    got, most = peak(lambda: sd.covered(at, ids, place, number, runs, run, owner))
    assert (got == want).all() and not want.all()
    assert most < 8 * len(want)


def test_pairs_of_a_common_shingle_come_in_small_parts():
    n = 3000
    at, size = np.zeros(n, np.int32), np.full(n, 100, np.int32)
    count, most = peak(lambda: sum(len(x[0]) for x in nc.candidates(np.ones(n, np.int64), np.arange(n), np.arange(n), size, at, 0.8)))
    assert count == n * (n - 1) // 2 and most < 24 << 20
