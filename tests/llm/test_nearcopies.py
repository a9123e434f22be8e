"""Near copies by 512-bit SimHash: held against exact Jaccard similarities and plain comparison of all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import nearcopies as nc
from tidemark.llm.common import utf8


def changed(rng, words, n):
    out = list(words)
    for p in rng.choice(len(words), n, replace=False):
        out[p] = f"new{rng.integers(0, 10**6)}"
    return out


def prints(texts):
    return nc.fingerprints_of(*utf8(pa.array(texts, pa.string())))


@pytest.mark.parametrize("edits, least, most", [(1, 0.99, 1.0), (2, 0.98, 1.0), (4, 0.8, 1.0), (12, 0.0, 0.05)])
def test_share_of_pairs_that_link(edits, least, most):
    """200 words; 1, 2, 4 and 12 changed words: Jaccard about 0.95, 0.9, 0.82 and 0.57."""
    rng, hits = np.random.default_rng(5), 0
    for _ in range(150):
        words = [f"w{v}" for v in rng.integers(0, 5000, 200)]
        fp = prints([" ".join(words), " ".join(changed(rng, words, edits))])
        at = nc.anchors(fp)
        hits += len(nc.meet(at.reshape(-1), np.tile(fp, (nc.SAMPLES, 1)), np.tile([0, 1], nc.SAMPLES), nc.most_bits(0.8))[0])
    assert least <= hits / 150 <= most


def test_bits_by_plain_count():
    from xxhash import xxh64_intdigest

    text = "A b c d e f\tb c d e f b c d e f " + "x " * 900
    words = text.lower().split()
    own = {xxh64_intdigest(" ".join(words[k : k + 5]).encode(), nc.SEED) for k in range(len(words) - 4)}
    ones = [0] * nc.BITS
    for h in own:
        for w, x in enumerate(nc._mixed(np.array([h], np.uint64))[0].tolist()):
            for b in range(64):
                ones[64 * w + b] += x >> b & 1
    want = [int(n * 2 > len(own)) for n in ones]
    got = np.unpackbits(prints([text]).view(np.uint8), bitorder="little").tolist()
    assert got == want


def test_large_groups_connect_as_small_ones_do():
    """Six hundred near copies of a few texts: connected alike by pairs, by fronts and by plain comparison at each anchor."""
    rng = np.random.default_rng(8)
    bases = [rng.integers(0, 2**64, nc.WORDS, np.uint64) for _ in range(4)]
    fp = []
    for k in range(600):
        flip = np.zeros(nc.BITS, bool)
        flip[rng.choice(nc.BITS, rng.integers(20, 60), replace=False)] = True
        fp.append(bases[k % 4] ^ np.packbits(flip, bitorder="little").view(np.uint64))
    fp = np.array(fp)
    at, rep, most = nc.anchors(fp), np.tile(np.arange(len(fp)), nc.SAMPLES), nc.most_bits(0.8)
    near = nc._differ(fp[:, None], fp[None]) <= most
    want = list(range(len(fp)))

    def root(up, x):
        while up[x] != x:
            x = up[x]
        return x

    for row in at:
        for a in range(len(fp)):
            for b in np.flatnonzero(near[a] & (row == row[a])):
                x, y = root(want, a), root(want, int(b))
                want[max(x, y)] = min(x, y)
    for small in (1, 20, 10**6):
        up = list(range(len(fp)))
        for a, b in zip(*nc.meet(at.reshape(-1), np.tile(fp, (nc.SAMPLES, 1)), rep, most, small=small, cells=1 << 12)):
            x, y = root(up, int(a)), root(up, int(b))
            up[max(x, y)] = min(x, y)
        assert [root(up, k) for k in range(len(fp))] == [root(want, k) for k in range(len(fp))]


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(7, long), (3, long.upper() + " end"), (None, long), (4, None), (5, ""), (6, " \n"), (8, "two words"), (9, "two words"), (9, "two words"), (None, "alone in the world of five words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as fp", "1 as rep", "2 as component_id", "3 as _id")
    got = sorted(((r.doc_id, r.component_id) for r in nc.near_copies(docs).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (None, 3), (4, 4), (5, 4), (6, 4), (8, 8), (9, 8), (9, 8), (None, None)], key=str)
    assert nc.near_copies(docs.limit(0)).collect() == []
