"""Pairs that share a passage only are told apart before their whole sets of shingles are joined to them."""

import numpy as np
import pyarrow as pa

from tidemark.llm import nearcopies as nc


def sharing(rng, size, common, other):
    own = rng.integers(0, 2**64, size, np.uint64)
    return np.unique(own), np.unique(np.concatenate((own[:common], rng.integers(0, 2**64, other, np.uint64))))


def test_no_alike_pair_is_sieved_out_and_few_others_stay():
    rng, sets = np.random.default_rng(3), []
    for size in (1, 2, 5, 31, 32, 33, 64, 100, 130, 500, 511, 2000, 9000):
        for share in (0.0, 0.3, 0.6, 0.8, 0.85, 0.89, 0.9, 0.95, 1.0):
            for grown in (0.0, 0.1, 0.24):
                sets.append(sharing(rng, size, int(share * size), int((1 - share + grown) * size)))
    x, y = (pa.array([nc.parities_of(s[k]) for s in sets], pa.binary()) for k in (0, 1))
    n = np.array([len(a) + len(b) for a, b in sets])
    stays = nc.may_be_alike(x, y, n, 0.8)
    like = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in sets])
    assert stays[like >= 0.8].all() and (like >= 0.8).sum() > 50
    assert not stays[(like < 0.7) & (n > 200)].any() and ((like < 0.7) & (n > 200)).sum() > 50
    assert (nc.may_be_alike(x[7:], y[7:], n[7:], 0.8) == stays[7:]).all()


def test_texts_with_a_passage_in_common_are_not_joined_to_their_shingles(spark):
    """Forty texts of which a third is the same, and a pair of Jaccard 0.9: of 780 pairs and one, the one stays."""
    rng = np.random.default_rng(6)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + [f"w{v}" for v in rng.integers(0, 10**6, 120)]) for _ in range(40)]
    words = [f"w{v}" for v in rng.integers(0, 10**6, 200)]
    texts += [" ".join(words), " ".join([*words[:-6], *"a b c d e f".split()])]
    prints = nc.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).cache()
    key = {r.doc_id: r.key for r in prints.collect()}
    pairs = spark.createDataFrame([(key[a], a, key[b], b) for b in range(42) for a in range(b)], "a bigint, ca bigint, b bigint, cb bigint")
    assert [(r.ca, r.cb) for r in nc.sieved(pairs, prints, 0.8).collect()] == [(40, 41)]
