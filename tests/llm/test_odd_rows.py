"""Operators over odd tables: nulls, empty and very long texts, repeated rows, clashing columns, and no rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, embeddings, lmscore, minhash, mixing, quality, simhash
from tidemark.llm.queries import QUERIES

GOOD = "The report says that the committee met in the town hall on Monday and agreed to keep the old bridge open for the year."
LONG = " ".join(f"word{k % 977} {GOOD}" for k in range(12_000))  # 1.5 MB


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, GOOD, "a"), (1, GOOD, "a"), (1, GOOD, "a"), (2, None, "a"), (3, "", None), (4, " \t\n", "b"), (5, LONG, "b"), (None, None, None), (6, "one", "b"), (6, "other", "a")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' as id", "7 as size", "8 as fp", "9 as row", "1 as good", "2 as k", "3 as t", "4 as part", "5 as n")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_every_row_comes_back(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    for f in (quality.classify, simhash.near_duplicates, minhash.edited_likeness, minhash.fingerprints, mixing.mix, lambda d: bpe.encoded(d, path), lambda d: lmscore.cross_entropy_difference(d, "doc_id = 1")):
        assert ids(f(odd)) == ids(odd)
        assert f(odd.limit(0)).collect() == []


def test_quality_of_odd_rows(odd):
    got = quality.classify(odd).collect()
    for r in got:
        assert 0 <= r.score <= 1
    assert all(r.score == 0 and not r.kept for r in got if r.doc_id in (2, 3, 4))


def test_quality_sample_takes_each_text_once(spark):
    """A text on nearly all rows doesn't crowd out the others, and reruns agree."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    hot = docs.unionByName(spark.range(3000).select((F.col("id") + 10_000).alias("doc_id"), F.lit(GOOD).alias("text")))
    a, b = quality.fit(hot), quality.fit(hot.repartition(7))
    assert np.allclose(a.weights, b.weights) and a.rates == b.rates
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect() if r.quality is not None}
    got = {r.doc_id: r.kept for r in quality.score(docs, a).collect()}
    assert sum(got[i] == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)


def test_estimate_finds_planted_rates():
    rng = np.random.default_rng(3)
    n, labellers = 20_000, 6
    bad = rng.random(n) < 0.3
    kind = rng.integers(0, labellers, n)
    votes = np.where(rng.random((n, labellers)) < 0.02, 2, 1)
    for j in range(labellers):
        hit = bad & ((kind == j) | (kind == (j + 1) % labellers))
        votes[hit, j] = np.where(rng.random(hit.sum()) < 0.9, 2, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, rates, prior = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.08
    assert all(abs(rates[j][1][1] - 0.02) < 0.02 for j in range(labellers))
    by = {tuple(p): q for p, q in zip(patterns.tolist(), post.tolist())}
    got = np.array([by[tuple(v)] for v in votes.tolist()]) > 0.5
    assert (got == ~bad).mean() > 0.9  # a single vote is good or bad nearly alike


def test_quality_query_against_labels(spark):
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.quality is not None]
    got = {r.doc_id: r.score for r in QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").collect()}
    good, poor = [got[r.doc_id] for r in labels if r.quality == 1], [got[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean(np.array(good)[:, None] > np.array(poor)) > 0.98
    assert np.mean(np.array(good) >= quality.LEAST) > 0.98 and np.mean(np.array(poor) >= quality.LEAST) < 0.1


def test_quality_stage_of_odd_rows(spark, odd):
    import corpus_pipeline as cp

    kept = cp.quality_classifier(spark, odd, "").collect()
    assert all(r.text and r.text.strip() for r in kept) and list(kept[0].asDict()) == list(cp.COLUMNS) if kept else True


def test_mix_meets_its_promise(spark):
    """Within half the shortest text of the target, where the cap leaves room."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 900))), "abc"[int(rng.random() ** 2 * 3)]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for run in (mixing.RUN, 64):
        mixing.RUN = run
        got = mixing.mix(docs).collect()
        for s in "abc":
            mine = [r for r in got if r.source == s]
            shortest = min(r.size for r in mine)
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= shortest / 2 + 1e-6, (run, s)
    mixing.RUN = 256


def test_fingerprint_ranges_split_null_ids(spark):
    """Without any id the order is by text, dealt to many ranges; each row's next one is the next in that order."""
    texts = [f"{k} {GOOD} {k * 7}" for k in range(300)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    got = minhash.edited_likeness(docs, parts=40).collect()
    assert len(got) == 300 and len({r.edited_sha256 for r in got}) == 300


def test_lm_scores_as_a_query(spark, tmp_path):
    """Columns of documents may clash with the query's own, and labels of other documents don't count."""
    texts = ["red wine and old cheese taste fine"] * 5 + ["blue cars on new roads drive fast"] * 5
    spark.createDataFrame([(k, t, True, k) for k, t in enumerate(texts)], "doc_id bigint, text string, good boolean, in_target int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(3)] + [(4, 1, 1), (99, 1, 0), (None, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.difference for r in QUERIES["op10_lm_scores"](spark, str(tmp_path)).collect()}
    docs = spark.createDataFrame([(k, t, k < 3) for k, t in enumerate(texts)], "doc_id bigint, text string, mine boolean")
    want = {r.doc_id: r.difference for r in lmscore.cross_entropy_difference(docs, "mine").collect()}
    assert got == pytest.approx(want) and max(got[k] for k in range(5)) < min(got[k] for k in range(5, 10))


def test_embeddings_of_any_size(spark):
    """Components near the ends of a double's range neither over- nor underflow."""
    rows = [(1, [1e200, 0.0]), (2, [2e200, 1e190]), (3, [1e-200, 0.0]), (4, [3e-200, 1e-203]), (5, [0.0, 1e200]), (6, [0.0, 0.0]), (7, None)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(docs).collect()}
    assert [got[k] for k in range(1, 8)] == [(3, 1)] * 4 + [(0, 5), (0, 6), (0, 7)]
    assert not any(math.isnan(x) for x, _ in got.values())


def test_recall_by_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (40, 8))
    vectors = [(base[k % 40] + rng.normal(0, 0.02, 8)).tolist() for k in range(400)]
    classes = spark.createDataFrame([(k, 1, v, k % 50 == 0) for k, v in enumerate(vectors)], "cid bigint, grp bigint, vec array<double>, asked boolean")
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & ~np.eye(400, dtype=bool)
    half = spark.createDataFrame([(k, k % 80) for k in range(400)], "node bigint, component bigint")
    hits = near & (np.arange(400)[:, None] % 80 == np.arange(400)[None, :] % 80)
    assert embeddings._recall(classes, half, 0.98, 4) == pytest.approx(hits[::50].sum() / near[::50].sum())
