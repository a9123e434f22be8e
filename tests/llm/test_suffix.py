"""Operator 9: the transform against sorted suffixes, and the operator against brute force."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm.suffixdedup import LENGTH, column_wise, remove_repeats

SF = "/root/testdata/sf0.001"


def brute(docs):
    """docs: (id, text) -> {id: (n_bytes, n_removed, n_spans, sha of what is kept)}; ids distinct."""
    first = {}
    raws = [(i, (t or "").encode()) for i, t in sorted(docs)]
    for i, r in raws:
        for k in range(len(r) - LENGTH + 1):
            first.setdefault(r[k : k + LENGTH], i)
    out = {}
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - LENGTH + 1):
            if first[r[k : k + LENGTH]] < i:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out[i] = (len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_column_wise():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(60)] + [b"aaaa"] * 3
    data = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    doc, size, common = column_wise(data, edge[:-1], edge[1:])
    suffixes = [texts[d][len(texts[d]) - s :] for d, s in zip(doc.tolist(), size.tolist())]
    assert len(suffixes) == sum(len(t) + 1 for t in texts)
    assert suffixes == sorted(suffixes)
    for a, b, c in zip(suffixes, suffixes[1:], common[1:].tolist()):
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == c


def check(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(frame).collect()}
    assert rows == brute(docs)


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    check(spark, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())))


def test_edges(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs far away from it all, again and again. "
    check(spark, [(5, passage * 3), (1, "x" * 300), (2, "x" * 120 + "y"), (3, None), (4, ""), (9, "é" * 60), (8, "é" * 40 + passage), (7, "short"), (6, "short"), (10, passage[:49]), (11, passage[:50]), (-1, "ü" + "é" * 30)])


def test_nulls_and_repeats(spark):
    text = "a passage that is long enough to count as one, since it has more than fifty bytes"
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text), (None, None)], "doc_id bigint, text string").selectExpr("*", "'x' as id", "1 as block")
    rows = sorted((r.doc_id is None, r.n_removed) for r in remove_repeats(frame).collect())
    assert rows == [(False, 0), (False, 0), (True, 0), (True, len(text)), (True, len(text))]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_pieces_of_one_hash_are_compared(monkeypatch):
    """Where hashes collide, different pieces stay apart."""
    from tidemark.llm import suffixdedup as S

    pieces = [b"a" * 50, b"b" * 50, b"a" * 50, b"c" * 51, b"d" * 60]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    start = np.cumsum(size) - size
    owner, anchor = np.array([5, 4, 3, 2, 1]), np.zeros(5, np.uint64)
    one, of = S._merged(data, start, size, owner, anchor)
    assert len(one) == 4 and of[0] == of[2] and owner[one[of[0]]] == 3
    monkeypatch.setattr(S, "_text_hashes", lambda data, start, end, step=0: np.zeros(len(start), np.uint64))
    one, of = S._merged(data, start, size, owner, anchor)
    assert all(pieces[k] == pieces[one[of[k]]] for k in range(5))
