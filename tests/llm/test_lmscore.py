"""Operator 10 against a plain model, and what it is for."""

import math
import re
from collections import Counter

import pyarrow.parquet as pq

from tidemark.llm.lmscore import LEAST_COUNT, PRIOR, cross_entropy_difference

SF = "/root/testdata/sf0.001"


def brute(docs):
    """docs: (id, text, good) -> {id: difference}."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, _ in docs}
    good = {i: bool(g) for i, _, g in docs}
    count = Counter(w for ws in words.values() for w in ws)
    words = {i: [w if count[w] >= LEAST_COUNT else None for w in ws] for i, ws in words.items()}
    vocabulary = len({w for ws in words.values() for w in ws})
    one, two, size, starts = ({True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}, {True: 0, False: 0}, {True: 0, False: 0})
    for i, ws in words.items():
        for of_target in {False, good[i]}:
            one[of_target].update(ws)
            two[of_target].update(zip(["<s>", *ws], ws))
            size[of_target] += len(ws)
            starts[of_target] += bool(ws)
    out = {}
    for i, ws in words.items():
        own1, own2 = Counter(ws), Counter(zip(["<s>", *ws], ws))
        loss = {}
        for m in (True, False):
            mine = good[i] if m else True
            scale = size[True] / max(size[m], 1)
            total = 0.0
            for a, w in zip(["<s>", *ws], ws):
                uni = ((one[m][w] - own1[w] * mine) * scale + 1) / ((size[m] - len(ws) * mine) * scale + vocabulary)
                before, own = (starts[m], 1) if a == "<s>" else (one[m][a], own1[a])
                total -= math.log(((two[m][a, w] - own2[a, w] * mine) * scale + PRIOR * uni) / ((before - own * mine) * scale + PRIOR))
            loss[m] = total / max(len(ws), 1)
        out[i] = loss[True] - loss[False]
    return out


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    docs = [(i, x, labels.get(i)) for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())]
    got = {r.doc_id: r.difference for r in cross_entropy_difference(spark.createDataFrame(docs, "doc_id bigint, text string, good boolean"), "good").collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_target_like_text_scores_lower(spark):
    docs = [(k, "red wine and old cheese taste fine " * 3, k < 5) for k in range(10)] + [(k, "blue cars on new roads drive fast " * 3, False) for k in range(10, 20)]
    got = {r.doc_id: r.difference for r in cross_entropy_difference(spark.createDataFrame(docs, "doc_id bigint, text string, good boolean"), "good").collect()}
    assert max(got[k] for k in range(5, 10)) < min(got[k] for k in range(10, 20))


def test_edges(spark):
    docs = [(1, None, True), (2, "", None), (None, " \t", False), (3, "one", None), (3, "one", None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, good boolean").selectExpr("*", "1 as id", "2 as target")
    rows = cross_entropy_difference(frame, "good").collect()
    assert len(rows) == 5 and all(r.difference == 0 and r.kept for r in rows)
    assert cross_entropy_difference(spark.createDataFrame([], frame.schema), "good").collect() == []
