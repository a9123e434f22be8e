"""The thin queries against brute force over a whole small table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


def rows(name, order):
    t = pq.read_table(f"{SF}/{name}.parquet").to_pylist()
    return sorted(t, key=lambda r: r[order])


def got(spark, name, order):
    from tidemark.llm.queries import QUERIES

    return [r.asDict() for r in QUERIES[name](spark, SF).orderBy(order).collect()]


@pytest.fixture(scope="module")
def documents():
    return rows("documents", "doc_id")


def test_op1(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    result = got(spark, "op1_token_store", "doc_id")
    assert len(result) == len(documents)
    for d, r in zip(documents, result):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op7(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    result = got(spark, "op7_bpe", "doc_id")
    assert len(result) == len(documents)
    for d, r in zip(documents, result):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want = (d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_op4(spark, documents):
    result = {r["doc_id"]: r for r in got(spark, "op4_fingerprints", "doc_id")}
    assert len(result) == len(documents)
    down = documents[::-1]
    near, true = [], []
    for k, d in enumerate(down):
        text, after = d["text"] or "", down[(k + 1) % len(down)]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = result[d["doc_id"]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

        def shingles(s):
            w = re.findall(r"[^\x20\x09-\x0D]+", s)
            return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

        a, b = shingles(text), shingles(edited)
        near.append(r["near_edited"])
        true.append(len(a & b) / len(a | b) if a | b else 1.0)
    assert np.abs(np.array(near) - np.array(true)).mean() < 0.02
    assert np.abs(np.array(near) - np.array(true)).max() < 0.2


def test_op5(spark, documents):
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in documents}
    by = defaultdict(int)
    for d in documents:
        by[d["source"]] += size[d["doc_id"]]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, open_ = sum(by.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * by[s] for s in over}
        open_ -= over
    result = got(spark, "op5_source_mixing", "doc_id")
    assert len(result) == len(documents)
    taken = defaultdict(int)
    for d, r in zip(documents, result):
        assert r["doc_id"] == d["doc_id"] and r["size"] == size[d["doc_id"]]
        assert r["source_size"] == by[d["source"]]
        assert math.isclose(r["target"], target[d["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.04 * target[s], 60), (s, taken[s], target[s])


def test_op8(spark, documents):
    import xxhash

    prints = []
    for d in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = {k: k for k in range(len(prints))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    result = got(spark, "op8_simhash_dedup", "doc_id")
    for k, (d, r) in enumerate(zip(documents, result)):
        assert (r["doc_id"], r["fingerprint"], r["component_id"]) == (d["doc_id"], f"{prints[k]:016x}", documents[root(k)]["doc_id"])


def test_op1_odd_rows(spark):
    """Null, empty, repeated and very long texts, spaces beyond ASCII, null and repeated ids, clashing columns, no rows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.tokenstore import digests

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    long = "".join(chr(97 + k % 26) + (" " if k % 7 == 0 else "\n\n" if k % 50 == 0 else "") for k in range(2_500_000))
    texts = [None, "", " ", "a  b  c ", "x　", " y  z", "don't  stop\t\n now ", "<|endoftext|> a<|endoftext|>", "\x1c \x1d a", "同じ 同じ\r\n", long, "twin", "twin"]
    docs = [(k, x) for k, x in enumerate(texts)] + [(None, "n"), (None, "n"), (3, "other"), (3, "a  b  c ")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as shard", "3 as copy")
    got = digests(frame, path).collect()
    crc = lambda x: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, crc(x)) for i, x in docs)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(r.n_tokens for r in order[:k]) for k in range(len(order))]
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert digests(frame.limit(0), path).collect() == []
