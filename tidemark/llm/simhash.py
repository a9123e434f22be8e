"""Operator 8: SimHash near-duplicates, linked through the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, slices, utf8, written
from .textkernel import LOWER, SPACE, word_spans

SHINGLE = 4
SEED = 42
DISTANCE = 4


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of each row's shingles of ``size`` words end to end, repeats included, and each row's number of them."""
    rows = len(at) - 1
    start, end, row = word_spans(data, at)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    # words joined by one space each, so that every shingle is one slice
    text = LOWER[data]
    keep = ~SPACE[data]
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    gap = start[inner] - 1
    keep[gap], text[gap] = True, 0x20
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    joined = text[keep].tobytes()
    start, end = place[start], place[end]
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    last = np.minimum(np.arange(len(row)) + size - 1, (first + n - 1)[row])
    whole = np.arange(len(row)) - first[row] <= np.maximum(n[row] - size, 0)
    digest = xxhash.xxh64_intdigest
    spans = zip(start[whole].tolist(), end[last[whole]].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64), np.maximum(n - size + 1, np.minimum(n, 1))


def fingerprints_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row's text; 0 for a row without words."""
    h, count = shingle_hashes(data, at)
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    edge = np.concatenate(([0], np.cumsum(count[some])))
    ones = np.empty((len(some), 64), np.int64)
    for k in range(0, len(some)):
        bits = np.unpackbits(h[edge[k] : edge[k + 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[k] = bits.sum(axis=0, dtype=np.int64)
    major = ones * 2 > count[some][:, None]
    out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): the fingerprint as a signed 64-bit number, one row per row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(fingerprints_of(*utf8(part.column("_text"))).view(np.int64))], ["_id", "fp"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, f"_id {kind}, fp bigint").withColumnRenamed("_id", id_col)


# --- the covering code -------------------------------------------------------------------------------------------

#: The 64 bits are cut into three segments; of 4 differing bits at least one segment has at most 1 (pigeonhole).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CODE = 15  # each segment: a Hamming(15, 11) code on the low bits (covering radius 1), the rest as they are (radius 0)


@cache
def hamming() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all 15-bit values: the nearest codeword, and the codewords within covering radius + 1 = 2 (row, codeword)."""
    v = np.arange(1 << _CODE)
    syndrome = np.zeros_like(v)
    for bit in range(_CODE):
        syndrome ^= np.where(v >> bit & 1, bit + 1, 0)
    nearest = np.where(syndrome > 0, v ^ (1 << np.maximum(syndrome - 1, 0)), v)
    pairs = [(v, nearest)]
    for i in range(_CODE):
        for j in range(i + 1, _CODE):
            at = v[syndrome == (i + 1) ^ (j + 1)]
            pairs.append((at, at ^ (1 << i) ^ (1 << j)))
    row, word = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.argsort(row, kind="stable")
    return nearest, np.searchsorted(row[order], np.arange((1 << _CODE) + 1)), word[order]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, visits): the one anchor that is each segment's home, then every anchor within reach.

    The home is the nearest codeword, at distance d <= R = 1.  A fingerprint that differs by at most t = 1 bit in the
    segment is within R + t = 2 of that anchor; it visits all anchors of that ball, so the two meet there.
    """
    nearest, edge, word = hamming()
    index, anchor, visits = [], [], []
    every = np.arange(len(fp))
    for k, (shift, width) in enumerate(SEGMENTS):
        seg = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        low, high = seg & ((1 << _CODE) - 1), seg >> _CODE
        name = np.int64(k) << 32
        home = (high << _CODE | nearest[low]) | name
        index.append(every)
        anchor.append(home)
        visits.append(np.zeros(len(fp), bool))
        n = edge[low + 1] - edge[low]
        which = np.repeat(every, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        index.append(which)
        anchor.append((high[which] << _CODE | word[edge[low[which]] + step]) | name)
        visits.append(np.ones(len(which), bool))
        for bit in range(width - _CODE):  # the one differing bit lies in the free part
            index.append(every)
            anchor.append(((high ^ (1 << bit)) << _CODE | nearest[low]) | name)
            visits.append(np.ones(len(fp), bool))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(visits)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that join two trees: they connect all that the given pairs connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    return a[kept], b[kept]


def meet(anchor: np.ndarray, visits: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Compare homes with visitors per anchor; returns a spanning forest of the links, by rep."""
    order = np.lexsort((visits, anchor))
    anchor, visits, fp, rep = anchor[order], visits[order], fp[order], rep[order]
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    homes = np.bincount(group, weights=~visits).astype(np.int64)
    guest = np.flatnonzero(visits & (homes[group] > 0))
    work = np.concatenate(([0], np.cumsum(homes[group[guest]])))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(guest):
        end = max(at + 1, int(np.searchsorted(work, work[at] + most, side="right")) - 1)
        g = guest[at:end]
        n = homes[group[g]]
        left = np.repeat(g, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[group[left]]
        near = (fp[left] != fp[right]) & (np.bitwise_count(fp[left] ^ fp[right]) <= distance)
        if near.any():
            a, b = rep[left[near]], rep[right[near]]
            pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            found.append(forest(pair[:, 0], pair[:, 1]))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


#: Fingerprints that a task compares, on average, some 45 rows of 25 bytes each.
TASK_PRINTS = 50_000


def links(prints: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """prints: (fp, rep), fingerprints distinct.  Returns (a, b): edges that connect the same reps as all the links."""
    if not 0 <= distance <= 5:
        raise ValueError("three segments with one differing bit each cover distances up to 5")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
            for k in range(0, len(fp), 20_000):
                index, anchor, visits = anchors(fp[k : k + 20_000])
                index = index + k
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(visits), pa.array(fp[index].view(np.int64)), pa.array(rep[index])], ["anchor", "visits", "fp", "rep"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)] for batch in batches if batch.num_rows]
        if got:
            anchor, visits, fp, rep = (np.concatenate(x) for x in zip(*got))
            a, b = meet(anchor, visits, fp.view(np.uint64), rep, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    conf = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(conf, -(-prints.count() // TASK_PRINTS))
    dealt = prints.mapInArrow(deal, "anchor bigint, visits boolean, fp bigint, rep bigint").repartition(parts, "anchor")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, shingles 4 words with repeats (fewer words: the whole
    sequence); a bit is 1 if set in over half the shingles' XXH64 (seed 42).  Texts that are null or without words have
    fingerprint zero, which links like any other.  Fingerprints link at ``distance`` or fewer differing bits;
    component_id is the smallest non-null id reachable.  Rows with a null id are fingerprinted and get the component of
    their fingerprint, null if no row with an id shares it.  Repeated rows stay repeated; extra columns are ignored; an
    empty table gives no rows.  Equal fingerprints are merged before any comparison, and each task returns a spanning
    forest of its links, so a large group of near copies never becomes all its pairs.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min(F.col(id_col).cast("bigint")).alias("rep")), "prints")
    found = components(links(distinct.where("rep is not null"), distance))
    named = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
