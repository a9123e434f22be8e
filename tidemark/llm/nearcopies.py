"""Near copies by likeness: 512-bit SimHash of five-word shingles, compared at the anchors of many covering codes.

A 64-bit fingerprint at 4 differing bits finds few texts of Jaccard 0.8, which differ in about 15 of 100 bits.  Here a
fingerprint has 512 bits, and 48 samples of 22 of them each have their own covering code.  A fingerprint goes to every
anchor within the covering radius in each sample, and two that meet anywhere link if all 512 bits are alike enough.
Pairs that this leaves out are found by a prefix join on shingles, sieved by the parities of their shingles and compared
by their whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, lean, slices, utf8, written
from .simhash import SEED, forest, hamming, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 8
BITS = 64 * WORDS
SAMPLES = 48
#: A sample: 15 bits with a Hamming(15, 11) code, covering radius 1, and bits that must agree.
CODE, FREE = 15, 7
#: Standard errors of the 512-bit estimate that a pair may lie beyond the similarity asked for.
SLACK = 1.0
#: Groups up to this size are compared pair by pair; in larger ones only what is not yet connected is compared.
SMALL = 64
#: Fingerprints that a task compares, on average: 48 rows of about 90 bytes each.
TASK_PRINTS = 10_000
_RUN = 255  # shingles summed in one byte
#: Shingles of one in HEAVY_SHARE texts are counted; those that occur there HEAVY_LEAST times, HEAVY_MOST of them, come
#: last in every prefix.  Any order gives the same links, this one compares fewer texts.
HEAVY_SHARE, HEAVY_LEAST, HEAVY_MOST = 32, 3, 1 << 18
#: Shingles of prefixes that a task takes, on average: 32 bytes each.
TASK_SHINGLES = 250_000
#: Bits of a parity map for each shingle, at least.
PARITIES = 2
#: Ids up to which a list of texts to compare is broadcast (16 bytes each); a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000
EPS = 1e-9


def most_bits(similarity: float) -> int:
    """Differing bits up to which texts link: two sets of Jaccard j have the cosine 2j / (1 + j), their bits differ at the angle's share of pi."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(BITS * share + SLACK * np.sqrt(BITS * share * (1 - share)))


def _mixed(h: np.ndarray) -> np.ndarray:
    """WORDS hashes of each hash (rows, WORDS), by the SplitMix64 finaliser."""
    x = h[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The hashes of each row's different shingles, in order."""
    h, count = shingle_hashes(data, at, SHINGLE)
    edge = np.concatenate(([0], np.cumsum(count)))
    return [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def fingerprints_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, WORDS): a bit is 1 if set in over half of the text's different shingles; zero for a text without words."""
    return _fingerprints(shingle_sets(data, at))


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), WORDS), np.uint64)
    for k, own in enumerate(sets):
        if not len(own):
            continue
        ones = np.zeros(BITS, np.int64)
        for start in range(0, len(own), _RUN):
            bits = np.unpackbits(_mixed(own[start : start + _RUN]).view(np.uint8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint8)
        out[k] = np.packbits(ones * 2 > len(own), bitorder="little").view(np.uint64)
    return out


def _binary(fp: np.ndarray) -> pa.Array:
    raw = pa.py_buffer(np.ascontiguousarray(fp))
    return pa.Array.from_buffers(pa.binary(8 * WORDS), len(fp), [None, raw]).cast(pa.binary())


def _words(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(8 * WORDS))
    return np.frombuffer(fixed.buffers()[1], np.uint64).reshape(-1, WORDS)[fixed.offset : fixed.offset + len(fixed)]


def key_of(own: np.ndarray) -> int:
    """A signed 64-bit number that stands for a set of shingles."""
    return int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_of(own: np.ndarray, similarity: float, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first shingles of a set in an order that all sets share: two sets as similar as asked have one of them in common."""
    if len(heavy) and len(own):
        place = np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)
        own = own[np.argsort(np.where(heavy[place] == own, weight[place], 0), kind="stable")]
    return own[: len(own) - int(np.ceil(similarity * len(own) - EPS)) + 1 if len(own) else 0]


def parities_of(own: np.ndarray) -> bytes:
    """For each value of the lowest bits of a hash, whether an odd number of shingles has it; the size is a power of two."""
    size = 1 << max(6, (PARITIES * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def may_be_alike(x: pa.Array, y: pa.Array, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets with the parities x and y and n shingles together can be as similar as asked.

    Each parity that differs takes a shingle that only one of the two has, so no alike pair is left out.  The larger map
    is folded to the size of the smaller.
    """
    x, y = x.cast(pa.large_binary()), y.cast(pa.large_binary())
    data, at, size = [], [], []
    for column in (x, y):
        _, offsets, raw = column.buffers()
        edge = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data.append(np.frombuffer(raw, np.uint8)), at.append(edge[:-1]), size.append(np.diff(edge))
    apart = np.zeros(len(n), np.int64)
    for p, q in np.unique(np.stack(size, axis=1), axis=0):
        rows = np.flatnonzero((size[0] == p) & (size[1] == q))
        step = max(1, (1 << 20) // int(max(p, q)))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            maps = [d[a[part][:, None] + np.arange(width)] for d, a, width in zip(data, at, (p, q))]
            least = int(min(p, q))
            a, b = (np.bitwise_xor.reduce(m.reshape(len(part), -1, least), axis=1) for m in maps)
            apart[part] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (n - apart) * (1 + similarity) >= 2 * (similarity * n - EPS)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def heavy_shingles(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts in order, and how often a sample of the texts has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(*utf8(part.column("_text")))]).view(np.int64))], ["token"])

    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(HEAVY_SHARE)) == 0).select(F.col(text_col).cast("string").alias("_text"))
    counts = some.mapInArrow(lean(run), "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY_LEAST)
    got = counts.orderBy(F.desc("n"), "token").limit(HEAVY_MOST).toArrow()
    token, n = got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, fp, key, n, prefix, odd) for each row of docs: 64 bytes, and its set of shingles by number, size, prefix and parities."""
    kind = docs.schema[id_col].dataType.simpleString()
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(*utf8(part.column("_text")))
                keys, sizes = pa.array([key_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32())
                prefixes = _lists([prefix_of(x, similarity, *heavy.value) for x in sets])
                odd = pa.array([parities_of(x) for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_id"), _binary(_fingerprints(sets)), keys, sizes, prefixes, odd], ["_id", "fp", "key", "n", "prefix", "odd"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(lean(run), f"_id {kind}, fp binary, key bigint, n int, prefix array<bigint>, odd binary").withColumnRenamed("_id", id_col)


@cache
def samples() -> np.ndarray:
    """(SAMPLES, CODE + FREE) places of bits; places differ within a run of samples that fits the fingerprint."""
    width = CODE + FREE
    draw, each = np.random.default_rng(SEED), BITS // width
    runs = [draw.permutation(BITS)[: each * width].reshape(each, width) for _ in range(-(-SAMPLES // each))]
    return np.concatenate(runs)[:SAMPLES]


def anchors(fp: np.ndarray) -> np.ndarray:
    """(SAMPLES, rows): the anchor within the covering radius of each sample; the code is perfect, so it is one."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    nearest, _, _ = hamming()
    out = np.empty((SAMPLES, len(fp)), np.int32)
    for k, places in enumerate(samples()):
        seg = bits[:, places].astype(np.int32) @ (1 << np.arange(CODE + FREE, dtype=np.int32))
        out[k] = k << (CODE + FREE) | (seg >> CODE) << CODE | nearest[seg & ((1 << CODE) - 1)]
    return out


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _trees(fp: np.ndarray, most: int, cells: int = 1 << 17) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among fp: each connected fingerprint looks once among those not yet connected."""
    left, right = [], []
    rest = np.arange(len(fp))
    front: list[int] = []
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
            continue
        now, front = np.array(front[:SMALL]), front[SMALL:]
        got = []
        for k in range(0, len(rest), step := max(1, cells // len(now))):
            near = _differ(fp[now][:, None], fp[rest[k : k + step]][None]) <= most
            hit = near.any(axis=0)
            left.append(now[near.argmax(axis=0)[hit]])
            right.append(rest[k : k + step][hit])
            got.append(hit)
        front += np.concatenate([r for r in right[-len(got) :]]).tolist()
        rest = rest[~np.concatenate(got)]
    return left, right


def meet(anchor: np.ndarray, fp: np.ndarray, rep: np.ndarray, most: int, small: int = SMALL, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Compare the fingerprints of each anchor; returns, by rep, pairs that connect what the links connect."""
    order = np.argsort(anchor, kind="stable")
    anchor, fp, rep = anchor[order], fp[order], rep[order]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(first, len(anchor)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        found.append(forest(pair[:, 0], pair[:, 1]))

    within = np.arange(len(anchor)) - np.repeat(first, size)
    after = np.where(np.repeat(size, size) <= small, np.repeat(size, size) - within - 1, 0)
    at, work = 0, np.concatenate(([0], np.cumsum(after)))
    while at < len(after):
        end = max(at + 1, int(np.searchsorted(work, work[at] + cells, side="right")) - 1)
        n = after[at:end]
        left = np.repeat(np.arange(at, end), n)
        right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = _differ(fp[left], fp[right]) <= most
        if near.any():
            keep(rep[left[near]], rep[right[near]])
        at = end
    for k in np.flatnonzero(size > small):
        own = slice(first[k], first[k] + size[k])
        left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in _trees(fp[own], most))
        if len(left):
            keep(rep[own][left], rep[own][right])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def links(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """prints: (fp, rep), fingerprints distinct.  Returns (a, b): edges that connect the same reps as all links found."""
    most = most_bits(similarity)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                at = anchors(_words(part.column("fp"))).reshape(-1)
                index = pa.array(np.tile(np.arange(part.num_rows), SAMPLES))
                yield pa.RecordBatch.from_arrays([pa.array(at), part.column("fp").take(index), part.column("rep").take(index)], ["anchor", "fp", "rep"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("anchor").to_numpy(), _words(b.column("fp")), b.column("rep").to_numpy()) for b in batches if b.num_rows]
        columns = [np.concatenate(x) for x in zip(*got)]
        del got  # or Arrow holds the rows a second time
        if columns:
            a, b = meet(*columns, most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    conf = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(conf, -(-prints.count() // TASK_PRINTS))
    dealt = prints.mapInArrow(lean(deal), "anchor int, fp binary, rep bigint").repartition(parts, "anchor")
    return dealt.mapInArrow(lean(compare), "a bigint, b bigint").distinct()


def candidates(token: np.ndarray, key: np.ndarray, component: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float, cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of sets that share a token, are in different components and whose sizes and places allow the similarity.

    at: the token's place in the set's order.  Where it is the first that two sets share, no more than what follows it
    is common to both.  Yields key, component, key, component of pairs; a pair may come for more than one token.
    """
    order = np.lexsort((component, token))
    token, key, component, n, at = (x[order] for x in (token, key, component, n, at))
    size = len(token)
    new = np.concatenate(([True], token[1:] != token[:-1])) if size else np.zeros(0, bool)
    run = new | np.concatenate(([True], component[1:] != component[:-1])) if size else new

    def ends(starts: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(starts)
        last = np.append(first[1:], size)
        return np.repeat(last, last - first)

    after = ends(run)
    count = ends(new) - after
    rows = np.flatnonzero(count)
    work = np.concatenate(([0], np.cumsum(count[rows])))
    start = 0
    while start < len(rows):
        end = max(start + 1, int(np.searchsorted(work, work[start] + cells, side="right")) - 1)
        own = rows[start:end]
        c = count[own]
        left = np.repeat(own, c)
        right = np.repeat(after[own], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        most = np.minimum(n[left] - at[left], n[right] - at[right])
        fits = most * (1 + similarity) >= similarity * (n[left].astype(np.int64) + n[right]) - EPS
        left, right = left[fits], right[fits]
        if len(left):
            yield key[left], component[left], key[right], component[right]
        start = end


def sieved(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, ca, b, cb) without those whose parities tell that they are less similar than asked."""
    names = ["a", "ca", "b", "cb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
                yield batch.select(names).filter(pa.array(may_be_alike(batch.column("x"), batch.column("y"), n, similarity)))

    maps = prints.where("n > 0").select("key", "n", "odd").dropDuplicates(["key"])
    x, y = maps.select(F.col("key").alias("a"), "n", F.col("odd").alias("x")), maps.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("odd").alias("y"))
    return pairs.join(x, "a").join(y, "b").select(*names, "n", "x", "m", "y").mapInArrow(lean(run), "a bigint, ca bigint, b bigint, cb bigint")


def left_out(docs: DataFrame, prints: DataFrame, named: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """prints: rows of ``fingerprints``; named: their fp with its component.  Returns (a, b): components that hold texts of Jaccard ``similarity`` or more.

    Exact but for equal hashes of 64 bits: texts of different components that share a shingle of their prefixes are
    compared by all their shingles, unless their parities tell that they are too different.
    """
    spark = prints.sparkSession
    prints = prints.withColumn(id_col, F.col(id_col).cast("bigint")).where(F.col(id_col).isNotNull() & (F.col("n") > 0))
    known = prints.select(id_col, "fp", "key", "n").join(named.where("component_id is not null"), "fp")
    # equal sets have equal fingerprints, so they are in one component
    reps = written(known.groupBy("key").agg(F.min(id_col).alias(id_col), F.min("component_id").alias("component_id"), F.min("n").alias("n")), "reps")
    dealt = prints.select("key", id_col, "n", "prefix").join(reps.drop("n"), ["key", id_col]).select("key", "component_id", "n", F.posexplode("prefix").alias("at", "token"))
    total = reps.agg(F.sum(F.col("n") * (1 - similarity) + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_SHINGLES))
    names = ["a", "ca", "b", "cb"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in ("token", "key", "component_id", "n", "at")] for b in batches if b.num_rows]
        columns = [np.concatenate(x) for x in zip(*got)]
        del got  # or Arrow holds the rows a second time
        for a, ca, b, cb in candidates(*columns, similarity) if columns else ():
            swap = a > b
            columns = [np.where(swap, y, x) for x, y in ((a, b), (ca, cb), (b, a), (cb, ca))]
            yield pa.Table.from_arrays([pa.array(c) for c in columns], names).group_by(names, use_threads=False).aggregate([]).combine_chunks().to_batches()[0].select(names)

    found = written(dealt.repartition(parts, "token").mapInArrow(lean(pair), "a bigint, ca bigint, b bigint, cb bigint").distinct(), "pairs")
    pairs = written(sieved(found, prints, similarity), "pairs", instead=found)
    nodes = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(*utf8(part.column("_text")))
                yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in sets], pa.int64()), _lists(sets)], ["key", "shingles"])

    asked = written(reps.join(nodes, "key").select(F.col(id_col).alias("_id")).distinct(), "asked")
    few = asked.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(asked) if few else asked, "_id", "left_semi")
    sets = written(texts.select("_text").mapInArrow(lean(whole), "key bigint, shingles array<bigint>"), "sets")
    own = sets.dropDuplicates(["key"])
    x, y = own.select(F.col("key").alias("a"), F.col("shingles").alias("x")), own.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = both * (1 + similarity) >= similarity * (F.size("x") + F.size("y")) - EPS
    out = written(pairs.join(x, "a").join(y, "b").where(alike).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "alike")
    for done in (reps, pairs, asked, sets):
        discard(done)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs; texts of Jaccard ``similarity`` or more link.

    Words and lower case as in ``simhash``; shingles are the different runs of five words (fewer words: the whole
    sequence).  Texts link by an estimate from 512 bits, so a pair somewhat below the limit may link; pairs at or above
    it that the estimate leaves out link by ``left_out``.  Texts that are null or without words are copies of each
    other.  component_id is the smallest non-null id reachable.  Rows with a null id are fingerprinted and get the
    component of their fingerprint, null if no row with an id shares it.  Repeated rows stay repeated; extra columns are
    ignored; an empty table gives no rows.  Equal fingerprints are merged before any comparison and each task returns a
    forest, so a large group never becomes all its pairs.
    """
    prints = written(fingerprints(docs, id_col, text_col, similarity), "copies")
    distinct = written(prints.groupBy("fp").agg(F.min(F.col(id_col).cast("bigint")).alias("rep")), "prints")
    found = components(links(distinct.where("rep is not null"), similarity))
    named = written(distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    more = components(left_out(docs, prints, named, id_col, text_col, similarity))
    named = named.join(more, named.component_id == more.node, "left").select("fp", F.coalesce("component", "component_id").alias("component_id"))
    return prints.join(named, "fp").select(id_col, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
