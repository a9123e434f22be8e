"""Operator 4: document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .textkernel import U64, mix, shingle_hashes, span_hashes, word_spans

SHINGLE = 5
BINS = 512
BITS = 4


@cache
def _donors(bins: int, tries: int) -> np.ndarray:
    """donor[t, b]: the bin that empty bin b asks at its t-th try; the same for every document."""
    t, b = np.meshgrid(np.arange(tries, dtype=U64), np.arange(bins, dtype=U64), indexing="ij")
    return (mix(mix(b + U64(0x1234567)) + t) % U64(bins)).astype(np.int32)


#: Bytes of text in a range, ranges at most, and rows sampled for each bound.
RANGE_BYTES = 64 << 20
MOST_RANGES = 20_000
SAMPLED = 20


def densify(low: np.ndarray, empty: np.ndarray, tries: int = 64) -> np.ndarray:
    """Fill empty bins, in place: each asks bins in an order that a hash of the bin and the try gives, and copies from
    the first that was not empty.  Rows without any full bin stay as they are."""
    bins = low.shape[1]
    left = empty.copy()
    left[empty.all(axis=1)] = False
    at = 0
    while left.any():
        donor = _donors(bins, at + tries)
        for t in range(at, at + tries):
            rows = np.flatnonzero(left.any(axis=1))
            if not len(rows):
                break
            ask = donor[t]
            fill = left[rows] & ~empty[rows][:, ask]
            r, b = np.nonzero(fill)
            low[rows[r], b] = low[rows[r], ask[b]]
            left[rows[r], b] = False
        at += tries
        tries *= 2
    return low


def bins_of(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(low-order bits of each bin's least shingle hash, whether a row has any shingle).

    One hash for each shingle: its high bits choose the bin, the rest is its value there.
    """
    rows = len(at) - 1
    start, end, row = word_spans(data, at)
    h, row = shingle_hashes(span_hashes(data, start, end), row, rows, shingle)
    shift = U64(64 - bins.bit_length() + 1)
    top = np.iinfo(np.uint64).max
    least = np.full(rows * bins, top, U64)
    np.minimum.at(least, row * bins + (h >> shift).astype(np.int64), mix(h) >> U64(1))
    least = least.reshape(rows, bins)
    empty = least == top
    return densify(least, empty), ~empty.all(axis=1)


def pack(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The lowest ``bits`` of every bin, packed; a text without words has the empty fingerprint.

    Each bin mixes its own number into the value first, so bins that hold one copied value stay independent."""
    low = mix(low + np.arange(low.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15))
    b = np.unpackbits((low & U64((1 << bits) - 1)).astype(np.uint8)[:, :, None], axis=2, bitorder="little")[:, :, :bits]
    packed = np.packbits(b.reshape(len(low), -1), axis=1, bitorder="little")
    return [x.tobytes() if s else b"" for x, s in zip(packed, some)]


def likeness(a: list[bytes], b: list[bytes], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard likeness of fingerprints: the share of equal bins, corrected for chance agreement of ``bits``
    low-order bits.  Two empty fingerprints are alike, an empty and another not at all."""
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(a, b)])
    both = [k for k, (x, y) in enumerate(zip(a, b)) if x and y and x != y]
    if both:
        x, y = (np.unpackbits(np.frombuffer(b"".join(s[k] for k in both), np.uint8).reshape(len(both), -1), axis=1, bitorder="little").reshape(len(both), bins, bits) for s in (a, b))
        same = (x == y).all(axis=2).mean(axis=1)
        chance = 2.0**-bits
        out[both] = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return out


def fingerprints_of(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    return pack(*bins_of(data, at))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint): hex digits of the packed bins of every row's whole text.

    Shingles are 5 words (fewer words: the whole sequence).  Null and empty texts and texts without words have the
    empty fingerprint; equal texts have equal ones.  Ids may be null or repeated; extra columns are ignored; an empty
    table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                prints = fingerprints_of(*utf8(part.column("_text")))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([p.hex() for p in prints], pa.string())], ["_id", "fingerprint"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, f"_id {kind}, fingerprint string").withColumnRenamed("_id", id_col)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of an edited text, and their likeness.

    The next document is the one before in id order (descending ids; after the last: the first; rows of one id follow
    by text; null ids come last).  The edited text is the text with its last floor(n/2) code points replaced by the
    first as many, or all, of the next one.  Returns (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for every row; null texts count as empty; an empty table gives no rows.

    Rows are dealt to ordered ranges of (id, text) by sampled bounds; the first row of each range is also sent to the
    range before, so every range has its last row's next document and no row needs a global order.  Rows equal in both
    stay in one range, whose task takes them one batch at a time.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # descending order; ties by a hash of the text, then the text
    key = base.withColumn("k", F.coalesce(F.bitwise_not(F.col("id").cast("bigint")), F.lit((1 << 63) - 1))).withColumn("t", F.xxhash64("text"))
    total = key.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = parts or min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.b or 0) // RANGE_BYTES)), MOST_RANGES)
    # ranges by (id, text's hash) from a bounded sample of rows, so that null and repeated ids are split as well
    share = min(1.0, SAMPLED * parts / max(total.n, 1))
    sample = sorted((r.k, r.t) for r in key.where(F.pmod(F.xxhash64("k", "t", F.lit("range")), F.lit(1 << 30)) < int(share * (1 << 30))).select("k", "t").limit(4 * SAMPLED * parts).collect())
    bounds = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    if bounds:
        # two steps of about the square root: which group of bounds, and where in it
        side = max(1, int(len(bounds) ** 0.5))
        groups = [bounds[k : k + side] for k in range(0, len(bounds), side)]
        pair = lambda b: F.struct(F.lit(b[0]).cast("bigint").alias("k"), F.lit(b[1]).cast("bigint").alias("t"))
        mine = F.struct("k", "t")
        coarse = F.size(F.filter(F.array(*[pair(g[0]) for g in groups]), lambda b: b <= mine))
        fine = F.array(*[F.array(*[pair(b) for b in g]) for g in groups])
        inside = F.size(F.filter(F.element_at(fine, F.col("coarse")), lambda b: b <= mine))
        placed = key.withColumn("coarse", coarse).withColumn("part", F.when(F.col("coarse") == 0, 0).otherwise((F.col("coarse") - 1) * side + inside)).drop("coarse")
    else:
        placed = key.withColumn("part", F.lit(0))
    heads = sorted((r.part, r.head) for r in placed.groupBy("part").agg(F.min(F.struct("k", "t")).alias("head")).collect())
    if not heads:
        schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    before = {p: heads[k - 1][0] for k, (p, _) in enumerate(heads)}  # the range before; before the first: the last
    ends = spark.createDataFrame([(p, h.k, h.t, before[p]) for p, h in heads], "hp int, hk bigint, ht bigint, goes int")
    first = placed.join(F.broadcast(ends), (F.col("part") == F.col("hp")) & (F.col("k") == F.col("hk")) & (F.col("t") == F.col("ht"))).select("id", "text", "k", "t", F.col("goes").alias("part")).dropDuplicates(["part"])
    dealt = placed.withColumn("halo", F.lit(False)).unionByName(first.select("id", "text", "k", "t", "part").withColumn("halo", F.lit(True)))
    dealt = dealt.repartition(max(parts, len(heads)), "part").sortWithinPartitions("part", "halo", "k", "t", "text").select("id", "text", "part", "halo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, which waits for the next one
        for batch in batches:
            for piece in slices(batch, "text"):
                both = piece if held is None else pa.Table.from_batches([held, piece]).combine_chunks().to_batches()[0]
                yield from emit(both)
                held = both.slice(both.num_rows - 1)

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Every row but the last one, with the row after it as its next document."""
        part, halo = batch.column("part").to_numpy(), batch.column("halo").to_numpy(zero_copy_only=False)
        own = np.flatnonzero(~halo[:-1] & (part[:-1] == part[1:]))
        if not len(own):
            return
        texts = batch.column("text").to_pylist()
        edited = [(t := texts[k])[: len(t) - len(t) // 2] + texts[k + 1][: len(t) // 2] for k in own]
        prints = fingerprints_of(*utf8(batch.column("text")))
        other = fingerprints_of(*utf8(pa.array(edited, pa.large_string())))
        mine, following = [prints[k] for k in own], [prints[k + 1] for k in own]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(own)),
                pa.array([len(texts[k]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
                pa.array([p.hex() for p in mine], pa.string()),
                pa.array([p.hex() for p in other], pa.string()),
                pa.array(likeness(mine, other)),
                pa.array(likeness(mine, following)),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
