"""Operator 1: token ids in binary shards with a minimal perfect hash index over document keys.

Layout under one folder (``path``), all integers little-endian:

* ``shard-NNNNNN.ids``  - the ids of the shard's documents one after another, raw, 2 bytes each where the vocabulary
  has at most 65,536 ids and 4 bytes otherwise; shards and the documents in them ascend by key;
* ``index-NNNNNN.mph``  - one file for each bucket of key hashes: a minimal perfect hash (pilots) and, slot by slot,
  a 32-bit fingerprint of the key, the shard, the first id's place in the shard and the number of ids.

A key is (id, copy): copy counts rows with the same id from 0.  A lookup hashes the key to a bucket, takes one pilot,
computes one slot, compares the fingerprint and reads one range of one shard.  Files are written under a name of the
attempt and then renamed, so a task that runs twice leaves one file with the same bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import encoder
from .common import scratch, slices, written
from .textkernel import U64, mix

#: Bytes of text for one shard, and keys for one index bucket.
SHARD_BYTES = 64 << 20
BUCKET_KEYS = 20_000  # at most, on average
#: Bytes of text encoded and written at a time (a longer text goes alone).
WRITTEN = 4 << 20
#: Shards at most: tables with a row for each shard are broadcast or numbered in one task, so their size has this bound.
MOST_SHARDS = 200_000


# --- files -------------------------------------------------------------------------------------------------------


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path behind a URI such as file:///x, hdfs://h/x or s3://b/x."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Attempt:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str, name: str) -> None:
        self.fs, folder = open_store(path)
        self.fs.create_dir(folder, recursive=True)
        self.name, self.temp = f"{folder}/{name}", f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.temp, self.name)
        except OSError:  # a file system that moves onto no existing name: an earlier attempt's file makes room
            self.fs.delete_file(self.name)
            self.fs.move(self.temp, self.name)


# --- minimal perfect hash ----------------------------------------------------------------------------------------


def key_hash(key: np.ndarray, copy: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hash of (id, copy); a null id hashes apart from every number."""
    h = mix(key.astype(np.int64).view(U64) ^ U64(0x5851F42D4C957F2D))
    return mix(h + copy.astype(U64) * U64(0x9E3779B97F4A7C15) + null.astype(U64) * U64(0xD1342543DE82EF95))


def _slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ mix(pilot.astype(U64) + U64(1))) % U64(max(n, 1))).astype(np.int64)


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    return ((h >> U64(32)) % U64(max(groups, 1))).astype(np.int64)


def build_pilots(h: np.ndarray, per_group: float = 3.0) -> np.ndarray:
    """Hash and displace: keys fall into groups; from the largest group on, the first pilot that sends all its keys to
    free slots of [0, n) is kept.  h must be distinct."""
    n = len(h)
    groups = max(1, int(np.ceil(n / per_group)))
    own = _group(h, groups)
    order = np.argsort(own, kind="stable")
    size = np.bincount(own, minlength=groups)
    edge = np.concatenate(([0], np.cumsum(size)))
    pilots = np.zeros(groups, np.uint32)
    taken = np.zeros(n, bool)
    for g in np.argsort(-size, kind="stable"):
        if not size[g]:
            break
        keys = h[order[edge[g] : edge[g + 1]]]
        start, step = 0, 16
        while True:
            tries = np.arange(start, start + step, dtype=np.uint32)
            at = _slot(keys[None, :], tries[:, None], n)
            good = ~taken[at].any(axis=1)
            if size[g] > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                pilots[g] = tries[hit[0]]
                taken[at[hit[0]]] = True
                break
            start, step = start + step, min(step * 2, 1 << 14)
    return pilots


SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("ids", "<u8")])


def index_bytes(h: np.ndarray, shard: np.ndarray, first: np.ndarray, ids: np.ndarray) -> bytes:
    pilots = build_pilots(h)
    at = _slot(h, pilots[_group(h, len(pilots))], len(h))
    slots = np.zeros(len(h), SLOT)
    slots["print"][at] = h.astype(np.uint32)
    slots["shard"][at], slots["first"][at], slots["ids"][at] = shard, first, ids
    return np.array([len(h), len(pilots)], "<u8").tobytes() + pilots.astype("<u4").tobytes() + slots.tobytes()


def look_up(raw: bytes, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot rows, found) for key hashes; found is whether the stored fingerprint agrees."""
    n, groups = np.frombuffer(raw, "<u8", 2).astype(int)
    pilots = np.frombuffer(raw, "<u4", groups, 16)
    slots = np.frombuffer(raw, SLOT, n, 16 + 4 * groups)
    if not n:
        return np.zeros(len(h), SLOT), np.zeros(len(h), bool)
    got = slots[_slot(h, pilots[_group(h, groups)], n)]
    return got, got["print"] == h.astype(np.uint32)


# --- the store ---------------------------------------------------------------------------------------------------


class TokenStore:
    """A folder of shards and index files; made by ``write``."""

    def __init__(self, spark: SparkSession, path: str, dtype: str, buckets: int, places: DataFrame) -> None:
        self.spark, self.path, self.dtype, self.buckets, self.places = spark, path, np.dtype(dtype), buckets, places

    def lookup(self, keys: DataFrame, id_col: str = "id", copy_col: str = "copy") -> DataFrame:
        """keys -> (id, copy, shard, first, n_tokens): where each key's ids lie; keys that the index lacks give no row."""
        path, kind = self.path, keys.schema[id_col].dataType.simpleString()

        def find(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = open_store(path)
            held: dict[int, bytes] = {}  # rows come bucket by bucket
            for batch in frames:
                bucket, h = batch.column("bucket").to_numpy(), batch.column("h").to_numpy().view(U64)
                for b in np.unique(bucket):
                    if b not in held:
                        held = {b: store.open_input_file(f"{folder}/index-{b:06d}.mph").read()}
                    mine = np.flatnonzero(bucket == b)
                    got, found = look_up(held[b], h[mine])
                    mine, got = mine[found], got[found]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(mine)), batch.column("copy").take(pa.array(mine)), pa.array(got["shard"].astype(np.int32)), pa.array(got["first"].astype(np.int64)), pa.array(got["ids"].astype(np.int64))], ["id", "copy", "shard", "first", "n_tokens"])

        dealt = _hashed(keys.select(F.col(id_col).alias("id"), F.col(copy_col).cast("bigint").alias("copy")), self.buckets)
        dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(find, f"id {kind}, copy bigint, shard int, first bigint, n_tokens bigint")

    def read(self, places: DataFrame) -> DataFrame:
        """(id, copy, shard, first, n_tokens) -> the same with the ids read from the shards, as bytes (payload)."""
        path, width = self.path, self.dtype.itemsize

        def load(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = open_store(path)
            held = (-1, None)
            for batch in frames:
                shard, first, n = (batch.column(k).to_numpy() for k in ("shard", "first", "n_tokens"))
                for k in range(0, len(n), 256):
                    payload = []
                    for s, f, m in zip(shard[k : k + 256].tolist(), first[k : k + 256].tolist(), n[k : k + 256].tolist()):
                        if held[0] != s:
                            held = (s, store.open_input_file(f"{folder}/shard-{s:06d}.ids"))
                        payload.append(held[1].read_at(m * width, f * width))
                    part = batch.slice(k, 256)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary())], [*part.schema.names, "payload"])

        schema = places.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
        return places.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(load, f"{schema}, payload binary")


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """id, copy, ... -> the same with h and its bucket."""
    schema = keys.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            null = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            h = key_hash(pc.fill_null(batch.column("id").cast(pa.int64()), 0).to_numpy(), batch.column("copy").to_numpy(), null)
            bucket = (mix(h) % U64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64)), pa.array(bucket)], [*batch.schema.names, "h", "bucket"])

    return keys.mapInArrow(run, f"{schema}, h bigint, bucket int")


def write(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> TokenStore:
    """Encode every row's whole text (null: empty) and write shards and index in ascending order of id_col.

    id_col is an integer column; null ids come first.  Rows with the same id are told apart by copy (0, 1, ...), in
    order of their text's hash; rows equal in both are interchangeable.  ``end_id`` follows each document.  An empty
    table gives an empty store; extra columns are ignored.  vocabulary: a tokenizer file readable on every executor.
    shards: number of shards, from the data's size if None.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    width = encoder(vocabulary).dtype.str
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = picked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    shards = shards or min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.b or 0) // SHARD_BYTES)), MOST_SHARDS)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.n // BUCKET_KEYS))

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(vocabulary)
        out, at, last, copy = None, 0, object(), 0
        for batch in frames:
            if out is None and batch.num_rows:
                out = Attempt(path, f"shard-{shard:06d}.ids")
            for part in slices(batch, "text", WRITTEN):
                ids, count = enc.encode(part.column("text"))
                count += 1  # the end id
                stop = np.cumsum(count)
                every = np.full(len(ids) + len(count), end_id, enc.dtype)
                inside = np.ones(len(every), bool)
                inside[stop - 1] = False
                every[inside] = ids
                out.out.write(every.tobytes())
                copies = np.empty(len(count), np.int64)
                for k, i in enumerate(part.column("id").to_pylist()):
                    copy = copy + 1 if i == last else 0
                    last, copies[k] = i, copy
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(copies), pa.array(np.full(len(count), shard, np.int32)), pa.array(at + stop - count), pa.array(count)], ["id", "copy", "shard", "first", "n_tokens"])
                at += int(stop[-1])
        if out is not None:
            out.close()

    tied = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = picked.repartitionByRange(shards, *tied).sortWithinPartitions(*tied)
    places = written(ordered.mapInArrow(encode, "id bigint, copy bigint, shard int, first bigint, n_tokens bigint"), "places")
    # an id may run over from one shard to the next: its copies go on from there
    edges = places.groupBy("shard").agg(F.min_by("id", "first").alias("low"), F.max_by("id", "first").alias("high"), F.count("*").alias("rows"))
    crossing = [(r.shard, r.low) for r in _carried(edges)]
    if crossing:
        spots = spark.createDataFrame(crossing, "shard int, low bigint")
        counts = places.join(F.broadcast(spots.select("low").distinct()), F.col("id").eqNullSafe(F.col("low"))).groupBy("id", "shard").agg(F.count("*").alias("n"))
        before = counts.select(F.col("id").alias("low"), F.col("shard").alias("s"), (F.sum("n").over(Window.partitionBy("id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
        places = written(places.join(F.broadcast(before), F.col("id").eqNullSafe(F.col("low")) & (F.col("shard") == F.col("s")), "left").select("id", (F.col("copy") + F.coalesce("before", F.lit(0))).alias("copy"), "shard", "first", "n_tokens"), "places")

    def build(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in frames if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by("bucket")
        bucket = t["bucket"].to_numpy()
        for b in np.unique(bucket):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            part = t.slice(lo, hi - lo)
            raw = index_bytes(part["h"].to_numpy().view(U64), part["shard"].to_numpy(), part["first"].to_numpy(), part["n_tokens"].to_numpy())
            file = Attempt(path, f"index-{b:06d}.mph")
            file.out.write(raw)
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([hi - lo], pa.int64())], ["bucket", "keys"])

    written(_hashed(places, buckets).repartition("bucket").mapInArrow(build, "bucket int, keys bigint"), "index")
    return TokenStore(spark, path, width, buckets, places)


def _carried(edges: DataFrame) -> list:
    """Shards whose first id is also the last id of the shard before: a few rows at most for each shard."""
    w = Window.orderBy("shard")
    before = F.lag("high").over(w)
    return edges.withColumn("goes_on", (F.lag("rows").over(w).isNotNull()) & before.eqNullSafe(F.col("low"))).where("goes_on").collect()


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store of docs, look every key up through the index and read its ids back from the shards.

    Returns (id_col, start, n_tokens, ids_crc32): start counts the ids of all documents before, n_tokens includes the
    end id, ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    store = write(docs, vocabulary, id_col=id_col, text_col=text_col)
    spark, dtype = store.spark, store.dtype
    width = dtype.itemsize
    shards = store.places.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def crc(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            got = batch.column("payload").to_pylist()
            n = [len(x) // width for x in got]
            c = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in got]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("shard"), batch.column("first"), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["id", "shard", "first", "n_tokens", "ids_crc32"])

    found = store.lookup(store.places.select("id", "copy"))
    read = store.read(found).mapInArrow(crc, "id bigint, shard int, first bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(F.broadcast(base), "shard").select(F.col("id").alias(id_col), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
