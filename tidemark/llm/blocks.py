"""Blocks of documents in sequential external files, and questions from blocks to ranges of hashes and back.

A block holds some 8 MB of whole texts in one file of the shared folder.  A pass over the blocks is a Spark job with a
row for each block; its task reads the block's file.  What blocks must find out about each other travels as packed
arrays: a block sends each range of hashes the hashes that it has there, each once however many rows share it, so a hot
value costs a range one entry for each block and not one for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, scratch, utf8, written
from .textkernel import U64
from .tokenstore import Attempt, open_store

#: Bytes of text in a block (a longer text stands alone), and hashes of one range, on average.
BLOCK_BYTES = 8 << 20
RANGE_HASHES = 1 << 20
#: Stands for a null id: after every other.
NULL_ID = np.iinfo(np.int64).max

_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed byte string."""
    raw = b"".join([np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], "<i8").tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return np.array([len(raw)], "<i8").tobytes() + _ZSTD.compress(raw, asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, "<i8", 1)[0])
    raw = _ZSTD.decompress(blob[8:], decompressed_size=size, asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    kinds = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, length in kinds.tolist():
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, dtype, length, at))
        at += length * dtype.itemsize
    return out


class Blocks:
    """The block files of a table; ``table`` has a row (block, rows, bytes, true) for each of them.

    true: how many rows each flag holds in, in the order of the flags.
    """

    def __init__(self, spark: SparkSession, path: str, table: DataFrame) -> None:
        self.spark, self.path, self.table = spark, path, table
        got = table.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
        self.count, self.bytes = got.n, got.b or 0

    def parts(self, least: int = 1) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.count, least)

    def each(self, work: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str, answers: DataFrame | None = None) -> DataFrame:
        """Run work(block, payloads) once for each block; payloads: those of ``answers`` (block, place, payload) in order of place."""
        rows = self.table.select("block", F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("payload"))
        if answers is not None:
            rows = rows.unionByName(answers.select("block", "place", "payload"))
        dealt = rows.repartition(self.parts(), "block").sortWithinPartitions("block", "place")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, got = None, []
            for batch in batches:
                for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                    if block != now:
                        if now is not None:
                            yield from work(now, got)
                        now, got = block, []
                    if payload is not None:
                        got.append(payload)
            if now is not None:
                yield from work(now, got)

        return dealt.mapInArrow(lean(run), schema)


def write_blocks(docs: DataFrame, id_col: str, text_col: str, flags: dict[str, str] | None = None, keep: dict[str, str] | None = None) -> Blocks:
    """Write docs (null ids: after all others; null texts: empty) as blocks; flags: boolean columns by
    SQL (null: false); keep: further columns by SQL."""
    spark = docs.sparkSession
    path = scratch(spark, "blocks")
    names, kept = list(flags or {}), [*(flags or {}), *(keep or {})]
    picked = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NULL_ID))).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.coalesce(F.expr(sql), F.lit(False)).alias(k) for k, sql in (flags or {}).items()], *[F.expr(sql).alias(k) for k, sql in (keep or {}).items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 24
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            file = Attempt(path, f"block-{seq}.arrow")
            with pa.ipc.new_file(file.out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            file.close()
            true = [pc.sum(table[k]).as_py() or 0 for k in names]
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([size], pa.int64()), pa.array([true], pa.list_(pa.int64()))], ["block", "rows", "bytes", "true"])

        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            batch = pa.RecordBatch.from_arrays([batch.column("id"), text, *[batch.column(k) for k in kept]], ["id", "text", *kept])
            _, at = utf8(text)
            start = 0
            while start < batch.num_rows:
                end = int(np.searchsorted(at, at[start] + BLOCK_BYTES - size, side="right")) - 1
                if end <= start and held:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
                    continue
                end = max(end, start + 1)
                held.append(batch.slice(start, end - start))
                size += int(at[end] - at[start])
                start = end
        if held:
            yield flush()

    return Blocks(spark, path, written(picked.mapInArrow(lean(run), "block bigint, rows bigint, bytes bigint, true array<bigint>"), "blocks"))


def load(path: str, block: int) -> pa.RecordBatch:
    """A block's rows (id, text, flags)."""
    store, folder = open_store(path)
    with store.open_input_file(f"{folder}/block-{block}.arrow") as f:
        return pa.ipc.open_file(f).read_all().combine_chunks().to_batches()[0]


def range_edges(hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """hashes ascending -> (range, from, to) for each of the equally wide ranges of the hash space that has any."""
    width = ((1 << 64) - 1) // ranges + 1
    edge = np.searchsorted(hashes, np.array([k * width for k in range(1, ranges)], U64))
    edge = np.concatenate(([0], edge, [len(hashes)]))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        yield k, int(edge[k]), int(edge[k + 1])


def questions(block: int, hashes: np.ndarray, ranges: int, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """hashes ascending and distinct -> a row (place, block, payload) for each range that the block has hashes in."""
    for place, lo, hi in range_edges(hashes, ranges):
        blob = packed(hashes[lo:hi], *[v[lo:hi] for v in values])
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([block]), pa.array([blob], pa.binary())], ["place", "block", "payload"])


QUESTION = "place bigint, block bigint, payload binary"


def ranges_for(hashes: int, spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hashes // RANGE_HASHES))


def answered(asked: DataFrame, ranges: int, answer: Callable[[np.ndarray, np.ndarray, list[list[np.ndarray]]], list[np.ndarray]]) -> DataFrame:
    """Each range looks at all that was asked of it.

    answer(hashes, which, values): all hashes of a range, distinct and ascending; ``which`` gives for the blocks'
    entries, end to end, their place in hashes; values: the blocks' value arrays end to end.  It returns arrays over
    hashes; every block gets them back at its own hashes, in its order: rows (block, place, payload).
    """
    dealt = asked.repartition(ranges, "place").sortWithinPartitions("place", "block")

    def emit(place: int, blocks: list[int], blobs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, which = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        values = [np.concatenate([b[k] for b in blobs]) for k in range(1, len(blobs[0]))]
        out = answer(hashes, which, values)
        edge = np.concatenate(([0], np.cumsum([len(b[0]) for b in blobs])))
        for k in range(0, len(blocks), 64):
            payload = [packed(*[a[which[edge[j] : edge[j + 1]]] for a in out]) for j in range(k, min(k + 64, len(blocks)))]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[k : k + 64], pa.int64()), pa.array([place] * len(payload), pa.int64()), pa.array(payload, pa.binary())], ["block", "place", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, blobs = None, [], []
        for batch in batches:
            for place, block, payload in zip(*(batch.column(k).to_pylist() for k in ("place", "block", "payload"))):
                if place != now:
                    if blobs:
                        yield from emit(now, blocks, blobs)
                    now, blocks, blobs = place, [], []
                blocks.append(block)
                blobs.append(unpacked(payload))
        if blobs:
            yield from emit(now, blocks, blobs)

    return dealt.mapInArrow(lean(run), "block bigint, place bigint, payload binary")
