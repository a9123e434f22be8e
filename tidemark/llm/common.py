"""What the operators share: written scratch tables, Arrow text batches and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python: texts are long, so batches are kept short.
ARROW_ROWS = 1000


#: The ``remembered`` functions of this process.
_REMEMBERED: list[Callable] = []


def remembered(make: Callable) -> Callable:
    """make, with its results kept in a Python worker until a ``lean`` task begins that doesn't use them."""
    kept = cache(make)
    _REMEMBERED.append(kept)
    return kept


def forget(but: Callable | None = None) -> None:
    """Drop what ``remembered`` functions keep, but for one of them."""
    held = [kept for kept in _REMEMBERED if kept is not but and kept.cache_info().currsize]
    for kept in held:
        kept.cache_clear()
    if held:
        gc.collect()


def give_back() -> None:
    """Return freed memory to the system; Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow; its task leaves no more in the Python worker than what the ``remembered`` function it uses keeps.

    Spark uses a worker for one task after another, of any operator, beside an executor that has taken its whole heap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(but=uses)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, one process gets a temporary folder; on a cluster that is an error, as executors would each write
    to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there and lost executors cost nothing.

    instead: a scratch table that the new one supersedes; its files go.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if instead is not None:
        discard(instead)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    path = df.__dict__.get("scratch_path")
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each (a longer text stands alone), so arrays stay in cache."""
    _, at = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    Returns (node, component) for every node of an edge; component is the smallest node reachable.  Each round is two
    grouped minima and two joins on the node, written to the shared folder; about log(diameter) rounds are needed.
    """
    spark = edges.sparkSession
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    stamp = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == stamp or not seen.n:
            break
        stamp = (seen.n, seen.h)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # after the large star every edge points down, so the small star groups by the upper end
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", instead=now)
    own = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())
