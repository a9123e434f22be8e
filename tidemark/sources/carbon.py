"""The carbon pickle protocol: frames of a 4-byte big-endian length and a pickled list of (path, (seconds, value))."""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterable, Iterator
from decimal import Decimal
from io import BytesIO
from numbers import Real

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a frame at most, its length included.
MOST = (1 << 20) + 4


class _Plain(pickle.Unpickler):
    """Reads lists, tuples, numbers and strings, and no classes at all."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} is not a plain value")


def pickled(points: Iterable[tuple[str, int, float]]) -> bytes:
    """Metrics (path, epoch seconds, value) as one frame; values travel as text, white space in names as hyphens."""
    body = pickle.dumps([("-".join(p.split()), (int(s), str(float(v)))) for p, s, v in points], protocol=0)
    return struct.pack(">I", len(body)) + body


def frames(data: bytes) -> Iterator[bytes]:
    """Bodies of the frames in data.  A cut or overlong frame ends it: no later frame's start is known."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if n + 4 > MOST or at + 4 + n > len(data):
            return
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def _number(x) -> float:
    if isinstance(x, bool) or not isinstance(x, (Real, Decimal, str)):
        raise ValueError(f"{x!r} is not a number")
    return float(x)


def points_of(body: bytes) -> list[tuple[str, int, float]]:
    """(path, epoch milliseconds, value) of a frame's body; a malformed one gives none.

    Times and values may be integers, doubles, decimals or text.
    """
    try:
        out = []
        for path, (seconds, value) in _Plain(BytesIO(body)).load():
            if not isinstance(path, str):
                raise ValueError(f"{path!r} is not a path")
            whole = int(seconds) if isinstance(seconds, str) else int(_number(seconds))
            out.append((path, whole * 1000, _number(value)))
        return out
    except (pickle.UnpicklingError, ValueError, TypeError, KeyError, IndexError, EOFError, AttributeError, OverflowError):
        return []


def unpickled(data: bytes) -> list[tuple[str, int, float]]:
    """(path, epoch milliseconds, value) of all frames in data."""
    return [p for body in frames(data) for p in points_of(body)]


class CarbonSource(DataSource):
    """spark.read.format("carbon_pickle").load(folder or file): points (topic, t, v), one task for each file."""

    @classmethod
    def name(cls) -> str:
        return "carbon_pickle"

    def schema(self) -> str:
        return "topic string, t bigint, v double"

    def reader(self, schema: StructType) -> CarbonReader:
        return CarbonReader(self.options["path"])


class CarbonReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        if store.get_file_info(folder).type == fs.FileType.File:
            return [InputPartition(folder)]
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        return [InputPartition(f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        names = ["topic", "t", "v"]
        kinds = [pa.string(), pa.int64(), pa.float64()]
        with store.open_input_stream(partition.value) as f:
            while len(head := f.read(4)) == 4:
                (n,) = struct.unpack(">I", head)
                if n + 4 > MOST or len(body := f.read(n)) < n:
                    return
                if got := points_of(body):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names)
