"""Ordered kernels over series that are split across tasks.

A series is one (plan, topic), or one topic where there are no plans.  Its points are numbered by time buckets, cut into
stretches of equal length and dealt out by stretch, so a series with a third of all points is work for many tasks.  A
kernel sees a stretch and a halo of points before it; what it needs from further back comes as summed-up state.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points of a stretch, and the width of the time buckets by which points are numbered.
STRETCH = 100_000
BUCKET_MS = 86_400_000

#: Points of a stretch whose moments are summed at once; what they come to is merged in LONG, so that neither the length of
#: a series nor that of a stretch costs digits.
PART = 2000
LONG = np.longdouble

log = logging.getLogger(__name__)
Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def keys_of(df: DataFrame, *more: str) -> list[str]:
    """What tells series apart: plan (where there is one), topic, and further columns."""
    return [*(["plan"] if "plan" in df.columns else []), "topic", *more]


def numbered(df: DataFrame, *more: str) -> DataFrame:
    """df with n, the number of earlier points of the series; no task holds more of a series than one time bucket."""
    keys = keys_of(df, *more)
    bucketed = df.withColumn("_bucket", F.floor(F.col("t") / BUCKET_MS))
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_size")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("t"))
    joined = bucketed.withColumn("_in", inside).join(counts.select(*keys, "_bucket", before.alias("_before")), [*keys, "_bucket"])
    return joined.withColumn("n", F.col("_before") + F.col("_in") - 1).drop("_bucket", "_in", "_before")


def contained(kernel: Kernel) -> Kernel:
    """A kernel whose failure on a stretch gives points without band or flag, so that other algorithms' votes still count."""

    def run(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        try:
            return kernel(columns)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            log.exception("a kernel failed on %d points", len(columns["v"]))
            nothing = np.full(len(columns["v"]), np.nan)
            return {"centre": nothing, "distance": nothing}

    return run


def over(df: DataFrame, kernel: Kernel, results: str = "centre double, distance double", halo: int = 0, more: tuple[str, ...] = (), state: DataFrame | None = None) -> DataFrame:
    """df (with n, from ``numbered``) with the kernel's columns.

    kernel: gets the numeric columns of a stretch with its halo in order of n, and returns an array for each of
    ``results``, as long; NaN comes back as null.  halo: points before a stretch that it sees.  state: (keys, _stretch,
    columns) joined to the stretches' rows.
    """
    keys = keys_of(df, *more)
    size = max(STRETCH, halo)
    own = F.floor(F.col("n") / size)
    dealt = df.withColumn("_stretch", own)
    if state is not None:
        dealt = dealt.join(state, [*keys, "_stretch"], "left")
    if halo:
        twice = F.when(F.pmod("n", F.lit(size)) >= size - halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        dealt = dealt.withColumn("_late", F.explode(twice)).withColumn("_stretch", F.col("_stretch") + F.col("_late"))
    else:
        dealt = dealt.withColumn("_late", F.lit(0))
    names = [*keys, "_stretch"]
    fields = [r.strip().split(" ") for r in results.split(",")]
    numeric = [c for c, kind in dealt.dtypes if kind in ("bigint", "int", "double")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n").combine_chunks()
        past = int(pc.sum(table["_late"]).as_py() or 0)
        # a stretch that nothing but a halo reaches has no points to score
        got = kernel({c: table[c].to_numpy() for c in numeric}) if past < table.num_rows else {name: np.zeros(past) for name, _ in fields}
        table = table.slice(past)
        for name, kind in fields:
            x = np.asarray(got[name])[past:]
            table = table.append_column(name, pa.array(x, mask=np.isnan(x)) if kind == "double" else pa.array(x))
        return table

    schema = ", ".join(f"`{c}` {kind}" for c, kind in dealt.dtypes)
    # grouped, as a repartition may be folded into the join with the state, whose rows adaptive execution deals otherwise
    return dealt.groupBy(*names).applyInArrow(run, f"{schema}, {results}").drop("_stretch", "_late", *([c for c in state.columns if c not in names] if state is not None else []))


def carried(df: DataFrame) -> DataFrame:
    """(keys, _stretch, n0, mean0, m0, low0, high0): count, mean, squared deviations and ends of all stretches before.

    One row for each stretch; its parts are merged in order, so that what comes later, or a spike, costs no digits.
    """
    keys = keys_of(df)
    own = df.withColumn("_stretch", F.floor(F.col("n") / STRETCH)).withColumn("_part", F.floor(F.pmod("n", F.lit(STRETCH)) / PART)).groupBy(*keys, "_stretch", "_part")
    parts = own.agg(F.count("*").alias("c"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, mean, square, low, high = None, 0, LONG(0), LONG(0), np.inf, -np.inf
        for batch in batches:
            out = []
            for *key, stretch, part, c, m, q, lo, hi in zip(*(x.to_pylist() for x in batch.columns)):
                if key != now:
                    now, n, mean, square, low, high = key, 0, LONG(0), LONG(0), np.inf, -np.inf
                if part == 0:
                    out.append((*key, stretch, n, float(mean), float(square), low, high))
                gap = m - mean
                n, before = n + c, n
                mean += gap * c / n
                square += q + gap * gap * before * c / n
                low, high = min(low, lo), max(high, hi)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), fields)] if out else [pa.array([], f.type) for f in fields], names)

    names = [*keys, "_stretch", "n0", "mean0", "m0", "low0", "high0"]
    fields = [pa.field(k, pa.string()) for k in keys] + [pa.field(k, pa.int64()) for k in names[len(keys) : len(keys) + 2]] + [pa.field(k, pa.float64()) for k in names[-4:]]
    schema = ", ".join(f"{k} {kind}" for k, kind in zip(names, ["string"] * len(keys) + ["bigint"] * 2 + ["double"] * 4))
    return parts.repartition(*keys).sortWithinPartitions(*keys, "_stretch", "_part").mapInArrow(run, schema)


#: Windows up to which every one is summed by itself.
DIRECT = 128


def _direct(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of each row without its NaNs; the first row has none."""
    mean, sd = np.full(len(windows) + 1, np.nan), np.full(len(windows) + 1, np.nan)
    for lo in range(0, len(windows), 1 << 14):
        part = windows[lo : lo + (1 << 14)]
        some = ~np.isnan(part)
        count = some.sum(axis=1)
        first = part[:, -1:]  # the latest value: differences from it vanish where all are equal
        d = np.where(some, part - first, 0.0)
        shift = d.sum(axis=1) / count
        at = slice(lo + 1, lo + 1 + len(part))
        mean[at] = first[:, 0] + shift
        sd[at] = np.sqrt((np.where(some, d - shift[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(count - 1, 1))
    return mean, sd


# --- moments of the values before a point --------------------------------------------------------------------------


def last_moments(v: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sample deviation of v[i-w : i] for every i (deviation: 0 for one value, NaN for none).

    Windows are put together from the end of one block of w values and the start of the next, so nothing is ever
    subtracted out of a sum and a spike leaves no trace once it is out of the window.
    """
    size = len(v)
    i = np.arange(size)
    n = np.minimum(i, w)
    if size < 2:
        return n, np.full(size, np.nan), np.full(size, np.nan)
    if w <= DIRECT:
        x = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(w, np.nan), v[:-1])), w)[1:]
        return n, *_direct(x)
    w = min(w, size)
    blocks = -(-size // w)
    x = np.full(blocks * w, v[-1])
    x[:size] = v
    x = x.reshape(blocks, w)
    centre = np.median(x, axis=1, keepdims=True)
    d = x - centre
    start1, start2 = np.cumsum(d, axis=1), np.cumsum(d * d, axis=1)
    end1, end2 = np.cumsum(d[:, ::-1], axis=1)[:, ::-1], np.cumsum((d * d)[:, ::-1], axis=1)[:, ::-1]
    b, k = np.divmod(i[1:] - 1, w)
    n1, s1, q1 = k + 1.0, start1[b, k], start2[b, k]
    some = (b > 0) & (k + 1 < w)
    before, after = np.where(some, b - 1, 0), np.where(some, k + 1, 0)
    n2, s2, q2 = (np.where(some, y, 0.0) for y in (w - 1.0 - k, end1[before, after], end2[before, after]))
    m1, m2 = centre[b, 0] + s1 / n1, centre[before, 0] + s2 / np.maximum(n2, 1)
    both = n1 + n2
    gap = np.where(some, m2 - m1, 0.0)
    mean = m1 + gap * n2 / both
    square = np.maximum(q1 - s1 * s1 / n1, 0) + np.maximum(q2 - s2 * s2 / np.maximum(n2, 1), 0) + gap * gap * n1 * n2 / both
    steps = np.concatenate(([0], np.cumsum(v[1:] != v[:-1])))
    flat = steps[i[1:] - 1] == steps[np.maximum(i[1:] - w, 0)]
    mean, square = np.where(flat, v[:-1], mean), np.where(flat, 0.0, square)
    sd = np.sqrt(square / np.maximum(both - 1, 1))
    return n, np.concatenate(([np.nan], mean)), np.concatenate(([np.nan], sd))


def all_moments(v: np.ndarray, n0: int = 0, mean0: float = 0.0, m0: float = 0.0, low0: float = np.inf, high0: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of all values before, those of earlier stretches (count, mean, squared deviations, ends) included.

    Running sums are of LONG: what doubles lose over a stretch shows in a digit that is rounded.
    """
    i = np.arange(len(v))
    centre = LONG(np.median(v)) if len(v) else LONG(0)
    d = v - centre
    s, q = (np.concatenate((np.zeros(1, LONG), np.cumsum(x)[:-1])) for x in (d, d * d))
    own_mean, own_square = centre + s / np.maximum(i, 1), np.maximum(q - s * s / np.maximum(i, 1), 0)
    n = n0 + i
    gap = np.where(i > 0, own_mean - mean0, 0.0) if n0 else 0.0
    mean = np.where(i > 0, mean0 + gap * i / np.maximum(n, 1), mean0) if n0 else own_mean
    square = own_square + (m0 + gap * gap * n0 * i / np.maximum(n, 1) if n0 else 0.0)
    low, high = (np.concatenate(([e], f.accumulate(np.concatenate(([e], v[:-1])))[1:])) if len(v) else v for f, e in ((np.minimum, low0), (np.maximum, high0)))
    flat = (n > 0) & (low == high)
    mean, square = np.where(flat, low, mean), np.where(flat, 0.0, square)
    mean, deviation = mean.astype(np.float64), np.sqrt(square / np.maximum(n - 1, 1)).astype(np.float64)
    return n, np.where(n > 0, mean, np.nan), np.where(n > 0, deviation, np.nan)
