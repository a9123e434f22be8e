"""Detection on streams: one state for each series, the same bands as in batch.

A series' points of a micro-batch are scored in order of time.  Points later than ``delay`` behind the newest are
dropped where a delay is given; without one, late points are scored and advance the state in order of arrival.
"""

from __future__ import annotations

import datetime
import zoneinfo
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grubbs_critical
from ..operators.series import merge
from ..operators.stretch import keys_of

OUT = "t bigint, v double, floor double, expected double, ceiling double, is_outlier boolean"
#: count, two moments, the last values, the last values for the tail average, and months with their latest time and value
STATE = "n bigint, a double, b double, ring array<double>, tail array<double>, months array<bigint>, times array<bigint>, latest array<double>"
State = dict
EMPTY = {"n": 0, "a": 0.0, "b": 0.0, "ring": [], "tail": [], "months": [], "times": [], "latest": []}
#: (state, time, value) -> (centre, distance) before the value, having advanced the state by it.
Step = Callable[[State, int, float], tuple[float, float]]
NONE = float("nan")


def _sd(values: list[float]) -> float:
    return 0.0 if len(values) == 1 or min(values) == max(values) else float(np.std(values, ddof=1))


def average_step(tolerance: float = 3.0, minimum: int = 2, window: int | None = None) -> Step:
    """Mean and deviation of all values, or of the last ``window``."""

    def step(s: State, t: int, v: float) -> tuple[float, float]:
        n = s["n"]
        if window is not None:
            ring = s["ring"]
            out = (float(np.mean(ring)), tolerance * _sd(ring)) if n >= minimum and ring else (NONE, NONE)
            s["ring"] = [*ring, v][-window:]
        else:
            out = (s["a"], tolerance * (s["b"] / (n - 1)) ** 0.5 if n > 1 else 0.0) if n >= max(minimum, 1) else (NONE, NONE)
            gap = v - s["a"]
            s["a"] += gap / (n + 1)
            s["b"] += gap * (v - s["a"])
        s["n"] = n + 1
        return out

    return step


def grubbs_step(tolerance: float = 3.0, minimum: int = 7, window: int = 60, alpha: float = 0.05) -> Step:
    inner = average_step(1.0, max(7, minimum), window)

    def step(s: State, t: int, v: float) -> tuple[float, float]:
        critical = grubbs_critical(s["n"], alpha)
        mean, sd = inner(s, t, v)
        return mean, tolerance * critical * sd if critical is not None else NONE

    return step


def ewma_step(alpha: float = 0.05, tolerance: float = 3.0) -> Step:
    def step(s: State, t: int, v: float) -> tuple[float, float]:
        mean, sd = s["a"], s["b"]
        out = (mean, tolerance * sd) if s["n"] else (NONE, NONE)
        s["n"], s["a"], s["b"] = s["n"] + 1, alpha * v + (1 - alpha) * mean, (alpha * sd**2 + (1 - alpha) * (v - mean) ** 2) ** 0.5
        return out

    return step


def past_period_step(window: int = 3, tolerance: float = 3.0, minimum: int = 1, zone: str = "UTC") -> Step:
    """Latest values of the last earlier months; an older point of a month doesn't replace a newer one."""
    where = zoneinfo.ZoneInfo(zone)

    def step(s: State, t: int, v: float) -> tuple[float, float]:
        day = datetime.datetime.fromtimestamp(t / 1000, where)
        month = day.year * 100 + day.month
        past = [x for _, x in sorted((m, x) for m, x in zip(s["months"], s["latest"]) if m < month)][-window:]
        out = (float(np.mean(past)), tolerance * _sd(past)) if past and len(past) >= minimum else (NONE, NONE)
        rows = {m: (at, x) for m, at, x in zip(s["months"], s["times"], s["latest"])}
        if month not in rows or rows[month][0] <= t:
            rows[month] = (t, v)
        held = sorted(rows)[-(window + 1) :]
        s["months"], s["times"], s["latest"] = held, [rows[m][0] for m in held], [rows[m][1] for m in held]
        s["n"] += 1
        return out

    return step


STEPS: dict[str, Callable[..., Step]] = {"simple-moving-average": average_step, "grubbs": grubbs_step, "ewma": ewma_step, "past-period": past_period_step}


def detect(points: DataFrame, step: Step, tail: int = 1, delay: str | None = None) -> DataFrame:
    """Score a stream of points (plan where there is one, topic, t, v) by a step; a value is compared by its tail average."""
    keys = keys_of(points)
    names = [f.split(" ")[0] for f in STATE.split(", ")]

    def score(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = {k: list(v) if isinstance(v, (list, tuple, np.ndarray)) else v for k, v in zip(names, state.get)} if state.exists else {k: list(v) if isinstance(v, list) else v for k, v in EMPTY.items()}
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        out = []
        for t, v in zip(rows.t.tolist(), rows.v.tolist()):
            s["tail"] = [*s["tail"], v][-tail:]
            scored = sum(s["tail"]) / len(s["tail"])
            centre, distance = step(s, t, v)
            if distance > 0:
                low, high = centre - distance, centre + distance
                out.append((*key, t, v, low, centre, high, scored < low or scored > high))
            else:
                out.append((*key, t, v, None, None, None, False))
        state.update(tuple(s[k] for k in names))
        yield pd.DataFrame(out, columns=[*keys, "t", "v", "floor", "expected", "ceiling", "is_outlier"])

    schema = ", ".join(f"{k} string" for k in keys) + ", " + OUT
    if delay is None:
        return points.groupBy(*keys).applyInPandasWithState(score, schema, STATE, "append", "NoTimeout")
    timed = points.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", delay)
    return timed.groupBy(*keys).applyInPandasWithState(score, schema, STATE, "append", "EventTimeTimeout")


def moving_average(points: DataFrame, tolerance: float = 3.0, minimum: int = 2) -> DataFrame:
    """Scores each point against all earlier ones of its series."""
    return detect(points, average_step(tolerance, minimum))


def conflate(points: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 minute"):
    """Each micro-batch merged (values of one topic and time averaged) into ``sink``, one batch each ``every``."""
    return points.writeStream.foreachBatch(lambda df, k: sink(merge(df), k)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def states(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The states that a stream's checkpoint holds: (key, value) of each series."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint).select("key", "value")
