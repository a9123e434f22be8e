"""Sources of points and sinks of results."""

from __future__ import annotations

import json
import logging
import socket
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import millis, sanitize
from .carbon import CarbonSource, pickled, unpickled

JSON = "topic string, points array<struct<timestamp: bigint, value: {value}>>"
#: Records that a sample source gives at most.
SAMPLE = 100

log = logging.getLogger(__name__)
__all__ = ["CarbonSource", "pickled", "unpickled"]


def _flat(lines: DataFrame) -> DataFrame:
    points = lines.select("topic", F.explode("points").alias("p")).select("topic", F.col("p.timestamp").alias("t"), F.col("p.value").alias("v"))
    return points.where("topic is not null and t is not null and v is not null")


def _strict(lines: DataFrame) -> DataFrame:
    """Values as they were written: those without a fraction or exponent are not doubles and go."""
    points = lines.select("topic", F.explode("points").alias("p")).where(F.col("p.value").rlike(r"[.eE]"))
    return points.select("topic", F.col("p.timestamp").alias("t"), F.col("p.value").cast("double").alias("v")).where("topic is not null and t is not null and v is not null")


def from_lines(lines: DataFrame, column: str = "value", doubles_only: bool = False) -> DataFrame:
    """Points of a column of JSON records."""
    kind = JSON.format(value="string" if doubles_only else "double")
    read = lines.select(F.from_json(column, kind).alias("r")).select("r.*")
    return _strict(read) if doubles_only else _flat(read)


def json_lines(spark: SparkSession, path: str, doubles_only: bool = False) -> DataFrame:
    """Points of lines {"topic": ..., "points": [{"timestamp": ms, "value": double}]}; malformed lines give none.

    doubles_only: values written as integers give no point.
    """
    lines = spark.read.schema(JSON.format(value="string" if doubles_only else "double")).json(path)
    return _strict(lines) if doubles_only else _flat(lines)


def json_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same from files as they appear in a folder, at any depth."""
    return _flat(spark.readStream.schema(JSON.format(value="double")).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).json(path))


def sample(spark: SparkSession, records: Iterable[dict | str], limit: int = SAMPLE) -> DataFrame:
    """Points of literal records in the JSON form, the first ``limit`` of them."""
    rows = [(r if isinstance(r, str) else json.dumps(r),) for r in records][:limit]
    return from_lines(spark.createDataFrame(rows, "value string"))


def synthetic(spark: SparkSession, values: list[float], start_ms: int, period_ms: int = 1000, wiggle: tuple[float, float] = (1.0, 1.0), topic: str = "synthetic", seed: int = 0) -> DataFrame:
    """Values one period apart from the whole second of start_ms on; each offset times a uniform factor within wiggle."""
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k bigint, v double")
    factor = F.lit(wiggle[0]) + F.rand(seed) * (wiggle[1] - wiggle[0])
    return rows.select(F.lit(topic).alias("topic"), (F.lit(start_ms // 1000 * 1000) + F.floor(F.col("k") * period_ms * factor)).cast("bigint").alias("t"), "v")


#: Fixed forms of a log line: SimpleTimeSeries:"topic"[(seconds, value), ...]
_PARTS = r"\(\s*{0}[0-9]+{1}\s*,\s*{0}-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?{1}\s*\)"
_POINT, _ANY = _PARTS.format("(", ")"), _PARTS.format("", "")
_HEAD = r'^SimpleTimeSeries:("[^"\\]*(?:\\.[^"\\]*)*")\s*\['
_BODY = _HEAD + r"([\s\S]*)\]\s*$"


def text_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Points of log lines; other lines give none.  Topics may hold JSON's escapes; seconds become milliseconds.

    A line's form is checked by what is left once its points are taken out: one pattern for a whole list of points would
    need a stack as deep as the list is long.
    """
    found = lines.where(F.col(column).rlike(_BODY)).select(F.regexp_extract(column, _HEAD, 1).alias("label"), F.regexp_extract(column, _BODY, 2).alias("body"))
    shape = F.regexp_replace(F.regexp_replace("body", _ANY, "P"), r"\s+", "")
    found = found.where(F.regexp_replace(shape, ",P", "") == "P")
    topic = F.get_json_object(F.concat(F.lit('{"k":'), "label", F.lit("}")), "$.k")
    both = F.arrays_zip(F.regexp_extract_all("body", F.lit(_POINT), F.lit(1)).alias("s"), F.regexp_extract_all("body", F.lit(_POINT), F.lit(2)).alias("v"))
    return found.select(topic.alias("topic"), F.explode(both).alias("p")).select("topic", (F.col("p.s").cast("bigint") * 1000).alias("t"), F.col("p.v").cast("double").alias("v"))


def read_points(spark: SparkSession, path: str, protocol: str = "pickle") -> DataFrame:
    """Points of a folder by protocol: pickle (length-led frames), json or text."""
    if protocol == "pickle":
        spark.dataSource.register(CarbonSource)
        return spark.read.format("carbon_pickle").load(path)
    if protocol == "json":
        return json_lines(spark, path)
    if protocol == "text":
        return text_log(spark.read.text(path))
    raise ValueError(f"no protocol {protocol}")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(F.concat(F.lit("events."), "event_type").alias("topic"), millis(F.col("ts")).alias("t"), F.col("value").alias("v"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.select(F.concat(F.lit("orders."), "o_orderpriority").alias("topic"), millis(F.col("o_orderdate")).alias("t"), F.col("o_totalprice").cast("double").alias("v"))


# --- sinks -------------------------------------------------------------------------------------------------------


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Metric rows (metric, t, value) as Parquet, sorted by metric within files."""
    metrics.sortWithinPartitions("metric", "t").write.mode(mode).parquet(path)


def archive(points: DataFrame, path: str) -> None:
    """Append series to an archive: a record (topic, points) for each series and hour, in a folder for each hour (UTC)."""
    hour = F.date_format(F.timestamp_millis(F.floor(F.col("t") / 3_600_000) * 3_600_000), "yyyyMMdd-HH")
    series = points.withColumn("hour", hour).groupBy("hour", "topic").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("timestamp"), F.col("v").alias("value")))).alias("points"))
    series.repartition("hour").write.partitionBy("hour").mode("append").option("compression", "snappy").parquet(path)


def csv_report(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def log_results(results: DataFrame) -> None:
    """Outliers and bands to the executors' logs, a line each."""

    def lines(rows) -> None:
        for r in rows:
            log.info("%s", r.asDict())

    results.foreachPartition(lines)


class Breaker:
    """Stops calls after ``most`` failures in a row; after ``reset`` seconds one call may try again."""

    def __init__(self, most: int = 5, reset: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.reset, self.clock = most, reset, clock
        self.failures, self.since = 0, 0.0

    @property
    def state(self) -> str:
        if self.failures < self.most:
            return "closed"
        return "pending" if self.clock() - self.since >= self.reset else "open"

    def record(self, well: bool) -> None:
        self.failures = 0 if well else self.failures + 1
        if not well:
            self.since = self.clock()


def publish(metrics: DataFrame, host: str, port: int, batch: int = 1000, timeout: float = 10.0, attempts: int = 10, breaker: tuple[int, float] = (5, 30.0)) -> None:
    """Metrics (metric, t, value) to a carbon pickle receiver: each task sends frames of ``batch`` points over its socket.

    A frame that fails is sent again on a new connection; while the breaker is open the task waits.  After ``attempts``
    failures of one frame the task fails, and Spark runs it again: a receiver may see points twice, never lose them.
    """

    def send(rows) -> None:
        guard, link = Breaker(*breaker), None

        def deliver(frame: bytes) -> None:
            nonlocal link
            for last in range(attempts):
                while guard.state == "open":
                    time.sleep(min(1.0, guard.reset))
                try:
                    if link is None:
                        link = socket.create_connection((host, port), timeout)
                    link.sendall(frame)
                    guard.record(True)
                    return
                except OSError:
                    guard.record(False)
                    if link is not None:
                        link.close()
                    link = None
                    if last == attempts - 1:
                        raise

        held = []
        for r in rows:
            held.append((r.metric, r.t // 1000, r.value))
            if len(held) == batch:
                deliver(pickled(held))
                held = []
        if held:
            deliver(pickled(held))
        if link is not None:
            link.close()

    metrics.select(sanitize(F.col("metric")).alias("metric"), "t", "value").foreachPartition(send)


def publish_stream(metrics: DataFrame, host: str, port: int, checkpoint: str, every: str = "5 seconds", **options):
    """The same for a stream, one micro-batch each ``every``."""
    return metrics.writeStream.foreachBatch(lambda df, _: publish(df, host, port, **options)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
