"""Series: merging, intervals, batches, frames, profiles."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import common_prefix
from .stretch import keys_of

#: Rows that a task groups, on average, where groups are about as many as rows.
TASK_ROWS = 250_000


def by_time(*keys: str) -> "Window":
    return Window.partitionBy(*(keys or ("topic",))).orderBy("t")


def prior(n: int | None = None, *keys: str) -> "Window":
    """The rows before the current one: all, or the last n."""
    return by_time(*keys).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def merge(*points: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Union of points; values of one topic (and plan, cohort or what else ``more`` names) and time are averaged.

    Nearly every row is a group of its own, so tasks are counted by rows: what one holds doesn't grow with the input.
    """
    every = fold(DataFrame.unionByName, points).where("v is not null")
    if not every.isStreaming:
        parts = max(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every.count() // TASK_ROWS))
        every = every.repartition(parts, *more, "topic", "t")
    return every.groupBy(*more, "topic", "t").agg(F.avg("v").alias("v"))


def cohort_merge(*cohorts: DataFrame) -> DataFrame:
    """Union of cohorts (cohort, topic, t, v): members of one topic are merged."""
    return merge(*cohorts, more=("cohort",))


def nested(points: DataFrame) -> DataFrame:
    """One row for each series, with its points in order of time: (topic, points array<struct<timestamp, value>>)."""
    return points.groupBy(*keys_of(points)).agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("timestamp"), F.col("v").alias("value")))).alias("points"))


def interval(points: DataFrame) -> DataFrame:
    return points.groupBy(*keys_of(points)).agg(F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count("*").alias("n"))


def own_output_guard(points: DataFrame, prefix: str) -> DataFrame:
    return points.where(~F.col("topic").startswith(prefix))


def tail_average(points: DataFrame, tail: int) -> DataFrame:
    """Each value by the mean of itself and the tail-1 values before it, as ``scored``."""
    w = by_time(*keys_of(points)).rowsBetween(-(tail - 1), 0)
    return points.withColumn("scored", F.avg("v").over(w) if tail > 1 else F.col("v"))


def window_batches(points: DataFrame, width_ms: int) -> DataFrame:
    """Tumbling batches of one series."""
    start = (F.floor(F.col("t") / width_ms) * width_ms).cast("bigint")
    return points.groupBy(*keys_of(points), start.alias("batch_ms")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def limited_batches(points: DataFrame, width_ms: int, limit: int = 10_000) -> DataFrame:
    """Batches of one series that end with their window or after ``limit`` points: (batch_ms, part, n, mean)."""
    keys = keys_of(points)
    start = (F.floor(F.col("t") / width_ms) * width_ms).cast("bigint")
    place = F.row_number().over(Window.partitionBy(*keys, "batch_ms").orderBy("t")) - 1
    cut = points.withColumn("batch_ms", start).withColumn("part", F.floor(place / limit).cast("bigint"))
    return cut.groupBy(*keys, "batch_ms", "part").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def latest_per_key(points: DataFrame) -> DataFrame:
    keys = keys_of(points)
    return points.groupBy(*keys).agg(F.max(F.struct("t", "v")).alias("last")).select(*keys, "last.t", "last.v")


def time_frames(points: DataFrame, unit_ms: int) -> DataFrame:
    """Half-open frames of unit_ms from the first point on; the last is cut one millisecond after the end."""
    ends = points.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    starts = ends.select(F.explode(F.sequence("a", "b", F.lit(unit_ms).cast("bigint"))).alias("frame_ms"), F.col("b"))
    stop = F.least(F.col("frame_ms") + unit_ms, F.col("b") + 1)
    return starts.select("frame_ms", stop.alias("stop_ms"), F.floor((F.col("frame_ms") + stop) / 2).cast("bigint").alias("mid_ms"))


def cohort_matrix(points: DataFrame, unit_ms: int) -> DataFrame:
    """Per frame and topic: the only value, or the values interpolated linearly at the frame's middle.

    A middle outside the frame's points is dropped, as an interpolation that failed.
    """
    ends = points.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    framed = points.crossJoin(F.broadcast(ends)).withColumn("frame_ms", (F.floor((F.col("t") - F.col("a")) / unit_ms) * unit_ms + F.col("a")).cast("bigint"))
    mid = F.floor((F.col("frame_ms") + F.least(F.col("frame_ms") + unit_ms, F.col("b") + 1)) / 2).cast("bigint")
    framed = framed.withColumn("mid_ms", mid)
    below, above = F.when(F.col("t") <= F.col("mid_ms"), F.struct("t", "v")), F.when(F.col("t") >= F.col("mid_ms"), F.struct("t", "v"))
    cells = framed.groupBy("topic", "frame_ms", "mid_ms").agg(F.count("*").alias("n"), F.min("v").alias("only"), F.max(below).alias("lo"), F.min(above).alias("hi"))
    slope = F.when(F.col("hi.t") == F.col("lo.t"), F.lit(0.0)).otherwise((F.col("hi.v") - F.col("lo.v")) / (F.col("hi.t") - F.col("lo.t")))
    value = F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("lo.v") + slope * (F.col("mid_ms") - F.col("lo.t")))
    return cells.select("topic", "frame_ms", "n", value.alias("value")).where("value is not null")


def cohort_name(points: DataFrame) -> DataFrame:
    got = points.agg(F.min("topic").alias("a"), F.max("topic").alias("b"), F.min("t").alias("start_ms"), F.max("t").alias("end_ms"))
    return got.select(common_prefix(F.col("a"), F.col("b")).alias("topic"), "start_ms", "end_ms")


def topic_parse(points: DataFrame) -> DataFrame:
    """Parts of a dotted topic, counted from 0: metric is part 1, web id parts 2 and 3 up to the underscore, segment what follows it.

    Parts that a topic lacks are null, and so is what is made of them.
    """
    parts = F.split("topic", r"\.")
    last = F.split(F.get(parts, 3), "_")
    return points.select("topic").distinct().select("topic", F.get(parts, 1).alias("metric"), F.concat(F.get(parts, 2), F.lit("."), F.get(last, 0)).alias("web_id"), F.get(last, 1).alias("segment"))


def sd(value: Column | str, window) -> Column:
    """Sample deviation over a window; 0 for one value, null for none."""
    return F.when(F.count(value).over(window) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value).over(window))


def moving_stats(points: DataFrame, width: int) -> DataFrame:
    by = by_time(*keys_of(points))
    w = by.rowsBetween(-(width - 1), 0)
    return points.select(*keys_of(points), "t", F.row_number().over(by).alias("seen"), F.sum("v").over(w).alias("total"), F.avg("v").over(w).alias("mean"), sd("v", w).alias("sd"), F.min("v").over(w).alias("low"), F.max("v").over(w).alias("high"))


def historical_stats(points: DataFrame) -> DataFrame:
    """Moments of values and, by the suffix _t, of times, and their covariance; population forms, natural logarithms."""

    def axis(x, end: str) -> list:
        log = F.log(F.when(x > 0, x))
        return [F.avg(x).alias("mean" + end), F.sum(x * x).alias("sum_sq" + end), F.max(x).alias("high" + end), F.stddev_pop(x).alias("sd" + end), F.min(x).alias("low" + end), F.sum(x).alias("total" + end), F.sum(log).alias("sum_log" + end), F.exp(F.avg(log)).alias("geometric" + end)]

    v, t = F.col("v"), F.col("t").cast("double")
    return points.groupBy(*keys_of(points)).agg(F.count("*").alias("n"), *axis(v, ""), *axis(t, "_t"), F.covar_pop(t, v).alias("covariance"))


def _shape(x, n) -> list:
    """Bias-corrected skewness and kurtosis from the population forms in columns g1 and g2 of x."""
    g1, g2 = F.col(f"{x}_g1"), F.col(f"{x}_g2")
    return [(g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias(f"{x}_skewness"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias(f"{x}_kurtosis")]


def _facts(x, name: str, tails: bool = False) -> list:
    out = [F.count(x).alias(f"{name}_n"), F.min(x).alias(f"{name}_low"), F.max(x).alias(f"{name}_high"), F.avg(x).alias(f"{name}_mean"), F.stddev_samp(x).alias(f"{name}_sd"), F.percentile(x, F.lit(0.5)).alias(f"{name}_median"), F.skewness(x).alias(f"{name}_g1"), F.kurtosis(x).alias(f"{name}_g2")]
    return out + [F.percentile(x, F.lit(p)).alias(f"{name}_p{k}") for k, p in ((95, 0.95), (99, 0.99))] * tails


def series_profile(points: DataFrame) -> DataFrame:
    """Count, extremes, mean, deviation, median, and bias-corrected skewness and kurtosis of each series."""
    keys = keys_of(points)
    got = points.groupBy(*keys).agg(*_facts(F.col("v"), "v"))
    plain = ["n", "low", "high", "mean", "sd", "median", "skewness", "kurtosis"]
    return got.select("*", *_shape("v", F.col("v_n"))).select(*keys, *[F.col(f"v_{c}").alias(c) for c in plain])


def distance_profile(points: DataFrame) -> DataFrame:
    """The same of the Euclidean and Mahalanobis distances between neighbours in time, their 95th and 99th percentiles,
    and how many lie over the 95th.  A series whose covariance has no inverse has no Mahalanobis distances."""
    keys = keys_of(points)
    by = by_time(*keys)
    t = F.col("t").cast("double")
    own = points.groupBy(*keys).agg(F.var_samp(t).alias("tt"), F.covar_samp(t, "v").alias("tv"), F.var_samp("v").alias("vv"))
    steps = points.select(*keys, (t - F.lag(t).over(by)).alias("dt"), (F.col("v") - F.lag("v").over(by)).alias("dv")).where("dt is not null").join(own, keys)
    det = F.col("tt") * F.col("vv") - F.col("tv") * F.col("tv")
    form = (F.col("vv") * F.col("dt") * F.col("dt") - 2 * F.col("tv") * F.col("dt") * F.col("dv") + F.col("tt") * F.col("dv") * F.col("dv")) / det
    apart = steps.select(*keys, F.sqrt(F.col("dt") * F.col("dt") + F.col("dv") * F.col("dv")).alias("e"), F.when(det > 0, F.sqrt(form)).alias("m"))
    got = apart.groupBy(*keys).agg(*_facts(F.col("e"), "euclidean", True), *_facts(F.col("m"), "mahalanobis", True))
    far = apart.join(got.select(*keys, "euclidean_p95", "mahalanobis_p95"), keys).groupBy(*keys).agg(F.count_if(F.col("e") > F.col("euclidean_p95")).alias("euclidean_outliers"), F.count_if(F.col("m") > F.col("mahalanobis_p95")).alias("mahalanobis_outliers"))
    return got.join(far, keys).select("*", *_shape("euclidean", F.col("euclidean_n")), *_shape("mahalanobis", F.col("mahalanobis_n"))).drop("euclidean_g1", "euclidean_g2", "mahalanobis_g1", "mahalanobis_g2")
