"""Voting over the flags of several algorithms: rows (plan, topic, t, v, algorithm, is_outlier) with bands where there are any.

Without a plan column rows are told apart by topic alone, and published names begin with the plan name given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stretch import keys_of

BOUNDS = ("floor", "expected", "ceiling")


def label(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several algorithms end to end, with their labels."""
    every = None
    for name, df in results.items():
        one = df.select(*keys_of(df), "t", "v", F.lit(name).alias("algorithm"), *BOUNDS, "is_outlier")
        every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("no results to vote on")
    return every


def tally(labelled: DataFrame) -> DataFrame:
    """Votes and voters of each point."""
    voters = F.array_sort(F.collect_set(F.when(F.col("is_outlier"), F.col("algorithm"))))
    return labelled.groupBy(*keys_of(labelled), "t").agg(F.first("v").alias("v"), F.count_if("is_outlier").alias("votes"), F.array_join(voters, ",").alias("voters"), F.count("*").alias("issued"))


def quorum(labelled: DataFrame, at_least: int | None = None, majority: float | None = None, total: int | None = None) -> DataFrame:
    """For each series whether enough algorithms found anomalies and enough agree on one point (corroborated).

    reached: corroborated, or all algorithms that were issued have replied.  total: how many were issued; None: as many
    as replied.
    """
    keys = keys_of(labelled)
    most = tally(labelled).groupBy(*keys).agg(F.max("votes").alias("agree"))
    found = labelled.groupBy(*keys).agg(F.countDistinct(F.when(F.col("is_outlier"), F.col("algorithm"))).alias("found"), F.countDistinct("algorithm").alias("replied"))
    both = found.join(most, keys).withColumn("issued", F.col("replied") if total is None else F.lit(total).cast("bigint"))
    if at_least is not None:
        holds = (F.col("found") >= at_least) & (F.col("agree") >= at_least)
    else:
        holds = (F.col("found") / F.col("issued") > majority / 100) & (F.col("agree") / F.col("issued") > majority / 100)
    return both.select(*keys, "found", "agree", "replied", "issued", holds.alias("corroborated"), (holds | (F.col("replied") >= F.col("issued"))).alias("reached"))


def needed(at_least: int | Column | None, percent: float | Column | None, algorithms: Column) -> Column:
    """Votes that corroborate a point: at_least (no more than there are algorithms), or a share of them, inclusive."""
    count, share = (x if x is None or isinstance(x, Column) else F.lit(x) for x in (at_least, percent))
    count = F.lit(None) if count is None else F.when(count.isNotNull(), F.least(count, algorithms))
    share = F.lit(None) if share is None else share / 100 * algorithms
    return F.coalesce(count.cast("double"), share.cast("double"))


def reduce(labelled: DataFrame, at_least: int | None = None, percent: float | None = None, algorithms: int | None = None) -> DataFrame:
    """Corroborated outliers.  algorithms: how many the plan has; None: as many as voted on the point."""
    counted = tally(labelled)
    every = F.col("issued") if algorithms is None else F.lit(algorithms)
    return counted.select(*keys_of(counted), "t", "v", "votes", "voters", (F.col("votes") >= needed(at_least, percent, every)).alias("is_outlier"))


def combined_bands(labelled: DataFrame) -> DataFrame:
    """Each point's bands by algorithm: (keys, t, thresholds map<algorithm, struct<floor, expected, ceiling>>)."""
    entry = F.struct("algorithm", F.struct(*BOUNDS))
    return labelled.groupBy(*keys_of(labelled), "t").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("thresholds"))


def anomalous_groups(reduced: DataFrame) -> DataFrame:
    """Runs of outliers that follow each other in their series."""
    keys = keys_of(reduced)
    w = Window.partitionBy(*keys).orderBy("t")
    change = (~F.lag("is_outlier", 1, False).over(w) & F.col("is_outlier")).cast("int")
    runs = reduced.withColumn("run", F.sum(change).over(w)).where("is_outlier")
    return runs.groupBy(*keys, "run").agg(F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count("*").alias("n"))


def annotations(reduced: DataFrame) -> DataFrame:
    """An interval for each run, or one clean interval for a series without outliers."""
    keys = keys_of(reduced)
    runs = anomalous_groups(reduced).select(*keys, F.lit("anomalous").alias("kind"), "start_ms", "end_ms")
    ends = reduced.groupBy(*keys).agg(F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.max("is_outlier").alias("bad"))
    return runs.unionByName(ends.where("not bad").select(*keys, F.lit("clean").alias("kind"), "start_ms", "end_ms"))


def bounded_annotations(bounds: DataFrame) -> DataFrame:
    """Kind of an annotation whose start_ms or end_ms may be unknown: unbounded, instant, interval, or error.

    No start, or a start after the end, is an error.
    """
    start, end = F.col("start_ms"), F.col("end_ms")
    kind = F.when(start.isNull() | (start > end), "error").when(end.isNull(), "unbounded").when(start == end, "instant").otherwise("interval")
    return bounds.withColumn("kind", kind)


def anomaly_rate(reduced: DataFrame) -> DataFrame:
    keys = keys_of(reduced)
    w = Window.partitionBy(*keys).orderBy("t")
    return reduced.select(*keys, "t", (F.sum(F.col("is_outlier").cast("double")).over(w) / F.row_number().over(w)).alias("rate"))


# --- publishing --------------------------------------------------------------------------------------------------


def _plan(df: DataFrame, plan: str) -> Column:
    return F.col("plan") if "plan" in df.columns else F.lit(plan)


def publishing_topic(df: DataFrame, plan: str = "plan", prefix: str | None = None) -> Column:
    return F.concat_ws(".", *([F.lit(prefix)] if prefix else []), _plan(df, plan), F.col("topic"))


def _with_outliers(df: DataFrame, wanted: bool = True) -> DataFrame:
    """Rows of the series that have outliers, or that have none."""
    keys = keys_of(df)
    have = df.where("is_outlier").select(*keys).distinct()
    return df.join(have, keys, "left_semi" if wanted else "left_anti")


def anomalies(df: DataFrame) -> DataFrame:
    """Only series with outliers."""
    return _with_outliers(df)


def marks(reduced: DataFrame, plan: str = "plan", prefix: str | None = None) -> DataFrame:
    """1 at outliers and 0 at all other points of the series that have any; other series give none."""
    return _with_outliers(reduced).select(publishing_topic(reduced, plan, prefix).alias("metric"), "t", F.col("is_outlier").cast("double").alias("value"))


def dense_fill(reduced: DataFrame, separation_ms: int, plan: str = "plan") -> DataFrame:
    """Zeros from start to end of the series without outliers."""
    clean = _with_outliers(reduced, wanted=False)
    ends = clean.groupBy(*keys_of(reduced)).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return ends.select(publishing_topic(ends, plan).alias("metric"), F.explode(F.sequence("a", "b", F.lit(separation_ms).cast("bigint"))).alias("t"), F.lit(0.0).alias("value"))


def threshold_metrics(labelled: DataFrame, plan: str = "plan", publish: dict[str, bool] | None = None) -> DataFrame:
    """Rows <plan>.<algorithm>.<bound>.<topic>; bounds that a point lacks give none.

    publish: algorithms whose bands are published (None: all; an algorithm left out is not).
    """
    rows = labelled if publish is None else labelled.where(F.col("algorithm").isin([a for a, on in publish.items() if on]))
    bounds = F.array(*[F.struct(F.lit(b).alias("bound"), F.col(b).alias("value")) for b in BOUNDS])
    each = rows.select(*keys_of(labelled), "t", "algorithm", F.explode(bounds).alias("b")).where("b.value is not null")
    return each.select(F.concat_ws(".", _plan(labelled, plan), "algorithm", "b.bound", "topic").alias("metric"), "t", "b.value")


def flatten_results(labelled: DataFrame) -> DataFrame:
    """A record for each algorithm of the series with outliers: (algorithm, topic, outliers[], threshold[]).

    Arrays are in order of time; an algorithm without outliers or bands has empty ones, and a point without a band has
    one without bounds.
    """
    rows = _with_outliers(labelled)
    outlier = F.when(F.col("is_outlier"), F.struct(F.col("t").alias("timestamp"), F.col("v").alias("value")))
    band = F.struct(F.col("t").alias("timestamp"), *BOUNDS)
    return rows.groupBy(*keys_of(labelled), "algorithm").agg(F.array_sort(F.collect_list(outlier)).alias("outliers"), F.array_sort(F.collect_list(band)).alias("threshold"))
