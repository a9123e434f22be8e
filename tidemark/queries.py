"""Registered queries of the time-series operators, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans as P
from . import sources as S
from .functions import ALGORITHM_ID, algorithm_id_parts, day_hour_key, grubbs_criticals, sanitize, scope_id, scope_parts
from .operators import density as N
from .operators import detect as D
from .operators import series as G
from .operators import vote as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Decimals that results keep, so that sums in another order hash alike, and what moves values off the ties of rounding.
DIGITS = 5
NUDGE, SHARE = 1e-9, 1e-12
DAY = 86_400_000

PTS = "pts AS (SELECT 'events.' || event_type AS topic, epoch_us(ts) // 1000 AS t, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"
ORD = "pts AS (SELECT 'orders.' || o_orderpriority AS topic, epoch_us(o_orderdate) // 1000 AS t, avg(o_totalprice::DOUBLE) AS v FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2)"
W = "(PARTITION BY topic ORDER BY t)"
ALL_PRIOR = "(PARTITION BY topic ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + NUDGE + F.abs(F.col(c)) * SHARE, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge(S.events(spark, sf_dir))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge(S.orders(spark, sf_dir))


def r(x: str) -> str:
    return f"round(({x}) + {NUDGE} + abs({x}) * {SHARE}, {DIGITS})"


def band_sql(stats: str, centre: str, distance: str, enough: str = "TRUE", scored: str = "v", ctes: str = PTS, prefix: str = "WITH") -> str:
    """stats: a SELECT of topic, t, v and what centre and distance need."""
    known = f"({enough}) AND {distance} > 0 AND NOT isnan({distance}) AND {centre} IS NOT NULL"
    return f"""{prefix} {ctes}, stats AS ({stats}), b AS (SELECT *, CASE WHEN {known} THEN {centre} END AS e, CASE WHEN {known} THEN {distance} END AS d FROM stats)
    SELECT topic, t, {r('v')} AS v, {r('e - d')} AS floor, {r('e')} AS expected, {r('e + d')} AS ceiling,
    coalesce({scored} < e - d OR {scored} > e + d, FALSE) AS is_outlier FROM b"""


def sd_sql(w: str, v: str = "v") -> str:
    return f"CASE WHEN count({v}) OVER {w} = 1 THEN 0.0 ELSE stddev_samp({v}) OVER {w} END"


# --- series ------------------------------------------------------------------------------------------------------


@query(f"WITH {PTS} SELECT topic, t, {r('v')} AS v FROM pts")
def series_merge(spark, d):
    return points(spark, d)


@query(f"WITH {PTS} SELECT topic, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM pts GROUP BY topic")
def series_interval(spark, d):
    return G.interval(points(spark, d))


@query(f"WITH {PTS} SELECT topic, t, {r('v')} AS v FROM pts WHERE NOT starts_with(topic, 'events.p')")
def own_output_guard(spark, d):
    return G.own_output_guard(points(spark, d), "events.p")


@query(f"WITH {PTS} SELECT topic, t, {r('v')} AS v, {r('avg(v) OVER (PARTITION BY topic ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS scored FROM pts")
def tail_average(spark, d):
    return G.tail_average(points(spark, d), 3)


@query(f"WITH {PTS} SELECT topic, t // {DAY} * {DAY} AS batch_ms, count(*) AS n, {r('avg(v)')} AS mean FROM pts GROUP BY 1, 2")
def window_batches(spark, d):
    return G.window_batches(points(spark, d), DAY)


@query(f"WITH {PTS} SELECT topic, max(t) AS t, {r('arg_max(v, t)')} AS v FROM pts GROUP BY topic")
def latest_per_key(spark, d):
    return G.latest_per_key(points(spark, d))


@query(f"WITH {PTS}, e AS (SELECT min(t) AS a, max(t) AS b FROM pts), f AS (SELECT unnest(range(a, b + 1, {DAY})) AS frame_ms, b FROM e) SELECT frame_ms, least(frame_ms + {DAY}, b + 1) AS stop_ms, (frame_ms + least(frame_ms + {DAY}, b + 1)) // 2 AS mid_ms FROM f")
def time_frames(spark, d):
    return G.time_frames(points(spark, d), DAY)


@query(f"""WITH {PTS}, e AS (SELECT min(t) AS a, max(t) AS b FROM pts), f AS (SELECT topic, t, v, b, (t - a) // {DAY} * {DAY} + a AS frame_ms FROM pts, e),
g AS (SELECT *, (frame_ms + least(frame_ms + {DAY}, b + 1)) // 2 AS mid_ms FROM f),
c AS (SELECT topic, frame_ms, mid_ms, count(*) AS n, min(v) AS only_v, max(t) FILTER (t <= mid_ms) AS lt, arg_max(v, t) FILTER (t <= mid_ms) AS lv, min(t) FILTER (t >= mid_ms) AS ht, arg_min(v, t) FILTER (t >= mid_ms) AS hv FROM g GROUP BY 1, 2, 3),
o AS (SELECT topic, frame_ms, n, CASE WHEN n = 1 THEN only_v WHEN ht = lt THEN lv ELSE lv + (hv - lv) / (ht - lt) * (mid_ms - lt) END AS value FROM c) SELECT topic, frame_ms, n, {r('value')} AS value FROM o WHERE value IS NOT NULL""")
def cohort_matrix(spark, d):
    return G.cohort_matrix(points(spark, d), DAY)


@query(f"WITH {PTS} SELECT 'events' AS topic, min(t) AS start_ms, max(t) AS end_ms FROM pts")
def common_prefix(spark, d):
    return G.cohort_name(points(spark, d))


@query("""WITH k AS (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders), d AS (SELECT 'shop.' || lower(s) || '.eu.' || replace(p, '-', '') || CASE WHEN s = 'F' THEN '' ELSE '_seg' || s || '_x' END AS topic FROM k)
SELECT topic, split_part(topic, '.', 2) AS metric, 'eu.' || split_part(split_part(topic, '.', 4), '_', 1) AS web_id, CASE WHEN contains(topic, '_') THEN split_part(topic, '_', 2) END AS segment FROM d""")
def topic_parse(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    end = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("_seg"), "o_orderstatus", F.lit("_x")))
    return G.topic_parse(o.select(F.concat(F.lit("shop."), F.lower("o_orderstatus"), F.lit(".eu."), F.regexp_replace("o_orderpriority", "-", ""), end).alias("topic")))


_FRAME = "(PARTITION BY topic ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(f"WITH {PTS} SELECT topic, t, row_number() OVER {W}::INT AS seen, {r(f'sum(v) OVER {_FRAME}')} AS total, {r(f'avg(v) OVER {_FRAME}')} AS mean, {r(sd_sql(_FRAME))} AS sd, {r(f'min(v) OVER {_FRAME}')} AS low, {r(f'max(v) OVER {_FRAME}')} AS high FROM pts")
def moving_stats(spark, d):
    return G.moving_stats(points(spark, d), 60)


def _axis(x: str, end: str, scale: str = "1") -> str:
    log = f"CASE WHEN {x} > 0 THEN ln({x}) END"
    facts = {"mean": f"avg({x})", "sum_sq": f"sum({x} * {x})", "high": f"max({x})", "sd": f"stddev_pop({x})", "low": f"min({x})", "total": f"sum({x})", "sum_log": f"sum({log})", "geometric": f"exp(avg({log}))"}
    return ", ".join(f"{r(f'({q}) / {scale}')} AS {k}{end}" for k, q in facts.items())


# the time axis in weeks since 2024, so that sums of squares stay exact enough to compare
@query(f"WITH {PTS}, w AS (SELECT topic, v, ((t - 1704067200000) // 604800000)::DOUBLE AS k FROM pts) SELECT topic, count(*) AS n, {_axis('v', '')}, {_axis('k', '_t')}, {r('covar_pop(k, v)')} AS covariance FROM w GROUP BY topic")
def historical_stats(spark, d):
    return G.historical_stats(points(spark, d).withColumn("t", F.floor((F.col("t") - 1_704_067_200_000) / 604_800_000)))


@query(f"""WITH {PTS}, s AS (SELECT topic, (t - lag(t) OVER w)::DOUBLE AS dt, v - lag(v) OVER w AS dv FROM pts WINDOW w AS {W}), c AS (SELECT topic, var_samp(t::DOUBLE) AS tt, covar_samp(t::DOUBLE, v) AS tv, var_samp(v) AS vv FROM pts GROUP BY topic),
x AS (SELECT topic, sqrt(dt * dt + dv * dv) / 60000 AS e, sqrt((vv * dt * dt - 2 * tv * dt * dv + tt * dv * dv) / (tt * vv - tv * tv)) AS m FROM s JOIN c USING (topic) WHERE dt IS NOT NULL), q AS (SELECT topic, quantile_cont(e, 0.95) AS pe, quantile_cont(m, 0.95) AS pm FROM x GROUP BY topic)
SELECT topic, count(*) AS n, {r('avg(e)')} AS euclidean_mean, {r('quantile_cont(e, 0.99)')} AS euclidean_p99, count(*) FILTER (e > pe) AS euclidean_outliers, {r('avg(m)')} AS mahalanobis_mean, {r('stddev_samp(m)')} AS mahalanobis_sd, {r('quantile_cont(m, 0.95)')} AS mahalanobis_p95, count(*) FILTER (m > pm) AS mahalanobis_outliers FROM x JOIN q USING (topic) GROUP BY topic""")
def distance_profile(spark, d):
    got = G.distance_profile(points(spark, d))
    return got.select("topic", F.col("euclidean_n").alias("n"), *[(F.col(c) / 60_000).alias(c) for c in ("euclidean_mean", "euclidean_p99")], "euclidean_outliers", "mahalanobis_mean", "mahalanobis_sd", "mahalanobis_p95", "mahalanobis_outliers")


@query(f"WITH {PTS} SELECT dayname(make_timestamp_ms(t)) || ':' || hour(make_timestamp_ms(t)) AS bin, count(*) AS n, {r('avg(v)')} AS mean FROM pts GROUP BY 1")
def day_hour_profile(spark, d):
    return points(spark, d).groupBy(day_hour_key(F.timestamp_millis("t")).alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


@query(f"WITH {PTS}, c AS (SELECT 'one' AS cohort, * FROM pts UNION ALL SELECT 'one', topic, t, v + 2 FROM pts UNION ALL SELECT 'two', topic, t, v FROM pts) SELECT cohort, topic, t, {r('avg(v)')} AS v FROM c GROUP BY 1, 2, 3")
def cohort_merge(spark, d):
    p = points(spark, d)
    one, two = p.withColumn("cohort", F.lit("one")), p.withColumn("cohort", F.lit("two"))
    return G.cohort_merge(one, one.withColumn("v", F.col("v") + 2), two)


@query(f"WITH {PTS}, b AS (SELECT *, t // {DAY} * {DAY} AS batch_ms, (row_number() OVER (PARTITION BY topic, t // {DAY} ORDER BY t) - 1) // 20 AS part FROM pts) SELECT topic, batch_ms, part, count(*) AS n, {r('avg(v)')} AS mean FROM b GROUP BY 1, 2, 3")
def limited_batches(spark, d):
    return G.limited_batches(points(spark, d), DAY, 20)


@query(f"WITH {PTS} SELECT topic, count(*)::INT AS n, min(t) AS first_ms, {r('arg_max(v, t)')} AS last_v FROM pts GROUP BY topic")
def nested_series(spark, d):
    return G.nested(points(spark, d)).select("topic", F.size("points").alias("n"), F.get("points", F.lit(0))["timestamp"].alias("first_ms"), F.element_at("points", -1)["value"].alias("last_v"))


@query(f"""WITH {PTS}, k AS (SELECT *, t // {DAY} AS batch, row_number() OVER {W} - 1 AS n FROM pts), z AS (SELECT topic, batch, count(*) AS size, min(n) AS n0 FROM k GROUP BY 1, 2)
SELECT topic, t, {r('v')} AS v, batch, n, FALSE AS past FROM k UNION ALL SELECT k.topic, k.t, {r('k.v')}, z.batch, k.n, TRUE FROM z JOIN k ON k.topic = z.topic AND z.size <= 70 AND k.n >= z.n0 - (71 - z.size) AND k.n < z.n0""")
def fill_data(spark, d):
    return D.filled(points(spark, d), DAY, 70).select("topic", "t", "v", "batch", "n", "past")


@query(f"WITH {PTS}, s AS (SELECT DISTINCT 'main:eu:' || topic AS scope FROM pts) SELECT scope, split_part(scope, ':', 1) AS plan, substr(scope, 6) AS topic FROM s")
def scope_ids(spark, d):
    s = points(spark, d).select(scope_id(F.lit("main"), F.concat(F.lit("eu:"), "topic")).alias("scope")).distinct()
    plan, topic = scope_parts(F.col("scope"))
    return s.select("scope", plan.alias("plan"), topic.alias("topic"))


@query(f"WITH {PTS}, a AS (SELECT DISTINCT 'p@' || length(topic) || CASE WHEN topic > 'events.p' THEN ':topic:' ELSE ':else:' END || topic AS id FROM pts) SELECT id, CASE WHEN regexp_matches(id, '{ALGORITHM_ID}') THEN regexp_extract(id, '{ALGORITHM_ID}', 2) END AS plan_id, CASE WHEN regexp_matches(id, '{ALGORITHM_ID}') THEN regexp_extract(id, '{ALGORITHM_ID}', 4) END AS span FROM a")
def algorithm_ids(spark, d):
    kind = F.when(F.col("topic") > "events.p", ":topic:").otherwise(":else:")
    ids = points(spark, d).select(F.concat(F.lit("p@"), F.length("topic").cast("string"), kind, "topic").alias("id")).distinct()
    return ids.withColumn("parts", algorithm_id_parts(F.col("id"))).select("id", "parts.plan_id", "parts.span")


@query(f"WITH {PTS} SELECT topic, t, {r('v')} AS v FROM pts WHERE v <> round(v, 0)")
def json_doubles(spark, d):
    """Points written as JSON records and read again; whole values are written as integers and so give no point."""
    p = points(spark, d)
    value = F.when(F.col("v") == F.round("v"), F.col("v").cast("bigint").cast("string")).otherwise(F.col("v").cast("decimal(30,5)").cast("string"))
    line = F.concat(F.lit('{"topic":"'), "topic", F.lit('","points":[{"timestamp":'), F.col("t").cast("string"), F.lit(',"value":'), value, F.lit("}]}"))
    return S.from_lines(p.select(line.alias("value")).union(spark.createDataFrame([("{broken",)], "value string")), doubles_only=True)


@query(f"WITH {PTS} SELECT topic, t // 1000 * 1000 AS t, {r('avg(v)')} AS v FROM pts GROUP BY 1, 2")
def text_log_points(spark, d):
    """Points written as log lines and read again."""
    pairs = points(spark, d).groupBy("topic").agg(F.collect_list(F.concat(F.lit("("), F.floor(F.col("t") / 1000).cast("string"), F.lit(", "), F.col("v").cast("decimal(30,10)").cast("string"), F.lit(")"))).alias("p"))
    lines = pairs.select(F.concat(F.lit('SimpleTimeSeries:"'), "topic", F.lit('"['), F.array_join("p", ","), F.lit("]")).alias("value"))
    return G.merge(S.text_log(lines))


@query(f"WITH {PTS} SELECT topic, count(*) AS n, {r('min(v)')} AS low, {r('max(v)')} AS high, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, {r('quantile_cont(v, 0.5)')} AS median, {r('skewness(v)')} AS skewness, {r('kurtosis(v)')} AS kurtosis FROM pts GROUP BY topic")
def series_profile(spark, d):
    return G.series_profile(points(spark, d))


# --- plans -------------------------------------------------------------------------------------------------------

PLANS = [P.Plan("listed", topics=["events.purchase", "events.click"]), P.Plan("pattern", regex="v.e|sign"), P.Plan("default")]
PLAN_SQL = "pl(plan, kind, topics, regex, line) AS (VALUES ('listed', 'topics', ['events.purchase', 'events.click'], NULL, 0), ('pattern', 'regex', NULL, 'v.e|sign', 1), ('default', 'all', NULL, NULL, 2))"
APPLIES = "CASE kind WHEN 'topics' THEN list_contains(topics, topic) WHEN 'regex' THEN regexp_matches(topic, regex) ELSE TRUE END"


@query(f"WITH {PTS}, {PLAN_SQL} SELECT topic, t, {r('v')} AS v, plan FROM pts JOIN pl ON {APPLIES}")
def plan_fanout(spark, d):
    return P.fan_out(points(spark, d), P.table(spark, PLANS))


@query(f"WITH {PTS}, {PLAN_SQL} SELECT DISTINCT topic, plan, CASE kind WHEN 'topics' THEN 1 WHEN 'regex' THEN 2 ELSE 4 END::INT AS type_order, line::INT AS line FROM pts JOIN pl ON {APPLIES}")
def plans_for_topic(spark, d):
    return P.plans_for_topic(points(spark, d), P.table(spark, PLANS))


@query(f"WITH {PTS}, {PLAN_SQL} SELECT topic, t, {r('v')} AS v FROM pts WHERE NOT EXISTS (SELECT 1 FROM pl WHERE kind <> 'all' AND {APPLIES})")
def unrecognised(spark, d):
    return P.unrecognised(points(spark, d), P.table(spark, PLANS[:2]))


@query(f"WITH {PTS}, {PLAN_SQL} SELECT topic, t, {r('v')} AS v FROM pts WHERE EXISTS (SELECT 1 FROM pl WHERE kind <> 'all' AND {APPLIES})")
def planned(spark, d):
    return P.planned(points(spark, d), P.table(spark, PLANS[:2]))


@query(f"WITH {PTS} SELECT topic, t, {r('v')} AS v FROM pts WHERE length(topic) = 12")
def predicate_plan(spark, d):
    return P.fan_out(points(spark, d), P.table(spark, [P.Plan("short", predicate="length(topic) = 12"), P.Plan("odd", predicate="cast(null as boolean)")])).drop("plan")


@query("SELECT * FROM (VALUES ('listed', TRUE), ('pattern', TRUE), ('lost', FALSE)) AS x(plan, registered)")
def plan_lookup(spark, d):
    found, lost = P.lookup(spark.createDataFrame([("listed",), ("lost",), ("pattern",)], "plan string"), P.table(spark, PLANS))
    return found.withColumn("registered", F.lit(True)).unionByName(lost.withColumn("registered", F.lit(False)))


_CHANGES = [("a", 1, "added", "first", "all", None, None, None, ["sma"]), ("b", 2, "added", "second", "regex", None, "x", None, ["ewma"]), ("a", 3, "renamed", "renamed", None, None, None, None, None), ("b", 4, "disabled", None, None, None, None, None, None), ("a", 5, "algorithms", None, None, None, None, None, ["ewma", "grubbs"]), ("b", 6, "applies_to", None, "topics", ["t"], None, None, None)]


def _changes(spark):
    return spark.createDataFrame(_CHANGES, "plan_id string, seq bigint, event string, name string, kind string, topics array<string>, regex string, predicate string, algorithms array<string>")


@query("SELECT * FROM (VALUES ('a', 'renamed', 'all', NULL, 'ewma,grubbs', TRUE), ('b', 'second', 'topics', 't', 'ewma', FALSE)) AS x(plan_id, plan, kind, topics, algorithms, is_active)")
def plan_catalogue(spark, d):
    return P.latest(_changes(spark)).select("plan_id", "plan", "kind", F.array_join("topics", ",").alias("topics"), F.array_join("algorithms", ",").alias("algorithms"), "is_active")


@query("SELECT * FROM (VALUES ('a', 1::BIGINT, 'sma', ''), ('a', 5::BIGINT, 'ewma,grubbs', 'sma'), ('b', 2::BIGINT, 'ewma', '')) AS x(plan_id, seq, added, dropped)")
def plan_algorithm_changes(spark, d):
    return P.algorithm_changes(_changes(spark)).select("plan_id", "seq", F.array_join("added", ",").alias("added"), F.array_join("dropped", ",").alias("dropped"))


def _one_plan(name: str, spark, d) -> DataFrame:
    return P.fan_out(points(spark, d), P.table(spark, [p for p in PLANS if p.name == name])).drop("plan")


@query(f"WITH {PTS} SELECT topic, t, {r('v')} AS v FROM pts WHERE topic IN ('events.purchase', 'events.click')")
def topic_list_plan(spark, d):
    return _one_plan("listed", spark, d)


@query(f"WITH {PTS} SELECT topic, t, {r('v')} AS v FROM pts WHERE regexp_matches(topic, 'v.e|sign')")
def topic_regex_plan(spark, d):
    return _one_plan("pattern", spark, d)


@query(f"WITH {PTS} SELECT topic, t, {r('v')} AS v FROM pts")
def default_plan(spark, d):
    return _one_plan("default", spark, d)


# --- detection ---------------------------------------------------------------------------------------------------

_STATS = "SELECT *, row_number() OVER " + W + " - 1 AS n, avg(v) OVER {w} AS m, {sd} AS s, avg(v) OVER (PARTITION BY topic ORDER BY t ROWS BETWEEN {tail} PRECEDING AND CURRENT ROW) AS x FROM pts"


def _last(n: int) -> str:
    return f"(PARTITION BY topic ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(band_sql(_STATS.format(w=ALL_PRIOR, sd=sd_sql(ALL_PRIOR), tail=0), "m", "3 * s", "n >= 2"))
def sma_unbounded(spark, d):
    return D.moving_average(points(spark, d))


@query(band_sql(_STATS.format(w=_last(60), sd=sd_sql(_last(60)), tail=2), "m", "2 * s", "n >= 2", "x"))
def sma_sliding(spark, d):
    return D.moving_average(points(spark, d), window=60, tolerance=2.0, tail=3)


#: Counts of a series that the SQL below has critical values for; tests hold them against published ones.
_COUNTS = np.arange(7, 400)
_G = ", ".join(f"({n}, {float(g)!r}::DOUBLE)" for n, g in zip(_COUNTS, grubbs_criticals(_COUNTS)))


@query(band_sql(f"SELECT a.*, g FROM ({_STATS.format(w=_last(60), sd=sd_sql(_last(60)), tail=0)}) a LEFT JOIN crit USING (n)", "m", "0.5 * g * s", "n >= 7", ctes="pts AS (SELECT 'customer.' || c_mktsegment || c_nationkey AS topic, c_custkey AS t, c_acctbal::DOUBLE AS v FROM customer), crit(n, g) AS (VALUES " + _G + ")"))
def grubbs(spark, d):
    """Balances of customers in order, a series for each segment and nation."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("customer."), "c_mktsegment", F.col("c_nationkey").cast("string")).alias("topic"), F.col("c_custkey").alias("t"), F.col("c_acctbal").cast("double").alias("v"))
    return D.grubbs(c, tolerance=0.5)


@query(band_sql(f"SELECT p.topic, p.t, p.v, s.m, s.s, s.n FROM pts p JOIN (SELECT topic, mon, avg(last) OVER w AS m, CASE WHEN count(last) OVER w = 1 THEN 0.0 ELSE stddev_samp(last) OVER w END AS s, count(last) OVER w AS n FROM (SELECT topic, year(make_timestamp_ms(t)) * 100 + month(make_timestamp_ms(t)) AS mon, arg_max(v, t) AS last FROM pts GROUP BY 1, 2) WINDOW w AS (PARTITION BY topic ORDER BY mon ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) s ON p.topic = s.topic AND s.mon = year(make_timestamp_ms(p.t)) * 100 + month(make_timestamp_ms(p.t))", "m", "3 * s", "n >= 1", ctes=ORD))
def past_period(spark, d):
    return D.past_period(prices(spark, d))


_EWMA = """WITH RECURSIVE {pts}, k AS (SELECT topic, {season} AS season, t, v, row_number() OVER (PARTITION BY topic, {season} ORDER BY t) AS i FROM pts),
f(topic, season, t, v, i, e, q, e2, q2) AS (SELECT topic, season, t, v, i, NULL::DOUBLE, NULL::DOUBLE, 0.05 * v, sqrt(0.95 * v * v) FROM k WHERE i = 1
UNION ALL SELECT k.topic, k.season, k.t, k.v, k.i, f.e2, f.q2, 0.05 * k.v + 0.95 * f.e2, sqrt(0.05 * f.q2 * f.q2 + 0.95 * (k.v - f.e2) * (k.v - f.e2)) FROM f JOIN k ON k.topic = f.topic AND k.season = f.season AND k.i = f.i + 1)
SELECT topic, {out} t, """ + f"{r('v')} AS v, {r('e - 3 * q')} AS floor, {r('e')} AS expected, {r('e + 3 * q')} AS ceiling, coalesce(v < e - 3 * q OR v > e + 3 * q, FALSE) AS is_outlier FROM f"


@query(_EWMA.format(pts=PTS, season="0", out=""))
def ewma(spark, d):
    return D.ewma(points(spark, d))


@query(_EWMA.format(pts=PTS, season=f"t % {DAY} * 24 // {DAY}", out="season,"))
def seasonal_ewma(spark, d):
    return D.seasonal_ewma(points(spark, d))


@query(band_sql("SELECT p.*, m, s FROM pts p JOIN (SELECT topic, avg(v) AS m, CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(v) END AS s FROM (SELECT *, min(t) OVER (PARTITION BY topic) AS t0 FROM pts) WHERE t < t0 + 3600000 GROUP BY topic) USING (topic)", "m", "3 * s"))
def first_hour_average(spark, d):
    return D.first_hour_average(points(spark, d))


@query(band_sql("SELECT p.*, m, s FROM pts p JOIN (SELECT topic, avg(v) AS m, stddev_pop(v) AS s FROM pts GROUP BY topic) USING (topic)", "m", "3 * s"))
def mean_subtraction(spark, d):
    return D.mean_subtraction(points(spark, d))


@query(band_sql("SELECT *, quantile_cont(v, 0.5) OVER w AS m, quantile_cont(dev, 0.5) OVER w AS s FROM (SELECT *, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY topic ORDER BY t ROWS BETWEEN 8639 PRECEDING AND CURRENT ROW)) AS dev FROM pts) WINDOW w AS (PARTITION BY topic ORDER BY t ROWS BETWEEN 8640 PRECEDING AND 1 PRECEDING)", "m", "3 * s"))
def median_absolute_deviation(spark, d):
    return D.median_absolute_deviation(points(spark, d))


@query(f"WITH {PTS}, e AS (SELECT topic, min(v) AS lo, (max(v) + 1e-13 - min(v)) / 16 AS width FROM pts GROUP BY topic), b AS (SELECT topic, t, v, CASE WHEN width > 0 THEN least(15, floor((v - lo) / width)::BIGINT) ELSE 0 END AS bin FROM pts JOIN e USING (topic)) SELECT topic, t, {r('v')} AS v, bin, count(*) OVER (PARTITION BY topic, bin) AS held, count(*) OVER (PARTITION BY topic, bin) < 5 AS is_outlier FROM b")
def histogram_bins(spark, d):
    return D.histogram_bins(points(spark, d))


_LAST3 = "(PARTITION BY topic ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {PTS}, h AS (SELECT *, (t - min(t) OVER (PARTITION BY topic)) / 3600000.0 AS h, row_number() OVER {W} - 1 AS n FROM pts),
l AS (SELECT topic, t, v, h, CASE WHEN n >= 3 THEN regr_slope(v, h) OVER {ALL_PRIOR} END AS slope, CASE WHEN n >= 3 THEN regr_intercept(v, h) OVER {ALL_PRIOR} END AS intercept, avg(v) OVER {_LAST3} AS m, {sd_sql(_LAST3)} AS s FROM h),
e AS (SELECT *, m - (slope * h + intercept) AS error, 3 * s AS d FROM l)
SELECT topic, t, {r('v')} AS v, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('error')} AS error, {r('v + error - d')} AS floor, {r('v + error')} AS expected, {r('v + error + d')} AS ceiling, coalesce(abs(error) > d AND floor(s + 0.5) <> 0 AND floor(error + 0.5) <> 0, FALSE) AS is_outlier FROM e""")
def least_squares(spark, d):
    return D.least_squares(points(spark, d))


@query(f"WITH {PTS}, g AS (SELECT topic, sqrt(pow(v - lag(v) OVER {W}, 2) + pow((t - lag(t) OVER {W})::DOUBLE, 2)) AS dist FROM pts) SELECT topic, count(*) AS n, round(avg(dist), 2) AS mean, round(stddev_samp(dist), 2) AS sd, round(avg(dist) + stddev_samp(dist), 2) AS eps FROM g WHERE dist IS NOT NULL GROUP BY topic")
def consecutive_distance_eps(spark, d):
    got = D.distance_eps(points(spark, d))
    return got.select("topic", "n", *[F.round(c, 2).alias(c) for c in ("mean", "sd", "eps")])


_SPLIT = 1_705_276_800_000  # the middle of the month


@query(f"WITH {PTS}, s AS (SELECT topic, v, sum((t < {_SPLIT})::INT) AS a, sum((t >= {_SPLIT})::INT) AS b FROM pts GROUP BY 1, 2), g AS (SELECT topic, a, b, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY topic) - sum(b) OVER w / sum(b) OVER (PARTITION BY topic)) AS gap FROM s WINDOW w AS (PARTITION BY topic ORDER BY v)) SELECT topic, sum(a)::BIGINT AS n_before, sum(b)::BIGINT AS n_after, {r('max(gap)')} AS d FROM g GROUP BY topic")
def ks_statistic(spark, d):
    return D.ks_statistic(points(spark, d), _SPLIT)


@query()
def ks_test(spark, d):
    return D.ks_test(points(spark, d))


@query()
def ks_outliers(spark, d):
    return D.ks_outliers(points(spark, d), tolerance=0.5)


@query(f"WITH {PTS} SELECT topic, t, {r(f'coalesce(v - lag(v) OVER {W}, 0.0)')} AS v FROM pts")
def padded_difference(spark, d):
    return D.differenced(points(spark, d))


@query("WITH RECURSIVE " + _EWMA.split("WITH RECURSIVE ")[1].split("SELECT topic, {out}")[0].format(pts=PTS, season="0") + f"SELECT topic, max(i) AS n, {r('arg_max(e2, i)')} AS mean, {r('arg_max(q2, i)')} AS sd, {r('pow(arg_max(q2, i), 2)')} AS variance, {r('max(i) * arg_max(e2, i)')} AS total, {r('min(v)')} AS low, {r('max(v)')} AS high FROM f GROUP BY topic")
def moments(spark, d):
    return D.moments(points(spark, d))


@query()
def dbscan_series(spark, d):
    return N.series_density(points(spark, d))


@query()
def dbscan_series_bands(spark, d):
    return N.series_density(points(spark, d), distance="mahalanobis", thresholds=True)


@query()
def dbscan_centroid(spark, d):
    return N.centroid_density(points(spark, d))


@query()
def dbscan_cohort(spark, d):
    return N.cohort_density(points(spark, d), DAY)


@query()
def adf(spark, d):
    return D.adf(points(spark, d))


@query()
def rpca(spark, d):
    return D.rpca(points(spark, d), 24)


# --- voting ------------------------------------------------------------------------------------------------------


def votes(spark, d) -> DataFrame:
    """Three algorithms with narrow bands, so that they agree and disagree."""
    p = points(spark, d)
    return V.label({"sma": D.moving_average(p, tolerance=1.5), "sliding": D.moving_average(p, window=60, tolerance=1.5), "all": D.mean_subtraction(p, tolerance=1.5)})


def _flags(name: str, sql: str) -> str:
    return f"SELECT topic, t, v, '{name}' AS algorithm, floor, expected, ceiling, is_outlier FROM ({sql})"


VOTES = "lab AS (" + " UNION ALL ".join(
    [
        _flags("sma", band_sql(_STATS.format(w=ALL_PRIOR, sd=sd_sql(ALL_PRIOR), tail=0), "m", "1.5 * s", "n >= 2")),
        _flags("sliding", band_sql(_STATS.format(w=_last(60), sd=sd_sql(_last(60)), tail=0), "m", "1.5 * s", "n >= 2")),
        _flags("all", band_sql("SELECT p.*, m, s FROM pts p JOIN (SELECT topic, avg(v) AS m, stddev_pop(v) AS s FROM pts GROUP BY topic) USING (topic)", "m", "1.5 * s")),
    ]
) + ")"
TALLY = "tal AS (SELECT topic, t, any_value(v) AS v, count(*) FILTER (is_outlier) AS votes, coalesce(string_agg(algorithm, ',' ORDER BY algorithm) FILTER (is_outlier), '') AS voters, count(*) AS issued FROM lab GROUP BY 1, 2)"
QUORUM = "q AS (SELECT topic, count(DISTINCT algorithm) FILTER (is_outlier) AS found, count(DISTINCT algorithm) AS issued FROM lab GROUP BY 1), a AS (SELECT topic, max(votes) AS agree FROM tal GROUP BY 1)"
RED = "red AS (SELECT topic, t, v, votes, voters, votes >= least(2, issued) AS is_outlier FROM tal)"
RUNS = "runs AS (SELECT topic, run, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM (SELECT *, sum(chg) OVER (PARTITION BY topic ORDER BY t) AS run FROM (SELECT *, (is_outlier AND NOT lag(is_outlier, 1, FALSE) OVER (PARTITION BY topic ORDER BY t))::INT AS chg FROM red)) WHERE is_outlier GROUP BY 1, 2)"


@query(f"WITH {VOTES}, {TALLY} SELECT topic, t, v, votes, voters, issued FROM tal")
def vote_tally(spark, d):
    return V.tally(votes(spark, d))


@query(f"WITH {VOTES}, {TALLY}, {QUORUM} SELECT topic, found, agree, issued AS replied, 4::BIGINT AS issued, found >= 2 AND agree >= 2 AS corroborated, (found >= 2 AND agree >= 2) OR issued >= 4 AS reached FROM q JOIN a USING (topic)")
def quorum_at_least(spark, d):
    return V.quorum(votes(spark, d), at_least=2, total=4)


@query(f"WITH {VOTES}, {TALLY}, {QUORUM} SELECT topic, found, agree, issued AS replied, issued, found / issued > 0.5 AND agree / issued > 0.5 AS corroborated, TRUE AS reached FROM q JOIN a USING (topic)")
def quorum_majority(spark, d):
    return V.quorum(votes(spark, d), majority=50.0)


@query(f"WITH {VOTES}, {TALLY}, {RED} SELECT * FROM red")
def reduce_count(spark, d):
    return V.reduce(votes(spark, d), at_least=2)


@query(f"WITH {VOTES}, {TALLY} SELECT topic, t, v, votes, voters, votes >= 0.5 * issued AS is_outlier FROM tal")
def reduce_percent(spark, d):
    return V.reduce(votes(spark, d), percent=50.0)


@query(f"WITH {VOTES}, {TALLY}, {RED}, {RUNS} SELECT topic, run::BIGINT AS run, start_ms, end_ms, n FROM runs")
def anomalous_groups(spark, d):
    return V.anomalous_groups(V.reduce(votes(spark, d), at_least=2))


@query(f"WITH {VOTES}, {TALLY}, {RED}, {RUNS} SELECT topic, 'anomalous' AS kind, start_ms, end_ms FROM runs UNION ALL SELECT topic, 'clean', min(t), max(t) FROM red GROUP BY topic HAVING NOT bool_or(is_outlier)")
def annotations(spark, d):
    return V.annotations(V.reduce(votes(spark, d), at_least=2))


@query(f"WITH {VOTES}, {TALLY}, {RED} SELECT topic, t, {r('sum(is_outlier::INT) OVER w / row_number() OVER w')} AS rate FROM red WINDOW w AS (PARTITION BY topic ORDER BY t)")
def anomaly_rate(spark, d):
    return V.anomaly_rate(V.reduce(votes(spark, d), at_least=2))


# one series is left without outliers, so that both kinds are there
_SOME = "kept AS (SELECT topic, t, v, votes, voters, is_outlier AND topic <> 'events.click' AS is_outlier FROM red), bad AS (SELECT DISTINCT topic FROM kept WHERE is_outlier)"


def _some(spark, d) -> DataFrame:
    return V.reduce(votes(spark, d), at_least=2).withColumn("is_outlier", F.col("is_outlier") & (F.col("topic") != "events.click"))


@query(f"WITH {VOTES}, {TALLY}, {RED}, {_SOME} SELECT 'plan.' || topic AS metric, t, is_outlier::INT::DOUBLE AS value FROM kept SEMI JOIN bad USING (topic)")
def marks(spark, d):
    return V.marks(_some(spark, d))


@query(f"WITH {VOTES}, {TALLY}, {RED}, {_SOME}, e AS (SELECT topic, min(t) AS a, max(t) AS b FROM kept ANTI JOIN bad USING (topic) GROUP BY 1) SELECT 'plan.' || topic AS metric, unnest(range(a, b + 1, 3600000)) AS t, 0.0::DOUBLE AS value FROM e")
def dense_fill(spark, d):
    return V.dense_fill(_some(spark, d), 3_600_000)


@query(f"WITH {VOTES}, {TALLY}, {RED}, {_SOME} SELECT topic, t, votes, is_outlier FROM kept SEMI JOIN bad USING (topic)")
def anomalies(spark, d):
    return V.anomalies(_some(spark, d)).select("topic", "t", "votes", "is_outlier")


@query(f"WITH {VOTES} SELECT 'plan.' || algorithm || '.' || b.k || '.' || topic AS metric, t, {r('b.x')} AS value FROM (SELECT *, unnest([{{'k': 'floor', 'x': floor}}, {{'k': 'expected', 'x': expected}}, {{'k': 'ceiling', 'x': ceiling}}]) AS b FROM lab WHERE algorithm <> 'all') WHERE b.x IS NOT NULL")
def threshold_metrics(spark, d):
    return V.threshold_metrics(votes(spark, d), publish={"sma": True, "sliding": True, "all": False})


@query(f"WITH {VOTES}, bad AS (SELECT DISTINCT topic FROM lab WHERE is_outlier) SELECT algorithm, topic, count(*) FILTER (is_outlier)::INT AS outliers, count(*)::INT AS bands, min(t) FILTER (is_outlier) AS first_ms, {r('arg_max(ceiling, t)')} AS last_ceiling FROM lab SEMI JOIN bad USING (topic) GROUP BY 1, 2")
def flatten_results(spark, d):
    got = V.flatten_results(votes(spark, d))
    return got.select("algorithm", "topic", F.size("outliers").alias("outliers"), F.size("threshold").alias("bands"), F.get("outliers", F.lit(0))["timestamp"].alias("first_ms"), F.element_at("threshold", -1)["ceiling"].alias("last_ceiling"))


@query("SELECT * FROM (VALUES (NULL::BIGINT, NULL::BIGINT, 'error'), (5, NULL, 'unbounded'), (NULL, 5, 'error'), (5, 5, 'instant'), (6, 5, 'error'), (5, 6, 'interval')) AS x(start_ms, end_ms, kind)")
def uncertain_annotations(spark, d):
    return V.bounded_annotations(spark.createDataFrame([(None, None), (5, None), (None, 5), (5, 5), (6, 5), (5, 6)], "start_ms bigint, end_ms bigint"))


# --- plans end to end --------------------------------------------------------------------------------------------

DEFAULTS = {"simple-moving-average": {"tolerance": 1.5}, "mean-subtraction-cumulation": {"tolerance": 1.5}, "grubbs": {}}
CONFIG = {
    "narrow": {"topics": ["events.purchase", "events.click"], "at-least": 2, "algorithms": {"simple-moving-average": "on", "mean-subtraction-cumulation": True, "grubbs": "off"}},
    "wide": {"is-default": True, "majority": 50, "algorithms": {"simple-moving-average": {"sliding-window": 60}, "mean-subtraction-cumulation": "yes", "first-hour-average": {"tolerance": 1.0}}},
}


def _running() -> list[P.Plan]:
    return P.from_config(CONFIG, DEFAULTS)


def _planned_flags(plan: str, algorithm: str, sql: str) -> str:
    only = "WHERE topic IN ('events.purchase', 'events.click')" if plan == "narrow" else ""
    return f"SELECT '{plan}' AS plan, topic, t, v, '{algorithm}' AS algorithm, floor, expected, ceiling, is_outlier FROM ({sql}) {only}"


_SMA, _ALL = band_sql(_STATS.format(w=ALL_PRIOR, sd=sd_sql(ALL_PRIOR), tail=0), "m", "1.5 * s", "n >= 2"), band_sql("SELECT p.*, m, s FROM pts p JOIN (SELECT topic, avg(v) AS m, stddev_pop(v) AS s FROM pts GROUP BY topic) USING (topic)", "m", "1.5 * s")
_HOUR = band_sql("SELECT p.*, m, s FROM pts p JOIN (SELECT topic, avg(v) AS m, CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(v) END AS s FROM (SELECT *, min(t) OVER (PARTITION BY topic) AS t0 FROM pts) WHERE t < t0 + 3600000 GROUP BY topic) USING (topic)", "m", "1.0 * s")
_SLIDE = band_sql(_STATS.format(w=_last(60), sd=sd_sql(_last(60)), tail=0), "m", "1.5 * s", "n >= 2")
RUN = "lab AS (" + " UNION ALL ".join([_planned_flags("narrow", "simple-moving-average", _SMA), _planned_flags("narrow", "mean-subtraction-cumulation", _ALL), _planned_flags("wide", "simple-moving-average", _SLIDE), _planned_flags("wide", "mean-subtraction-cumulation", _ALL), _planned_flags("wide", "first-hour-average", _HOUR)]) + ")"
PLAN_TALLY = "tal AS (SELECT plan, topic, t, any_value(v) AS v, count(*) FILTER (is_outlier) AS votes, coalesce(string_agg(algorithm, ',' ORDER BY algorithm) FILTER (is_outlier), '') AS voters, count(*) AS issued FROM lab GROUP BY 1, 2, 3), red AS (SELECT *, CASE plan WHEN 'narrow' THEN votes >= 2 ELSE votes >= 1.5 END AS is_outlier FROM tal)"


@query(f"WITH {RUN}, {PLAN_TALLY} SELECT plan, topic, t, v, votes, voters, issued, is_outlier FROM red")
def plan_run(spark, d):
    """Plans end to end; a topic of two plans is scored once in each."""
    return P.run(points(spark, d), _running()).drop("thresholds")


@query(f"WITH {RUN} SELECT plan, topic, t, algorithm, floor, expected, ceiling FROM lab")
def plan_bands(spark, d):
    """The bands that the reduced results carry, by algorithm."""
    got = P.run(points(spark, d), _running())
    return got.select("plan", "topic", "t", F.explode("thresholds").alias("algorithm", "b")).select("plan", "topic", "t", "algorithm", "b.*")


@query(f"WITH {RUN}, {PLAN_TALLY}, runs AS (SELECT plan, topic, run, min(t) AS start_ms, max(t) AS end_ms FROM (SELECT *, sum(chg) OVER (PARTITION BY plan, topic ORDER BY t) AS run FROM (SELECT *, (is_outlier AND NOT lag(is_outlier, 1, FALSE) OVER (PARTITION BY plan, topic ORDER BY t))::INT AS chg FROM red)) WHERE is_outlier GROUP BY 1, 2, 3) SELECT plan, topic, 'anomalous' AS kind, start_ms, end_ms FROM runs UNION ALL SELECT plan, topic, 'clean', min(t), max(t) FROM red GROUP BY 1, 2 HAVING NOT bool_or(is_outlier)")
def plan_annotations(spark, d):
    return V.annotations(P.run(points(spark, d), _running()))


@query(f"WITH {RUN}, {PLAN_TALLY}, bad AS (SELECT DISTINCT plan, topic FROM red WHERE is_outlier) SELECT plan || '.' || topic AS metric, t, is_outlier::INT::DOUBLE AS value FROM red SEMI JOIN bad USING (plan, topic)")
def plan_marks(spark, d):
    return V.marks(P.run(points(spark, d), _running()))


_WRONG = "w AS (SELECT 'narrow' AS plan, 'events.view' AS topic, t, 'simple-moving-average' AS algorithm, v > 100 AS is_outlier FROM pts WHERE topic = 'events.view' UNION ALL SELECT 'wide', topic, t + 1, 'grubbs', v > 100 FROM pts WHERE topic = 'events.click')"


@query(f"WITH {PTS}, {_WRONG} SELECT 'algorithm' AS rule, plan, topic, t, algorithm FROM w WHERE algorithm = 'grubbs' UNION ALL SELECT 'source', plan, topic, t, algorithm FROM w WHERE topic = 'events.view' UNION ALL SELECT 'point', plan, topic, t, algorithm FROM w WHERE is_outlier AND (topic, t) NOT IN (SELECT (topic, t) FROM pts)")
def plan_violations(spark, d):
    """All rules that made-up results break."""
    p = points(spark, d)
    view = p.where("topic = 'events.view'").select(F.lit("narrow").alias("plan"), "topic", "t", F.lit("simple-moving-average").alias("algorithm"), (F.col("v") > 100).alias("is_outlier"))
    click = p.where("topic = 'events.click'").select(F.lit("wide").alias("plan"), "topic", (F.col("t") + 1).alias("t"), F.lit("grubbs").alias("algorithm"), (F.col("v") > 100).alias("is_outlier"))
    return P.violations(view.unionByName(click), p, _running())


@query("SELECT s_suppkey, regexp_replace(s_name || ' of  ' || s_nationkey, '\\s+', '-', 'g') AS metric FROM supplier")
def sanitize_names(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select("s_suppkey", sanitize(F.concat("s_name", F.lit(" of  "), F.col("s_nationkey").cast("string"))).alias("metric"))
