"""Detection plans: which topics they apply to, what they run, and running them.

A plans table has a row (plan, kind, topics, regex, predicate, line) for each plan; kind is all, topics, regex or
predicate.  It is small by nature (configuration), yet joins check its size before they broadcast it.
"""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import vote
from ..operators.detect import ALGORITHMS

SCHEMA = "plan string, kind string, topics array<string>, regex string, predicate string, line int"
#: Plans up to which a plans table is broadcast.
BROADCAST_ROWS = 10_000
#: Share of a finite time budget that detection may use.
UTILISATION = 0.8
#: Names of settings and of the arguments that they set.
SETTINGS = {"tolerance": "tolerance", "tail-average": "tail", "minimum-population": "minimum", "sliding-window": "window", "window": "window", "alpha": "alpha", "minimum-bin-size": "least"}

log = logging.getLogger(__name__)


@dataclass
class Plan:
    name: str
    topics: list[str] | None = None
    regex: str | None = None
    #: an SQL condition on the column topic; where it is null it doesn't hold
    predicate: str | None = None
    #: label -> settings
    algorithms: dict[str, dict] = field(default_factory=dict)
    at_least: int | None = None
    majority: float = 50.0
    #: (window in ms, limit of points) of a batch
    grouping: tuple[int, int] | None = None
    budget_ms: float | None = None
    active: bool = True

    @property
    def kind(self) -> str:
        return "topics" if self.topics is not None else "regex" if self.regex is not None else "predicate" if self.predicate is not None else "all"


def algorithms_of(entries: dict, defaults: dict[str, dict] | None = None) -> dict[str, dict]:
    """Settings by label: True or a string that says yes takes the defaults, an object overrides them, the rest is off."""
    out = {}
    for label, entry in entries.items():
        base = (defaults or {}).get(label, {})
        if isinstance(entry, dict):
            out[label] = {**base, **entry}
        elif entry is True or isinstance(entry, str) and entry.lower() in ("yes", "true", "on"):
            out[label] = dict(base)
    return out


def from_config(config: dict, defaults: dict[str, dict] | None = None) -> list[Plan]:
    """Plans by name, in order.

    Precedence: is-default (if it holds), topics, regex, predicate; a plan with none of them is dropped.  at-least
    goes before majority (50 by default).  group: {within_ms, limit (10,000)}; a finite budget counts for 80 %.
    """
    out = []
    for name, spec in config.items():
        group, budget = spec.get("group"), spec.get("budget-ms")
        plan = Plan(name, algorithms=algorithms_of(spec.get("algorithms", {}), defaults), at_least=spec.get("at-least"), majority=float(spec.get("majority", 50.0)), grouping=(int(group["within-ms"]), int(group.get("limit", 10_000))) if group else None, budget_ms=budget * UTILISATION if budget is not None else None)
        if spec.get("is-default"):
            out.append(plan)
        elif "topics" in spec:
            out.append(replace(plan, topics=list(spec["topics"])))
        elif "regex" in spec:
            out.append(replace(plan, regex=spec["regex"]))
        elif "predicate" in spec:
            out.append(replace(plan, predicate=spec["predicate"]))
    return out


def table(spark: SparkSession, plans: list[Plan]) -> DataFrame:
    return spark.createDataFrame([(p.name, p.kind, p.topics, p.regex, p.predicate, k) for k, p in enumerate(plans) if p.active], SCHEMA)


def applies(topic: Column, predicates: list[str] = ()) -> Column:
    """Whether a plan of the table applies; predicates: all SQL conditions that the table may hold."""
    own = fold(lambda rest, sql: F.when(F.col("predicate") == sql, F.expr(sql)).otherwise(rest), predicates, F.lit(False))
    kind = F.col("kind")
    rule = F.when(kind == "topics", F.array_contains("topics", topic)).when(kind == "regex", F.expr("regexp_like(topic, regex)")).when(kind == "predicate", own).otherwise(F.lit(True))
    return F.coalesce(rule, F.lit(False))


def _small(plans: DataFrame) -> DataFrame:
    return F.broadcast(plans) if plans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else plans


def fan_out(points: DataFrame, plans: DataFrame) -> DataFrame:
    """Every point once for each plan that applies to its topic; the default plan is not exclusive."""
    pairs = plans_for_topic(points, plans).select("topic", "plan")
    return points.join(pairs, "topic")


def plans_for_topic(points: DataFrame, plans: DataFrame) -> DataFrame:
    """(topic, plan, type_order, line): lists before patterns before conditions before the default, then by line."""
    predicates = [r.predicate for r in plans.where("predicate is not null").select("predicate").distinct().limit(BROADCAST_ROWS).collect()]
    order = F.when(F.col("kind") == "topics", 1).when(F.col("kind") == "regex", 2).when(F.col("kind") == "predicate", 3).otherwise(4)
    return points.select("topic").distinct().join(_small(plans), applies(F.col("topic"), predicates)).select("topic", "plan", order.alias("type_order"), "line")


def split(points: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points whose topic some plan applies to, and the others."""
    known = plans_for_topic(points, plans).select("topic").distinct()
    return points.join(known, "topic", "left_semi"), points.join(known, "topic", "left_anti")


def planned(points: DataFrame, plans: DataFrame) -> DataFrame:
    return split(points, plans)[0]


def unrecognised(points: DataFrame, plans: DataFrame) -> DataFrame:
    """Points whose topic no plan applies to."""
    return split(points, plans)[1]


def lookup(specified: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Specified plans that are registered by name, and those that are missing."""
    names = registered.select("plan").distinct()
    return specified.join(names, "plan", "left_semi"), specified.join(names, "plan", "left_anti")


# --- running -----------------------------------------------------------------------------------------------------


def arguments(algorithm: Callable[..., DataFrame], settings: dict) -> dict:
    """Settings as the algorithm's arguments; those that it doesn't have are left out."""
    takes = inspect.signature(algorithm).parameters
    named = {SETTINGS.get(k, k.replace("-", "_")): v for k, v in settings.items()}
    return {k: v for k, v in named.items() if k in takes and v is not None}


def score(points: DataFrame, plans: list[Plan], registry: dict[str, Callable[..., DataFrame]] = ALGORITHMS) -> DataFrame:
    """Every algorithm of every plan over the points that the plan applies to: (plan, topic, t, v, algorithm, band, is_outlier).

    Plans that share an algorithm with the same settings share its pass.  An algorithm that isn't registered is logged
    and gives no rows, but still counts among those that its plan asks.
    """
    spark = points.sparkSession
    live = [p for p in plans if p.active]
    fanned = fan_out(points, table(spark, live))
    passes: dict[str, tuple[str, dict, list[str]]] = {}
    for plan in live:
        for name, settings in plan.algorithms.items():
            if name not in registry:
                log.error("plan %s asks for %s, which is not registered", plan.name, name)
                continue
            own = arguments(registry[name], settings)
            passes.setdefault(f"{name} {sorted(own.items())}", (name, own, []))[2].append(plan.name)
    out = []
    for name, own, names in passes.values():
        mine = fanned if len(names) == len(live) else fanned.where(F.col("plan").isin(names))
        out.append(vote.label({name: registry[name](mine, **own)}))
    if not out:
        raise ValueError("no plan has an algorithm that is registered")
    return fold(DataFrame.unionByName, out)


def _rules(spark: SparkSession, plans: list[Plan]) -> DataFrame:
    rows = [(p.name, len(p.algorithms), p.at_least, None if p.at_least is not None else p.majority) for p in plans]
    return spark.createDataFrame(rows, "plan string, algorithms int, at_least int, majority double")


def reduced(scored: DataFrame, plans: list[Plan]) -> DataFrame:
    """Points with their votes and whether their plan's rule corroborates them, and the bands of all algorithms."""
    rules = _small(_rules(scored.sparkSession, plans))
    need = vote.needed(F.col("at_least"), F.col("majority"), F.col("algorithms"))
    counted = vote.tally(scored).join(rules, "plan")
    flags = counted.select("plan", "topic", "t", "v", "votes", "voters", "issued", (F.col("votes") >= need).alias("is_outlier"))
    return flags.join(vote.combined_bands(scored), ["plan", "topic", "t"])


def run(points: DataFrame, plans: list[Plan], registry: dict[str, Callable[..., DataFrame]] = ALGORITHMS) -> DataFrame:
    """Plans end to end: fan out, score, vote.  Annotations and metrics follow by ``operators.vote``."""
    return reduced(score(points, plans, registry), plans)


# --- checks ------------------------------------------------------------------------------------------------------


def violations(scored: DataFrame, points: DataFrame, plans: list[Plan]) -> DataFrame:
    """What is wrong with results, all of it: (rule, plan, topic, t, algorithm).

    algorithm: not one of the plan's; source: a plan that doesn't apply to the topic; point: an outlier at a time that
    the series lacks.
    """
    spark = scored.sparkSession
    have = spark.createDataFrame([(p.name, a) for p in plans for a in p.algorithms], "plan string, algorithm string")
    pairs = plans_for_topic(scored.select("topic"), table(spark, plans)).select("topic", "plan")
    row = ["plan", "topic", "t", "algorithm"]
    foreign = scored.join(_small(have), ["plan", "algorithm"], "left_anti").select(F.lit("algorithm").alias("rule"), *row)
    stray = scored.join(pairs, ["topic", "plan"], "left_anti").select(F.lit("source").alias("rule"), *row)
    absent = scored.where("is_outlier").join(points.select("topic", "t"), ["topic", "t"], "left_anti").select(F.lit("point").alias("rule"), *row)
    return foreign.unionByName(stray).unionByName(absent)


def valid(scored: DataFrame, points: DataFrame, plans: list[Plan]) -> DataFrame:
    """Results of the (plan, topic) that have no violation: failed detections go as a whole."""
    bad = violations(scored, points, plans).select("plan", "topic").distinct()
    return scored.join(bad, ["plan", "topic"], "left_anti")


# --- a catalogue that changes -------------------------------------------------------------------------------------


def latest(changes: DataFrame) -> DataFrame:
    """Log of changes (plan_id, seq, event, name, kind, topics, regex, predicate, algorithms) -> the plans as they are.

    event: added, renamed, applies_to, algorithms, disabled or enabled; each carries what it changes, and of each column
    the last value that an event carried holds.  Columns: plan_id, plan, ..., is_active.
    """
    w = Window.partitionBy("plan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rule = F.when(F.col("event").isin("added", "applies_to"), F.struct("kind", "topics", "regex", "predicate"))
    switch = F.when(F.col("event") == "disabled", False).when(F.col("event").isin("enabled", "added"), True)
    every = changes.select("plan_id", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("seq"))).alias("back"), F.last("name", True).over(w).alias("plan"), F.last(rule, True).over(w).alias("rule"), F.last("algorithms", True).over(w).alias("algorithms"), F.last(switch, True).over(w).alias("is_active"))
    return every.where("back = 1").select("plan_id", "plan", "rule.*", "algorithms", "is_active")


def algorithm_changes(changes: DataFrame) -> DataFrame:
    """For each event that carries algorithms: those added and those dropped since the plan's event before it."""
    w = Window.partitionBy("plan_id").orderBy("seq")
    some = changes.where("algorithms is not null").withColumn("before", F.coalesce(F.lag("algorithms").over(w), F.array().cast("array<string>")))
    return some.select("plan_id", "seq", F.array_sort(F.array_except("algorithms", "before")).alias("added"), F.array_sort(F.array_except("before", "algorithms")).alias("dropped"))
