"""Operator 5: mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """(source, source_size) -> the same with target: weights 1..cycle in code point order, capped water level.

    One row per source.  A source stops at ``cap`` times its size; the excess is shared again by weight.  The level L
    with sum(min(cap * size, L * weight)) = total comes from one ordered pass over the sources.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    ratio = F.col("source_size") / F.col("weight")
    by_fill = every.orderBy(ratio, F.col("source").asc_nulls_last())
    so_far = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sizes.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * cap).over(so_far), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
        .withColumn("ratio", ratio)
    )
    # the first source, in filling order, that stays under its stop sets the level for all after it
    under = F.when(F.col("level") <= F.col("ratio") * cap, F.struct("ratio", "source", "level"))
    stop = F.col("source_size") * F.lit(cap)
    return level.withColumn("water", F.min(under).over(every)["level"]).select(
        "source", "source_size", F.coalesce(F.least(stop, F.col("water") * F.col("weight")), stop).alias("target")
    )


def balance(groups: DataFrame, wanted: DataFrame, cap: float = 3.0, ridge: float = 0.05, rounds: int = 30, tolerance: float = 1e-7) -> DataFrame:
    """Entropy balancing.  groups: (source, size, n, x): n documents of that size; wanted: (source, target).

    Over rates r in [0, cap] it minimises  sum n*size*(r*log r - r + 1)  with, for every source, sum n*size*r = target,
    and a ridge-weighted constraint that the mix keeps the corpus' mean of x (the log size), which ties the sources to
    each other.  The dual is smooth and convex; its solution is the exponential tilt r = min(cap, exp(l_source + b*x)).
    Every Newton round is one grouped aggregation: the Hessian is an arrow (one diagonal entry per source and one
    border), so Schur's complement needs sums per source and one row of totals, all of them DataFrame columns.
    Returns groups with ``rate``.  A source of target 0 gets rate 0.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("t")).first().t or 1.0
    dual = written(wanted.where("target > 0").select("source", "target", F.log(F.col("target") / F.col("source_size")).alias("l")), "dual")
    b = 0.0
    for _ in range(rounds):
        rated = groups.alias("g").join(dual.alias("d"), F.col("g.source").eqNullSafe(F.col("d.source")))
        free = F.exp(F.col("l") + F.lit(b) * F.col("x"))
        m = F.col("n") * F.col("size")
        inner = F.when(free < cap, free).otherwise(F.lit(0.0))  # the capped documents don't move
        sums = written(
            rated.groupBy("d.source", "target", "l").agg(
                F.sum(m * F.least(free, F.lit(cap))).alias("mass"),
                F.sum(m * F.least(free, F.lit(cap)) * F.col("x")).alias("moment"),
                F.sum(m * inner).alias("a"),
                F.sum(m * inner * F.col("x")).alias("c"),
                F.sum(m * inner * F.col("x") * F.col("x")).alias("q"),
            ),
            "newton",
        )
        gap = F.col("mass") - F.col("target")
        live = F.col("a") > 1e-12 * F.col("target")
        s = sums.agg(
            F.sum("moment").alias("moment"),
            F.sum("q").alias("q"),
            F.sum(F.when(live, F.col("c") * F.col("c") / F.col("a"))).alias("cc"),
            F.sum(F.when(live, F.col("c") * gap / F.col("a"))).alias("cg"),
            F.max(F.abs(gap) / F.col("target")).alias("worst"),
        ).first()
        if s.moment is None:
            break
        weight = ridge * total
        step = -((s.moment + weight * b) - (s.cg or 0.0)) / max(s.q + weight - (s.cc or 0.0), 1e-9 * total)
        step = max(-1.0, min(1.0, step))
        b += step
        move = F.when(live, -(gap + F.col("c") * F.lit(step)) / F.col("a")).otherwise(F.lit(0.0))
        dual = sums.select("source", "target", (F.col("l") + F.least(F.greatest(move, F.lit(-1.0)), F.lit(1.0))).alias("l"))
        if abs(step) < tolerance and s.worst < tolerance:
            break
    dual = written(dual, "dual")
    rate = F.least(F.lit(cap), F.exp(F.col("l") + F.lit(b) * F.col("x")))
    return groups.alias("g").join(dual.alias("d"), F.col("g.source").eqNullSafe(F.col("d.source")), "left").select("g.*", F.coalesce(rate, F.lit(0.0)).alias("rate"), "target")


#: Sizes of a source whose rates are rounded in one pass.
RUN = 256


def rounded(rated: DataFrame, cap: int) -> DataFrame:
    """(source, size, n, rate) -> (source, size, copies): whole numbers of copies, at most cap * n.

    A source's sizes are cut into runs of RUN.  Within a run, from long to short, copies keep the running sum nearest to
    what the rates have due, so a run ends less than half its shortest text off where the cap leaves room.  The shortest
    run goes last and starts with what all others were off, so the source ends that near as well.
    """
    place = F.row_number().over(Window.partitionBy("source").orderBy("size")) - 1
    runs = rated.withColumn("run", F.floor(place / RUN)).groupBy("source", "run").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "n", "rate"))).alias("sizes"))
    out = "array<struct<size: bigint, copies: bigint>>"

    def carry(state: Column, one: Column) -> Column:
        size = -one["s"]
        due = state["due"] + one["n"] * one["rate"] * size
        copies = F.least(F.greatest(F.round((due - state["got"]) / size), F.lit(0.0)), (one["n"] * cap).cast("double")).cast("long")
        return F.struct(due.alias("due"), (state["got"] + copies * size).alias("got"), F.concat(state["out"], F.array(F.struct(size.alias("size"), copies.alias("copies")))).alias("out"))

    def settled(frame: DataFrame, begun: Column) -> DataFrame:
        start = F.struct(begun.cast("double").alias("due"), F.lit(0.0).alias("got"), F.array().cast(out).alias("out"))
        return frame.withColumn("done", F.aggregate("sizes", start, carry))

    long = written(settled(runs.where("run > 0"), F.lit(0)).select("source", "done"), "runs")
    off = long.groupBy("source").agg(F.sum(F.col("done.due") - F.col("done.got")).alias("off"))
    short = runs.where("run = 0").alias("r").join(off.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")), "left").select("r.source", "sizes", F.coalesce("off", F.lit(0.0)).alias("off"))
    every = long.unionByName(settled(short, F.col("off")).select("source", "done"))
    return every.select("source", F.explode("done.out").alias("o")).select("source", "o.size", "o.copies")


def mix(docs: DataFrame, cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salt_rows: int = 500) -> DataFrame:
    """Returns every row of docs as (id_col, size, source, source_size, target, rate, copies, taken).

    size: words of the text (null text: 0).  copies (0..cap) is a whole number of repeats, taken = copies * size.  Documents of one source and
    size share a rate; per source the rates are rounded into copies from long to short texts, the error carried from
    one size to the next, so a source misses its target by less than half its shortest text where the cap leaves room.
    Which documents of a size get the extra copy follows a hash of their id, so reruns agree; rows that are equal in
    every column are interchangeable.  A hot (source, size) is dealt to salts of about ``salt_rows`` documents; copies
    are shared over salts before documents are ranked, so no task holds a whole source.

    Null ids, texts and sources are allowed (null source: a source of its own, last); an empty table gives no rows;
    texts without words are taken 0 times; extra columns are ignored.
    """
    spark = docs.sparkSession
    base = written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.lit("mix")).alias("h")), "sizes")
    groups = written(base.groupBy("source", "size").agg(F.count("*").alias("n")), "groups")
    by_source = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    wanted = written(targets(by_source, float(cap)), "targets")
    words = F.log1p(F.col("size").cast("double"))
    moments = groups.agg((F.sum(F.col("n") * F.col("size") * words) / F.sum(F.col("n") * F.col("size"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("size") * words * words) / F.sum(F.col("n") * F.col("size"))).alias("r")).first()
    mean, spread = (moments.m or 0.0), 1.0
    if moments.m is not None:
        spread = max(1e-6, (moments.r**2 - moments.m**2) ** 0.5 if moments.r**2 > moments.m**2 else 1.0)
    rated = balance(groups.where("size > 0").withColumn("x", (words - mean) / spread), wanted, float(cap))
    dealt = rounded(rated, cap)
    plan = groups.alias("g").join(dealt.alias("d"), F.col("g.source").eqNullSafe(F.col("d.source")) & (F.col("g.size") == F.col("d.size")), "left").select("g.source", "g.size", "n", F.coalesce("copies", F.lit(0)).alias("copies"))
    plan = plan.alias("p").join(wanted.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source"))).select("p.*", "source_size", "target", F.ceil(F.col("n") / F.lit(salt_rows)).alias("salts"))
    plan = written(plan, "plan")
    keyed = base.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.size") == F.col("p.size"))).select("b.*", "n", "copies", "source_size", "target", F.pmod("h", "salts").alias("salt"))
    keyed = written(keyed, "keyed")
    salted = keyed.groupBy("source", "size", "salt").agg(F.count("*").alias("here"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    upto = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    extra = F.col("copies") % F.col("n")
    share = salted.withColumn("end", F.sum("here").over(upto)).select(
        "source", "size", "salt", "here",
        # the salt's share of the extra copies, by the whole numbers that its part of the running share passes
        (F.floor(extra * F.col("end") / F.col("n")) - F.floor(extra * (F.col("end") - F.col("here")) / F.col("n"))).cast("long").alias("extra"),
    )
    rank = F.row_number().over(Window.partitionBy("k.source", "k.size", "k.salt").orderBy("k.h", "k._id"))
    same = F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col("k.size") == F.col("s.size")) & (F.col("k.salt") == F.col("s.salt"))
    ranked = keyed.alias("k").join(share.alias("s"), same).select("k.*", "extra", rank.alias("rank"))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("rank") <= F.col("extra")).cast("long")
    return ranked.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
