"""Merging: what one task groups doesn't grow with the input."""

from tidemark.operators import series


def test_tasks_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(series, "TASK_ROWS", 100)
    one = spark.range(1500).selectExpr("'one' as cohort", "'a' as topic", "id as t", "cast(id as double) as v")
    both = series.cohort_merge(one, one.withColumn("v", one.v + 2), one.selectExpr("'two' as cohort", "topic", "t", "if(t = 7, null, v) as v"))
    rows = both.rdd.glom().map(len).collect()
    assert sum(rows) == 2999 and max(rows) <= 200
    got = {(r.cohort, r.t): r.v for r in both.collect()}
    assert got == {**{("one", t): t + 1.0 for t in range(1500)}, **{("two", t): float(t) for t in range(1500) if t != 7}}
