"""Stretches reach their kernels whole, however adaptive execution deals the join with the state before them."""

import numpy as np
import pandas as pd

from tidemark.operators import detect


def test_cumulative_moments_over_many_partitions(spark, tmp_path, monkeypatch):
    from tidemark.operators import stretch

    monkeypatch.setattr(stretch, "STRETCH", 3000)
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"topic": np.repeat(["a", "b", "c"], 20_000), "t": np.tile(np.arange(20_000) * 400_000, 3), "v": rng.normal(50, 20, 60_000).round(2)})
    spark.createDataFrame(rows).repartition(8).write.parquet(f"file://{tmp_path}/points")
    ours = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "20kb"}
    old = {k: spark.conf.get(k) for k in ours}
    try:
        # the join with the state is planned by shuffle and becomes a broadcast, after which each task reads what one mapper wrote
        for k, v in ours.items():
            spark.conf.set(k, v)
        got = detect.moving_average(spark.read.parquet(f"file://{tmp_path}/points")).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows)
    for topic, own in got.groupby("topic"):
        own = own.sort_values("t")
        v = own.v
        mean, sd = v.expanding(2).mean().shift(), v.expanding(2).std().shift()
        assert np.allclose(own.expected, mean, equal_nan=True) and np.allclose(own.ceiling, mean + 3 * sd, equal_nan=True), topic
        assert (own.is_outlier.to_numpy() == ((v > mean + 3 * sd) | (v < mean - 3 * sd)).to_numpy()).all()
