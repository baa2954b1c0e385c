import numpy as np
from pyspark.sql import functions as F

from textrisk.operators.sketches import (
    RANK_ERROR,
    merged_sketches,
    quantile_sketches,
    sketch_percentiles,
    sketch_stream,
)


def off(values, estimate, fraction):
    """How far the place of an estimate is from the fraction asked for."""
    low, high = np.mean(values < estimate), np.mean(values <= estimate)
    return max(0.0, low - fraction, fraction - high)


def test_merged_sketches_stay_within_their_bound(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(size=30_000), np.full(10_000, 2.5)])
    rows = [(float(v), int(i) % 9) for i, v in enumerate(values)] + [(None, 1), (float("nan"), 2)]
    df = spark.createDataFrame(rows, "v double, part int").repartition(6)
    found = sketch_percentiles(merged_sketches(quantile_sketches(df, "v", ["part"])), (0.05, 0.5, 0.95, 0.999)).first()
    assert found["n"] == len(values) and np.isclose(found["mean"], values.mean())
    for name, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99_9", 0.999)):
        assert off(values, found[name], q) <= RANK_ERROR


def test_sketches_of_groups_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double")
    found = {r["g"]: r for r in sketch_percentiles(quantile_sketches(df, "v", ["g"]), (1.0,)).collect()}
    assert (found["a"]["n"], found["a"]["mean"], found["a"]["p100"]) == (2, 2.0, 3.0)
    assert (found["b"]["n"], found["b"]["mean"], found["b"]["p100"]) == (0, None, None)
    assert sketch_percentiles(merged_sketches(quantile_sketches(df.limit(0), "v", ["g"])), (0.5,)).first()["n"] == 0


def test_stream_keeps_a_sketch_per_batch(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sketches")
    for start in (0, 1000):
        spark.range(start, start + 1000).select(F.col("id").cast("double").alias("v")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("v double").parquet(source)
        sketch_stream(stream, "v", sink, str(tmp_path / "progress")).awaitTermination()
    kept = spark.read.parquet(sink)
    assert sorted(r["n"] for r in kept.collect()) == [1000, 1000]
    found = sketch_percentiles(merged_sketches(kept), (0.5,)).first()
    assert found["n"] == 2000 and abs(found["p50"] - 1000) <= 2000 * RANK_ERROR + 1
