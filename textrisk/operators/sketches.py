"""Percentiles of streams and of tables that grow: mergeable quantile sketches.

A sketch (KLL) has a bounded size, whatever it has seen, and two sketches merge into that of all
their rows. Kept per batch, they answer for any set of batches without a second read. The place
that a percentile really has is off by at most ``RANK_ERROR`` of the rows, at 99 % confidence;
``textrisk.operators.ordering.exact_percentiles`` is exact and reads the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

K = 400
RANK_ERROR = 2.296 / K**0.9021


def quantile_sketches(df: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, total, sketch`` per group; nulls and NaN are no values."""
    value = F.col(value_col).cast("double")
    known = F.when(~F.isnan(value), value)
    return df.groupBy(*by).agg(
        F.count(known).alias("n"),
        F.coalesce(F.sum(known), F.lit(0.0)).alias("total"),
        F.kll_sketch_agg_double(known, F.lit(K)).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketch of all rows of a group of sketches."""
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def sketch_percentiles(sketches: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """``n, mean`` and the percentiles of each sketch, in place of its bytes; null without values."""
    kept = [c for c in sketches.columns if c not in ("n", "total", "sketch")]
    points = [
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(f"p{round(q * 100, 4):g}".replace(".", "_"))
        for q in fractions
    ]
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return sketches.select(*kept, "n", mean.alias("mean"), *points)


def sketch_stream(stream: DataFrame, value_col: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep one sketch per micro-batch below ``sink``; ``spark.read.parquet(sink)`` has them all.

    A batch that is run again, after a failure, replaces its own folder.
    """

    def keep(batch: DataFrame, number: int) -> None:
        quantile_sketches(batch, value_col).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
