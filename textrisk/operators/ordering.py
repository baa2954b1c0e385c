"""Global order statistics without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textrisk.sources.scratch import materialized

_BEFORE = (W.unboundedPreceding, -1)
_FEWEST_SLICES = 16
_ACCURACY = 10_000


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based position in the order of ``order_by``.

    Range partitions are sorted in parallel and written once; then each needs only the row
    count of the partitions before it. Equal keys are spread by their input position.
    """
    seq, local, part = "_seq", "_local", "_part"
    ordered = (
        df.withColumn(seq, F.monotonically_increasing_id())
        .repartitionByRange(*order_by, seq)
        .sortWithinPartitions(*order_by, seq)
        .drop(seq)
        .withColumn(local, F.monotonically_increasing_id())
    )
    # The id holds the partition number above bit 33 and the position inside it below.
    written = materialized(ordered, "row-index").withColumn(part, F.shiftright(local, 33))
    sizes = written.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(part).rowsBetween(*_BEFORE))
    # One row per shuffle partition, so the broadcast is bounded by the session's partition number.
    offsets = sizes.select(part, F.coalesce(before, F.lit(0)).alias("_offset"))
    position = F.col("_offset") + F.col(local).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        written.join(F.broadcast(offsets), part)
        .withColumn(name, position)
        .select(*df.columns, name)
    )


def with_slice(stored: DataFrame, value_col: str, name: str = "_slice") -> DataFrame:
    """Add the number of the value's slice: slices follow the value order and hold about equally
    many rows each.

    ``stored`` is read twice, so it should be a written table, and its values should be distinct,
    so that no value can overfill a slice. There are as many slices as the session has shuffle
    partitions; only their bounds come to the driver.
    """
    slices = max(_FEWEST_SLICES, int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = [i / slices for i in range(1, slices)]
    found = stored.agg(F.percentile_approx(value_col, F.lit(marks), _ACCURACY)).first()[0]
    bounds = sorted({float(b) for b in found or [] if isfinite(b)})
    if not bounds:
        return stored.withColumn(name, F.lit(0))
    # Finds the slice by binary search; NaN, the largest value, is in a slice after all others.
    slicer = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")], inputCol="_sliced", outputCol="_bucket", handleInvalid="keep"
    )
    sliced = slicer.transform(stored.withColumn("_sliced", F.col(value_col).cast("double")))
    return sliced.select(*stored.columns, F.col("_bucket").cast("int").alias(name))


def exact_percentiles(
    df: DataFrame, value_col: str, fractions: Sequence[float], approximate: bool = False
) -> DataFrame:
    """One row: row count, mean and linearly interpolated percentiles of a numeric column.

    Rows collapse to one counted row per distinct value. Counts per slice of values tell where
    each slice starts; values are ordered only inside their slice.
    """
    value = F.col(value_col).cast("double")
    values = df.select(value.alias("_v")).filter(F.col("_v").isNotNull())
    names = [f"p{round(q * 100, 4):g}".replace(".", "_") for q in fractions]
    if approximate:
        points = [F.percentile_approx("_v", q, _ACCURACY).alias(n) for q, n in zip(fractions, names)]
        return values.agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), *points)

    counted = materialized(values.groupBy("_v").agg(F.count("*").alias("_n")), "value-counts")
    sliced = with_slice(counted, "_v")
    sizes = sliced.groupBy("_slice").agg(F.sum("_n").alias("_size"))
    starts = sizes.select(
        "_slice",
        F.coalesce(F.sum("_size").over(W.orderBy("_slice").rowsBetween(*_BEFORE)), F.lit(0)).alias(
            "_start"
        ),
        F.sum("_size").over(W.partitionBy()).alias("_total"),
    )
    inside = W.partitionBy("_slice").orderBy("_v").rowsBetween(*_BEFORE)
    ranked = sliced.withColumn("_lower", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    # One row per slice, so at most the session's number of shuffle partitions.
    placed = ranked.join(F.broadcast(starts), "_slice").withColumn(
        "_from", F.col("_start") + F.col("_lower")
    )

    def at_rank(rank: Column) -> Column:
        holds = (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n"))
        return F.max(F.when(holds, F.col("_v")))

    points = []
    for q, name in zip(fractions, names):
        rank = (F.col("_total") - 1) * F.lit(q)
        low, high = at_rank(F.floor(rank)), at_rank(F.ceil(rank))
        share = F.max(rank - F.floor(rank))
        points.append((low + (high - low) * share).alias(name))
    mean = F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")
    return placed.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), mean.alias("mean"), *points)
