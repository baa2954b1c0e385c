"""Order-independent table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical(df: DataFrame, column: str) -> Column:
    """Length-prefixed text of a value, so that neighbouring values cannot run together."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.ArrayType, T.StructType, T.MapType)):
        value = F.to_json(value)
    value = value.cast("string")
    sized = F.concat(F.char_length(value).cast("string"), F.lit(":"), value)
    return F.coalesce(sized, F.lit("-"))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.sha2(F.concat(*[_canonical(df, c) for c in columns]), 256)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row count and a SHA-256 over all rows, whatever their order or partitioning.

    Equal rows collapse to a digest with a count. Digests are then combined as a tree, first by
    six leading hex digits, then by three, then all; digests are uniform, so every group stays
    small and no task sees the whole table.
    """
    digests = df.groupBy(row_digest(df, columns or df.columns).alias("_d")).agg(
        F.count("*").alias("_n")
    )

    def combined(value: Column) -> Column:
        return F.sha2(F.array_join(F.sort_array(F.collect_list(value)), ""), 256)

    leaf = F.concat("_d", F.lit(":"), F.col("_n").cast("string"), F.lit(";"))
    leaves = digests.groupBy(F.left("_d", F.lit(6)).alias("_p6")).agg(
        combined(leaf).alias("_h"), F.sum("_n").alias("_n")
    )
    branches = leaves.groupBy(F.left("_p6", F.lit(3)).alias("_p3")).agg(
        combined(F.concat("_p6", "_h")).alias("_h"), F.sum("_n").alias("_n")
    )
    return branches.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        combined(F.concat("_p3", "_h")).alias("fingerprint"),
    )


def fingerprint_value(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    return fingerprint(df, columns).first()["fingerprint"]
