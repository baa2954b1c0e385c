"""Schema checks, and data checks that run as their own aggregate job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrisk.functions.labels import mapped_label


def require_exact_columns(df: DataFrame, expected: Sequence[str], name: str = "table") -> None:
    if df.columns != list(expected):
        raise ValueError(f"{name} has schema {df.columns}, not {list(expected)}")


def require_columns(df: DataFrame, needed: Iterable[str]) -> None:
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"input must contain {', '.join(absent)}; found {df.columns}")


def require_string_column(df: DataFrame, name: str) -> None:
    require_columns(df, [name])
    if not isinstance(df.schema[name].dataType, T.StringType):
        raise TypeError(f"{name} must be a string column, not {df.schema[name].dataType}")


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("input has no rows")


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of nulls in each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def require_no_nulls(df: DataFrame, columns: Sequence[str]) -> None:
    found = {k: v for k, v in null_report(df, columns).first().asDict().items() if v}
    if found:
        raise ValueError(f"null values: {found}")


def unknown_labels(df: DataFrame, label_col: str, spellings: dict[str, int]) -> DataFrame:
    """Distinct labels outside the domain, sorted."""
    label = F.col(label_col)
    return (
        df.filter(mapped_label(label, spellings).isNull())
        .select(label.cast("string").alias("label"))
        .distinct()
        .orderBy("label")
    )


def require_known_labels(
    df: DataFrame, label_col: str, spellings: dict[str, int], shown: int = 20
) -> None:
    """Raise when a label is outside the domain, with their number and the first ``shown``; the
    full list is ``unknown_labels``."""
    found = unknown_labels(df, label_col, spellings)
    number = found.count()
    if number:
        first = [r["label"] for r in found.limit(shown).collect()]
        raise ValueError(f"{number} labels outside the domain, among them {first}")


def _outside_unit(score: Column) -> Column:
    return ~F.coalesce(score.between(0.0, 1.0), F.lit(False)) | F.isnan(score.cast("double"))


def score_range_violations(df: DataFrame, score_cols: Sequence[str]) -> DataFrame:
    """One row per score column with the number of values outside [0, 1]; null counts."""
    counts = df.agg(*[F.count_if(_outside_unit(F.col(c))).alias(c) for c in score_cols])
    return counts.unpivot([], list(score_cols), "component", "violations")


def require_scores_in_range(df: DataFrame, score_cols: Sequence[str]) -> None:
    bad = score_range_violations(df, score_cols).filter("violations > 0").collect()
    if bad:
        raise ValueError(f"scores outside the unit interval: {[r.asDict() for r in bad]}")


def split_check(frame: DataFrame, split: DataFrame, id_col: str = "Id") -> DataFrame:
    """One row: frame ids without a partition, and rows per partition name."""
    ids = frame.select(F.col(id_col).cast("string").alias("_id"))
    known = split.select(F.col(id_col).cast("string").alias("_id"), "partition")
    joined = ids.join(known, "_id", "left")
    return joined.agg(
        F.count_if(F.col("partition").isNull()).alias("unmapped"),
        F.count_if(F.col("partition") == "train").alias("train_rows"),
        F.count_if(F.col("partition") == "validation").alias("validation_rows"),
        F.count_if(~F.col("partition").isin("train", "validation")).alias("other_rows"),
    )


def require_split_matches(frame: DataFrame, split: DataFrame, id_col: str = "Id") -> None:
    found = split_check(frame, split, id_col).first()
    complete = found["unmapped"] == 0 and found["other_rows"] == 0
    if not (complete and found["train_rows"] and found["validation_rows"]):
        raise ValueError(f"split does not match the frame: {found.asDict()}")


def require_frozen(manifest: dict, known_types: Iterable[str]) -> None:
    if manifest.get("status") != "frozen":
        raise RuntimeError(f"expected a frozen manifest, found status {manifest.get('status')!r}")
    kind = manifest["model"]["artifact_type"]
    if kind not in set(known_types):
        raise ValueError(f"no loader for artifacts of type {kind!r}")
