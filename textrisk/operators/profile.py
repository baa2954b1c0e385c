"""Row counts, value counts and duplicate counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def duplicate_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: rows and the number of rows that repeat an earlier text.

    Texts are compared by their SHA-256, so that only digests are shuffled.
    """
    copies = df.groupBy(F.sha2(F.col(text_col), 256).alias("_digest")).agg(
        F.count("*").alias("_copies")
    )
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_texts"),
    )


def dataset_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: sizes of both tables, rows per class, and repeated training texts."""
    classes = train.agg(
        F.count("*").alias("train_rows"),
        F.count_if(F.col("target") == 0).alias("benign_rows"),
        F.count_if(F.col("target") == 1).alias("jailbreak_rows"),
    )
    repeated = duplicate_texts(train).select("duplicate_texts").scalar()
    unlabeled = test.agg(F.count("*")).scalar()
    return classes.withColumn("test_rows_unlabeled", unlabeled).withColumn(
        "duplicate_texts", repeated
    )


def decision_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("decision", "risk_level").agg(F.count("*").alias("rows"))
