"""Inspection of a data set folder: required files, schemas, sizes, label counts, repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from textrisk.operators.profile import dataset_summary, value_counts
from textrisk.sources.schemas import DATASET_FILES
from textrisk.sources.tables import load_labeled, missing_files, read_csv


@dataclass(frozen=True)
class DatasetProfile:
    """A one-row summary, and counts per label and per target."""

    summary: DataFrame
    labels: DataFrame
    targets: DataFrame


def profile_dataset(spark: SparkSession, folder: str) -> DatasetProfile:
    """Raise when a required file, column or label is wrong; else describe the data set.

    The files may lie at any depth below ``folder``.
    """
    absent = [row["name"] for row in missing_files(spark, folder).collect()]
    if absent:
        raise FileNotFoundError(f"data set is missing: {absent}")

    def read(name: str) -> DataFrame:
        return read_csv(spark, folder, DATASET_FILES[name], named=name)

    train = load_labeled(read("train.csv"))
    test, submission = read("test.csv"), read("sample_submission.csv")
    # A header that differs from the schema fails the read, also where no row is used.
    submission.head(1)
    return DatasetProfile(
        dataset_summary(train, test), value_counts(train, "label"), value_counts(train, "target")
    )

