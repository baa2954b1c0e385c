"""Explicit schemas of the tables that are read and written."""

from pyspark.sql import types as T

LABELED = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Id", "text", "label")]
)
UNLABELED = T.StructType([T.StructField(c, T.StringType()) for c in ("Id", "text")])
SUBMISSION = T.StructType(
    [T.StructField("Id", T.StringType()), T.StructField("TARGET", T.StringType())]
)
SPLIT = T.StructType([T.StructField(c, T.StringType()) for c in ("Id", "partition")])

# The files a data set consists of and their columns.
DATASET_FILES = {"train.csv": LABELED, "test.csv": UNLABELED, "sample_submission.csv": SUBMISSION}


def predictions(id_col: str = "Id") -> T.StructType:
    scores = ("risk_score", "ml_score", "heuristic_score", "unicode_score")
    return T.StructType(
        [T.StructField(id_col, T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in scores]
        + [T.StructField(c, T.StringType()) for c in ("decision", "reasons")]
    )
