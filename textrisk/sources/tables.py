"""CSV, JSON and parquet readers and writers with fixed options."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrisk.functions.labels import TRAINING_LABELS, mapped_label
from textrisk.operators import checks
from textrisk.sources import schemas

_QUOTING = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
# Spaces inside a field belong to it, and an empty string is not a missing value.
_VERBATIM = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A parquet table in as many partitions as its files split into, unless the caller says so.

    ``partitions`` shuffles the rows; it is meant for single small files, which do not split.
    """
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multiline: bool = True,
    enforce_header: bool = True,
    named: str | None = None,
) -> DataFrame:
    """Quoted CSV with header; a byte order mark, doubled quotes and line breaks are handled.

    A multi-line file cannot be split, so large inputs should come as many files. Pass
    ``multiline=False`` where no field holds a line break and files are split as usual. ``named``
    reads the files of that name at any depth below ``path``.
    """
    reader = spark.read.schema(schema).options(
        **_QUOTING, **_VERBATIM, multiLine=multiline, enforceSchema=not enforce_header
    )
    if named:
        reader = reader.options(pathGlobFilter=named, recursiveFileLookup=True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.options(**_QUOTING, **_VERBATIM, emptyValue='""', quoteAll=False).mode(mode).csv(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON document, one object or list per file, as rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small report (a bounded number of rows) as one JSON list, nulls included."""
    rows = F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"})
    df.agg(rows.alias("value")).coalesce(1).write.mode(mode).text(path)


def write_document(spark: SparkSession, payload: dict, path: str, mode: str = "errorifexists") -> None:
    """One nested document, such as a manifest, as a one-line JSON text file."""
    row = spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "value string")
    row.coalesce(1).write.mode(mode).text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def load_labeled(df: DataFrame, checked: bool = True) -> DataFrame:
    """``Id, text, label`` with the 0/1 ``target`` added.

    ``checked`` runs the null and label-domain checks as jobs of their own; they raise.
    """
    checks.require_exact_columns(df, schemas.LABELED.names, "training table")
    if checked:
        checks.require_no_nulls(df, schemas.LABELED.names)
        checks.require_known_labels(df, "label", TRAINING_LABELS)
    return df.withColumn("text", F.col("text").cast("string")).withColumn(
        "target", mapped_label(F.col("label"), TRAINING_LABELS)
    )


def missing_files(spark: SparkSession, folder: str, required=tuple(schemas.DATASET_FILES)) -> DataFrame:
    """Required file names that are not below ``folder``; file contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter="*.csv")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"))
    )
    wanted = spark.createDataFrame([(name,) for name in required], "name string")
    return wanted.join(found, "name", "left_anti").orderBy("name")
