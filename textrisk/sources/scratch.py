"""Durable intermediate results in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="textrisk-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused. ``release`` deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables made so far; call it when a job's results are written."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def materialized(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back, so that several readers share one run.

    ``options`` are those of the parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
