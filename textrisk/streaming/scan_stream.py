"""The scan over a stream of files: stateless, append-only, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textrisk.functions.risk import RiskConfig
from textrisk.operators.models import Detector
from textrisk.plans.scan import scan_batch


def read_text_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files that arrive below ``path``; the file limit sizes a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def scan_stream(
    stream: DataFrame,
    detector: Detector,
    sink: str,
    checkpoint: str,
    text_col: str = "text",
    id_col: str = "Id",
    config: RiskConfig = RiskConfig(),
    available_now: bool = True,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Append flat predictions to parquet at ``sink``; each input file is scored exactly once.

    ``checkpoint`` is the folder of the stream's progress. A restart needs the same one, and one
    ``sink`` goes with one ``checkpoint``.
    """
    scored = scan_batch(stream, detector, text_col, id_col, config)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(sink)
    )
