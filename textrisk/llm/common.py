"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.sources.scratch import scratch_path

# Rows that go to Python at once. Texts may be very long, and each executor has little memory.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
NULL_PARTS = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that one Arrow batch holds; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Bound the rows and bytes of Arrow batches of what is run inside; settings come back after."""
    wanted = {"maxRecordsPerBatch": rows, "maxBytesPerBatch": size}
    before = {}
    for name, most in wanted.items():
        key = f"spark.sql.execution.arrow.{name}"
        before[key] = spark.conf.get(key, None)
        now = int(before[key] or 0) if str(before[key] or 0).lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def null_part(key: str, spread: str) -> Column:
    """0 where there is a key, else a part number by another column, for joins in which rows without
    a key meet nothing but would all go to one task."""
    return F.when(F.col(key).isNull(), 1 + F.pmod(F.col(spread), F.lit(NULL_PARTS))).otherwise(0).cast("int")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs no second run, and what several readers see is the
    one committed result. ``textrisk.sources.scratch.release`` deletes all such tables, ``release``
    those given.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_batches(
    df: DataFrame, rows_of: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow`` of a function from one batch to some batches, given as column lists."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            if batch.num_rows:
                for columns in rows_of(batch):
                    yield as_batch(columns, arrow)

    return df.mapInArrow(run, kind)


def as_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """Columns (Arrow arrays, numpy arrays or lists) as a batch of that schema."""
    arrays = []
    for column, field in zip(columns, schema, strict=True):
        if not isinstance(column, pa.Array):
            column = pa.array(column, type=field.type)
        elif column.type != field.type:
            column = column.cast(field.type)
        arrays.append(column)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column; null is the empty text."""
    return ["" if text is None else text for text in column.to_pylist()]


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


class Remembered:
    """What ``learn`` says of words, kept for the words met last.

    There are two generations: when the young one is full it becomes the old one, so words that
    keep coming back stay, and the many that come once go. Forgetting changes no result.
    """

    def __init__(self, learn: Callable[[list[str]], dict], size: int = 250_000):
        self._learn, self._size = learn, size
        self._young: dict = {}
        self._old: dict = {}

    def lookup(self, words: set[str]) -> dict:
        """What is known, of these words at least."""
        if len(self._young) > self._size:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        new = []
        for word in words - young.keys():
            if word in old:
                young[word] = old[word]
            else:
                new.append(word)
        young.update(self._learn(new))
        return young
