"""Session set-up."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_BYTES = 8 << 20


def ship_package(spark: SparkSession, *siblings: str) -> SparkSession:
    """Send this package, and sibling packages, to the Python workers, once per application.

    Not needed where the packages are installed on every node or passed with ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="textrisk-package-")) / "textrisk.zip"
        with zipfile.ZipFile(archive, "w") as bundle:
            for package in ("textrisk", *siblings):
                for source in sorted((root / package).rglob("*.py")):
                    bundle.write(source, source.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start in here send Python workers batches of a few MB.

    A batch is held by the JVM and by the worker, beside what the worker makes of it, and rows of
    blocks and vectors are large.
    """
    before = spark.conf.get(_BATCH)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(_BATCH, min(_BATCH_BYTES, size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
