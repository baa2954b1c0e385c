"""Published models: every version stays, and readers see whole ones only.

A version is written to a folder of its own, which nothing refers to yet. One small record then
names it: written aside and renamed to the next free number, so it is there in full or not at all.
Readers take the record with the highest number. A publisher that fails before the rename leaves
the version before it in place, and of two that race for a number one takes the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textrisk.operators.models import load_detector

_DIGITS = 10
_SCHEMA = "version bigint, folder string, note string"


def _file_system(spark: SparkSession, path: str):
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    return home.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path


def _records(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """All records by ascending number; there is one per published version."""
    system, at = _file_system(spark, path)
    home = at(f"{path}/records")
    if not system.exists(home):
        return []
    names = [status.getPath().getName() for status in system.listStatus(home)]
    out = []
    for name in sorted(n for n in names if n.isdigit() and len(n) == _DIGITS):
        stream = system.open(at(f"{path}/records/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        out.append((int(name), json.loads(text)))
    return out


def publish(spark: SparkSession, path: str, write: Callable[[str], None], note: dict | None = None) -> int:
    """Let ``write`` fill a new folder, then make it the current version; gives the version."""
    folder = f"versions/{uuid.uuid4().hex}"
    write(f"{path}/{folder}")
    system, at = _file_system(spark, path)
    system.mkdirs(at(f"{path}/records"))
    aside = at(f"{path}/records/.{uuid.uuid4().hex}")
    stream = system.create(aside, False)
    stream.write(bytearray(json.dumps({"folder": folder, "note": note or {}}).encode("utf-8")))
    stream.close()
    version = max((number for number, _ in _records(spark, path)), default=0) + 1
    while True:
        target = at(f"{path}/records/{version:0{_DIGITS}d}")
        if not system.exists(target) and system.rename(aside, target):
            return version
        version += 1


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``version, folder, note`` of every published version."""
    rows = [(n, f"{path}/{record['folder']}", json.dumps(record["note"])) for n, record in _records(spark, path)]
    return spark.createDataFrame(rows, _SCHEMA)


def published(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, str, dict]:
    """Number, folder and note of a version, by default of the current one."""
    found = dict(_records(spark, path))
    if not found or (version is not None and version not in found):
        raise LookupError(f"{path} has no such version")
    number = max(found) if version is None else version
    return number, f"{path}/{found[number]['folder']}", found[number]["note"]


def publish_detector(spark: SparkSession, path: str, detector, note: dict | None = None) -> int:
    """Publish a fitted detector; the version can be loaded before it becomes the current one."""

    def write(folder: str) -> None:
        detector.save(folder)
        load_detector(spark, folder, detector.artifact_type)

    return publish(spark, path, write, {"artifact_type": detector.artifact_type, **(note or {})})


def current_detector(spark: SparkSession, path: str, version: int | None = None):
    """The detector of a version, by default of the current one."""
    _, folder, note = published(spark, path, version)
    return load_detector(spark, folder, note["artifact_type"])
