"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; where its top bits are zero a chunk may end.
Chunking is normalised: before the normal size a rarer pattern is asked for, after it a commoner
one, so that chunk sizes gather around the normal one. The hash sees ``WINDOW`` bytes, and no
chunk is shorter, so an insertion or deletion changes the chunks around it and no others. The
fingerprint is the set of chunk digests, each with its chunk's length as its weight.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import as_batch, field_type, small_batches, texts_of

WINDOW = 16
SHORTEST, NORMAL, LONGEST = WINDOW, 32, 128
RARE_BITS, COMMON_BITS = 6, 4

# One 16-bit number per byte value, by rule.
GEAR = np.array([zlib.crc32(bytes([value, value ^ 0xA5])) & 0xFFFF for value in range(256)], np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear numbers of the last ``WINDOW`` bytes, each shifted left
    by its distance; built by doubling the window."""
    hashes = GEAR[data]
    reach = 1
    while reach < WINDOW:
        hashes[reach:] += hashes[:-reach] << np.uint16(reach)
        reach *= 2
    return hashes


def chunk_ends(size: int, rare: list[int], common: list[int], start: int) -> list[int]:
    """Ends of the chunks of the ``size`` bytes from ``start`` on.

    ``rare`` and ``common`` are the sorted places after which a chunk may end.
    """
    ends, at, stop = [], start, start + size
    while stop - at > SHORTEST:
        turn, most = at + NORMAL, min(at + LONGEST, stop)
        i = bisect_left(rare, at + SHORTEST)
        if i < len(rare) and rare[i] < turn:
            at = rare[i]
        else:
            i = bisect_left(common, turn)
            at = common[i] if i < len(common) and common[i] < most else most
        if at >= stop:
            break
        ends.append(at)
    if size:
        ends.append(stop)
    return ends


def fingerprints(blobs: list[bytes]) -> list[dict[int, int]]:
    """Of each blob: chunk digest to chunk length."""
    data = b"".join(blobs)
    hashes = gear_hashes(np.frombuffer(data, np.uint8))
    common_at = np.flatnonzero(hashes >> np.uint16(16 - COMMON_BITS) == 0)
    rare_at = common_at[hashes[common_at] >> np.uint16(16 - RARE_BITS) == 0]
    common_at, rare_at = common_at + 1, rare_at + 1
    out, start, crc = [], 0, zlib.crc32
    sizes = np.array([len(blob) for blob in blobs], np.int64)
    stops = np.cumsum(sizes)
    rare_parts = np.searchsorted(rare_at, stops).tolist()
    common_parts = np.searchsorted(common_at, stops).tolist()
    r = c = 0
    for size, r_stop, c_stop in zip(sizes.tolist(), rare_parts, common_parts, strict=True):
        ends = chunk_ends(size, rare_at[r:r_stop].tolist(), common_at[c:c_stop].tolist(), start)
        found, at = {}, start
        for end in ends:
            found[crc(data[at:end])] = end - at
            at = end
        out.append(found)
        start, r, c = start + size, r_stop, c_stop
    return out


def written(fingerprint: dict[int, int]) -> str:
    """Digests in order, eight hexadecimal digits each, then two for the length."""
    return "".join([f"{digest:08x}{fingerprint[digest]:02x}" for digest in sorted(fingerprint)])


def read_back(text: str) -> dict[int, int]:
    return {int(text[i : i + 8], 16): int(text[i + 8 : i + 10], 16) for i in range(0, len(text), 10)}


def likeness(one: dict[int, int], other: dict[int, int]) -> float:
    """The smaller of the two containments: shared length over the length of the longer one.

    Two empty fingerprints are alike; an empty one is like no other.
    """
    longer = max(sum(one.values()), sum(other.values()))
    if not longer:
        return 1.0
    shared = sum([size for digest, size in one.items() if digest in other])
    return shared / longer


def fingerprint(text: Column | str) -> Column:
    """The written fingerprint of a string column; null text has the empty one."""

    @F.arrow_udf(T.StringType())
    def of(column: pa.Array) -> pa.Array:
        found = fingerprints([t.encode() for t in texts_of(column)])
        return pa.array([written(f) for f in found], pa.string())

    return of(text)


def with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """Rows ``(part, ahead, id, text)``, partitioned by ``part`` and sorted so that each document
    is followed by the next one in descending order of id; null ids come last, equal ids in the
    order of their texts.

    Ids are cut into ``parts`` ranges (default: the session's shuffle partitions). The first
    document of a range is sent to the range before it, too, as the ``ahead`` row that follows
    its last; the first of all follows the last of all. The driver holds one id per range.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).alias("id"))
    places = [i / parts for i in range(1, parts)]
    cuts = ids.stat.approxQuantile("id", places, 0.1 / parts) if places else []
    cuts = np.unique(np.array(cuts, np.int64))

    def part_numbers(column: pa.Array) -> np.ndarray:
        """Higher ids have lower numbers; null ids the highest of all."""
        values = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        numbers = len(cuts) - np.searchsorted(cuts, values, side="right")
        return np.where(column.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, numbers)

    @F.arrow_udf(T.IntegerType())
    def part_of(column: pa.Array) -> pa.Array:
        return pa.array(part_numbers(column), pa.int32())

    firsts = sorted(ids.groupBy(part_of("id").alias("part")).agg(F.max("id").alias("id")).collect())
    before = {row["id"]: firsts[i - 1]["part"] for i, row in enumerate(firsts)}

    @F.arrow_udf(T.IntegerType())
    def ahead_of(column: pa.Array) -> pa.Array:
        return pa.array([before.get(value) for value in column.to_pylist()], pa.int32())

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = F.struct(part_of("id").alias("part"), F.lit(False).alias("ahead"))
    extra = F.struct(ahead_of("id").alias("part"), F.lit(True).alias("ahead"))
    return (
        rows.withColumn("place", F.explode(F.array(own, extra)))
        .select("place.*", "id", "text")
        .where("part IS NOT NULL")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "ahead", F.col("id").desc_nulls_last(), "text")
    )


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_chars``, the SHA-256 of the edited text, both written
    fingerprints, and the likeness to the edited and to the next text.

    The edited text is the text with its last third replaced by as many first characters of the
    next document in descending order of id (fewer if that is shorter). Null text counts as
    empty; a single document is its own next. Repeated rows and ids stay; other columns are
    dropped.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("id", field_type(docs, id_col)),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def compared(rows: list[tuple]) -> list[tuple]:
        """Of rows ``(id, text, next text)``."""
        texts, edits = [], []
        for _, text, following in rows:
            cut = len(text) // 3
            texts.append(text.encode())
            edits.append((text[: len(text) - cut] + following[:cut]).encode())
        prints = fingerprints(texts + [rows[-1][2].encode()])
        edited = fingerprints(edits)
        by_text = {row[1]: found for row, found in zip(rows, prints, strict=False)} | {rows[-1][2]: prints[-1]}
        return [
            (
                key,
                len(text),
                hashlib.sha256(edit).hexdigest(),
                written(own),
                written(changed),
                likeness(own, changed),
                likeness(own, by_text[following] if following in by_text else fingerprints([following.encode()])[0]),
            )
            for (key, text, following), edit, own, changed in zip(rows, edits, prints, edited, strict=False)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        waiting = None  # the last document, until its next one comes: part, id, text
        for batch in batches:
            ready = []
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for part, ahead, key, text in zip(*columns, texts_of(batch.column(3)), strict=True):
                if waiting is not None and waiting[0] == part:
                    ready.append((waiting[1], waiting[2], text))
                waiting = None if ahead else (part, key, text)
            if ready:
                yield as_batch(list(zip(*compared(ready), strict=True)), arrow)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
