"""Packing of documents into fixed-length sequences along a space-filling curve.

Each document's hashed token counts are projected to a few dimensions, and the point's place on
a Hilbert curve is its key: documents with similar vocabulary get near keys. The table is
range-sorted by key, and each range packs its documents one after the other, cutting them where
a sequence is full. The rest at the end of a range goes into sequences whose lengths are powers
of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import as_batch, field_type, map_batches, small_batches, stored, texts_of
from textrisk.llm.pretokens import BYTE_VOCABULARY, PreTokenizer, byte_alphabet, vocabulary_path

SEQUENCE_TOKENS = 1024  # a power of two
SEPARATOR = 0  # the id after each document
BUCKETS = 1024  # of the hashed token counts
DIMENSIONS, BITS = 4, 12  # of the curve's space


class IdEncoder:
    """Packed ids of whole texts.

    A byte-level vocabulary whose ids follow the order of its merges is a table of ranks, from
    which a second library encodes several times faster. It serves texts of plain characters,
    on which both split alike; all other texts go through the vocabulary's own library.
    """

    def __init__(self, vocabulary: str):
        self.pretokens = PreTokenizer(vocabulary)
        tokenizer = self.pretokens.tokenizer
        self.width = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(vocabulary_path(vocabulary), encoding="utf-8") as source:
            model = json.load(source)["model"]
        made = ["".join(merge if isinstance(merge, list) else merge.split(" ")) for merge in model["merges"]]
        order = np.array([model["vocab"][token] for token in made])
        value = {letter: byte for byte, letter in enumerate(byte_alphabet())}
        self._quick = None
        if (np.diff(order) > 0).all():
            ranks = {bytes([value[letter] for letter in token]): number for token, number in model["vocab"].items()}
            self._quick = tiktoken.Encoding(
                vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self._quick and self.pretokens.is_plain(text):
                ids = self._quick.encode_to_numpy(text, disallowed_special=())
            else:
                ids = np.array(self.pretokens.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            out.append(ids.astype(self.width).tobytes())
        return out


@lru_cache(maxsize=2)
def id_encoder(vocabulary: str) -> IdEncoder:
    return IdEncoder(vocabulary)


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    """One Gaussian direction per dimension, over the buckets."""
    return np.random.Generator(np.random.PCG64(20)).standard_normal((BUCKETS, DIMENSIONS))


def curve_points(documents: list[np.ndarray]) -> np.ndarray:
    """Of each document's ids: integer coordinates from its projected, damped, unit-length counts."""
    counts = np.zeros((len(documents), BUCKETS))
    for row, ids in enumerate(documents):
        bucket = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
        counts[row] = np.bincount(bucket, minlength=BUCKETS)
    np.sqrt(counts, out=counts)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    places = (counts / np.maximum(norms, 1e-9)) @ _directions()  # standard normal for any text
    top = (1 << BITS) - 1
    return np.clip((places + 4.0) / 8.0 * top, 0, top).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates below ``2 ** bits``.

    From the highest bit down, each level's cell is renamed so that the curve enters and leaves
    it at neighbouring corners; a Gray code then orders the cells.
    """
    axes = points.T.copy()
    n = len(axes)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(n):
            high = (axes[i] & level) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(high, below, swap)
            axes[i] ^= swap
        level >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((axes[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    axes ^= flip
    keys = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((axes[i] >> bit) & 1)
    return keys


def curve_table(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """``key, id, ids``: the place on the curve, and the ids packed in two or four bytes each,
    the separator last."""
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("id", field_type(docs, id_col)),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def rows_of(batch: pa.RecordBatch):
        encoder = id_encoder(vocabulary)
        packed = encoder.encode(texts_of(batch.column(1)))
        keys = hilbert_keys(curve_points([np.frombuffer(p, encoder.width) for p in packed]))
        end = np.array([SEPARATOR], encoder.width).tobytes()
        yield [keys, batch.column(0), [p + end for p in packed]]

    return map_batches(docs.select(id_col, text_col), rows_of, schema)


class _Packer:
    """Cuts documents into pieces; holds the pieces of the open sequence only."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.filled = 0
        self.open: list[tuple] = []  # id, start, its ids, tokens of the document

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            room = min(SEQUENCE_TOKENS - self.filled, len(ids) - at)
            self.open.append((key, at, ids[at : at + room], len(ids)))
            self.filled += room
            at += room
            if self.filled == SEQUENCE_TOKENS:
                yield from self._close(SEQUENCE_TOKENS)

    def _close(self, length: int) -> Iterator[tuple]:
        """Emit a sequence of the next ``length`` tokens; what is left over stays open."""
        offset, rest = 0, []
        for key, start, ids, total in self.open:
            part = ids[: length - offset]
            if len(part):
                crc = zlib.crc32(part.astype("<u4").tobytes())
                yield key, start, len(part), crc, total, self.sequence, offset
                offset += len(part)
            if len(part) < len(ids):
                rest.append((key, start + len(part), ids[len(part) :], total))
        self.open, self.filled, self.sequence = rest, self.filled - length, self.sequence + 1

    def finish(self) -> Iterator[tuple]:
        while self.filled:
            yield from self._close(1 << (self.filled.bit_length() - 1))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_VOCABULARY
) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32`` of its ids as little-endian
    unsigned 32-bit integers, ``doc_tokens``, ``sequence_id`` and ``offset``.

    Each document's ids (without added special tokens; special strings inside are their own ids)
    and the separator lie in exactly one piece each. Every sequence has 1024 tokens or a power of
    two, so there is no padding. Null and empty texts are their separator alone; repeated rows
    and ids are packed each; other columns are dropped. Documents with one key, copies for
    instance, are spread over ranges by a hash of their id.
    """
    small_batches(docs.sparkSession)
    kind = field_type(docs, id_col)
    long = T.LongType()
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, long) for n in names)])
    table = stored(curve_table(docs, id_col, text_col, vocabulary), "curve")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, width = to_arrow_schema(schema), id_encoder(vocabulary).width
        packer = _Packer(TaskContext.get().partitionId() << 32)
        for batch in batches:
            out = []
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.extend(packer.add(key, np.frombuffer(packed, width)))
            if out:
                yield as_batch(list(zip(*out, strict=True)), arrow)
        if out := list(packer.finish()):
            yield as_batch(list(zip(*out, strict=True)), arrow)

    spread = table.withColumn("tie", F.xxhash64("id"))
    ranges = spread.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "id", "ids")
    return ranges.select("id", "ids").mapInArrow(run, schema).withColumnRenamed("id", id_col)
