"""Token counts of whole texts without their ids.

Each block of documents lists its distinct pre-tokens and, for each, the documents that hold it
and how often. The lists are dealt out by the pre-token's hash, so that every occurrence of a
pre-token meets in one task, which counts its pieces once; multiplying by the frequencies gives
sums per document, which are added up per block. What is shuffled is one entry per document and
distinct pre-token, packed in binary; a word that occurs everywhere is one entry per block.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import Remembered, as_batch, field_type, small_batches, texts_of
from textrisk.llm.pretokens import WORD_VOCABULARY, PreTokenizer

# Documents, and characters, after which a block is closed.
BLOCK_DOCS = 4_000
BLOCK_CHARS = 16_000_000


class PieceCounter:
    """Pieces of single pre-tokens, by the library."""

    def __init__(self, vocabulary: str):
        self.pretokens = PreTokenizer(vocabulary)
        self.known = Remembered(self._learn)

    def _learn(self, new: list[str]) -> dict[str, int]:
        special, spell = self.pretokens.special, self.pretokens.spell
        pieces = self.pretokens.tokenizer.model.tokenize
        return {word: 1 if word in special else len(pieces(spell(word))) for word in new}

    def counts(self, pretokens: list[str]) -> np.ndarray:
        found = self.known.lookup(set(pretokens))
        return np.array([found[word] for word in pretokens], np.int64)


@lru_cache(maxsize=2)
def piece_counter(vocabulary: str) -> PieceCounter:
    return PieceCounter(vocabulary)


class _Block:
    """Documents of one block, and their pre-token frequencies."""

    def __init__(self):
        self.ids: list = []
        self.n_bytes: list[int] = []
        self.chars = 0
        self.words: dict[str, int] = {}
        self.entries: list[np.ndarray] = []  # per document: word number, frequency

    def add(self, key, text: str, pretokens: list[str]) -> None:
        counts = Counter(pretokens)
        words = self.words
        numbers = np.fromiter([words.setdefault(w, len(words)) for w in counts], np.int32, len(counts))
        self.entries.append(np.stack([numbers, np.fromiter(counts.values(), np.int32, len(counts))]))
        self.ids.append(key)
        self.n_bytes.append(len(text.encode()))
        self.chars += len(text)

    def rows(self, number: int, buckets: int) -> Iterator[tuple]:
        """A header with the documents, and for each bucket its words and entries."""
        yield number, number % buckets, self.ids, self.n_bytes, None, None, None
        words = list(self.words)
        home = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int32, len(words))
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), [e.shape[1] for e in self.entries])
        word, often = np.concatenate(self.entries, axis=1)
        order = np.lexsort((doc, word, home[word]))
        doc, word, often = doc[order], word[order], often[order]
        bounds = np.searchsorted(home[word], np.arange(buckets + 1))
        for bucket in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[bucket], bounds[bucket + 1])
            heads = np.flatnonzero(np.diff(word[part], prepend=-1))
            sizes = np.diff(np.append(heads, part.stop - part.start))
            listed = [words[w] for w in word[part][heads]]
            packed = np.stack([doc[part], often[part]]).astype(np.uint16 if often[part].max() < 65536 else np.int32)
            yield number, int(bucket), None, None, listed, sizes.astype(np.int32).tobytes(), packed.tobytes()


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = WORD_VOCABULARY,
    buckets: int | None = None,
) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8) and ``n_tokens``.

    Counts are those of the library without added special tokens; a special string inside a text
    is one token. Null and empty texts count 0. Repeated rows and ids stay, each with its count;
    other columns are dropped. ``buckets`` (default: the session's shuffle partitions, 64 at
    least) is the number of parts that the pre-tokens are dealt to. ``docs`` should be a stored
    table, whose rows come in the same order when a task is run again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = field_type(docs, id_col)
    long = T.LongType()
    listed = T.StructType(
        [
            T.StructField("block", long),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("n_bytes", T.ArrayType(long)),
            T.StructField("words", T.ArrayType(T.StringType())),
            T.StructField("sizes", T.BinaryType()),
            T.StructField("entries", T.BinaryType()),
        ]
    )
    summed = T.StructType([*listed.fields[:1], *listed.fields[2:4], T.StructField("sums", T.BinaryType())])
    result = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", long), T.StructField("n_tokens", long)])

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, split = to_arrow_schema(listed), piece_counter(vocabulary).pretokens.split
        number, block = TaskContext.get().partitionId() << 32, _Block()

        def close():
            rows = list(block.rows(number, buckets))
            for at in range(0, len(rows), 64):
                yield as_batch(list(zip(*rows[at : at + 64], strict=True)), arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                block.add(key, text, split(text))
                if len(block.ids) >= BLOCK_DOCS or block.chars >= BLOCK_CHARS:
                    yield from close()
                    number, block = number + 1, _Block()
        if block.ids:
            yield from close()

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, counter = to_arrow_schema(summed), piece_counter(vocabulary)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["words"] is None:
                    out.append((row["block"], row["ids"], row["n_bytes"], None))
                    continue
                pieces = counter.counts(row["words"])
                sizes = np.frombuffer(row["sizes"], np.int32)
                entries = np.frombuffer(row["entries"], _entry_type(len(row["entries"]), sizes))
                doc, often = entries.reshape(2, -1).astype(np.int64)
                sums = np.bincount(doc, weights=often * np.repeat(pieces, sizes)).astype(np.int64)
                out.append((row["block"], None, None, _narrow(sums)))
            if out:
                yield as_batch(list(zip(*out, strict=True)), arrow)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the header first."""
        arrow, head, total = to_arrow_schema(result), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    if head:
                        yield as_batch([head["ids"], head["n_bytes"], total], arrow)
                    head, total = row, np.zeros(len(row["ids"]), np.int64)
                else:
                    sums = _wide(row["sums"])
                    total[: len(sums)] += sums
        if head:
            yield as_batch([head["ids"], head["n_bytes"], total], arrow)

    lists = docs.select(id_col, text_col).mapInArrow(list_words, listed)
    sums = lists.repartition(buckets, "bucket").mapInArrow(count_pieces, summed)
    by_block = sums.repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
    return by_block.mapInArrow(add_up, result).withColumnRenamed("id", id_col)


def _entry_type(n_bytes: int, sizes: np.ndarray):
    return np.uint16 if n_bytes == 4 * int(sizes.sum()) else np.int32


def _narrow(sums: np.ndarray) -> bytes:
    """The width in bytes, then the numbers."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if sums.max(initial=0) <= np.iinfo(kind).max:
            return bytes([kind().itemsize]) + sums.astype(kind).tobytes()
    return b"\x08" + sums.tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)
