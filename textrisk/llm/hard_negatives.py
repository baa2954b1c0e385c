"""Hard negatives of anchors, from a secondary sort of pair scores.

Scores are inner products of vectors in whole units, so they are exact. A pair's key packs the
anchor, the score in descending order and the row's id; pairs are dealt by anchor and sorted by
key inside each partition, which is what ``repartitionAndSortWithinPartitions`` does. An iterator
then walks down each anchor's pairs: the first rows of the same label are its positives, each of
which opens a window of scores below it, and rows of other labels are emitted as they pass an
open window. No anchor's pairs are ever held.

All rows are scored against all anchors in blocks, but few pairs are sent: of each task the best
pairs of the same label (from which the positives are known) and then, as windows are known,
the best pairs in each window. Anchors are sent to all tasks in chunks of ``CHUNK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import as_batch, bounded_batches, stored

CHUNK_BYTES = 16 << 20  # of anchors that are broadcast and scored in one pass
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 512  # scored at once

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_NO_SCORE = _LEAST  # below every score
_PAIR = np.dtype([(n, ">u8") for n in ("anchor", "anchor_mark", "down")] + [("kind", "u1"), ("id", ">u8"), ("mark", ">u8")])
_POSITIVE, _NEGATIVE = 0, 1  # of equal scores the positives come first
_FIELDS = ("anchor", "score", "id", "mark")


# ---- keys ---------------------------------------------------------------------------------


def _ascending(numbers: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order."""
    return np.asarray(numbers, np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def pack_keys(anchor, anchor_mark, score, kind: int, ids, marks) -> pa.Array:
    """Keys whose byte order is that of anchor, descending score, kind, id and mark."""
    out = np.empty(len(score), _PAIR)
    out["anchor"], out["anchor_mark"] = _ascending(anchor), _ascending(anchor_mark)
    out["down"] = ~_ascending(score)
    out["kind"], out["id"], out["mark"] = kind, _ascending(ids), _ascending(marks)
    ends = np.arange(len(out) + 1, dtype=np.int32) * _PAIR.itemsize
    return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])


def unpack_keys(keys: pa.Array) -> Iterator[tuple[int, ...]]:
    """``anchor, anchor_mark, score, kind, id, mark`` of each key."""
    packed = np.frombuffer(b"".join(keys.to_pylist()), _PAIR)

    def signed(numbers: np.ndarray) -> list[int]:
        return (numbers.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).tolist()

    columns = (signed(packed["anchor"]), signed(packed["anchor_mark"]), signed(~packed["down"].astype(np.uint64)))
    return zip(*columns, packed["kind"].tolist(), signed(packed["id"]), signed(packed["mark"]), strict=True)


# ---- scores -------------------------------------------------------------------------------


def inner_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, kept at the ends of the 64-bit range."""
    most = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (rows, anchors)]
    bound = most[0] * most[1] * max(1, rows.shape[1])
    if bound < 1 << 53:
        return (rows.astype(np.float64) @ anchors.T.astype(np.float64)).astype(np.int64)
    if bound < _MOST:
        return rows @ anchors.T
    exact = rows.astype(object) @ anchors.T.astype(object)
    return np.clip(exact, _LEAST + 1, _MOST).astype(np.int64).reshape(len(rows), len(anchors))


def _first(found: dict[str, np.ndarray], most: int) -> dict[str, np.ndarray]:
    """Of each anchor the first ``most`` pairs, by descending score, id and mark."""
    order = np.lexsort((found["mark"], found["id"], ~found["score"], found["anchor"]))
    anchor = found["anchor"][order]
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, int)
    place = np.arange(len(anchor)) - np.repeat(starts, np.diff(np.append(starts, len(anchor))))
    kept = order[place < most]
    return {name: column[kept] for name, column in found.items()}


class _Best:
    """The first pairs of every anchor met so far."""

    def __init__(self, anchors: int, most: int):
        self.most = most
        self.found = {name: np.zeros(0, np.int64) for name in _FIELDS}
        self.least = np.full(anchors, _NO_SCORE)  # scores below these are out

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        """``scores`` of some rows against the anchors from ``at`` on; ``_NO_SCORE`` is no pair."""
        end = at + scores.shape[1]
        least = self.least[at:end]
        if len(scores) >= self.most:
            cut = len(scores) - self.most
            least = np.maximum(least, np.partition(scores, cut, axis=0)[cut])
        row, anchor = np.nonzero((scores >= least) & (scores > _NO_SCORE))
        if not len(row):
            return
        new = dict(zip(_FIELDS, (anchor + at, scores[row, anchor], ids[row], marks[row]), strict=True))
        self.found = _first({n: np.concatenate([self.found[n], new[n]]) for n in _FIELDS}, self.most)
        held, last, count = self.found["anchor"], self.found["score"], np.bincount(self.found["anchor"], minlength=len(self.least))
        full = np.flatnonzero(count == self.most)
        self.least[full] = last[np.searchsorted(held, full, "right") - 1]


@dataclass
class _Chunk:
    """Anchors of one vector length, and the score windows of their positives once known."""

    ids: np.ndarray
    marks: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """``id, mark, label, vector`` of rows of one vector length."""
    for batch in batches:
        ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        labels = np.array(batch.column(2).to_pylist())
        units = batch.column(3)
        lengths = units.value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            flat = units.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield ids[at], marks[at], labels[at], flat.reshape(len(at), length)


def _scored(chunks: dict[int, _Chunk], block: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """Scores of a block of rows, for some anchors at a time, and which labels agree."""
    ids, marks, labels, vectors = block
    chunk = chunks.get(vectors.shape[1])
    if chunk is None:
        return
    for at in range(0, len(chunk.ids), BLOCK_ANCHORS):
        part = slice(at, at + BLOCK_ANCHORS)
        scores = inner_products(vectors, chunk.vectors[part])
        own = (ids[:, None] == chunk.ids[part]) & (marks[:, None] == chunk.marks[part])
        same = labels[:, None] == chunk.labels[part]
        yield chunk, at, scores, same & ~own, ~same


def _keys(chunk: _Chunk, kind: int, found: dict[str, np.ndarray]) -> list:
    anchor = found["anchor"]
    ids, marks = chunk.ids[anchor], chunk.marks[anchor]
    return [ids, pack_keys(ids, marks, found["score"], kind, found["id"], found["mark"])]


def _best_positives(chunks: dict[int, _Chunk], most: int, block_rows: Iterator[tuple]) -> Iterator[list]:
    best = {length: _Best(len(chunk.ids), most) for length, chunk in chunks.items()}
    for block in block_rows:
        for _, at, scores, same, _ in _scored(chunks, block):
            best[block[3].shape[1]].add(at, np.where(same, scores, _NO_SCORE), block[0], block[1])
    for length, chunk in chunks.items():
        yield _keys(chunk, _POSITIVE, best[length].found)


def _best_negatives(chunks: dict[int, _Chunk], most: int, block_rows: Iterator[tuple]) -> Iterator[list]:
    best = {
        length: [_Best(len(chunk.ids), most) for _ in range(chunk.low.shape[1])] for length, chunk in chunks.items()
    }
    for block in block_rows:
        for chunk, at, scores, _, other in _scored(chunks, block):
            part = slice(at, at + scores.shape[1])
            for nth, held in enumerate(best[block[3].shape[1]]):
                inside = other & (scores >= chunk.low[part, nth]) & (scores <= chunk.high[part, nth])
                if inside.any():
                    held.add(at, np.where(inside, scores, _NO_SCORE), block[0], block[1])
    for length, chunk in chunks.items():
        for pairs in _once(best[length]):
            yield _keys(chunk, _NEGATIVE, pairs)


def _once(windows: list[_Best]) -> Iterator[dict[str, np.ndarray]]:
    """The pairs of overlapping windows, each pair once."""
    rows = [np.stack([held.found[name] for name in _FIELDS], axis=1) for held in windows]
    if rows:
        pairs = np.unique(np.concatenate(rows), axis=0)
        yield dict(zip(_FIELDS, pairs.T, strict=True))


# ---- the operator -------------------------------------------------------------------------


@dataclass(frozen=True)
class Window:
    """How far below a positive's score a negative's may lie, in hundredths of it."""

    low: int = 30
    high: int = 90

    def __post_init__(self):
        if not 0 <= self.low < self.high < 100:
            raise ValueError("a window lies below its positive: 0 <= low < high < 100")

    def of(self, score: int) -> tuple[int, int]:
        """The least and the largest score inside; empty below a negative score."""
        return -(-self.low * score // 100), self.high * score // 100


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("anchor").sortWithinPartitions("key").select("key")


def _walk(keys: Iterator[pa.RecordBatch], positives: int, negatives: int, window: Window) -> Iterator[tuple]:
    """``anchor, anchor_mark, positive, rank, negative, positive_score, negative_score`` in sorted
    order; each positive comes once with rank 0 and without a negative as it opens its window."""
    now, opened, seen = None, [], 0
    for batch in keys:
        for anchor, mark, score, kind, key, _ in unpack_keys(batch.column(0)):
            if (anchor, mark) != now:
                now, opened, seen = (anchor, mark), [], 0
            if kind == _POSITIVE:
                if seen < positives:
                    seen += 1
                    opened.append([*window.of(score), key, score, 0])
                    yield anchor, mark, key, 0, None, score, None
                continue
            for held in opened:
                low, high, positive, positive_score, rank = held
                if low <= score <= high and rank < negatives:
                    held[4] = rank + 1
                    yield anchor, mark, positive, rank + 1, key, positive_score, score


_WALKED = T.StructType(
    [
        T.StructField("anchor_id", T.LongType()),
        T.StructField("anchor_mark", T.LongType()),
        T.StructField("positive_id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("negative_id", T.LongType()),
        T.StructField("positive_score", T.LongType()),
        T.StructField("negative_score", T.LongType()),
    ]
)


def walk_pairs(pairs: DataFrame, positives: int, negatives: int, window: Window) -> DataFrame:
    """Sort ``anchor, key`` pairs and walk down each anchor's scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = to_arrow_schema(_WALKED), []
        for row in _walk(batches, positives, negatives, window):
            out.append(row)
            if len(out) == 10_000:
                yield as_batch(list(zip(*out, strict=True)), schema)
                out = []
        if out:
            yield as_batch(list(zip(*out, strict=True)), schema)

    return _sorted_pairs(pairs).mapInArrow(run, _WALKED)


def usable_rows(items: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """``id, mark, label, units`` of rows that take part, equal rows once; ``mark`` tells apart
    rows that share an id."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    units = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    taking = items.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & finite)
    rows = taking.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), units.alias("units"))
    return rows.distinct().select("id", F.xxhash64("label", "units").alias("mark"), "label", "units")


def _chunks(anchors: DataFrame, most: int) -> Iterator[dict[int, _Chunk]]:
    """The anchors, about ``most`` bytes at a time, by vector length."""
    held, size = {}, 0
    for row in chain(anchors.toLocalIterator(), [None]):
        if row is not None:
            held.setdefault(len(row["units"]), []).append(row)
            size += 8 * len(row["units"]) + 64
        if held and (row is None or size > most):
            yield {
                length: _Chunk(
                    np.array([r["id"] for r in rows], np.int64),
                    np.array([r["mark"] for r in rows], np.int64),
                    np.array([r["label"] for r in rows]),
                    np.array([r["units"] for r in rows], np.int64).reshape(len(rows), length),
                )
                for length, rows in held.items()
            }
            held, size = {}, 0


def _pairs(rows: DataFrame, chunks: dict[int, _Chunk], most: int, best: Callable) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(chunks)
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for columns in best(sent.value, most, _blocks(batches)):
            for at in range(0, len(columns[0]), 50_000):
                part = slice(at, at + 50_000)
                yield as_batch([columns[0][part], columns[1][part]], arrow)

    return rows.mapInArrow(run, schema)


def _with_windows(chunks: dict[int, _Chunk], found: DataFrame, positives: int, window: Window) -> None:
    """Set the windows of every anchor from its positives, at most ``positives`` rows an anchor."""
    known: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for row in found.select("anchor_id", "anchor_mark", "positive_score").toLocalIterator():
        known.setdefault((row[0], row[1]), []).append(window.of(row[2]))
    closed = (1, 0)
    for chunk in chunks.values():
        bounds = [known.get(key, []) for key in zip(chunk.ids.tolist(), chunk.marks.tolist(), strict=True)]
        filled = np.array([b + [closed] * (positives - len(b)) for b in bounds], np.int64).reshape(-1, positives, 2)
        chunk.low, chunk.high = filled[..., 0], filled[..., 1]


def mine_hard_negatives(
    items: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    window: Window = Window(),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``id_col`` and ``label_col``. Each component counts as the floor
    of ``scale`` times it. Of an anchor's rows by descending score, ties by ascending id, the first
    ``positives`` other rows of its label are its positives; for each of them the first
    ``negatives`` rows of other labels inside ``window`` come back, ranked from 1.

    Ids are whole numbers. Rows with a null id, label or vector, or with a null or non-finite
    component, take no part. Rows alike in id, label and all components are one row; other rows
    that share an id are rows of their own, ordered by a hash. Only vectors of one length have a
    score; that of empty vectors is 0, and scores beyond 64 bits count as the nearest such number.
    Without rows, anchors or negatives the result is empty. Other columns are not looked at.
    """
    spark = items.sparkSession
    rows = stored(usable_rows(items, id_col, vector_col, label_col, scale), "negative-rows")
    chosen = rows.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "mark", "units").where(anchors)
    chosen = chosen.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), "mark", "units")
    results = []
    with bounded_batches(spark, BLOCK_ROWS):
        for chunks in _chunks(chosen, CHUNK_BYTES):
            near = stored(_pairs(rows, chunks, positives, _best_positives), "negative-positives")
            _with_windows(chunks, walk_pairs(near, positives, 0, window), positives, window)
            far = _pairs(rows, chunks, negatives, _best_negatives)
            walked = walk_pairs(near.unionByName(far), positives, negatives, window).where("rank > 0")
            results.append(stored(walked.drop("anchor_mark"), "negatives"))
    if not results:
        return spark.createDataFrame([], T.StructType([f for f in _WALKED if f.name != "anchor_mark"]))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
