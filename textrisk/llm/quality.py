"""A quality classifier over random-indexing word vectors.

Every token has a sparse random index vector, by a hash; a token's word vector is the sum of the
index vectors around its occurrences in the whole corpus, normalised, and its own index vector.
Tokens share ``BUCKETS`` rows by a hash, so the table of word vectors has a fixed size whatever
the vocabulary. A document is the mean of its tokens' vectors and a few figures; a network of two
layers scores it, and a temperature fitted on rows set aside calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import as_batch, small_batches, texts_of
from textrisk.llm.training import Adam, logistic, training_rows

BUCKETS, DIMENSIONS = 1 << 14, 64
NONZERO = 2  # entries of an index vector
CONTEXT = 2  # tokens to either side
CHUNK = 128  # rows of the table that travel together
TRAINING_ROWS_PER_CLASS = 6_000
HIDDEN = 32
EPOCHS, LEAST_STEPS = 60, 1_000  # few rows are seen more often
_TOKENS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+").findall
_SAME = "\x00same"  # in place of a word that repeats the one before it


# ---- tokens -------------------------------------------------------------------------------


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def _parts(word: str) -> list[int]:
    """The buckets of a word's letters, digits and signs; capitals and long runs are marked."""
    if word == _SAME:
        return [_bucket(word)]
    out = []
    for part in _TOKENS(word):
        if len(part) > 1 and part.isupper():
            out.append(_bucket("\x00capitals"))
        out.append(_bucket(part.lower()))
    return out or [_bucket(word)]


def token_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all tokens of all texts, and the number of tokens of each text."""
    split = [text.split() for text in texts]
    numbers = {word: i + 1 for i, word in enumerate(set().union(*split))}
    parts = [_parts(_SAME), *map(_parts, numbers)]
    sizes = np.array([len(p) for p in parts], np.int64)
    listed = np.array([b for p in parts for b in p], np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.array([len(s) for s in split], np.int64)
    of = numbers.__getitem__
    flat = np.fromiter((of(word) for s in split for word in s), np.int64, int(words.sum()))
    repeated = np.zeros(len(flat), bool)
    repeated[1:] = flat[1:] == flat[:-1]
    heads = np.cumsum(words) - words
    repeated[heads[words > 0]] = False
    flat[repeated] = 0
    counts = sizes[flat]
    ends = np.cumsum(counts)
    at = np.arange(int(counts.sum())) - np.repeat(ends - counts, counts) + np.repeat(starts[flat], counts)
    per_text = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])])
    return listed[at], per_text


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket: the places of its entries, and their signs."""
    random = np.random.Generator(np.random.PCG64(4))
    return random.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), random.choice([-1.0, 1.0], (BUCKETS, NONZERO))


# ---- word vectors -------------------------------------------------------------------------


def packed(sums: np.ndarray) -> bytes:
    """Whole numbers in four bytes each where they fit, else in eight."""
    return sums.astype("<i4" if np.abs(sums).max() < 2**31 else "<i8").tobytes()


def unpacked(sums: bytes) -> np.ndarray:
    return np.frombuffer(sums, "<i4" if len(sums) == 4 * CHUNK * DIMENSIONS else "<i8").astype(np.float64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors, from every text of ``docs``.

    Each task sums up a table of its own; tables are added up by chunks of rows. The driver gets
    one table, of a fixed size. Sums are whole numbers, exact up to 2^53, so the table does not
    depend on how the texts are dealt to tasks.
    """
    schema = T._parse_datatype_string("chunk int, sums binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, (places, signs) = to_arrow_schema(schema), index_vectors()
        sums = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            tokens, per_text = token_buckets(texts_of(batch.column(0)))
            text = np.repeat(np.arange(len(per_text)), per_text)
            for gap in range(1, CONTEXT + 1):
                near = text[gap:] == text[:-gap]
                left, right = tokens[:-gap][near], tokens[gap:][near]
                for here, there in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        flat = here * DIMENSIONS + places[there, k]
                        sums += np.bincount(flat, weights=signs[there, k], minlength=len(sums))
        table = sums.reshape(-1, CHUNK * DIMENSIONS)
        kept = np.flatnonzero(table.any(axis=1))
        if len(kept):
            yield as_batch([kept, [packed(table[i]) for i in kept]], arrow)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, totals = to_arrow_schema(schema), {}
        for batch in batches:
            for chunk, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[chunk] = totals.get(chunk, 0.0) + unpacked(sums)
        if totals:
            yield as_batch([list(totals), [packed(v) for v in totals.values()]], arrow)

    small_batches(docs.sparkSession)
    sums = docs.select(text_col).mapInArrow(gather, schema).repartition("chunk").mapInArrow(add_up, schema)
    table = np.zeros((BUCKETS // CHUNK, CHUNK * DIMENSIONS))
    for row in sums.toLocalIterator():
        table[row["chunk"]] = unpacked(row["sums"])
    table = table.reshape(BUCKETS, DIMENSIONS)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)
    places, signs = index_vectors()
    for k in range(NONZERO):
        table[np.arange(BUCKETS), places[:, k]] += signs[:, k]
    return table.astype(np.float32)


def document_features(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The mean word vector of each text, the log of its number of tokens, and the share of the
    commonest bucket and of distinct ones."""
    tokens, per_text = token_buckets(texts)
    ends = np.cumsum(per_text)
    out = np.zeros((len(texts), DIMENSIONS + 3), np.float32)
    for i, (end, size) in enumerate(zip(ends.tolist(), per_text.tolist(), strict=True)):
        if size:
            found, counts = np.unique(tokens[end - size : end], return_counts=True)
            out[i, :DIMENSIONS] = counts.astype(np.float32) @ table[found] / size
            out[i, DIMENSIONS:] = np.log1p(size) / 10, counts.max() / size, len(found) / size
    return out


# ---- the network --------------------------------------------------------------------------


class QualityNetwork:
    """Two layers and a temperature."""

    def __init__(self, prior: float):
        self.shift, self.scale = np.zeros(DIMENSIONS + 3), np.ones(DIMENSIONS + 3)
        self.layers: list[np.ndarray] | None = None
        self.temperature = 1.0
        self.prior = np.array(np.log(prior / (1 - prior)))

    def logits(self, features: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(features), self.prior)
        a, b, c, d = self.layers
        # Sums of a row in one order whatever the batch, which matrix products do not promise.
        hidden = np.tanh(np.einsum("ij,jk->ik", (features - self.shift) / self.scale, a) + b)
        return np.einsum("ij,j->i", hidden, c) + d

    def scores(self, features: np.ndarray) -> np.ndarray:
        return logistic(self.logits(features) / self.temperature)

    def fit(self, features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """A fifth of the rows is set aside for the temperature."""
        random = np.random.Generator(np.random.PCG64(7))
        order = random.permutation(len(labels))
        aside, used = order[: len(order) // 5], order[len(order) // 5 :]
        self.shift, self.scale = features[used].mean(axis=0), features[used].std(axis=0) + 1e-6
        self.layers = [
            random.normal(0, features.shape[1] ** -0.5, (features.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            random.normal(0, HIDDEN**-0.5, HIDDEN),
            np.zeros(1),
        ]
        a, b, c, d = self.layers
        adam = Adam(self.layers, 0.005)
        steps = -(-len(used) // 256)
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // steps))):
            random.shuffle(used)
            for at in range(0, len(used), 256):
                part = used[at : at + 256]
                x = (features[part] - self.shift) / self.scale
                hidden = np.tanh(x @ a + b)
                wrong = (logistic(hidden @ c + d) - labels[part]) * weights[part] / weights[part].sum()
                back = np.outer(wrong, c) * (1 - hidden * hidden)
                adam.step([x.T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ wrong, wrong.sum(keepdims=True)])
        if len(aside):
            logits, y, w = self.logits(features[aside]), labels[aside], weights[aside]
            tried = np.geomspace(0.25, 8.0, 60)
            losses = [(w * np.logaddexp(0.0, np.where(y == 1, -logits, logits) / t)).sum() for t in tried]
            self.temperature = float(tried[int(np.argmin(losses))])


def train(
    docs: DataFrame, labels: DataFrame, kept: Column, table: np.ndarray, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality", per_class: int = TRAINING_ROWS_PER_CLASS,
) -> QualityNetwork:
    """Fit on at most ``per_class`` rows of either label; rows weigh so that labels keep their
    share. With rows of one label only, every score is about that label's; with none, 1/2."""
    small_batches(docs.sparkSession)
    rows, sizes = training_rows(docs, labels, label_col, kept, per_class, id_col, text_col)
    network = QualityNetwork((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2))

    @F.arrow_udf(T.BinaryType())
    def features(column: pa.Array) -> pa.Array:
        return pa.array([f.tobytes() for f in document_features(texts_of(column), table)], pa.binary())

    # Rows are set aside by their place, so it must not depend on the order in which they arrive.
    found = sorted(rows.select(features("text").alias("features"), "label").collect())
    y = np.array([row["label"] for row in found], np.float64)
    if 0 < y.sum() < len(y):
        x = np.stack([np.frombuffer(row["features"], np.float32) for row in found]).astype(np.float64)
        share = np.array([sizes[0] / (y == 0).sum(), sizes[1] / (y == 1).sum()])
        network.fit(x, y, (share / share.max())[y.astype(int)])
    return network


def score(text: Column | str, network: QualityNetwork, table: np.ndarray) -> Column:
    """The score, 0 to 1, of a string column; null counts as the empty text."""

    @F.arrow_udf(T.DoubleType())
    def of(column: pa.Array) -> pa.Array:
        return pa.array(network.scores(document_features(texts_of(column), table)), pa.float64())

    return of(text)


def quality_score(
    docs: DataFrame, labels: DataFrame, kept: Column, id_col: str = "doc_id", text_col: str = "text"
) -> Column:
    """A score column for ``docs``: word vectors from all its texts, labels from the rows that
    ``kept`` allows. Any text has a score, the empty one and null included."""
    small_batches(docs.sparkSession)
    table = word_vectors(docs, text_col)
    return score(text_col, train(docs, labels, kept, table, id_col, text_col), table)
