"""A toxicity classifier over bags of subwords.

A word's vector is the mean of the vectors of its whole form and its character n-grams, which
share ``BUCKETS`` rows by a hash, so a misspelt or derived word keeps most of a known word's
vector. Vectors and a linear softmax on them are trained together: every distinct word of the
training texts is an example, labelled by the shares of toxic and of clean texts that hold it.
A few toxic words make a long text toxic, so a text is judged by its most toxic word and by the
share of its words that are toxic; a logistic curve fitted on rows set aside turns the two into
a probability.

As all steps before the softmax are means, a trained model is one number per bucket.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrisk.llm.common import Remembered, small_batches, texts_of
from textrisk.llm.training import Adam, logistic, training_rows

BUCKETS, DIMENSIONS = 1 << 18, 4
SHORTEST, LONGEST = 3, 5  # character n-grams, word ends marked
WINDOW = 8  # words
TRAINING_ROWS_PER_CLASS = 2_000
EPOCHS = 60
RATE = 0.1
LEAST_GRADIENT = 1e-4  # entries with smaller ones, as those of a rare word, hardly move
CERTAIN = 2.0  # margins beyond this say no more; misspelt words reach it less far than known ones
SMOOTHING = 0.5  # texts of either label that are added to those that hold a word
_WORDS = re.compile(r"\w+").findall


def subwords(word: str) -> list[int]:
    """The buckets of a word and its character n-grams."""
    marked = f"<{word}>"
    grams = [marked]
    for size in range(SHORTEST, min(LONGEST, len(marked) - 1) + 1):
        grams += [marked[i : i + size] for i in range(len(marked) - size + 1)]
    return [zlib.crc32(gram.encode()) % BUCKETS for gram in grams]


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct lower-case words, the words of all texts as places in them, and the number of
    words of each text."""
    split = [text.lower().split() for text in texts]
    listed: dict[str, int] = {}
    # A run without white space may hold several words, or none.
    runs = {run: [listed.setdefault(word, len(listed)) for word in _WORDS(run)] for run in set().union(*split)}
    numbers = [[n for run in s for n in runs[run]] for s in split]
    sizes = np.array([len(n) for n in numbers], np.int64)
    flat = np.fromiter((n for s in numbers for n in s), np.int64, int(sizes.sum()))
    return list(listed), flat, sizes


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words one after the other, and where each word's begin."""
    bags = [subwords(word) for word in words]
    sizes = np.array([len(bag) for bag in bags], np.int64)
    return np.fromiter((b for bag in bags for b in bag), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes


class ToxicityModel:
    """Margins of buckets and the curve from margin to probability."""

    def __init__(self, prior: float):
        self.known = Remembered(self._learn)
        self.margins = np.zeros(BUCKETS, np.float32)
        self.bias = 0.0
        self.curve = np.array([0.0, 0.0, np.log(prior / (1 - prior))])

    def _learn(self, new: list[str]) -> dict[str, float]:
        """The mean margin of each word's subwords."""
        if not new:
            return {}
        bags, heads = _bags(new)
        lengths = np.diff(np.append(heads, len(bags)))
        means = np.add.reduceat(self.margins[bags].astype(np.float64), heads) / lengths
        return dict(zip(new, means.tolist(), strict=True))

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Of each text: the margin of its most toxic word, up to ``CERTAIN``, and the logarithm of the share of its
        words that are toxic by their probabilities. A text without words shows nothing."""
        words, flat, sizes = words_of(texts)
        best, share = np.full(len(texts), self.bias), np.full(len(texts), logistic(np.array(self.bias)))
        if len(flat):
            found = self.known.lookup(set(words))
            margins = np.array([found[word] for word in words])[flat] + self.bias
            some = sizes > 0
            heads = (np.cumsum(sizes) - sizes)[some]
            best[some] = np.maximum.reduceat(margins, heads)
            share[some] = np.add.reduceat(logistic(margins), heads) / sizes[some]
        return np.column_stack([np.minimum(best, CERTAIN), np.log(share)])

    def scores(self, texts: list[str]) -> np.ndarray:
        return logistic(self.evidence(texts) @ self.curve[:2] + self.curve[2])

    def fit(self, texts: list[str], labels: np.ndarray, shares: tuple[float, float]) -> None:
        """A fifth of the rows is set aside for the curve. ``shares``: weight of a row by label."""
        order = np.random.Generator(np.random.PCG64(7)).permutation(len(labels))
        aside, used = order[: len(order) // 5], order[len(order) // 5 :]
        self._fit_vectors([texts[i] for i in used], labels[used])
        if len(aside):
            weights = np.where(labels[aside] == 1, shares[1], shares[0])
            self._fit_curve(self.evidence([texts[i] for i in aside]), labels[aside], weights / weights.mean())

    def _fit_vectors(self, texts: list[str], labels: np.ndarray) -> None:
        held: dict[str, list[int]] = {}  # of each word: distinct clean and toxic texts with it
        for text, label in {t: int(y) for t, y in zip(texts, labels, strict=True)}.items():
            for word in set(words_of([text])[0]):
                held.setdefault(word, [0, 0])[label] += 1
        words = list(held)
        counts = np.array(list(held.values()), np.float64)
        share = counts[:, 1] / counts.sum(axis=1)
        weight = counts.sum(axis=1) / (counts.sum(axis=1) + 2 * SMOOTHING) * np.sqrt(counts.sum(axis=1))
        weight /= weight.sum()
        bags, heads = _bags(words)
        lengths = np.diff(np.append(heads, len(bags)))
        member = np.repeat(np.arange(len(words)), lengths)
        random = np.random.Generator(np.random.PCG64(11))
        vectors = random.normal(0, 0.05, (BUCKETS, DIMENSIONS))
        toxic = (weight * share).sum()
        softmax, bias = random.normal(0, 0.5, (DIMENSIONS, 2)), np.log([1 - toxic, toxic])
        adam = Adam([vectors, softmax, bias], RATE, LEAST_GRADIENT)
        for _ in range(EPOCHS):
            mean = np.add.reduceat(vectors[bags], heads, axis=0) / lengths[:, None]
            logits = mean @ softmax + bias
            wrong = (logistic(logits[:, 1] - logits[:, 0]) - share) * weight
            both = np.column_stack([-wrong, wrong])
            to_word = both @ softmax.T / lengths[:, None]
            to_bucket = np.column_stack(
                [np.bincount(bags, weights=to_word[member, d], minlength=BUCKETS) for d in range(DIMENSIONS)]
            )
            adam.step([to_bucket, mean.T @ both, both.sum(axis=0)])
        # Buckets that no training word fell into are neutral.
        unseen = np.ones(BUCKETS, bool)
        unseen[bags] = False
        self.margins = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
        self.margins[unseen] = 0.0
        self.bias = float(bias[1] - bias[0])
        self.known = Remembered(self._learn)

    def _fit_curve(self, evidence: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        shift, scale = evidence.mean(axis=0), evidence.std(axis=0) + 1e-6
        x = np.column_stack([(evidence - shift) / scale, np.ones(len(evidence))])
        slope = np.zeros(3)
        for _ in range(50):  # Newton's steps on a penalised fit of three numbers
            p = logistic(x @ slope)
            gradient = x.T @ ((p - labels) * weights) + 1e-2 * slope
            curvature = (x * (p * (1 - p) * weights)[:, None]).T @ x + 1e-2 * np.eye(3)
            move = np.linalg.solve(curvature, gradient)
            slope -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-9))
        self.curve = np.array([*(slope[:2] / scale), slope[2] - (slope[:2] / scale) @ shift])


def train(
    docs: DataFrame, labels: DataFrame, kept: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", per_class: int = TRAINING_ROWS_PER_CLASS,
) -> ToxicityModel:
    """Fit on at most ``per_class`` rows of either label, whole texts. With rows of one label
    only, every score is about that label's; with none, 1/2."""
    small_batches(docs.sparkSession)
    rows, sizes = training_rows(docs, labels, label_col, kept, per_class, id_col, text_col)
    model = ToxicityModel((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2))
    found = sorted(rows.collect())
    y = np.array([row["label"] for row in found], np.float64)
    if 0 < y.sum() < len(y):
        shares = sizes[0] / (y == 0).sum(), sizes[1] / (y == 1).sum()
        model.fit([row["text"] for row in found], y, shares)
    return model


def score(text: Column | str, model: ToxicityModel) -> Column:
    """The score, 0 to 1, of a string column; null counts as the empty text."""

    @F.arrow_udf(T.DoubleType())
    def of(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts_of(column)), pa.float64())

    return of(text)


def toxicity_score(
    docs: DataFrame, labels: DataFrame, kept: Column, id_col: str = "doc_id", text_col: str = "text"
) -> Column:
    """A score column for ``docs``, learnt from the rows of ``labels`` that ``kept`` allows. Any
    text has a score, the empty one and null included."""
    small_batches(docs.sparkSession)
    return score(text_col, train(docs, labels, kept, id_col, text_col))
