"""Labelled rows for the classifiers of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column | str, folds: int) -> Column:
    """The CRC-32 of the id as text, modulo ``folds``."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(key.cast("string").cast("binary")) % folds


def training_rows(
    docs: DataFrame, labels: DataFrame, label_col: str, kept: Column, per_class: int, id_col: str, text_col: str
) -> tuple[DataFrame, dict[int, int]]:
    """``text, label`` of at most ``per_class`` ids of either label, and how many rows of each
    label there are.

    ``kept`` says which rows of ``labels`` may be learnt from. Ids are taken in the order of their
    hash; the chosen ones, two times ``per_class`` at most, are broadcast. An id gives one row a
    label, however often either table repeats it: of several texts the smallest.
    """
    usable = labels.where(kept & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    sizes = {row[label_col]: row["count"] for row in usable.groupBy(label_col).count().collect()}
    order = F.xxhash64(id_col)
    parts = [
        usable.where(F.col(label_col) == label).select(id_col, label_col).distinct().orderBy(order, id_col).limit(per_class)
        for label in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1]).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return found.select("text", "label"), sizes


class Adam:
    """Gradient steps for arrays that are changed in place.

    Entries whose gradients are well below ``least`` move by their gradient only, and so hardly.
    """

    def __init__(self, arrays: list[np.ndarray], rate: float, least: float = 1e-8):
        self.arrays, self.rate, self.least, self.turn = arrays, rate, least, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.turn += 1
        for a, m, v, g in zip(self.arrays, self.first, self.second, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + self.least)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))
