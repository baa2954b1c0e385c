"""Pluggable detectors: keyword, column, TF-IDF or embedding logistic regression, batch model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textrisk.functions.once import computed_once
from textrisk.functions.risk import over_threshold
from textrisk.operators.certificate import penalised_gradient, relational_scores, term_coefficients
from textrisk.operators.counting import pieces, probabilities
from textrisk.operators.features import CHAR_BLOCK, WORD_BLOCK, TfidfBlock, fit_blocks, tfidf_vectors
from textrisk.operators.linear import fit_logistic, text_blocks
from textrisk.operators.split import with_class_weight
from textrisk.session import small_batches
from textrisk.sources.scratch import materialized, scratch_path
from textrisk.sources.tables import read_document, write_document

# Model names, regularization strengths, iteration limit and tolerance.
TFIDF_MODEL = "word_char_tfidf_logistic_regression"
EMBEDDING_MODEL = "frozen_multilingual_embeddings_logistic_regression"
TFIDF_C, EMBEDDING_C, MAX_ITERATIONS, TOLERANCE = 2.0, 1.0, 2000, 1e-4
MAX_TOKENS = 256  # of a text that a model reads
_BLOCKS = {spec.name: spec for spec in (WORD_BLOCK, CHAR_BLOCK)}


class Detector(Protocol):
    """Anything that adds a probability column to a table with a text column."""

    model_name: str

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame: ...


@dataclass(frozen=True)
class ColumnDetector:
    """A detector given as a column expression of the text."""

    model_name: str
    expression: Callable[[Column], Column]

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return df.withColumn(out_col, self.expression(F.col(text_col)))


def keyword_detector(
    keywords: Sequence[str], high: float, low: float, model_name: str = "keyword"
) -> ColumnDetector:
    """``high`` when the folded text contains any keyword, else ``low``."""

    def expression(text: Column) -> Column:
        folded = F.lower(text)
        found = F.lit(False)
        for word in keywords:
            found = found | F.contains(folded, F.lit(word))
        return F.when(found, F.lit(high)).otherwise(F.lit(low))

    return ColumnDetector(model_name, expression)


@dataclass(frozen=True)
class BatchDetector:
    """Batched inference with a caller's model function over one input column.

    ``make_predict`` runs once per Python worker and returns a function from a numpy batch to
    one probability per row.
    """

    model_name: str
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]]
    input_col: str
    input_shape: tuple[int, ...] | None = None
    batch_size: int = 16

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        predict = predict_batch_udf(
            self.make_predict,
            return_type=DoubleType(),
            batch_size=self.batch_size,
            input_tensor_shapes=[list(self.input_shape)] if self.input_shape else None,
        )
        return df.withColumn(out_col, predict(self.input_col))


@dataclass(frozen=True)
class TextBatchDetector:
    """Batched inference on texts with a caller's tokenizer and model.

    ``make_model`` runs once per batch stream of a Python worker and returns two functions: one
    from a text to its token ids, and one from padded ids and their mask (rows by tokens) to one
    probability per row. Each text is cut to ``max_tokens``. Texts of about equal length share a
    batch, so a long text does not pad short ones, and results go back to the rows they belong to.
    A null text is the empty text.
    """

    model_name: str
    make_model: Callable[[], tuple[Callable[[str], Sequence[int]], Callable[[np.ndarray, np.ndarray], np.ndarray]]]
    max_tokens: int = MAX_TOKENS
    batch_size: int = 16

    def predict(self, texts: Sequence[str], tokenize, model) -> np.ndarray:
        """The probabilities of some texts, in their order."""
        ids = [list(tokenize(text or ""))[: self.max_tokens] for text in texts]
        order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
        out = np.zeros(len(ids))
        for start in range(0, len(order), self.batch_size):
            rows = order[start : start + self.batch_size]
            padded = np.zeros((len(rows), max(1, len(ids[rows[-1]]))), np.int64)
            mask = np.zeros(padded.shape, np.int64)
            for row, i in enumerate(rows):
                padded[row, : len(ids[i])] = ids[i]
                mask[row, : len(ids[i])] = 1
            out[rows] = np.asarray(model(padded, mask), float)
        return out

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        predict, make_model = self.predict, self.make_model

        @F.arrow_udf(DoubleType())
        def probabilities_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenize, model = make_model()
            for texts in batches:
                yield pa.array(predict(texts.to_pylist(), tokenize, model), pa.float64())

        made = probabilities_of(F.col(text_col).cast("string"))
        return computed_once(df.select(*df.columns, made.alias(out_col)), [out_col])


def _fit_balanced(
    features: DataFrame, target: str, strength: float, intercept: bool, tolerance: float
) -> LogisticRegressionModel:
    """Class-balanced L2 logistic regression.

    The loss here is a mean over rows and balanced weights sum to the row count, so the
    penalty is 1 / (C * rows). The vectors are written once, as every iteration reads them.
    """
    features = materialized(features, "features")
    rows = features.count()
    estimator = LogisticRegression(
        featuresCol="features",
        labelCol=target,
        weightCol="weight",
        regParam=1.0 / (strength * rows),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=intercept,
        maxIter=MAX_ITERATIONS,
        tol=tolerance,
    )
    # Read back without its training summary, which holds the session: a session that observes
    # metrics cannot be sent to tasks.
    path = scratch_path(features.sparkSession, "classifier")
    estimator.fit(with_class_weight(features, target)).write().save(path)
    return LogisticRegressionModel.load(path)


def _positive(model: LogisticRegressionModel, features: DataFrame, out_col: str) -> DataFrame:
    return model.transform(features).withColumn(out_col, vector_to_array("probability")[1])


@dataclass(frozen=True)
class TfidfDetector:
    """Word and character TF-IDF with logistic regression.

    The last feature is a constant 1 in place of an intercept, so that the penalty covers it.
    ``coefficients`` are those of the blocks' terms in turn and of the constant.
    """

    blocks: tuple[TfidfBlock, ...]
    coefficients: np.ndarray
    threshold: float = 0.5
    model_name: str = TFIDF_MODEL

    artifact_type = "tfidf_logistic_regression"

    @property
    def _parts(self) -> list[tuple]:
        return [(block.spec.count, block.weights) for block in self.blocks]

    @classmethod
    def fit(
        cls, df: DataFrame, text_col: str = "text", target: str = "target", tolerance: float = TOLERANCE
    ) -> TfidfDetector:
        blocks = fit_blocks(df, tuple(_BLOCKS.values()), text_col)
        size = sum(len(block.weights.idf) for block in blocks) + 1
        parts = [(block.spec.count, block.weights) for block in blocks]
        rows = text_blocks(with_class_weight(df.select(text_col, target), target), parts, text_col, target, "weight")
        return cls(blocks, fit_logistic(rows, size, TFIDF_C, tolerance, MAX_ITERATIONS))

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        parts, coefficients = self._parts, self.coefficients

        @F.arrow_udf(DoubleType())
        def probability(texts: pa.Array) -> pa.Array:
            found = [probabilities(piece, parts, coefficients) for piece in pieces(texts)]
            return pa.array(np.concatenate([*found, np.zeros(0)]))

        made = probability(F.col(text_col).cast("string"))
        return computed_once(df.select(*df.columns, made.alias(out_col)), [out_col])

    def gradient(self, df: DataFrame, text_col: str = "text", target: str = "target") -> DataFrame:
        """``penalised_gradient`` over the rows ``df``, which the model was fitted on."""
        known = with_class_weight(df.select(text_col, target), target)
        scored = feature_union(known, self.blocks, text_col, score=("score", self.coefficients))
        vectors = scored.select(target, "weight", "score", "features")
        weights = _coefficient_table(df.sparkSession, self.coefficients)
        with small_batches(df.sparkSession):
            return materialized(penalised_gradient(vectors, weights, TFIDF_C, target_col=target), "gradient")

    def relational_score(self, df: DataFrame, text_col: str, out_col: str, id_col: str = "Id") -> DataFrame:
        """``id_col, out_col``: the same probability, from joins of terms with the coefficients."""
        weights = materialized(_coefficient_table(df.sparkSession, self.coefficients), "coefficients")
        known = term_coefficients([(block.spec.name, block.terms) for block in self.blocks], weights)
        specs, constant = [block.spec for block in self.blocks], float(self.coefficients[-1])
        return relational_scores(df, specs, materialized(known, "term-coefficients"), constant, id_col, text_col, out_col)

    def predict(self, df: DataFrame, text_col: str, out_col: str = "prediction") -> DataFrame:
        scored = self.score(df, text_col, "_score")
        return scored.withColumn(out_col, over_threshold(F.col("_score"), self.threshold)).drop(
            "_score"
        )

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The fitted state as tables, for storing and fingerprinting."""
        out = {block.spec.name: block.terms for block in self.blocks}
        out["coefficients"] = _coefficient_table(spark, self.coefficients)
        return out

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for block in self.blocks:
            block.save(f"{path}/{block.spec.name}")
        _coefficient_table(spark, self.coefficients).write.parquet(f"{path}/coefficients")
        _save_meta(spark, self, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfDetector:
        meta = _load_meta(spark, path, cls.artifact_type)
        blocks = tuple(
            TfidfBlock.load(spark, f"{path}/{name}", spec) for name, spec in _BLOCKS.items()
        )
        rows = spark.read.parquet(f"{path}/coefficients").orderBy("position").toArrow()
        return cls(blocks, rows["value"].to_numpy(), meta["threshold"], meta["model_name"])


def feature_union(
    df: DataFrame,
    blocks: Sequence[TfidfBlock],
    text_col: str = "text",
    out_col: str = "features",
    score: tuple[str, np.ndarray] | None = None,
) -> DataFrame:
    """Add the unit-length blocks side by side, followed by a constant 1; with ``score``, also the
    probability by these coefficients."""
    return tfidf_vectors(df, blocks, text_col, out_col, constant=True, score=score)


@dataclass(frozen=True)
class EmbeddingDetector:
    """Logistic regression over an embedding column, one dense vector per text."""

    classifier: LogisticRegressionModel
    embedding_col: str = "embedding"
    threshold: float = 0.5
    model_name: str = EMBEDDING_MODEL

    artifact_type = "embedding_logistic_regression"

    @staticmethod
    def _features(df: DataFrame, embedding_col: str) -> DataFrame:
        vector = array_to_vector(F.col(embedding_col).cast("array<double>"))
        scaled = Normalizer(p=2.0, inputCol="_vector", outputCol="features")
        return scaled.transform(df.withColumn("_vector", vector)).drop("_vector")

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        embedding_col: str = "embedding",
        target: str = "target",
        tolerance: float = TOLERANCE,
    ) -> EmbeddingDetector:
        vectors = cls._features(df, embedding_col).select(target, "features")
        return cls(_fit_balanced(vectors, target, EMBEDDING_C, True, tolerance), embedding_col)

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        kept = list(df.columns)
        features = self._features(df, self.embedding_col)
        return _positive(self.classifier, features, out_col).select(*kept, out_col)

    def gradient(self, df: DataFrame, text_col: str = "text", target: str = "target") -> DataFrame:
        """``penalised_gradient`` over the rows ``df``, which the model was fitted on."""
        vectors = self._features(df, self.embedding_col).select(target, "features")
        scored = _positive(self.classifier, with_class_weight(vectors, target), "score")
        weights = _coefficient_table(df.sparkSession, _coefficients(self.classifier))
        return penalised_gradient(scored, weights, EMBEDDING_C, target_col=target, dense=True, intercept=True)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"coefficients": _coefficient_table(spark, _coefficients(self.classifier))}

    def save(self, path: str) -> None:
        self.classifier.write().save(f"{path}/classifier")
        _save_meta(SparkSession.active(), self, path, embedding_col=self.embedding_col)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EmbeddingDetector:
        meta = _load_meta(spark, path, cls.artifact_type)
        model = LogisticRegressionModel.load(f"{path}/classifier")
        return cls(model, meta["embedding_col"], meta["threshold"], meta["model_name"])


def _coefficients(model: LogisticRegressionModel) -> np.ndarray:
    """The coefficients of a model, its intercept last."""
    return np.append(model.coefficients.toArray(), model.intercept)


def _coefficient_table(spark: SparkSession, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"position": np.arange(len(values), dtype=np.int32), "value": values}))


def _save_meta(spark: SparkSession, detector, path: str, **extra) -> None:
    meta = {
        "artifact_type": detector.artifact_type,
        "model_name": detector.model_name,
        "threshold": detector.threshold,
        **extra,
    }
    write_document(spark, meta, f"{path}/meta")


def _load_meta(spark: SparkSession, path: str, expected: str) -> dict:
    meta = read_document(spark, f"{path}/meta")
    if meta["artifact_type"] != expected:
        raise ValueError(f"{path} holds a {meta['artifact_type']}, not a {expected}")
    return meta


ARTIFACT_TYPES = {cls.artifact_type: cls for cls in (TfidfDetector, EmbeddingDetector)}


def load_detector(spark: SparkSession, path: str, artifact_type: str):
    """Load a stored detector by its type."""
    if artifact_type not in ARTIFACT_TYPES:
        raise ValueError(f"no detector class for {artifact_type!r}")
    return ARTIFACT_TYPES[artifact_type].load(spark, path)
