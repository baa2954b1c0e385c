"""Evaluation of a prediction table against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textrisk.functions.labels import CATEGORY_COLUMNS, first_present, with_truth
from textrisk.functions.risk import RiskConfig, ablated_risk, is_positive, over_threshold
from textrisk.operators.checks import require_columns
from textrisk.operators.joins import join_one_to_one
from textrisk.operators.metrics import binary_metrics

# The columns of the error table and the names of the ablation arms.
ERROR_COLUMNS = (
    "Id",
    "text",
    "_target",
    "prediction",
    "decision",
    "risk_score",
    "ml_score",
    "heuristic_score",
    "unicode_score",
    "reasons",
)
ABLATION_ARMS = ("A_ml_only", "B_heuristic_only", "C_ml_plus_heuristic", "D_full_pipeline")


def with_outcome(predictions: DataFrame, truth: DataFrame, checked: bool = True) -> DataFrame:
    """Predictions with ``_target``, the 0/1 ``prediction`` and the category, if the truth has one.

    ``checked`` raises unless both tables hold the same ids, once each. An unknown ground-truth
    value raises wherever the target is used. Rows without a decision have no prediction; the
    metrics count them as ``unscored_rows``.
    """
    require_columns(truth, ["Id"])
    category = first_present(truth, CATEGORY_COLUMNS)
    wanted = ["Id", "_target"] + ([category] if category else [])
    known = with_truth(truth).select(*wanted)
    out = join_one_to_one(predictions, known, "Id", checked=checked)
    return out.withColumn("prediction", is_positive(F.col("decision")))


def full_metrics(outcome: DataFrame) -> DataFrame:
    return binary_metrics(outcome, "_target", "prediction", "risk_score")


def ablation(
    outcome: DataFrame, config: RiskConfig, ml_threshold: float, heuristic_threshold: float
) -> DataFrame:
    """Metrics of classifier only, rules only, both, and the full blend, from one pass."""
    ml, heuristic = F.col("ml_score"), F.col("heuristic_score")
    blend = ablated_risk(ml, heuristic, config)
    choices = (
        (over_threshold(ml, ml_threshold), ml),
        (over_threshold(heuristic, heuristic_threshold), heuristic),
        (over_threshold(blend, config.medium_threshold), blend),
        (F.col("prediction"), F.col("risk_score")),
    )
    arms = [
        F.struct(F.lit(name).alias("arm"), chosen.alias("prediction"), score.alias("score"))
        for name, (chosen, score) in zip(ABLATION_ARMS, choices)
    ]
    rows = outcome.select("_target", F.explode(F.array(*arms)).alias("a")).select("_target", "a.*")
    return binary_metrics(rows, "_target", "prediction", "score", by=["arm"])


def category_breakdown(outcome: DataFrame) -> DataFrame:
    """The full metrics per category of the truth table."""
    name = first_present(outcome, CATEGORY_COLUMNS)
    if name is None:
        raise ValueError(f"ground truth has none of: {', '.join(CATEGORY_COLUMNS)}")
    rows = outcome.withColumn("category", F.col(name).cast("string"))
    return binary_metrics(rows, "_target", "prediction", "risk_score", by=["category"])


def error_table(outcome: DataFrame, inputs: DataFrame, checked: bool = True) -> DataFrame:
    """Wrong rows with their text. Right rows leave before the join."""
    wrong = outcome.filter(F.col("prediction") != F.col("_target"))
    texts = inputs.select("Id", "text")
    out = join_one_to_one(wrong, texts, "Id", how="left", checked=checked)
    kind = F.when(F.col("_target") == 1, "false_negative").otherwise("false_positive")
    return out.select(*ERROR_COLUMNS, kind.alias("error_type"))


def error_examples(errors: DataFrame, per_type: int = 5) -> DataFrame:
    """The first rows of each error type by id."""
    first = W.partitionBy("error_type").orderBy("Id")
    ranked = errors.withColumn("_rank", F.row_number().over(first))
    return ranked.filter(F.col("_rank") <= per_type).drop("_rank")
