"""Scoring of a table of untrusted text, from raw text to decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.functions import risk
from textrisk.functions.normalize import with_normalized
from textrisk.functions.once import computed_once
from textrisk.functions.risk import RiskConfig
from textrisk.functions.rules import with_rule_hits
from textrisk.operators.checks import require_columns, require_rows, require_string_column
from textrisk.operators.models import Detector
from textrisk.operators.ordering import with_row_index

FLAT_SCORES = ("risk_score", "ml_score", "heuristic_score", "unicode_score")


def text_components(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Normalization and rule columns, which do not depend on the detector."""
    require_string_column(df, text_col)
    out = with_normalized(df, text_col).withColumnRenamed("anomaly_score", "unicode_score")
    return with_rule_hits(out, "comparison_text", folded=True)


def _with_risk(df: DataFrame, detector: Detector, text_col: str, config: RiskConfig) -> DataFrame:
    """Add the unrounded ``_ml`` and ``_risk``, and ``decision``. Null text gives nulls.

    A probability outside [0, 1], NaN or null for a known text fails the scan.
    """
    out = detector.score(df, "normalized_text", "_ml")
    ml = F.col("_ml").cast("double")
    message = F.concat(F.lit(f"detector {detector.model_name} gave no probability: "), F.coalesce(ml.cast("string"), F.lit("null")))
    checked = F.when(F.coalesce(ml.between(0.0, 1.0), F.lit(False)), ml).otherwise(
        F.raise_error(message).cast("double")
    )
    out = out.withColumn("_ml", F.when(F.col(text_col).isNotNull(), checked))
    out = computed_once(out, ["_ml"])
    scores = (F.col(c) for c in ("_ml", "heuristic_score", "unicode_score"))
    out = out.withColumn("_risk", risk.blended_risk(*scores, config))
    return out.withColumn("decision", risk.decision(F.col("_risk"), config))


def score_components(
    df: DataFrame,
    detector: Detector,
    text_col: str = "text",
    config: RiskConfig = RiskConfig(),
) -> DataFrame:
    """All scan columns next to the input columns. Narrow: no shuffle, one Arrow step.

    The detector reads the normalized text, the rules read the comparison form. Null text gives
    null results.
    """
    kept = list(df.columns)
    out = _with_risk(text_components(df, text_col), detector, text_col, config)
    return out.select(
        *kept,
        "normalized_text",
        "comparison_text",
        "matched_rules",
        "rule_reasons",
        "signals",
        "heuristic_score",
        "unicode_score",
        F.round("_ml", 6).alias("ml_score"),
        F.round("_risk", 6).alias("risk_score"),
        "decision",
        risk.risk_level(F.col("_risk"), config).alias("risk_level"),
        risk.reasons(F.col("_ml"), F.col("rule_reasons"), F.col("signals")).alias("reasons"),
        risk.sanitized(F.col("normalized_text"), F.col("decision")).alias("sanitized_text"),
    )


def compare_detectors(
    df: DataFrame,
    first: tuple[str, Detector],
    second: tuple[str, Detector],
    text_col: str = "text",
    id_col: str = "Id",
    config: RiskConfig = RiskConfig(),
) -> DataFrame:
    """Two named detectors side by side on the same rows, with a flag for differing decisions.

    Text is normalized and matched once, and nothing is joined; for tables that are already
    scored there is ``compare_scored``.
    """
    out = text_components(df, text_col)
    shown = []
    for name, detector in (first, second):
        out = (
            _with_risk(out, detector, text_col, config)
            .withColumn(f"ml_score_{name}", F.round("_ml", 6))
            .withColumn(f"risk_score_{name}", F.round("_risk", 6))
            .withColumnRenamed("decision", f"decision_{name}")
            .drop("_ml", "_risk")
        )
        shown += [f"ml_score_{name}", f"risk_score_{name}", f"decision_{name}"]
    differs = F.col(f"decision_{first[0]}") != F.col(f"decision_{second[0]}")
    return out.select(id_col, *shown, differs.alias("disagrees"))


def scan(
    df: DataFrame,
    detector: Detector,
    text_col: str = "text",
    id_col: str = "Id",
    config: RiskConfig = RiskConfig(),
    metadata_col: str | None = None,
) -> DataFrame:
    """The id and one nested result per row."""
    require_columns(df, [id_col])
    scored = score_components(df, detector, text_col, config)
    metadata = F.col(metadata_col) if metadata_col else F.lit(None).cast("map<string,string>")
    return scored.select(
        id_col,
        "decision",
        "risk_level",
        "risk_score",
        F.struct(
            F.lit(detector.model_name).alias("model"),
            F.col("ml_score").alias("jailbreak_probability"),
        ).alias("ml"),
        F.struct(F.col("heuristic_score").alias("score"), "matched_rules").alias(
            "prompt_injection"
        ),
        F.struct(F.col("unicode_score").alias("score"), "signals").alias("text_anomalies"),
        "reasons",
        F.col(text_col).alias("raw_text"),
        "normalized_text",
        "sanitized_text",
        metadata.alias("source_metadata"),
    )


def scan_batch(
    df: DataFrame,
    detector: Detector,
    text_col: str = "text",
    id_col: str = "Id",
    config: RiskConfig = RiskConfig(),
    order_by: tuple[str, ...] = (),
    allow_empty: bool = False,
) -> DataFrame:
    """The flat prediction table, reasons as a JSON array.

    Without an id column the row's position in the order of ``order_by`` takes its place. An
    empty table is refused, by a look at its first row, unless ``allow_empty``; a stream never is.
    """
    if not (allow_empty or df.isStreaming):
        require_rows(df)
    if id_col not in df.columns:
        if not order_by:
            raise ValueError(f"input has no {id_col}; name the columns that order the rows")
        df = with_row_index(df, order_by, id_col)
    scored = score_components(df, detector, text_col, config)
    return scored.select(id_col, *FLAT_SCORES, "decision", F.to_json("reasons").alias("reasons"))


def rejected_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows without text; a scan gives them no decision."""
    return df.filter(F.col(text_col).isNull())
