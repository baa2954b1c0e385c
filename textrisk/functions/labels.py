"""Label columns to 0/1 targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted label spellings and the order in which columns are looked for.
TRAINING_LABELS = {"benign": 0, "jailbreak": 1, "0": 0, "1": 1}
TRUTH_LABELS = {"benign": 0, "jailbreak": 1, "safe": 0, "attack": 1, "0": 0, "1": 1}
TRUTH_COLUMNS = ("label", "TARGET", "target", "ground_truth", "y")
CATEGORY_COLUMNS = ("category", "attack_category", "type")


def mapped_label(label: Column, spellings: dict[str, int]) -> Column:
    """0/1 for a known spelling, null otherwise."""
    text = label.cast("string")
    out = F.lit(None).cast("int")
    for value in sorted(set(spellings.values())):
        names = [name for name, target in spellings.items() if target == value]
        out = F.when(text.isin(names), F.lit(value)).otherwise(out)
    return out


def first_present(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((name for name in names if name in df.columns), None)


def truth_column(df: DataFrame) -> str:
    name = first_present(df, TRUTH_COLUMNS)
    if name is None:
        raise ValueError(f"no ground-truth column; looked for {', '.join(TRUTH_COLUMNS)}")
    return name


def with_truth(df: DataFrame, out_col: str = "_target") -> DataFrame:
    """Add the 0/1 target read from the first known ground-truth column.

    A value outside the domain, or null, raises when the target is evaluated;
    ``checks.unknown_labels`` lists such values.
    """
    label = F.col(truth_column(df))
    target = mapped_label(label, TRUTH_LABELS)
    shown = F.coalesce(label.cast("string"), F.lit("null"))
    refused = F.raise_error(F.concat(F.lit("ground truth outside the domain: "), shown)).cast("int")
    return df.withColumn(out_col, F.when(target.isNotNull(), target).otherwise(refused))
