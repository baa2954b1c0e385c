"""Keeping costly expressions from being copied into pushed-down filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same table, with ``columns`` passed through a generator of one row.

    A filter on a computed column is otherwise rewritten in terms of the columns it was made
    from, which evaluates it twice and, through several such steps, grows without bound. Filters
    on generated columns stay above the generator; those on all other columns still move down to
    the scan.
    """
    kept = [c for c in df.columns if c not in set(columns)]
    made = df.select(*kept, F.inline(F.array(F.struct(*columns))))
    return made.select(*df.columns)
