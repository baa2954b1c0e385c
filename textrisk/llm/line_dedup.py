"""Removal of lines that recur across sites.

The spread of a line is the number of distinct sites on which it occurs, in distinct texts.
HyperLogLog sketches per line hash, merged by aggregation, estimate it; lines whose estimate
is near the threshold are counted exactly. Occurrences of a line are spread over ``SALTS`` tasks,
whose sketches are merged, so a line that every document holds is no burden for one task. The
hashes of boilerplate lines, few in comparison, are sent to all tasks if there are at most
``BROADCAST_LINES``, and texts stay where they are; more are joined by a shuffle of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrisk.llm.common import release, stored

MIN_SITES = 5  # distinct sites, and distinct texts, from which on a line is boilerplate
SKETCH_LG_K = 10
# Estimates within this share of the threshold are settled by an exact count: over four standard
# errors of such a sketch.
MARGIN = 0.15
SALTS = 8
BROADCAST_LINES = 200_000  # 8 bytes each


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``docs``."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def occurrences(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """``line, text, site``: hashes, once per line of a text on a site; blank lines are left out."""
    site = F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("")))
    lines = F.filter(_lines(F.col(text_col)), lambda line: F.trim(line) != "")
    hashes = F.array_distinct(F.transform(lines, line_hash))
    return docs.select(F.explode(hashes).alias("line"), F.xxhash64(text_col).alias("text"), site.alias("site"))


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The hashes of lines that occur in ``min_sites`` distinct texts and on as many sites."""
    spread = found.groupBy("line").agg(
        *(f(c).alias(f"{c}_{name}") for c in ("site", "text") for name, f in (("low", F.min), ("high", F.max)))
    )
    several = spread.where("site_low <> site_high AND text_low <> text_high").select("line")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = found.withColumn("salt", F.pmod("text", F.lit(SALTS)).cast("int")).join(
        several.withColumn("salt", salts), ["line", "salt"], "left_semi"
    )
    columns = ("site", "text")
    sketched = (
        salted.groupBy("line", "salt")
        .agg(*(F.hll_sketch_agg(c, SKETCH_LG_K).alias(c) for c in columns))
        .groupBy("line")
        .agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns))
    )
    least = F.least(*columns)
    sketched = stored(sketched.where(least >= min_sites * (1 - MARGIN)), "spread")
    near = sketched.where(least < min_sites * (1 + MARGIN)).select("line")
    pairs = found.join(near, "line", "left_semi")
    exact = None
    for column in columns:
        counted = pairs.select("line", column).distinct().groupBy("line").count()
        kept = counted.where(F.col("count") >= min_sites).select("line")
        exact = kept if exact is None else exact.join(kept, "line", "left_semi")
    far = sketched.where(least >= min_sites * (1 + MARGIN)).select("line")
    return far.unionByName(exact)


def remove_boilerplate(
    docs: DataFrame,
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines taken out of the text; all columns stay.

    A line is boilerplate when it occurs in ``min_sites`` distinct texts and on as many distinct
    sites, so exact copies of one document do not make its lines boilerplate. Lines are compared
    without the blanks around them; blank lines always stay. A text of boilerplate alone becomes
    empty; null text stays null; a null site counts as one site. Repeated rows all stay.
    """
    found = stored(occurrences(docs, text_col, site_col), "occurrences")
    lines = stored(boilerplate(found, min_sites), "boilerplate")
    if lines.limit(broadcast_lines + 1).count() <= broadcast_lines:
        release(found)
        return _without_listed(docs, text_col, np.array([row["line"] for row in lines.collect()], np.int64))
    return _without_joined(docs, text_col, found, lines)


def _without_listed(docs: DataFrame, text_col: str, lines: np.ndarray) -> DataFrame:
    listed = np.sort(lines)

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def stays(hashes: pa.Array) -> pa.Array:
        """Of each line of each text; a blank line's hash is null."""
        flat = hashes.flatten()
        values = flat.fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(listed, values), max(0, len(listed) - 1))
        kept = listed[at] != values if len(listed) else np.ones(len(values), bool)
        kept |= flat.is_null().to_numpy(zero_copy_only=False)
        ends = np.cumsum(hashes.value_lengths().fill_null(0).to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(kept))

    lines_of = _lines(F.col(text_col))
    hashes = F.transform(lines_of, lambda line: F.when(F.trim(line) != "", line_hash(line)))
    stays_col = _unused(docs, "__llm_stays")
    mask = F.col(stays_col)
    kept = F.filter(lines_of, lambda line, i: F.get(mask, i))
    cleaned = F.when(F.forall(mask, lambda stay: stay), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return docs.withColumn(stays_col, stays(hashes)).withColumn(text_col, cleaned).select(*docs.columns)


def _without_joined(docs: DataFrame, text_col: str, found: DataFrame, lines: DataFrame) -> DataFrame:
    text_key, drop_col = _unused(docs, "__llm_text"), _unused(docs, "__llm_drop")
    drops = (
        found.join(lines, "line", "left_semi")
        .groupBy(F.col("text").alias(text_key))
        .agg(F.collect_set("line").alias(drop_col))
    )
    drops = stored(drops, "drops")
    release(found)
    drop = F.col(drop_col)
    kept = F.filter(_lines(F.col(text_col)), lambda line: (F.trim(line) == "") | ~F.array_contains(drop, line_hash(line)))
    cleaned = F.when(drop.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return (
        docs.withColumn(text_key, F.xxhash64(text_col))
        .join(drops.hint("merge"), text_key, "left")
        .withColumn(text_col, cleaned)
        .select(*docs.columns)
    )
