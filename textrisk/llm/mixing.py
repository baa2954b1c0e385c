"""Mixing of sources to target weights by exponential keys and prefix sums.

Every source gets a budget of words. As many complete epochs as fit into it come first; what is
left is spent on single documents, in the order of Efraimidis-Spirakis keys: ``-ln(u) / weight``
with a uniform ``u`` made from the id, so a document of twice the weight comes first twice as
often, and reruns agree. The document at which the budget ends is taken in part.

Rows without their texts are range-sorted by source and key, so a source that holds a third of
all rows is spread over a third of the tasks; prefix sums run inside each range of a source, and
the sums of the ranges before it are added. Built of DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textrisk.llm.common import null_part, stored
from textrisk.operators.ordering import with_row_index

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
# Rows of about 100 bytes, without texts, that one sorted range holds.
RANGE_ROWS = 1_000_000

_SOURCE = ["no_source", "source"]


def word_count(text: Column | str) -> Column:
    """Maximal runs of characters other than blank, tab, line and page ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(id_col: Column | str, seed: str = SEED) -> Column:
    """A number between 0 and 1, both excluded, from the first 52 bits of a digest of the id."""
    text = F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def exponential_key(draw: Column, weight: Column) -> Column:
    """Smaller keys come first; without a positive weight a row comes last."""
    return F.when(weight > 0, -F.log(draw) / weight).otherwise(F.lit(float("inf")))


def source_targets(sources: DataFrame, cycle: Sequence[int], share: float, most: int) -> DataFrame:
    """Add ``target`` to a stored table of ``no_source, source, source_size``.

    The sources, null last, weigh the numbers of ``cycle`` in turn and share ``share`` times the
    size of all. A target stops at ``most`` times the source's size, and what it had above is
    reshared by weight until none is above. Only sums come to the driver.
    """
    parts = F.array(*map(F.lit, cycle))
    placed = with_row_index(sources, _SOURCE, "place")
    weighed = stored(placed.withColumn("part", F.get(parts, (F.col("place") % len(cycle)).cast("int"))), "mix-sources")
    wanted = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while True:
        above = F.col("source_size") * most < F.lit(level) * F.col("part")
        stopped, open_parts = weighed.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("part"))), F.lit(0)),
        ).first()
        if (stopped, open_parts) == before or not open_parts:
            break
        before = (stopped, open_parts)
        level = (wanted - most * stopped) / open_parts
    full = (F.col("source_size") * most).cast("double")
    return weighed.select(*_SOURCE, "source_size", F.when(above, full).otherwise(F.lit(level) * F.col("part")).alias("target"))


def _with_weights(rows: DataFrame, weights: DataFrame | None, id_col: str, weight_col: str) -> DataFrame:
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    known = weights.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(weight_col).cast("double")).alias("weight")
    )
    apart = rows.withColumn("apart", null_part("id", "mark"))
    joined = apart.join(known.withColumn("apart", F.lit(0)), ["id", "apart"], "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("apart")


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str = "weight",
    cycle: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: str = SEED,
) -> DataFrame:
    """``id, source, size, source_size, target, taken`` of every row of ``docs``.

    ``size`` is the number of words, ``target`` the budget of the source (``source_targets``) and
    ``taken`` the words of the row in the mix, repeats counted, never more than ``most`` times
    its size. The words taken of a source add up to its target, rounded.

    ``weights`` is a table of ``id_col, weight_col``: the larger, the earlier a row is drawn. Of
    several weights the largest holds, ids without one weigh 1, and rows with a weight of 0 or
    less come last. Null and empty texts have size 0 and are never taken; a null source is a
    source, the last one. Rows that repeat an id are rows of their own, drawn next to each other;
    rows without an id share one draw. Ties go by id, then by a hash of the text. An empty table
    gives an empty result; other columns are not looked at.
    """
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            word_count(text_col).alias("size"),
            F.xxhash64(text_col).alias("mark"),
            F.monotonically_increasing_id().alias("spread"),
        ),
        "mix-rows",
    )
    # One row per source; a source is summed in every task before anything is sent.
    sources = stored(rows.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")), "mix-sizes")
    targets = source_targets(sources, cycle, share, most)
    key = exponential_key(uniform("id", seed), F.col("weight"))
    keyed = _with_weights(rows, weights, id_col, weight_col).withColumn("key", key).drop("weight")
    order = ["key", "id", "mark", "spread"]  # the last spreads rows that are all alike
    session = docs.sparkSession
    ranges = max(int(session.conf.get("spark.sql.shuffle.partitions")), ceil(rows.count() / RANGE_ROWS))
    placed = stored(
        keyed.repartitionByRange(ranges, *_SOURCE, *order).withColumn("range", F.spark_partition_id()), "mix-ranges"
    )
    loads = placed.groupBy("range", *_SOURCE).agg(F.sum("size").alias("load"))
    earlier = W.partitionBy(*_SOURCE).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    size, target = F.col("source_size"), F.col("target")
    epochs = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("bigint")
    plans = (
        loads.withColumn("earlier", F.coalesce(F.sum("load").over(earlier), F.lit(0)))
        .join(targets, _SOURCE)
        .withColumn("epochs", epochs)
        .withColumn("budget", F.floor(target - F.col("epochs") * size + 0.5))
        .drop("load")
    )
    inside = W.partitionBy("range", *_SOURCE).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # A row per range and source: Spark sends it to all tasks if its files are small enough.
    mixed = summed.join(stored(plans, "mix-plans"), ["range", *_SOURCE])
    rest = F.col("budget") - F.col("earlier") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return mixed.select(
        F.col("id").alias(id_col),
        F.when(~F.col("no_source"), F.col("source")).alias(source_col),
        "size",
        "source_size",
        "target",
        taken.cast("bigint").alias("taken"),
    )
