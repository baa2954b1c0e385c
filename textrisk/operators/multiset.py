"""Fingerprints of tables that can be added up.

A row's digest is stretched to ``LIMBS`` numbers of 24 bits, and a table's state is the sum of its
rows' numbers, each modulo 2^24, with the number of rows. States of parts add up to the state of
the whole, in any order, so appended files or stream batches extend a fingerprint without a second
read, and a job can take the fingerprint of what it reads and writes while it runs. Each limb is
summed in 64 bits, which holds 2^39 rows between two reductions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textrisk.functions.once import computed_once
from textrisk.operators.fingerprint import row_digest

DIGESTS, PER_DIGEST, HEX = 4, 10, 6
LIMBS = DIGESTS * PER_DIGEST
_LIMIT = 1 << (4 * HEX)


def row_limbs(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The numbers of a row as an array."""
    digest = row_digest(df, columns or df.columns)
    stretched = [F.sha2(F.concat(digest, F.lit(f":{i}")), 256) for i in range(DIGESTS)]
    wide = F.concat(*(F.left(part, F.lit(PER_DIGEST * HEX)) for part in stretched))
    at = F.sequence(F.lit(0), F.lit(LIMBS - 1))
    return F.transform(
        F.arrays_zip(at.alias("i"), F.array_repeat(wide, LIMBS).alias("w")),
        lambda x: F.conv(F.substr(x["w"], x["i"] * HEX + 1, F.lit(HEX)), 16, 10).cast("bigint"),
    )


def _sums(limbs_col: str) -> list[Column]:
    return [F.coalesce(F.sum(F.get(limbs_col, F.lit(i))), F.lit(0)).alias(f"limb_{i}") for i in range(LIMBS)]


def _state(summed: DataFrame) -> DataFrame:
    return summed.select("rows", F.array(*(F.col(f"limb_{i}") % _LIMIT for i in range(LIMBS))).alias("limbs"))


def multiset_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows, limbs``."""
    limbs = computed_once(df.select(row_limbs(df, columns).alias("_limbs")), ["_limbs"])
    return _state(limbs.agg(F.count("*").alias("rows"), *_sums("_limbs")))


def merged_states(states: DataFrame) -> DataFrame:
    """The state of all parts together, from a table of ``rows, limbs``."""
    return _state(states.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *_sums("limbs")))


def state_fingerprint(states: DataFrame) -> DataFrame:
    """``rows, fingerprint`` of each state: a SHA-256 over the number of rows and the limbs."""
    shown = F.transform("limbs", lambda x: F.lpad(F.lower(F.hex(x)), HEX, "0"))
    text = F.concat(F.col("rows").cast("string"), F.lit(":"), F.array_join(shown, ""))
    return states.select("rows", F.sha2(text, 256).alias("fingerprint"))


def multiset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    return state_fingerprint(multiset_state(df, columns)).first()["fingerprint"]


class Watched:
    """Metrics of the rows of a table, taken by the first job that reads all of ``table``.

    ``table`` has the columns of ``df``; besides its fingerprint, further aggregates may be given.
    Rows are counted where they pass, so ``table`` should be read through narrow steps, in which no
    row is made twice.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, **aggregates: Column):
        self._spark, self._found, self._names = df.sparkSession, Observation(), list(aggregates)
        marked = computed_once(df.withColumn("_limbs", row_limbs(df, columns)), ["_limbs"])
        wanted = [F.count("*").alias("rows"), *_sums("_limbs")]
        wanted += [value.alias(name) for name, value in aggregates.items()]
        self.table = marked.observe(self._found, *wanted).drop("_limbs")

    def result(self) -> dict:
        """``rows, fingerprint`` and the other aggregates; waits for the job."""
        found = self._found.get
        row = [(found["rows"], [found[f"limb_{i}"] % _LIMIT for i in range(LIMBS)])]
        state = self._spark.createDataFrame(row, "rows bigint, limbs array<bigint>")
        taken = state_fingerprint(state).first().asDict()
        return taken | {name: found[name] for name in self._names}
