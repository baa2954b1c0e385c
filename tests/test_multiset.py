"""Fingerprints that add up, and metrics taken by the writing job."""

import pytest
from pyspark.sql import functions as F

from textrisk.operators.multiset import (
    LIMBS,
    Watched,
    merged_states,
    multiset_fingerprint,
    multiset_state,
    state_fingerprint,
)

ROWS = [(i, f"text {i % 7}", None if i % 5 else float(i)) for i in range(60)]
SCHEMA = "a int, b string, c double"


def test_parts_add_up_to_the_whole(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    whole = state_fingerprint(multiset_state(df)).first()
    assert whole["rows"] == 60
    parts = [multiset_state(df.where(F.col("a") % 4 == k).repartition(k + 1)) for k in range(4)]
    parts.append(multiset_state(df.limit(0)))
    first, *others = parts
    for other in others:
        first = first.unionAll(other)
    assert state_fingerprint(merged_states(first)).first() == whole
    # A merged state can be merged again.
    low, high = (merged_states(parts[i].unionAll(parts[i + 1])) for i in (0, 2))
    assert state_fingerprint(merged_states(low.unionAll(high))).first() == whole


@pytest.mark.parametrize("other", [
    ROWS[1:], ROWS + ROWS[:1], [(0, "text 1", 0.0), *ROWS[1:]], [(None, "text 0", 0.0), *ROWS[1:]],
    [(0, None, 0.0), *ROWS[1:]], [(0, "", 0.0), *ROWS[1:]], [(ROWS[1][0], *ROWS[0][1:]), (ROWS[0][0], *ROWS[1][1:]), *ROWS[2:]],
])
def test_any_change_shows(spark, other):
    assert multiset_fingerprint(spark.createDataFrame(ROWS, SCHEMA)) != multiset_fingerprint(spark.createDataFrame(other, SCHEMA))


def test_order_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert multiset_fingerprint(df) == multiset_fingerprint(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(5))
    assert multiset_fingerprint(df, ["a", "b"]) != multiset_fingerprint(df, ["b", "a"])


def test_limbs_use_all_their_bits(spark):
    limbs = multiset_state(spark.createDataFrame(ROWS[:1], SCHEMA)).first()["limbs"]
    assert len(limbs) == LIMBS and max(limbs) > 1 << 22 and len(set(limbs)) > LIMBS - 3


def test_watched_rows_are_those_that_pass(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    watched = Watched(df, ["a", "b"], empty=F.count_if(F.col("c").isNull()), top=F.max("a"))
    assert watched.table.columns == df.columns
    watched.table.where("a < 10").write.parquet(str(tmp_path / "some"))
    found = watched.result()
    assert found == {"rows": 60, "empty": 48, "top": 59, "fingerprint": multiset_fingerprint(df, ["a", "b"])}
