"""How document filters act on each other: what each removes, in every order of filters.

A row's verdicts are one bit per filter. Those about the text alone come from one pass over the
texts. Whether an earlier row has the same text is found with radix tries: texts are dealt to
tasks by ranges that adaptive prefixes bound, each range is inserted in full into a compressed
trie whose terminals hold the smallest id, and its traversal yields the first row of every
distinct text. Rows then shrink to counts per part and mask, from which every order of the
filters is worked out.

Copies meet before they are sent: a block of input sends one copy of a text. A text of which all
blocks hold one may still be much for one task, so the heaviest texts, a thousand at most, go
through a first round of tries by range and salt.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import ceil, factorial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import as_batch, bounded_batches, field_type, map_batches, null_part, stored

# The filters. Words are runs of bytes other than blank, tab, line and page ends.
LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # distinct words in a hundred
MOST_UPPER = 5  # A to Z in a hundred code points
SIGNS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes inside a code point
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20  # bytes of one text whose words are listed at once

RANGE_BYTES = 32 << 20  # of distinct texts in one trie
BLOCK_BYTES = 16 << 20  # of distinct texts in which copies meet before the shuffle
SAMPLES = 20  # prefixes per range, from which its bounds are taken
FIRST_DEPTH, DEEPER = 32, 8  # characters of a prefix, and the factor where texts share it
HEAVY_SHARE = 1000  # a text whose copies make up more than one in so many bytes is heavy
SALTS = 64


# ---- one text -----------------------------------------------------------------------------


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces that break no word."""
    start = 0
    while len(data) - start > _PIECE:
        blank = _BLANK.search(data, start + _PIECE)
        if blank is None:
            break
        yield data[start : blank.start()]
        start = blank.start()
    yield data[start:] if start else data


def text_mask(data: bytes) -> int:
    """The filters A to D that a text in UTF-8 fails, one bit each."""
    words, distinct = 0, set()
    for piece in _pieces(data):
        found = piece.split()  # of bytes: at ASCII white space alone
        words += len(found)
        distinct.update(found)
    upper = len(data) - len(data.translate(None, UPPER))
    points = len(data.translate(None, _FOLLOWING))
    return (
        (words < LEAST_WORDS)
        | (100 * len(distinct) < LEAST_DISTINCT * words) << 1
        | (100 * upper > MOST_UPPER * points) << 2
        | (len(data.translate(None, SIGNS)) < len(data)) << 3
    )


def text_digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


# ---- tries --------------------------------------------------------------------------------


class _Node:
    __slots__ = ("edges", "text", "least")

    def __init__(self, text: bytes | None = None, least=None):
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.text, self.least = text, least


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``text`` from ``at``."""
    if text.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """A compressed trie of whole texts; the terminal of a text holds the smallest id it came with."""

    def __init__(self):
        self.root = _Node()

    def insert(self, text: bytes, key) -> None:
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                node.edges[text[at]] = (text[at:], _Node(text, key))
                return
            label, below = edge
            shared = _shared(label, text, at)
            if shared < len(label):
                fork = _Node()
                fork.edges[label[shared]] = (label[shared:], below)
                node.edges[text[at]] = (label[:shared], fork)
                below = fork
            node, at = below, at + shared
        if node.text is None:
            node.text, node.least = text, key
        elif key is not None and (node.least is None or key < node.least):
            node.least = key

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """Every text and its smallest id, which is null only where no copy had one."""
        pending = [self.root]
        while pending:
            node = pending.pop()
            if node.text is not None:
                yield node.text, node.least
            pending.extend(below for _, below in node.edges.values())


# ---- ranges -------------------------------------------------------------------------------


def split_prefixes(docs: DataFrame, text_col: str, rows: int, ranges: int) -> list[bytes]:
    """At most ``ranges - 1`` ascending prefixes, so that the distinct texts between two of them are
    about equally many.

    Taken from a sample of about ``SAMPLES`` prefixes a range, of texts chosen by their hash.
    Where so many texts share a prefix that it would bound several ranges, longer prefixes of
    these texts are looked at.
    """
    if ranges < 2:
        return []
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.select(F.xxhash64(text).alias("hash"), text.alias("text")).where(
        F.pmod("hash", F.lit(max(1, rows // (ranges * SAMPLES)))) == 0
    )
    bounds: set[str] = set()
    crowded, depth = {"": ranges}, FIRST_DEPTH
    before = 0
    while crowded:
        near = sample if not before else sample.where(F.substring("text", 1, before).isin(*crowded))
        prefixes = near.groupBy("hash").agg(F.min(F.substring("text", 1, depth)).alias("prefix"))
        members: dict[str, list[str]] = {}
        for row in prefixes.select("prefix").toLocalIterator():
            members.setdefault(row["prefix"][:before], []).append(row["prefix"])
        deeper: dict[str, int] = {}
        for start, parts in crowded.items():
            found = sorted(members.get(start, ()))
            cuts = [found[i * len(found) // parts] for i in range(1, parts)] if found else []
            for cut in cuts:
                if cut in bounds and len(cut) == depth:
                    deeper[cut] = deeper.get(cut, 1) + 1
                bounds.add(cut)
        crowded, before, depth = deeper, depth, depth * DEEPER
    return sorted(bound.encode() for bound in bounds if bound)


# ---- first rows of texts ------------------------------------------------------------------


def _binary(column: pa.Array) -> list[bytes]:
    return [b"" if data is None else data for data in column.cast(pa.binary()).to_pylist()]


def _batches(rows: Iterable[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few megabytes."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + len(row[text_at] or b"")
        if size > 4 << 20:
            yield as_batch(list(zip(*out, strict=True)), schema)
            out, size = [], 0
    if out:
        yield as_batch(list(zip(*out, strict=True)), schema)


def _dealt(
    docs: DataFrame, id_col: str, text_col: str, bounds: list[bytes], heavy: frozenset[int], tasks: int
) -> DataFrame:
    """``range, slot, salted, id, text``: once per distinct text of a block of input."""
    schema = T.StructType(
        [
            T.StructField("range", T.IntegerType()),
            T.StructField("slot", T.IntegerType()),
            T.StructField("salted", T.BooleanType()),
            T.StructField("id", field_type(docs, id_col)),
            T.StructField("text", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, salt = to_arrow_schema(schema), TaskContext.get().partitionId() % SALTS

        def rows(least: dict[bytes, object]) -> Iterator[tuple]:
            for text, key in least.items():
                place = bisect_right(bounds, text)
                salted = bool(heavy) and text_digest(text) in heavy
                yield place, (place + salted * (1 + salt)) % tasks, salted, key, text

        least: dict[bytes, object] = {}
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), _binary(batch.column(1)), strict=True):
                known = least.get(text, least)
                if known is least:
                    held += len(text)
                    least[text] = key
                elif key is not None and (known is None or key < known):
                    least[text] = key
            if held > BLOCK_BYTES:
                yield from _batches(rows(least), arrow, 4)
                least, held = {}, 0
        yield from _batches(rows(least), arrow, 4)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _tried(dealt: DataFrame, tasks: int, last: bool) -> DataFrame:
    """``id, digest`` of the first row of every text of a range; salted texts come back whole for
    a ``last`` round."""
    schema = T.StructType(
        [dealt.schema["id"], T.StructField("digest", T.LongType()), dealt.schema["range"], dealt.schema["text"]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie, now = RadixTrie(), None
            for batch in batches:
                columns = (batch.column(i).to_pylist() for i in range(4))
                for place, salted, key, text in zip(*columns, strict=True):
                    if (place, salted) != now:
                        yield from found(trie, now)
                        trie, now = RadixTrie(), (place, salted)
                    trie.insert(text, key)
            yield from found(trie, now)

        def found(trie: RadixTrie, now: tuple[int, bool] | None) -> Iterator[tuple]:
            again = now is not None and now[1] and not last
            for text, key in trie.terminals():
                yield key, text_digest(text), now[0], text if again else None

        yield from _batches(rows(), to_arrow_schema(schema), 3)

    placed = dealt.repartitionById(tasks, F.col("slot")).sortWithinPartitions("range", "salted")
    return placed.select("range", "salted", "id", "text").mapInArrow(run, schema)


def first_rows(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest`` of the row with the smallest id of every distinct text; null text is empty.

    ``marks`` is the stored ``text_marks`` of the same rows, from which the number of ranges and
    the heaviest texts are known. Rows without an id are first only where no other row has the
    text, and then the id is null.
    """
    spark = docs.sparkSession
    rows, size = marks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / RANGE_BYTES))
    bounds = split_prefixes(docs, text_col, rows, ranges)
    shares = marks.groupBy("digest").agg(F.count("*").alias("copies"), F.sum("bytes").alias("all"))
    # At most HEAVY_SHARE texts can be above the share.
    above = shares.where((F.col("copies") > 1) & (F.col("all") * HEAVY_SHARE > size)).select("digest")
    heavy = frozenset(row["digest"] for row in above.collect())
    with bounded_batches(spark):
        found = stored(_tried(_dealt(docs, id_col, text_col, bounds, heavy, ranges), ranges, last=False), "audit-tries")
        firsts = found.where("text IS NULL").select("id", "digest")
        if not heavy:
            return firsts
        again = found.where("text IS NOT NULL").select(
            "range", F.col("range").alias("slot"), F.lit(True).alias("salted"), "id", "text"
        )
        last = stored(_tried(again, ranges, last=True), "audit-heavy")
    return firsts.unionByName(last.select("id", "digest"))


# ---- rows and counts ----------------------------------------------------------------------


def text_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, digest, mask, bytes`` of every row: the filters A to D that its text fails."""
    schema = T.StructType(
        [
            T.StructField("id", field_type(docs, id_col)),
            T.StructField("part", T.StringType()),
            T.StructField("digest", T.LongType()),
            T.StructField("mask", T.IntegerType()),
            T.StructField("bytes", T.LongType()),
        ]
    )

    def marks(batch: pa.RecordBatch) -> Iterator[list]:
        texts = _binary(batch.column(2))
        digests = [text_digest(text) for text in texts]
        yield [batch.column(0), batch.column(1), digests, [text_mask(t) for t in texts], [len(t) for t in texts]]

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    return map_batches(docs.select(F.col(id_col), part, F.col(text_col).cast("string")), marks, schema)


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, mask, n``: equal rows counted, with the bit of each filter they fail.

    The last bit, for a text that a row of smaller id has, compares ids: a row without one neither
    fails it nor makes others fail, and rows that share the smallest id all pass.
    """
    with bounded_batches(docs.sparkSession):
        marks = stored(text_marks(docs, id_col, text_col, part_col), "audit-marks")
    firsts = first_rows(docs, marks, id_col, text_col).where("id IS NOT NULL")
    counted = marks.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    keys = ["id", "digest", "apart"]
    joined = counted.withColumn("apart", null_part("id", "digest")).join(
        firsts.withColumn("apart", F.lit(0)).withColumn("first", F.lit(True)), keys, "left"
    )
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(copy, 1 << (len(LETTERS) - 1)).otherwise(0)
    return joined.select("id", "part", mask.alias("mask"), "digest", "n")


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    good: str = "quality = 1",
    toxic: str = "toxic = 1",
) -> DataFrame:
    """One row per part, order of the filters and step; see ``interactions``.

    A null part is the part of the empty string, null text is empty, and rows without an id are
    never copies and have no label. Of several labels of one id any good one counts as good, any
    toxic one as toxic. Repeated rows count each. An empty table gives an empty result; other
    columns are not looked at.
    """
    rows = filter_masks(docs, id_col, text_col, part_col)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.expr(good).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce(F.expr(toxic).cast("int"), F.lit(0))).alias("toxic"),
    )
    joined = rows.withColumn("apart", null_part("id", "digest")).join(
        known.withColumn("apart", F.lit(0)), ["id", "apart"], "left"
    )

    def marked(name: str):
        return F.sum(F.coalesce(name, F.lit(0)) * F.col("n")).alias(name)

    cells = joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))
    return interactions(cells)


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each filter removes, part by part, in every order of the filters.

    ``cells`` has ``part, mask, n, good, toxic``, one row per part and mask, so a part has as many
    rows as there are masks at most. Every part gets ``filter_order``, ``step`` (from 1) and the
    counts ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and
    ``shapley``, the removals of the step's filter summed over all orders.
    """
    steps = []
    for order in permutations(range(len(letters))):
        name, earlier = "".join(letters[i] for i in order), 0
        for step, bit in enumerate(order, 1):
            steps.append({"filter_order": name, "step": step, "bit": 1 << bit, "earlier": earlier})
            earlier |= 1 << bit
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, earlier int>>")
    orders = factorial(len(letters))
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    stepped = held.select("part", "cells", F.explode(plan).alias("at")).select("part", "cells", "at.*")
    bit, earlier = F.col("bit"), F.col("earlier")

    def total(name: str, condition, value):
        picked = F.filter("cells", lambda c: condition(c["mask"]))
        return F.aggregate(picked, F.lit(0).cast("bigint"), lambda sum_, c: sum_ + value(c)).alias(name)

    def fails(mask):
        return mask.bitwiseAND(bit) != 0

    def gone(mask):
        return mask.bitwiseAND(earlier) != 0

    def removed(mask):
        return fails(mask) & ~gone(mask)

    return stepped.select(
        "part",
        "filter_order",
        "step",
        total("kept", lambda m: ~fails(m) & ~gone(m), lambda c: c["n"]),
        total("removed", removed, lambda c: c["n"]),
        total("redundant", lambda m: fails(m) & gone(m), lambda c: c["n"]),
        total("unique_fails", lambda m: m == bit, lambda c: c["n"]),
        total("good_lost", removed, lambda c: c["good"]),
        total("toxic_lost", removed, lambda c: c["toxic"]),
        # In one order out of as many as it fails filters, a row falls to this one.
        total("shapley", fails, lambda c: (c["n"] * orders / F.bit_count(c["mask"])).cast("bigint")),
    )
