"""Similarity join of documents on their word shingles, by parity sketches.

A document's set holds its distinct shingles. The shingles are dealt into parts by a hash, and
each part keeps the exclusive or of its shingles' hashes: the code of a wide bit sketch in which
every shingle flips one bit, so that two documents agree on a part exactly when no shingle of
their symmetric difference fell into it. Documents that reach the threshold differ in at most a
seventh of the sum of their sizes, so by the pigeonhole principle they agree on some parts; per
size band the number of parts is set so that ``AGREEMENTS`` agreeing parts that hold a shingle
are expected for the least similar pair of the band. All are missed with a probability of about
exp(-AGREEMENTS), for pairs just at the threshold; more similar ones agree far more often.

Documents of equal sets are one throughout. Those that agree on a part are grouped by a sort,
in blocks. First each member of a group is verified against the group's center, and the links are
joined up; groups choose their centers by ``CENTERS`` different orders, so that one odd center
does no harm. A group that then lies in one component is done. Of the others, members of
different components are compared block by block: a narrow bit sketch, whose Hamming distance
bounds the symmetric difference from below, leaves few pairs to verify. So a large group of
copies or near copies costs a number of rows in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import as_batch, field_type, map_batches, release, small_batches, stored, texts_of
from textrisk.llm.components import connected_components

WORDS = 5
AGREEMENTS = 16
BLOCK = 256  # members of a group that are kept in one row
CENTERS = 8
SKETCH_BITS = 2048  # of the narrow sketch
# Representatives of candidate sets that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


# ---- sets ---------------------------------------------------------------------------------


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Words are maximal runs without ASCII white space, with A-Z in lower case; a text of fewer
    words has its whole sequence as one shingle, a text without words none.
    """
    split = [text.encode().lower().split() for text in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    hash_of = {word: xxhash.xxh3_64_intdigest(word) for word in set().union(*split)}.__getitem__
    flat = np.fromiter((hash_of(word) for s in split for word in s), np.uint64, int(sizes.sum()))
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for i in range(words):
        rolled = _mixed(rolled * _MIX + flat[i : i + len(rolled)] + np.uint64(words))
    out, at = [], 0
    for size in sizes.tolist():
        if size >= words:
            out.append(np.unique(rolled[at : at + size - words + 1]))
        elif size:
            whole = np.zeros(1, np.uint64)
            for word in flat[at : at + size]:
                whole = _mixed(whole * _MIX + word + np.uint64(size))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def set_key(shingles: np.ndarray) -> int | None:
    """A signed 64-bit key of a set; None for the empty set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


# ---- sketches -----------------------------------------------------------------------------


def parts_of_band(band: int, num: int, den: int) -> int:
    """Parts for pairs whose smaller set has ``2 ** band`` to ``2 ** (band + 1) - 1`` shingles."""
    small = 2 ** (band + 1) - 1
    large = small * den / num
    worst = ((small + small) * (den - num) / (den + num), small), (large - small, large)
    parts = 1
    while True:
        # Parts without a differing shingle and with a common one, if shingles fall at random.
        expected = min(
            parts * math.exp(-differ / parts) * -math.expm1(-(2 * size - differ) / 2 / parts) for differ, size in worst
        )
        if expected >= min(AGREEMENTS, 0.7 * small) or parts >= 16 * small:
            return parts
        parts += max(1, parts // 16)


def bands_of(size: int, num: int, den: int) -> list[int]:
    """The bands in which a set of that size looks for partners: its own as the smaller set, and
    the lower ones that reach up to it."""
    own = size.bit_length() - 1
    reach = -(-size * num // den)  # the smallest partner
    return list(range(reach.bit_length() - 1, own + 1))


def part_codes(shingles: np.ndarray, band: int, parts: int) -> np.ndarray:
    """The codes of the parts that hold a shingle, told apart by band and part."""
    mixed = _mixed(shingles + np.uint64((band + 1) * int(_MIX) % (1 << 64)))
    part = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part)
    part, mixed = part[order], mixed[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    codes = np.bitwise_xor.reduceat(mixed, starts)
    return _mixed(codes + part[starts] * _MIX + np.uint64(band))


def narrow_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles on each of ``SKETCH_BITS`` bits."""
    bits = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


# ---- the join -----------------------------------------------------------------------------


def _sets_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("id", field_type(docs, id_col)),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set", T.LongType()),
        ]
    )

    def rows_of(batch: pa.RecordBatch):
        sets = shingle_sets(texts_of(batch.column(1)))
        yield [batch.column(0), [len(s) for s in sets], [set_key(s) for s in sets]]

    return map_batches(docs.select(id_col, text_col), rows_of, schema)


def _codes_table(docs: DataFrame, text_col: str, num: int, den: int) -> DataFrame:
    """``code, set`` of every part of every distinct set of a batch."""
    parts: dict[int, int] = {}

    def rows_of(batch: pa.RecordBatch):
        sets = {key: s for s in shingle_sets(texts_of(batch.column(0))) if (key := set_key(s)) is not None}
        codes, keys = [], []
        for key, shingles in sets.items():
            for band in bands_of(len(shingles), num, den):
                if band not in parts:
                    parts[band] = parts_of_band(band, num, den)
                found = part_codes(shingles, band, parts[band])
                codes.append(found)
                keys.append(np.full(len(found), key, np.int64))
        if codes:
            codes, keys = np.concatenate(codes).view(np.int64), np.concatenate(keys)
            for at in range(0, len(codes), 20_000):
                yield [codes[at : at + 20_000], keys[at : at + 20_000]]

    return map_batches(docs.select(text_col), rows_of, "code long, set long")


def _groups(codes: DataFrame) -> DataFrame:
    """``code, center, block, members``: the sets that share a code, where there are several, in
    blocks; the center is the first of them in one of ``CENTERS`` orders. Groups of one block
    that have the same members are one. Rows come through a sort that spills, and a task holds
    one block."""
    schema = T._parse_datatype_string("code long, center long, block int, members array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        code, center, block, members = None, None, 0, []

        def close():
            if block or len(members) == BLOCK:
                out.append((code, center, block, members))
            elif len(members) > 1:
                listed = sorted(members)
                out.append((xxhash.xxh3_64_intdigest(str(listed)) - (1 << 63), center, 0, listed))

        for batch in batches:
            codes, sets = (c.to_numpy() for c in batch.columns)
            # Rows without an equal code next to them need no closer look.
            same = codes[1:] == codes[:-1]
            first, final = np.concatenate([[True], same]), np.concatenate([same, [True]])
            picked = np.flatnonzero(first | final)
            out = []
            for c, s in zip(codes[picked].tolist(), sets[picked].tolist(), strict=True):
                if c != code:
                    close()
                    code, center, block, members = c, s, 0, [s]
                elif s != members[-1]:
                    if len(members) == BLOCK:
                        close()
                        block, members = block + 1, []
                    members.append(s)
            if out:
                yield as_batch(list(zip(*out, strict=True)), arrow)
        out = []
        close()
        if out:
            yield as_batch(list(zip(*out, strict=True)), arrow)

    order = F.xxhash64("set", F.pmod("code", F.lit(CENTERS)))
    ordered = codes.repartition("code").sortWithinPartitions("code", order, "set")
    return ordered.mapInArrow(run, schema).dropDuplicates(["code", "block"])


def _shingles_table(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame) -> DataFrame:
    """``set, shingles, sketch`` of the representatives ``id, set`` in ``reps``."""
    schema = "set long, shingles binary, sketch binary"
    small = reps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    reps = reps.select(F.col("id").alias("rep"), "set")
    wanted = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(
        F.broadcast(reps) if small else reps, "rep"
    )

    def rows_of(batch: pa.RecordBatch):
        sets = shingle_sets(texts_of(batch.column(0)))
        # Another text under a representative's id is not the one that is meant.
        rows = [(k, s) for k, s in zip(batch.column(1).to_pylist(), sets, strict=True) if set_key(s) == k]
        if rows:
            yield [[k for k, _ in rows], [s.tobytes() for _, s in rows], [narrow_sketch(s) for _, s in rows]]

    return map_batches(wanted.select("text", "set"), rows_of, schema).dropDuplicates(["set"])


def _verified(pairs: DataFrame, shingles: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the distinct pairs ``a, b`` whose sets reach the threshold."""
    sets = shingles.select("set", "shingles")
    joined = pairs.join(sets.withColumnsRenamed({"set": "a", "shingles": "a_set"}), "a").join(
        sets.withColumnsRenamed({"set": "b", "shingles": "b_set"}), "b"
    )

    def rows_of(batch: pa.RecordBatch):
        linked = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            one, other = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.sort(np.concatenate([one, other]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            linked.append(den * common >= num * (len(both) - common))
        keep = pa.array(linked)
        if keep.true_count:
            yield [batch.column(0).filter(keep), batch.column(1).filter(keep)]

    return map_batches(joined.select("a", "b", "a_set", "b_set"), rows_of, "a long, b long")


def _across(groups: DataFrame, labels: DataFrame, shingles: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a, b`` of members of one group that lie in different components and that sizes and
    narrow sketches do not rule out; the center's pairs are left out, being verified already."""
    rows = groups.select("code", "center", "block", F.explode("members").alias("set"))
    labelled = rows.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    mixed = (
        labelled.groupBy("code")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
        .where("low <> high AND n > 2")
        .select("code")
    )
    known = sizes.join(shingles.select("set", "sketch"), "set")
    members = labelled.where("set <> center").join(mixed, "code", "left_semi").join(known, "set")
    blocks = members.groupBy("code", "block").agg(
        F.collect_list(F.struct("set", "label", "n_shingles", "sketch")).alias("members")
    )
    blocks = stored(blocks, "blocks")
    one = blocks.select("code", F.col("block").alias("i"), F.col("members").alias("one"))
    other = blocks.select("code", F.col("block").alias("j"), F.col("members").alias("other"))
    met = one.join(other, "code").where("i <= j")

    def arrays(column: pa.Array, row: int) -> tuple[np.ndarray, ...]:
        found = column[row].values
        sketches = np.frombuffer(b"".join(found.field("sketch").to_pylist()), np.uint64).reshape(len(found), -1)
        return *(found.field(n).to_numpy() for n in ("set", "label", "n_shingles")), sketches

    def rows_of(batch: pa.RecordBatch):
        for row in range(batch.num_rows):
            a, a_label, a_size, a_bits = arrays(batch.column(0), row)
            b, b_label, b_size, b_bits = arrays(batch.column(1), row)
            one, other = a_size[:, None], b_size[None, :]
            may = (a_label[:, None] != b_label[None, :]) & (den * np.minimum(one, other) >= num * np.maximum(one, other))
            i, j = np.nonzero(may)
            for at in range(0, len(i), 16_384):
                p, q = i[at : at + 16_384], j[at : at + 16_384]
                differ = np.bitwise_count(a_bits[p] ^ b_bits[q]).sum(axis=1, dtype=np.int64)
                near = differ * (den + num) <= (a_size[p] + b_size[q]) * (den - num)
                if near.any():
                    p, q = a[p[near]], b[q[near]]
                    pairs = np.unique(np.column_stack([np.minimum(p, q), np.maximum(p, q)]), axis=0)
                    yield [pairs[:, 0], pairs[:, 1]]

    return map_batches(met.select("one", "other"), rows_of, "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100
) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` and ``component_id``, the smallest id that
    links lead to, its own included.

    Two documents link when ``den`` times the size of their sets' intersection is at least
    ``num`` times the size of the union. Null, empty and blank texts have no shingles and link
    with nothing, not even with each other. Ids are whole numbers; rows that repeat an id count
    as one node; null ids get a null component unless a link leads on. Other columns are dropped.
    """
    small_batches(docs.sparkSession)
    table = stored(_sets_table(docs, id_col, text_col), "sets")
    groups = stored(_groups(_codes_table(docs, text_col, num, den)), "groups")
    sizes = table.where("set IS NOT NULL").groupBy("set").agg(
        F.min("id").alias("id"), F.max("n_shingles").alias("n_shingles")
    )
    sizes = stored(sizes, "sizes")
    candidates = groups.select(F.explode("members").alias("set")).distinct()
    reps = stored(sizes.join(candidates, "set").select("id", "set"), "reps")
    shingles = stored(_shingles_table(docs, id_col, text_col, reps), "shingles")

    stars = groups.select(F.col("center").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct()
    links = stored(_verified(stars, shingles, num, den), "links")
    labels = connected_components(links).select(F.col("node").alias("set"), F.col("component").alias("label"))
    labels = stored(labels, "labels")
    more = _across(groups, labels, shingles, sizes.select("set", "n_shingles"), num, den)
    links = links.unionByName(stored(_verified(more, shingles, num, den), "links"))

    ids = sizes.select("set", "id")
    named = (
        links.join(ids.withColumnsRenamed({"set": "a", "id": "a_id"}), "a")
        .join(ids.withColumnsRenamed({"set": "b", "id": "b_id"}), "b")
        .select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    )
    components = stored(connected_components(named), "components")
    release(groups, shingles, reps)
    smallest = ids.join(components, ids["id"] == components["node"], "left").select(
        "set", F.coalesce("component", "id").alias("component_id")
    )
    return table.join(stored(smallest, "smallest"), "set", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )
