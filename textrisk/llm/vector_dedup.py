"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every vector is projected on ``PROJECTIONS`` random lines. Around a vector's place on a line lies
its window; another vector in it collides. Pairs that collide on enough lines are verified by
their cosine. For vectors at the threshold the difference of two projections is normal with a
known deviation, so the windows' width and the count asked for follow from the recall that is
wanted (``RECALL``, at the threshold itself; closer pairs are found more surely).

The table is sorted along one line and cut into slabs; each vector goes to its own slab and, as a
query, to the slabs that its window on that line reaches to the left. A slab keeps its vectors in
memory, and queries stream past. Equal vectors are one throughout. Each slab reports numbers of
links and a forest of them, not pairs.

The work grows with the square of the number of distinct vectors, as every one-dimensional window
holds a fixed share of them; it is spread over slabs of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import as_batch, map_batches, small_batches, stored
from textrisk.llm.components import connected_components

PROJECTIONS = 20
SPREAD = 2.24  # half a window's width, in deviations of a pair at the threshold
REACH = 3.5  # the same on the line of the slabs, on which a collision is a must
RECALL = 0.999
SLAB_ROWS = 4096
_QUERIES = 256  # compared with a slab at a time


def lines(dim: int) -> np.ndarray:
    """The directions, the slabs' line first; a unit vector's projections deviate by 1."""
    return np.random.Generator(np.random.PCG64(64)).standard_normal((dim, PROJECTIONS + 1))


def collisions_needed() -> int:
    """The largest count that a pair at the threshold reaches with probability ``RECALL``."""
    hit = math.erf(SPREAD / math.sqrt(2))
    reached = 1.0
    for count in range(PROJECTIONS + 1):
        reached -= math.comb(PROJECTIONS, count) * hit**count * (1 - hit) ** (PROJECTIONS - count)
        if reached < RECALL:
            return count
    return PROJECTIONS


class _Slab:
    """The vectors of one slab, and the links found in it."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.deviation = math.sqrt(2 - 2 * threshold)
        self.step = SPREAD * self.deviation / 24  # of the projections' whole numbers
        self.needed = collisions_needed()
        self.rows: list[tuple] = []
        self.ready = False

    def add(self, ids, place, weight, vectors) -> None:
        self.rows.append((ids, place, weight, vectors))

    def _close(self) -> None:
        self.ids, self.place, self.weight, vectors = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.rows, self.ready = [], True
        self.unit, self.marks = self._prepared(vectors)
        self.columns = np.ascontiguousarray(self.marks.T)
        self.linked = np.zeros(len(self.ids), np.int64)
        self.parent = np.arange(len(self.ids))

    def _prepared(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        # Whole numbers modulo 256: vectors that far apart are ruled out by other lines.
        marks = np.floor(unit @ lines(unit.shape[1])[:, 1:] / self.step).astype(np.int64).astype(np.uint8)
        return unit, marks

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def query(self, ids, place, weight, vectors) -> Iterator[tuple]:
        """Rows ``(id, links, linked id)`` of the queries; the slab's side comes with ``finish``.

        A pair is met once, with the vector that comes later on the line, or has the larger id at
        one place, as the query.
        """
        if not self.ready:
            self._close()
        unit, marks = self._prepared(vectors)
        width = np.uint8(48)
        for at in range(0, len(ids), _QUERIES):
            part = slice(at, at + _QUERIES)
            counts = np.zeros((len(ids[part]), len(self.ids)), np.uint8)
            gap, hit = np.empty_like(counts), np.empty(counts.shape, bool)
            for line in range(PROJECTIONS):
                np.subtract((marks[part, line] + np.uint8(24))[:, None], self.columns[line][None, :], out=gap)
                np.less_equal(gap, width, out=hit)
                counts += hit.view(np.uint8)
            q, x = np.nonzero(counts >= self.needed)
            later = (self.place[x] < place[part][q]) | ((self.place[x] == place[part][q]) & (self.ids[x] < ids[part][q]))
            q, x = q[later], x[later]
            near = np.empty(len(q), bool)
            for i in range(0, len(q), 65_536):
                s = slice(i, i + 65_536)
                near[s] = np.einsum("ij,ij->i", unit[part][q[s]], self.unit[x[s]]) >= self.threshold
            q, x = q[near], x[near]
            links = np.bincount(q, weights=self.weight[x], minlength=len(ids[part])).astype(np.int64)
            self.linked += np.bincount(x, weights=weight[part][q], minlength=len(self.ids)).astype(np.int64)
            heads = np.flatnonzero(np.diff(q, prepend=-1))
            for head, stop in zip(heads, [*heads[1:], len(q)], strict=False):
                met = {self._root(i) for i in np.unique(self.parent[x[head:stop]])}
                top = min(met)
                for root in met:
                    self.parent[root] = top
                yield int(ids[part][q[head]]), int(links[q[head]]), int(self.ids[top])

    def finish(self) -> Iterator[tuple]:
        if not self.ready and self.rows:
            self._close()
        if self.ready:
            for i in range(len(self.ids)):
                root = self._root(i)
                if self.linked[i] or root != i:
                    yield int(self.ids[i]), int(self.linked[i]), int(self.ids[root])


def _links(vectors: DataFrame, threshold: float) -> DataFrame:
    """``id, links, other`` of the distinct vectors ``id, weight, vector``: partial numbers of
    linked rows, and links that connect all that are linked."""
    placed_schema = "id long, weight long, vector binary, place double"

    def place(batch: pa.RecordBatch):
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = flat.reshape(batch.num_rows, -1)
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        places = unit @ lines(rows.shape[1])[:, 0]
        yield [batch.column(0), batch.column(1), [r.tobytes() for r in rows], places]

    placed = stored(map_batches(vectors.select("id", "weight", "vector"), place, placed_schema), "placed")
    count = placed.count()
    slabs = max(1, -(-count // SLAB_ROWS))
    cuts = placed.stat.approxQuantile("place", [i / slabs for i in range(1, slabs)], 0.05 / slabs) if slabs > 1 else []
    cuts = np.unique(np.array(cuts, np.float64))
    reach = REACH * math.sqrt(2 - 2 * threshold)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def slabs_of(column: pa.Array) -> pa.Array:
        """The own slab first, then those to the left that the window reaches."""
        places = column.to_numpy()
        own, first = np.searchsorted(cuts, places, "right"), np.searchsorted(cuts, places - reach, "right")
        return pa.array([list(range(o, f - 1, -1)) for o, f in zip(own, first, strict=True)], pa.list_(pa.int32()))

    schema = T._parse_datatype_string("id long, links long, other long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current, slab = to_arrow_schema(schema), None, None

        def emit(rows):
            rows = list(rows)
            if rows:
                yield as_batch(list(zip(*rows, strict=True)), arrow)

        for batch in batches:
            number, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, weight, places = (batch.column(i).to_numpy() for i in (2, 3, 5))
            rows = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            turns = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(guest, prepend=-1) != 0))
            for at, stop in zip(turns, np.append(turns[1:], len(number)), strict=True):
                s = slice(at, stop)
                if number[at] != current:
                    if slab:
                        yield from emit(slab.finish())
                    current, slab = number[at], _Slab(threshold)
                if guest[at] == 0:
                    slab.add(ids[s], places[s], weight[s], rows[s])
                else:
                    yield from emit(slab.query(ids[s], places[s], weight[s], rows[s]))
        if slab:
            yield from emit(slab.finish())

    # The slab's vectors come first (0), then the queries (1), which are its own and its guests.
    met = placed.withColumn("slabs", slabs_of("place")).select(
        "*", F.posexplode(F.concat(F.slice("slabs", 1, 1), F.col("slabs"))).alias("nth", "slab")
    )
    ordered = (
        met.select("slab", F.when(F.col("nth") == 0, 0).otherwise(1).alias("guest"), "id", "weight", "vector", "place")
        .repartition("slab")
        .sortWithinPartitions("slab", "guest")
    )
    return ordered.mapInArrow(run, schema)


def near_duplicate_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95
) -> DataFrame:
    """One row per input row: the id, ``n_links`` (other rows whose cosine is at least the
    threshold), ``component_id`` (the smallest id that links lead to) and ``kept`` (whether that
    is its own).

    Cosines are computed in double precision. Vectors that are null, empty or zero, or hold a
    null, NaN or infinite component, link with nothing, and so do vectors of different lengths;
    each length is searched by itself. Equal vectors link with each other. Rows that repeat an id
    are counted each, with the links of their own vector, and are one node of a component, but for
    those without a usable vector, which stand alone; a null id links with nothing. Ids are whole
    numbers; other columns are dropped.
    """
    small_batches(table.sparkSession, 2048)
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).alias("id"), vector.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.array_max(F.transform("vector", F.abs))
    usable = F.coalesce(F.col("id").isNotNull() & sound & (largest > 0), F.lit(False))
    # Squares of components beyond these would leave the range of doubles.
    scale = F.when((largest > 1e140) | (largest < 1e-140), largest).otherwise(F.lit(1.0))
    rows = rows.select("id", F.when(usable, F.transform("vector", lambda x: x / scale)).alias("vector"))
    made = {"key": F.xxhash64("vector"), "key2": F.hash("vector")}
    known = F.col("vector").isNotNull()
    rows = stored(rows.select("id", *(F.when(known, c).alias(n) for n, c in made.items()), "vector"), "vectors")
    usable_rows = rows.where("key IS NOT NULL")
    distinct = usable_rows.groupBy("key", "key2").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector")
    )
    # Nodes are distinct vectors; one id may stand for several.
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    lengths = [row[0] for row in distinct.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    links = distinct.select(F.col("node").alias("id"), F.lit(0).cast("bigint").alias("links"), F.col("node").alias("other")).limit(0)
    for length in lengths:
        mine = distinct.where(F.size("vector") == length).select(F.col("node").alias("id"), "weight", "vector")
        links = links.unionByName(_links(mine, threshold))
    links = stored(links, "links")
    components = stored(connected_components(_id_links(usable_rows, distinct, links)), "components")
    totals = links.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    reps = (
        distinct.select("key", "key2", "node", "rep", "weight")
        .join(totals, "node", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "key",
            "key2",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    found = rows.select("id", "key", "key2").join(stored(reps, "reps"), ["key", "key2"], "left")
    component = F.coalesce("component_id", "id")
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _id_links(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b``: the ids of linked vectors, and each id that has several vectors with theirs."""
    names = distinct.select("node", "rep")
    linked = links.where("id <> other").join(names.withColumnsRenamed({"node": "id", "rep": "a"}), "id")
    linked = linked.join(names.withColumnsRenamed({"node": "other", "rep": "b"}), "other").select("a", "b")
    both = F.struct("key", "key2")
    several = rows.groupBy("id").agg(F.min(both).alias("low"), F.max(both).alias("high")).where("low <> high")
    shared = rows.select("id", "key", "key2").join(several.select("id"), "id", "left_semi").distinct()
    again = shared.join(distinct.select("key", "key2", "rep"), ["key", "key2"])
    return linked.unionByName(again.select(F.col("id").alias("a"), F.col("rep").alias("b")))
