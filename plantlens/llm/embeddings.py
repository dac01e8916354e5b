"""Near duplicates among embeddings by an exact metric range join.

Angles between vectors are a metric.  Every vector belongs to the cell of its nearest pivot; by the triangle
inequality a vector of another cell can only be within reach of cell j if its angle to pivot j is at most
twice the reach larger than that to its own pivot, and at most the cell's radius plus the reach.  Vectors are
copied to such cells, for each pair of cells in one direction, and cells join independently.

Equal vectors are one vector with a weight.  A cell with many vectors is cut into chunks of ``CHUNK`` targets, each of
which meets all of the cell as a stream of probes, so a task holds one chunk and one batch.  A chunk returns
counts of links and a spanning forest of them, never pairs.

On vectors without any cluster structure no exact metric partition can prune (all angles to pivots are nearly equal);
the join is then as complete as a comparison of all cells, still without emitting pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import stored
from plantlens.llm.components import Forest, components

COSINE = 0.9
PER_CELL = 4096
MOST_PIVOTS = 2048
CHUNK = 4096
# float32 products are this close to the exact ones; what lies nearer to the bound is computed in double.
NEAR = 1e-4


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, node, vector``: unit vectors in double as bytes; null where a vector has no direction."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(_unit_task, "vec_id long, node long, vector binary")


def _unit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for item in batch.column("v"):
            values = None if not item.is_valid or item.values.null_count else item.values.to_numpy(zero_copy_only=False)
            if values is not None and len(values) and np.isfinite(values).all():
                values = values + 0.0
                largest = np.abs(values).max()
                if largest > 0:
                    scaled = values / largest
                    out.append((scaled / math.sqrt(float(scaled @ scaled))).tobytes())
                    continue
            out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.nulls(len(out), pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "node", "vector"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _home_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            angle = _angles(_matrix(batch.column("vector")), pivots)
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], names=["cell", "angle"])

    return run


def _deal_task(shared, reach: float):
    """Each vector to its own cell's chunks as target and probe, and to other cells in reach as probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, chunks = shared.value
        places = np.arange(len(pivots))
        for batch in batches:
            node = batch.column("node").to_numpy()
            angle = _angles(_matrix(batch.column("vector")), pivots)
            home = angle.argmin(axis=1)
            own = angle[np.arange(len(home)), home]
            lower = places[None, :] < home[:, None]
            turn = (places[None, :] + home[:, None]) % 2 == 0
            slack = 2 * reach + 1e-9
            go = (lower == turn) & (angle <= own[:, None] + slack) & (angle <= radius[None, :] + reach + 1e-9)
            go[np.arange(len(home)), home] = False
            part = (node.view(np.uint64) % chunks[home].astype(np.uint64)).astype(np.int64)
            row, cell = np.nonzero(go)
            times = chunks[cell]
            far_row, far_cell = np.repeat(row, times), np.repeat(cell, times)
            far_chunk = np.arange(len(far_row)) - np.repeat(np.cumsum(times) - times, times)
            # own cell: target in its chunk, probe in its chunk and in those before it
            near_row = np.repeat(np.arange(len(home)), part + 1)
            near_chunk = np.arange(len(near_row)) - np.repeat(np.cumsum(part + 1) - part - 1, part + 1)
            rows = np.concatenate([np.arange(len(home)), near_row, far_row])
            cells = np.concatenate([home, home[near_row], far_cell])
            chunk = np.concatenate([part, near_chunk, far_chunk])
            role = np.concatenate([np.zeros(len(home)), np.where(near_chunk == part[near_row], 1, 2), np.full(len(far_row), 2)])
            for at in range(0, len(rows), 4096):
                some = slice(at, at + 4096)
                take = pa.array(rows[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[some].astype(np.int32)), pa.array(chunk[some].astype(np.int32)), pa.array(role[some].astype(np.int32)),
                     batch.column("node").take(take), batch.column("weight").take(take), batch.column("vector").take(take)],
                    names=["cell", "chunk", "role", "node", "weight", "vector"])

    return run


class _Chunk:
    """Targets of one chunk; probes come in batches."""

    def __init__(self, cosine: float) -> None:
        self.cosine, self.held = cosine, []
        self.ready = False

    def add(self, node: np.ndarray, weight: np.ndarray, x: np.ndarray) -> None:
        self.held.append((node, weight, x))

    def _prepare(self) -> None:
        self.node, self.weight = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        self.x = np.concatenate([h[2] for h in self.held])
        self.low = self.x.astype(np.float32)
        self.forest = Forest(len(self.node))
        self.count = np.zeros(len(self.node), np.int64)
        self.ready = True

    def meet(self, node: np.ndarray, weight: np.ndarray, x: np.ndarray, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows (node, other, links): the probes' counts, each with one linked target."""
        if not self.held:
            return
        if not self.ready:
            self._prepare()
        for at in range(0, len(node), 512):
            some = slice(at, at + 512)
            product = x[some].astype(np.float32) @ self.low.T
            probe, target = np.nonzero(product >= self.cosine - NEAR)
            close = product[probe, target] < self.cosine + NEAR
            if close.any():
                exact = np.einsum("ij,ij->i", x[some][probe[close]], self.x[target[close]])
                good = np.ones(len(probe), bool)
                good[close] = exact >= self.cosine
                probe, target = probe[good], target[good]
            other = node[some][probe] != self.node[target]
            probe, target = probe[other], target[other]
            if not len(probe):
                continue
            first = self.forest.join(probe, target)
            links = np.add.reduceat(self.weight[target], first)
            if not inside:
                np.add.at(self.count, target, weight[some][probe])
            yield node[some][probe[first]], self.node[target[first]], links

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.ready:
            return None
        root = np.arange(len(self.node))
        child, parent = self.forest.edges()
        root[child] = parent
        some = np.flatnonzero((self.count > 0) | (root != np.arange(len(root))))
        return self.node[some], self.node[root[some]], self.count[some]


def _cells_task(cosine: float):
    names = ["node", "other", "links"]

    def packed(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk = None, _Chunk(cosine)
        for batch in batches:  # sorted by cell, chunk and role
            ids = np.stack([batch.column(c).to_numpy() for c in ("cell", "chunk", "role")], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(ids, axis=0) != 0).any(axis=1)])) if len(ids) else np.zeros(0, np.int64)
            for a, b in zip(cuts, np.append(cuts[1:], len(ids)), strict=True):
                if (ids[a][0], ids[a][1]) != key:
                    last = chunk.close()
                    if last is not None:
                        yield packed(last)
                    key, chunk = (ids[a][0], ids[a][1]), _Chunk(cosine)
                node, weight = batch.column("node")[a:b].to_numpy(), batch.column("weight")[a:b].to_numpy()
                x = _matrix(batch.column("vector")[a:b])
                if ids[a][2] == 0:
                    chunk.add(node, weight, x)
                else:
                    for rows in chunk.meet(node, weight, x, ids[a][2] == 1):
                        yield packed(rows)
        last = chunk.close()
        if last is not None:
            yield packed(last)

    return run


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, per_cell: int = PER_CELL) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``: ``vec_id, node`` of every vector (node null: none), and ``node, other, links`` of distinct vectors.

    ``links`` rows add up to the number of linked vectors of a node; their ``other`` nodes span its component.
    Vectors of different lengths are never linked.
    """
    spark = vectors.sparkSession
    rows = unit_vectors(vectors, id_col, vector_col).select(
        "vec_id", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("node"), "vector")
    rows = stored(rows, "vectors")
    distinct = rows.where("node is not null").groupBy("node", F.length("vector").alias("size")).agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"))
    distinct = stored(distinct, "vectors-distinct")
    lengths = [r["size"] for r in distinct.select("size").distinct().orderBy("size").toLocalIterator()]
    found = []
    for length in lengths:
        same = distinct.where(F.col("size") == length)
        n = same.count()
        wanted = max(1, min(MOST_PIVOTS, -(-n // per_cell)))
        pivots = np.stack([np.frombuffer(bytes(r["vector"]), np.float64) for r in same.orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(wanted).collect()])
        homes = same.select("vector").mapInArrow(_home_task(spark.sparkContext.broadcast(pivots)), "cell int, angle double")
        radius, chunks = np.full(len(pivots), -1e3), np.ones(len(pivots), np.int64)
        for r in homes.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # one row per pivot
            radius[r["cell"]], chunks[r["cell"]] = r["angle"], -(-r["n"] // CHUNK)
        plan = spark.sparkContext.broadcast((pivots, radius, chunks))
        dealt = same.select("node", "weight", "vector").mapInArrow(
            _deal_task(plan, math.acos(cosine)), "cell int, chunk int, role int, node long, weight long, vector binary")
        joined = dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role", "node")
        found.append(stored(joined.mapInArrow(_cells_task(cosine), "node long, other long, links long"), "vector-links"))
    links = found[0] if found else spark.createDataFrame([], "node long, other long, links long")
    for more in found[1:]:
        links = links.unionByName(more)
    return rows.select("vec_id", "node"), links


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, per_cell: int = PER_CELL) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows at ``cosine`` or more, ``component_id`` is the least id reachable by links, itself
    included.  Vectors that are null, zero or empty or hold null or non-finite components link with nothing.  Rows
    that repeat a vector link with each other; repeated rows each get a row.  Null ids take part but name no
    component.  Empty tables give an empty result; other columns are never read.
    """
    rows, links = linked_vectors(vectors, id_col, vector_col, cosine, per_cell)
    weights = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = weights.join(counts, "node", "left").join(roots, "node", "left").select(
        "node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("root"))
    nodes = stored(nodes, "vector-nodes")
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(names, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(nodes, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
