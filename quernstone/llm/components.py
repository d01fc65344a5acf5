"""Problem 6: one group per set of records linked directly or through others.

Two-dimensional grid. Vertices are hashed into B blocks, an edge belongs to the cell of its two
blocks, and every cell runs a union-find of its own. Each vertex then meets the representatives it
got in its row and column of cells; it keeps the best as its parent, and the others become edges of
the next, smaller graph between representatives. Priorities are hashed anew each round, so chains
shrink geometrically whatever the order of their ids. When no edge is left, the parents are resolved
from the last level back to the first.

A vertex with a third of all edges is spread over the cells of its row and meets at most one
representative per cell (or per flush of a cell), so no task ever holds its edges. A task takes its cells
one after the other, so that their number grows with the edges over TASK_EDGES, not with the grid.

Nulls and edges of a vertex with itself link nothing. Repeated and reversed edges change nothing. An
empty edge table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.runtime import materialise, release

#: Edges a cell should hold, the edges a task keeps at once, and those of a task, which takes many cells in turn.
CELL_EDGES = 50_000
FLUSH_EDGES = 400_000
TASK_EDGES = 4_000_000


def union_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex number reachable from each of 0..n-1 over the edges u-v."""
    parent = np.arange(n)
    while len(u):
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            break
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _local(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(v, r, p) of every vertex of these edges: its local representative r with priority p."""
    t = pa.Table.from_batches(batches)
    both = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).combine_chunks().dictionary_encode()
    if isinstance(both, pa.ChunkedArray):
        both = both.combine_chunks()
    index, ids = both.indices.to_numpy(), both.dictionary
    prio = np.empty(len(ids), np.int64)
    prio[index] = np.concatenate([t.column("pa").to_numpy(), t.column("pb").to_numpy()])
    order = pa.table({"p": prio, "id": ids})
    order = pa.compute.sort_indices(order, sort_keys=[("p", "ascending"), ("id", "ascending")]).to_numpy()
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    k = len(index) // 2
    root = union_roots(len(ids), rank[index[:k]], rank[index[k:]])
    rep = order[root[rank]]
    return pa.RecordBatch.from_arrays([ids, ids.take(pa.array(rep)), pa.array(prio[rep])], ["v", "r", "p"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FLUSH_EDGES:
            yield _local(held)
            held, n = [], 0
    if n:
        yield _local(held)


def connected_groups(edges: DataFrame, src: str = "src", dst: str = "dst", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(id, group_id) of every linked id; group_id is the smallest id that can be reached.

    Ids may be strings or integers; other columns of `edges` are ignored.
    """
    edges = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    kind = edges.schema["a"].dataType.simpleString()
    edges = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"), "edges")
    left, levels, written = edges.count(), [], [edges]
    while left:
        blocks = math.ceil(math.sqrt(2 * left / cell_edges)) if left > cell_edges else 1
        seed = len(levels)
        block = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(f"block{seed}")), F.lit(blocks))  # noqa: B023, E731
        rank = lambda c: F.xxhash64(F.col(c), F.lit(f"rank{seed}"))  # noqa: B023, E731
        cell = F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b"))
        tasks = min(blocks * (blocks + 1) // 2, max(4 * edges.sparkSession.sparkContext.defaultParallelism, math.ceil(left / TASK_EDGES)))
        met = (
            edges.select("a", "b", rank("a").alias("pa"), rank("b").alias("pb"), cell.alias("cell"))
            .repartition(tasks, "cell")
            .sortWithinPartitions("cell")
            .drop("cell")
            .mapInArrow(_cells, f"v {kind}, r {kind}, p bigint")
        )
        level = met.groupBy("v").agg(F.collect_set(F.struct("p", "r")).alias("reps"))
        level = level.select("v", F.array_min("reps").alias("m"), "reps")
        level = level.select("v", F.col("m.r").alias("m"), F.expr("transform(filter(reps, x -> x <> m), x -> x.r)").alias("others"))
        level = materialise(level, f"level{seed}")
        written.append(level)
        levels.append(level.select("v", "m"))
        edges = level.where(F.size("others") > 0).select(F.explode("others").alias("a"), F.col("m").alias("b"))
        left = level.agg(F.sum(F.size("others"))).first()[0] or 0
        if left and left > cell_edges:
            edges = materialise(edges.distinct(), "edges")
            written.append(edges)
            left = edges.count()
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    labels = levels.pop().select("v", F.col("m").alias("root"))
    while levels:
        upper = labels.select(F.col("v").alias("m"), "root")
        labels = levels.pop().join(upper, "m", "left").select("v", F.coalesce("root", "m").alias("root"))
    labels = materialise(labels, "labels")
    release(*written)
    least = labels.groupBy("root").agg(F.min("v").alias("group_id"))
    return labels.join(least, "root").select(F.col("v").alias("id"), "group_id")


def match_groups(pairs: DataFrame) -> DataFrame:
    """Groups of the ids that `match_pairs` links, whatever the score of a pair."""
    return connected_groups(pairs, "id_a", "id_b")
