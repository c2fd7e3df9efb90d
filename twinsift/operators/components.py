"""Connected components of a very large edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import attach
from twinsift.session import checkpointed, ship_package

# Edges that a task connects at a time, about 100 bytes of memory each.
LOCAL_EDGES = 2_000_000
# Rows of an Arrow batch that leaves such a task.
BATCH_ROWS = 50_000


def _downhill(pairs: DataFrame) -> DataFrame:
    """Each undirected edge once, from its larger to its smaller end."""
    return pairs.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )


def _paired(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Several (u, v) rows per edge in one pass."""
    return edges.select(
        F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs]))
    )


def _least_neighbour(edges: DataFrame, hot_rows: int | None, total: int) -> DataFrame:
    """Edges (u, v) with ``m``, the smallest v of their u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return attach(edges, least, ["u"], ["v"], counts="degree", hot_rows=hot_rows, total=total)


def _stars(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that it is connected to by edges, whose first ends are the
    first half of ``ends`` and whose second ends follow."""
    order = np.argsort(ends)
    nodes = ends[order]
    new = np.append(True, nodes[1:] != nodes[:-1])
    numbers = np.empty(len(ends), dtype=np.int32)
    numbers[order] = np.cumsum(new, dtype=np.int32) - 1
    nodes, (x, y) = nodes[new], np.split(numbers, 2)
    del order, numbers
    root = np.arange(len(nodes), dtype=np.int32)
    while (apart := x != y).any():
        x, y = x[apart], y[apart]
        # A tree goes below the smallest of the trees that it touches.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, higher := root[root]):
            root = higher
        x, y = root[x], root[y]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _star_batches(batches: Iterator[pa.RecordBatch], local_edges: int) -> Iterator[pa.RecordBatch]:
    """Stars of the edges (u, v), worked out over about ``local_edges`` at a time."""
    held, rows = [], 0

    def told() -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([b.column(i).to_numpy() for i in (0, 1) for b in held])
        held.clear()
        stars = _stars(ends)
        for start in range(0, len(stars[0]), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[start : start + BATCH_ROWS]) for c in stars], ["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= local_edges:
            yield from told()
            rows = 0
    if rows:
        yield from told()


def _connected_locally(state: DataFrame, tasks: int, local_edges: int) -> DataFrame:
    """Stars of the counted edges (u, v), connected within so many tasks, each by arrays."""
    ship_package(state.sparkSession)
    return state.coalesce(tasks).mapInArrow(lambda batches: _star_batches(batches, local_edges), "u long, v long")


def connected_components(
    edges: DataFrame, hot_rows: int | None = None, local_edges: int = LOCAL_EDGES
) -> DataFrame:
    """(id, component) for every node of the edges (src, dst); component = smallest id.

    Alternating large-star and small-star steps (Kiveris et al., 2014). No step gathers the
    neighbours of a node: it needs only their minimum, which is pre-aggregated, and the join
    that brings it back splits hubs. Labels only ever fall, so the rounds end by themselves.

    A round costs the driver two plans and their stages, however few the edges, so ``local_edges`` or fewer of
    whole numbers take no rounds: one task connects them. More are connected piece by piece first.
    """
    state = checkpointed(_downhill(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).distinct())
    local, mark = dict(state.dtypes)["u"] == "bigint", None
    while True:
        summary = state.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(summary) == mark:
            return _paired(state, ("u", "v"), ("v", "v")).toDF("id", "component").distinct()
        if local and summary[0] <= local_edges:
            stars = checkpointed(_connected_locally(state, 1, summary[0] + 1))
            return _paired(stars, ("u", "v"), ("v", "v")).toDF("id", "component").distinct()
        if local and mark is None:
            pieces = -(-summary[0] // local_edges)
            state = checkpointed(_connected_locally(state, pieces, local_edges).distinct())
            mark = ()
            continue
        mark = tuple(summary)
        both = _paired(state, ("u", "v"), ("v", "u"))
        large = _least_neighbour(both, hot_rows, 2 * mark[0]).where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")
        )
        small = _least_neighbour(large.distinct(), hot_rows, 2 * mark[0])
        state = checkpointed(_downhill(_paired(small, ("u", "m"), ("v", "m"))).distinct())
