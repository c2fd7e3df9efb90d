"""Near pairs of prints that Spark has brought together by a key.

Spark deals the rows by key and sorts them; a task then reads them in Arrow batches and compares the
prints of each key a whole array at a time. Memory holds the rows of one key and a batch, pairs
leave the task as they are found. Callers keep the rows of a key bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinsift.session import ship_package

# Rows that are compared at a time, unless one key has more.
CHUNK_ROWS = 50_000
# A key with more rows on either side is compared by matrices of at most so many cells, or one row.
WIDE = 100
CELLS = 1 << 16


def _firsts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Positions where a new combination of values begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first ``keys`` columns, no key cut in two."""
    held, rows = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = _firsts(columns[:keys])[-1]
        if cut:
            yield [c[:cut] for c in columns]
        held, rows = [[c[cut:] for c in columns]], rows - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def _walk(
    prints: np.ndarray, rows: np.ndarray, others: np.ndarray, steps: np.ndarray, threshold: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (row, other) of near prints: each of ``rows`` meets as many rows from ``others`` on as
    ``steps`` says, all rows in one array operation a step."""
    order = np.argsort(-steps, kind="stable")
    rows, others, own = rows[order], others[order], prints[rows[order]]
    # How many rows take another step.
    going = len(steps) - np.cumsum(np.bincount(steps))
    for step, count in enumerate(going[:-1]):
        met = others[:count] + step
        near = np.flatnonzero(np.bitwise_count(own[:count] ^ prints[met]) <= threshold)
        if len(near):
            yield rows[near], met[near]


def _block(
    prints: np.ndarray, rows: tuple[int, int], others: tuple[int, int], threshold: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of near prints of two ranges, or row < other of one range, by bounded matrices."""
    (begin, end), (least, most) = rows, others
    height = max(1, CELLS // (most - least))
    for low in range(begin, end, height):
        high = min(low + height, end)
        left = low if rows == others else least
        near = np.flatnonzero(np.bitwise_count(prints[low:high, None] ^ prints[None, left:most]) <= threshold)
        if len(near):
            x, y = np.divmod(near, most - left)
            x, y = x + low, y + left
            if rows == others:
                x, y = x[x < y], y[x < y]
            yield x, y


def _near_within(prints: np.ndarray, first: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions a < b of near prints of each range that starts at ``first``."""
    ends = np.append(first[1:], len(prints))
    size = ends - first
    for low, high in zip(first[size > WIDE].tolist(), ends[size > WIDE].tolist()):
        yield from _block(prints, (low, high), (low, high), threshold)
    rows = np.flatnonzero(np.repeat(size <= WIDE, size))
    yield from _walk(prints, rows, rows + 1, np.repeat(ends, size)[rows] - rows - 1, threshold)


def _near_across(
    prints: np.ndarray, side: np.ndarray, first: np.ndarray, threshold: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of near prints of side 0 and side 1, in either order, of each range, sorted by side."""
    ends = np.append(first[1:], len(prints))
    cut = ends - np.add.reduceat(side.astype(np.int64), first)
    wide = np.minimum(cut - first, ends - cut) > WIDE
    for low, middle, high in zip(first[wide].tolist(), cut[wide].tolist(), ends[wide].tolist()):
        yield from _block(prints, (low, middle), (middle, high), threshold)
    # Each row of the larger side meets the smaller one.
    first, cut, ends = first[~wide], cut[~wide], ends[~wide]
    zeros = cut - first > ends - cut
    size = np.where(zeros, cut - first, ends - cut)
    begin, other = np.where(zeros, first, cut), np.where(zeros, cut, first)
    rows = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
    steps = np.where(zeros, ends - cut, cut - first)
    yield from _walk(prints, rows, np.repeat(other, size), np.repeat(steps, size), threshold)


def _flips_meet(flips: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair whose first print is the smaller one counts here: one bucket per block and pair."""
    match = np.ones(len(a), dtype=bool)
    for f in flips:
        match &= (f[a] == 0) | (f[a] < f[b])
    return match


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of edges (u, v) that connect what all of them connect, without a ring (Boruvka)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = np.split(ends, 2)
    edges, root, chosen = np.arange(len(u)), np.arange(len(nodes)), []
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return np.concatenate(chosen) if chosen else edges[:0]
        u, v, edges, x, y = u[apart], v[apart], edges[apart], x[apart], y[apart]
        # Each tree takes its first edge; two trees that took the same one stay below the smaller.
        first = np.full(len(nodes), len(edges))
        np.minimum.at(first, x, np.arange(len(edges)))
        np.minimum.at(first, y, np.arange(len(edges)))
        trees = np.flatnonzero(first < len(edges))
        taken = first[trees]
        hook = np.arange(len(nodes))
        hook[trees] = np.where(x[taken] == trees, y[taken], x[taken])
        mutual = trees[(hook[hook[trees]] == trees) & (trees < hook[trees])]
        hook[mutual] = mutual
        chosen.append(edges[np.unique(taken)])
        while not np.array_equal(hook, higher := hook[hook]):
            hook = higher
        root = hook[root]


def _thinned(
    pairs: Iterator[tuple[np.ndarray, np.ndarray]], labels: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pairs (positions), as many as connect the same labels. Never more are held than rows and CHUNK_ROWS."""
    held, fresh = [], 0
    for a, b in pairs:
        apart = labels[a] != labels[b]
        held.append((a[apart], b[apart]))
        fresh += len(held[-1][0])
        if fresh >= CHUNK_ROWS:
            held, fresh = [_thin(held, labels)], 0
    if held:
        yield _thin(held, labels)


def _thin(pairs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(c) for c in zip(*pairs))
    kept = _forest(labels[a], labels[b])
    return a[kept], b[kept]


def _batches(pairs: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about CHUNK_ROWS pairs."""
    held, rows = [], 0
    for pair in pairs:
        held.append(pair)
        rows += len(pair[0])
        if rows >= CHUNK_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*held)], names)
            held, rows = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*held)], names)


def _run(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], find: Callable, names: list[str], dealt: bool = False
) -> DataFrame:
    """``find`` over rows dealt by ``keys``; the first key, by which Spark sorts fastest, tells most apart."""
    ship_package(rows.sparkSession)
    together = rows if dealt else rows.repartition(*keys)
    return together.sortWithinPartitions(*keys, *order).mapInArrow(
        lambda batches: _batches((pair for columns in _whole_keys(batches, len(keys)) for pair in find(columns)), names),
        ", ".join(f"{name} long" for name in names),
    )


def pairs_within(
    rows: DataFrame, keys: Sequence[str], flips: Sequence[str], threshold: int, links_only: bool, near: str | None = None,
    label: str | None = None, dealt: bool = False,
) -> DataFrame:
    """Pairs a < b of rows of one key within the threshold. For ``links_only`` as many as connect what all
    pairs not both near its hub connect.

    ``near`` names a column that tells which rows are near the hub. Without it the hub is the smallest
    print of the key, and the links of the hub count as well. ``label`` names a column by which prints are
    connected already; links are then returned with the labels ``of_a`` and ``of_b``. Rows that are ``dealt``
    are partitioned by the keys as they come.
    """
    keys, flips = list(keys), list(flips)
    kept = [*flips, *[c for c in (near, label) if c]]
    n, levels = len(keys), len(flips)

    def positions(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        prints, marks = columns[n].view(np.uint64), columns[n + 1 : n + 1 + levels]
        first = _firsts(columns[:n])
        close = columns[n + 1 + levels].astype(bool) if near else None
        if links_only and not near:
            hub = np.repeat(first, np.diff(np.append(first, len(prints))))
            close = np.bitwise_count(prints ^ prints[hub]) <= threshold
            spokes = np.flatnonzero(close & (hub != np.arange(len(prints))))
            yield hub[spokes], spokes
        for a, b in _near_within(prints, first, threshold):
            match = _flips_meet(marks, a, b)
            if links_only:
                match &= ~(close[a] & close[b])
            yield a[match], b[match]

    def find(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        return _shown(positions(columns), columns[n], columns[-1] if label else columns[n], links_only, label)

    return _run(rows.select(*keys, "print", *kept), keys, ["print"], find, _names(label), dealt)


def _names(label: str | None) -> list[str]:
    return ["a", "b", "of_a", "of_b"] if label else ["a", "b"]


def _shown(
    pairs: Iterator[tuple[np.ndarray, np.ndarray]], prints: np.ndarray, labels: np.ndarray, thin: bool, label: str | None
) -> Iterator[tuple[np.ndarray, ...]]:
    for a, b in _thinned(pairs, labels) if thin else pairs:
        yield (prints[a], prints[b], labels[a], labels[b]) if label else (prints[a], prints[b])


def pairs_across(
    rows: DataFrame, keys: Sequence[str], threshold: int, flips: Sequence[str] = (), near: str | None = None,
    label: str | None = None,
) -> DataFrame:
    """Pairs a < b of a row of side 0 and a row of side 1 of one key within the threshold.

    ``rows`` has ``side`` and ``print``; pairs count by their ``flips``, and not if both are ``near``.
    With a ``label`` only as many as connect the same labels, as in :func:`pairs_within`.
    """
    keys, flips = list(keys), list(flips)
    n, levels = len(keys), len(flips)

    def positions(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        signed, marks = columns[n + 1], columns[n + 2 : n + 2 + levels]
        prints = signed.view(np.uint64)
        for x, y in _near_across(prints, columns[n], _firsts(columns[:n]), threshold):
            low = signed[x] < signed[y]
            a, b = np.where(low, x, y), np.where(low, y, x)
            match = _flips_meet(marks, a, b) & (signed[a] != signed[b])
            if near:
                close = columns[n + 2 + levels].astype(bool)
                match &= ~(close[a] & close[b])
            yield a[match], b[match]

    def find(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        labels = columns[-1] if label else columns[n + 1]
        return _shown(positions(columns), columns[n + 1], labels, bool(label), label)

    kept = [*flips, *[c for c in (near, label) if c]]
    return _run(rows.select(*keys, "side", "print", *kept), keys, ["side"], find, _names(label))


def meetings(rows: DataFrame, keys: Sequence[str], told: str, threshold: int) -> DataFrame:
    """(a, b), a print of side 0 and one of side 1 of the same key within the threshold, and ``told``, one
    of the keys."""
    keys = list(keys)
    n, shown = len(keys), keys.index(told)

    def find(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        side, prints = columns[n], columns[n + 1].view(np.uint64)
        for x, y in _near_across(prints, columns[n], _firsts(columns[:n]), threshold):
            home = side[x] == 0
            a, b = np.where(home, x, y), np.where(home, y, x)
            yield prints[a], prints[b], columns[shown][a].astype(np.int64)

    return _run(rows.select(*keys, "side", "print"), keys, ["side"], find, ["a", "b", told])
