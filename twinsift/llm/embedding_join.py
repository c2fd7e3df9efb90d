"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with a cosine of at least c have a squared distance of at most 2 - 2c. Rotated and split
into blocks, they must agree in some block within the block's share of that budget. Each block is
range-joined twice. The first join moves nothing but a block's coordinates, packed by slabs of the first
one; inside a slab a grid of the first five coordinates, with cells as wide as the budget allows, brings
a vector together with those of its own and the adjacent cells. It tells which vectors agree with any
other in a block. Only these, and only for such blocks, move as a whole: what agrees in a block is
verified, by the same grid, on the whole vectors in double precision, and counts in the first block in which it agrees, so
the union of the blocks needs no pairs to be kept.

Equal vectors are compared once. A slab with many vectors is cut into slices and each pair of
slices is a task of its own, so one that holds a third of all vectors is compared in bounded pieces. A
task returns flags, or counts and the edges of a spanning forest, never its pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without a label, link with nothing and are their own component; vectors of different length never
link; rows that share a vec_id are separate vectors; a null vec_id is never the smallest of a
component unless all are null; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.components import connected_components
from twinsift.operators.skew import attach
from twinsift.session import checkpointed, ship_package

BLOCKS = 8
# Coordinates of a block that choose its grid cell, and cells of the first one that make a slab.
GRID = 5
SLAB = 4
# Vectors of a slab that one side of a task holds, and of a packed row.
PACKED = 16_384
PACK = 2048
# Whole vectors of a slab that one side of a task compares.
SLICE = 4096
_SLACK = 1e-9
_PAIRS_AT_ONCE = 20_000
_LOOKUPS = 1 << 18
_PACKS = "label string, width int, block int, slab long, home boolean, n int, first long, ids binary, parts binary"
_CELLS = "class string, copies long, label string, block int, slab long, home boolean, vector array<{}>"
_FOUND = "class string, root string, links long"


def _rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _cuts(size: int) -> np.ndarray:
    """Where the blocks begin in a vector of this size, and its end."""
    return np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)


def _budgets(size: int, cosine: float) -> np.ndarray:
    """Squared distance that each block may use: in proportion to its width."""
    return (2 - 2 * cosine) * np.diff(_cuts(size)) / size


def _vectors(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(array), -1)


def _rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated. Row by row, so that a vector has the same bits in every task."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    turn = _rotation(vectors.shape[1])
    return np.stack([(v / n) @ turn for v, n in zip(vectors, norms)])


def _side(budget: float) -> float:
    """Width of grid cells of which only adjacent ones hold single-precision points within the budget."""
    return float(np.sqrt(budget)) * (1 + 1e-4) + 1e-6


def _packs(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Coordinates of each block, packed by slab; the top cells of a slab also visit the next one."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch["vector"]])
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            vectors = _vectors(part["vector"])
            turned = (vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]) @ _rotation(size)
            turned = turned.astype(np.float32)
            ids = part["id"].to_numpy()
            labels = part["label"].dictionary_encode()
            names, label = labels.dictionary, labels.indices.to_numpy()
            cuts, budgets = _cuts(size), _budgets(size, cosine)
            for block, (a, b, budget) in enumerate(zip(cuts[:-1], cuts[1:], budgets)):
                cell = np.floor(turned[:, a] / _side(budget)).astype(np.int64)
                top = np.flatnonzero(cell % SLAB == SLAB - 1)
                rows = np.concatenate([np.arange(len(cell)), top])
                slab = np.concatenate([cell // SLAB, cell[top] // SLAB + 1])
                home = np.arange(len(rows)) < len(cell)
                order = np.lexsort((home, slab, label[rows]))
                rows, slab, home = rows[order], slab[order], home[order]
                new = (np.diff(label[rows]) != 0) | (np.diff(slab) != 0) | (np.diff(home.astype(np.int8)) != 0)
                runs = np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows)]])
                starts = np.concatenate([np.arange(s, e, PACK) for s, e in zip(runs[:-1], runs[1:])])
                ends = np.append(starts[1:], len(rows))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(label[rows[starts]])), pa.array(np.full(len(starts), size), pa.int32()),
                     pa.array(np.full(len(starts), block), pa.int32()), pa.array(slab[starts]), pa.array(home[starts]),
                     pa.array(ends - starts, pa.int32()), pa.array(ids[rows[starts]]),
                     pa.array([ids[rows[s:e]].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                     pa.array([turned[rows[s:e], a:b].tobytes() for s, e in zip(starts, ends)], pa.binary())],
                    names=["label", "width", "block", "slab", "home", "n", "first", "ids", "parts"],
                )


def _meetings(parts: np.ndarray, left: np.ndarray, right: np.ndarray, side: float, done: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of left, rows of right) in the same or adjacent grid cells, but for those that are
    done already when their turn comes. The first coordinate is the last digit of a cell's code, so
    its three adjacent cells are one range of codes."""
    digits = np.floor(parts[:, :GRID] / side).astype(np.int64)
    digits -= digits.min(axis=0) - 1
    weights = [1]
    for radix in (digits.max(axis=0) + 2).tolist():
        if weights[-1] * radix >= 1 << 62:
            break
        weights.append(weights[-1] * radix)
    used = max(1, len(weights) - 1)
    weights = np.array(weights[:used])
    code = digits[:, :used] @ weights
    around = np.array(list(product((-1, 0, 1), repeat=used - 1)), dtype=np.int64).reshape(3 ** (used - 1), used - 1) @ weights[1:]
    order = right[np.argsort(code[right], kind="stable")]
    codes = code[order]
    step = max(1, _LOOKUPS // len(around))
    for begin in range(0, len(left), step):
        rows = left[begin : begin + step]
        cells = (code[rows][:, None] + around).ravel()
        start, stop = np.searchsorted(codes, cells - 1, "left"), np.searchsorted(codes, cells + 1, "right")
        some = np.flatnonzero(stop > start)
        rows, start, stop = np.repeat(rows, len(around))[some], start[some], stop[some]
        total = np.cumsum(stop - start)
        at = 0
        while at < len(rows):
            until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _LOOKUPS, "right")))
            undone = np.concatenate([[0], np.cumsum(~done[order])])
            s, e, i = start[at:until], stop[at:until], rows[at:until]
            open_ = ~done[i] | (undone[e] > undone[s])
            s, e, i = s[open_], e[open_], i[open_]
            ends = np.cumsum(e - s)
            if len(ends):
                yield np.repeat(i, e - s), order[np.arange(ends[-1]) + np.repeat(s - ends + (e - s), e - s)]
            at = until


def _agreeing(table: pa.Table, cosine: float) -> pa.Table:
    """Vectors that agree with another one of a slab, or of two slices of it, in its block."""
    size, block = table["width"][0].as_py(), table["block"][0].as_py()
    first, second = table["one"][0].as_py(), table["two"][0].as_py()
    cuts, budget = _cuts(size), _budgets(size, cosine)[block]
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()])
    parts = np.concatenate([np.frombuffer(x, np.float32) for x in table["parts"].to_pylist()]).reshape(-1, cuts[block + 1] - cuts[block])
    lengths = table["n"].to_numpy()
    home = np.repeat(table["home"].to_numpy(), lengths)
    piece = np.repeat(table["slice"].to_numpy(), lengths)
    found = np.zeros(len(ids), dtype=bool)
    left, right = np.flatnonzero(piece == first), np.flatnonzero(piece == second)
    for i, j in _meetings(parts, left, right, _side(budget), found):
        ok = (home[i] | home[j]) & ~(found[i] & found[j])
        if first == second:  # each pair once
            ok &= i < j
        i, j = i[ok], j[ok]
        gap = parts[i] - parts[j]
        near = np.einsum("ij,ij->i", gap, gap) <= budget * (1 + 1e-4) + 1e-6
        found[i[near]] = True
        found[j[near]] = True
    ids = np.unique(ids[found])
    return pa.table({"id": pa.array(ids), "block": pa.array(np.full(len(ids), block), pa.int32())})


def _cells(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Each vector in its slab, and from the top cells also as a visitor in the next one, for each block
    in which it agrees with another one: those of the bits of ``agrees``."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch["vector"]])
        for size in np.unique(sizes):
            whole = batch.filter(pa.array(sizes == size))
            whole_turned = _rotated(_vectors(whole["vector"]))
            agrees = whole["agrees"].to_numpy()
            cuts, budgets = _cuts(size), _budgets(size, cosine)
            for block, (a, b, budget) in enumerate(zip(cuts[:-1], cuts[1:], budgets)):
                here = agrees >> block & 1 == 1
                part, turned = whole.filter(pa.array(here)), whole_turned[here]
                cell = np.floor(turned[:, a] / _side(budget)).astype(np.int64)
                for rows, step in ((np.arange(len(cell)), 0), (np.flatnonzero(cell % SLAB == SLAB - 1), 1)):
                    some = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [some["class"], some["copies"], some["label"], pa.array(np.full(len(rows), block), pa.int32()),
                         pa.array(cell[rows] // SLAB + step), pa.array(np.full(len(rows), step == 0)), some["vector"]],
                        names=["class", "copies", "label", "block", "slab", "home", "vector"],
                    )


def _compared(table: pa.Table, cosine: float) -> pa.Table:
    """Links among the vectors of a slab, or between two slices of it."""
    vectors = _vectors(table["vector"])
    block = table["block"][0].as_py()
    one = table["slice"].to_numpy() == table["one"][0].as_py()
    other = table["slice"].to_numpy() == table["two"][0].as_py()
    home = table["home"].to_numpy(zero_copy_only=False)
    names = np.array(table["class"].to_pylist(), dtype=object)
    copies = table["copies"].to_numpy()
    turned = _rotated(vectors)
    size = vectors.shape[1]
    cuts, budgets = _cuts(size), _budgets(size, cosine)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    left, right = np.flatnonzero(one), np.flatnonzero(other)
    part = turned[:, cuts[block] : cuts[block + 1]]
    links = np.zeros(len(names), dtype=np.int64)
    root = np.arange(len(names))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    same = table["one"][0].as_py() == table["two"][0].as_py()
    for at, to in _meetings(part, left, right, _side(budgets[block]), np.zeros(len(names), dtype=bool)):
        ok = home[at] | home[to]
        if same:  # each pair once
            ok &= at < to
        at, to = at[ok], to[ok]
        gap = part[at] - part[to]
        near = np.einsum("ij,ij->i", gap, gap) <= budgets[block] + _SLACK
        at, to = at[near], to[near]
        for k in range(0, len(at), _PAIRS_AT_ONCE):
            i, j = at[k : k + _PAIRS_AT_ONCE], to[k : k + _PAIRS_AT_ONCE]
            exact = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norms[i] * norms[j]) >= cosine
            i, j = i[exact], j[exact]
            gap = np.add.reduceat((turned[i] - turned[j]) ** 2, cuts[:-1], axis=1) if len(i) else np.zeros((0, 1))
            first = np.argmax(gap <= budgets + _SLACK / 2, axis=1) == block
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while (root != root[root]).any():
                root = root[root]
            apart = root[i] != root[j]
            for a, b in zip(i[apart].tolist(), j[apart].tolist()):
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
    found = np.flatnonzero(links)
    return pa.table(
        {
            "class": pa.array(names[found], pa.string()),
            "root": pa.array([names[top(i)] for i in found], pa.string()),
            "links": pa.array(links[found], pa.int64()),
        }
    )


def _sliced(rows: DataFrame, sized: DataFrame, key: list[str], by: str, counts: str, slice_rows: int) -> DataFrame:
    """The rows of each key of ``sized`` (key, rows and ``counts``), dealt to all pairs of its slices."""
    slices = sized.select(*key, F.ceil(F.col("rows") / slice_rows).cast("int").alias("slices"), counts)
    return (
        attach(rows, slices, key, [by], counts=counts)
        .withColumn("slice", F.pmod(F.xxhash64(by), F.col("slices")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumn("one", F.least("slice", "with"))
        .withColumn("two", F.greatest("slice", "with"))
    )


def agreeing(classes: DataFrame, cosine: float, slice_rows: int = PACKED) -> DataFrame:
    """(id, agrees) of the rows (id, label, vector) that agree with another one: a bit for each block."""
    packs = classes.select("id", "label", "vector").mapInArrow(lambda batches: _packs(batches, cosine), _PACKS)
    key = ["label", "width", "block", "slab"]
    sized = packs.groupBy(*key).agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("home"), F.col("n")).otherwise(0)).alias("homes"), F.count(F.lit(1)).alias("packs")
    )
    dealt = _sliced(packs, sized.where("homes > 0 and rows > 1"), key, "first", "packs", slice_rows)
    found = dealt.groupBy(*key, "one", "two").applyInArrow(lambda table: _agreeing(table, cosine), "id long, block int")
    return found.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, block)")).alias("agrees"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, slice_rows: int = SLICE, packed_rows: int = PACKED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row (vec_id, embedding, label)."""
    ship_package(vectors.sparkSession)
    # Single-precision input moves as such; all sums are of doubles.
    number = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    numbers = F.col("embedding").cast(f"array<{number}>")
    usable = (
        F.col("label").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("vector", lambda v: v != 0)
    )
    rows = checkpointed(
        vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), numbers.alias("vector"))
        .withColumn("class", F.when(F.coalesce(usable, F.lit(False)), F.sha2(F.concat_ws(",", "label", F.col("vector").cast("array<string>")), 256)))
    )
    classes = checkpointed(
        rows.where("class is not null")
        .groupBy("class")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    )
    # Classes that chance to share an id share their flags, which only lets one more vector through.
    named = classes.drop("least").withColumn("id", F.xxhash64("class"))
    flagged = checkpointed(named.join(agreeing(named, cosine, packed_rows), "id"))
    cells = flagged.mapInArrow(lambda batches: _cells(batches, cosine), _CELLS.format(number))
    key = ["label", "width", "block", "slab"]
    cells = cells.withColumn("width", F.size("vector"))
    sized = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes"))
    dealt = _sliced(cells, sized.where("homes > 0 and rows > 1"), key, "class", "rows", slice_rows)
    found = checkpointed(dealt.groupBy(*key, "one", "two").applyInArrow(lambda table: _compared(table, cosine), _FOUND))
    groups = connected_components(found.where("class <> root").select(F.col("class").alias("src"), F.col("root").alias("dst")))
    named = (
        classes.select("class", "least", "copies")
        .join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
        .join(groups.withColumnRenamed("id", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    named = checkpointed(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    labels = attach(named, least, ["component"], ["class"], counts="classes").select(
        "class", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return attach(rows.select("vec_id", "class"), labels, ["class"], ["vec_id"], how="left", counts="copies").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
