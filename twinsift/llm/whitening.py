"""Whitening of vectors by an incremental eigendecomposition.

Every partition keeps the spectrum of its rows and updates it by centred rank-one terms: a term r z zᵀ
turns the eigenvalues into the roots of a secular equation, after coordinates that z does not reach and
equal eigenvalues have been deflated; the eigenvectors follow from the roots. The rows of an Arrow batch
are centred and turned into their triangular factor first, an orthogonal change that leaves the sum of
their rank-one terms as it is, so a batch costs as many updates as there are dimensions instead of rows.
Spectra of partitions are combined the same way, each eigenpair of one being a rank-one term for the
other, plus one for the distance of their means, in rounds of a fixed number of spectra a task. The
leading vectors of the last spectrum span the start of a distributed Rayleigh-Ritz refinement, which goes
over all rows again until the residual is down to rounding.

Entries become integers first (see ``scaled``), so counts, sums and deviations are exact. No task or
driver holds more than a fixed number of (dimensions x dimensions) matrices.

Edge cases: rows whose vector is null or holds null or non-finite entries are left out; so are vectors
whose length is not the most common one (of equally common lengths the larger counts) and empty ones;
an entry of more than 2^42 in size counts as that; equal vectors, rows that share a vec_id and rows
without one are rows of their own; a component without variance has whitened 0 and explained 0 and does
not count in identity_error; a deviation above the largest long is null; no rows give no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.session import checkpointed, ship_package

SCALE, SHIFT = 1024, 100_000
# Spectra that one task combines.
FAN_IN = 16
# Directions beyond those asked for that the refinement carries along.
SPARE = 8
_LARGEST = float(1 << 42)
_EPS = np.finfo(float).eps
_LONG = (1 << 63) - 1


# ---- rank-one updates of a spectrum


def _deflated(d: np.ndarray, z: np.ndarray, q: np.ndarray, rho: float):
    """Rotate runs of equal eigenvalues so that z reaches one coordinate of each run, and tell the
    coordinates that stay as they are. ``d`` ascends."""
    norm = np.linalg.norm(z)
    tolerance = 8 * _EPS * max(abs(d[0]), abs(d[-1]), rho * norm * norm)
    z = z.copy()
    # A run ends where the next value is farther than the tolerance from the run's first.
    begin = 0
    while begin < len(d):
        end = int(np.searchsorted(d, d[begin] + tolerance, "right"))
        end = max(end, begin + 1)
        if end - begin > 1:
            largest = np.abs(z[begin:end]).max()
            if largest > 0:
                mirror = z[begin:end] / largest
                length = np.linalg.norm(mirror)
                sign = 1.0 if mirror[-1] >= 0 else -1.0
                mirror[-1] += sign * length
                mirror /= np.linalg.norm(mirror)
                q[:, begin:end] -= 2 * np.outer(q[:, begin:end] @ mirror, mirror)
                z[begin:end] = 0
                z[end - 1] = -sign * length * largest
        begin = end
    return z, rho * np.abs(z) * norm > tolerance


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - x)), one above each pole, as (nearest pole, distance to it).

    All roots are looked for at once: both sums of poles, below and above a root, are replaced by
    one pole each that agrees in value and slope, and a step that leaves the bracket halves it instead.
    """
    k = len(d)
    top = rho * z2.sum()
    upper = np.append(d[1:], d[-1] + top)
    width = upper - d
    middle = d + width / 2
    value = 1 + rho * (z2 / (d[None, :] - middle[:, None])).sum(axis=1)
    origin = np.where(value > 0, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    gaps = d[None, :] - d[origin][:, None]
    # Bracket of the distance from the origin.
    low = np.where(origin == np.arange(k), 0.0, -width / 2)
    high = np.where(origin == np.arange(k), width / 2, 0.0)
    if value[-1] <= 0:  # the last root has no pole above it
        low[-1], high[-1] = width[-1] / 2, width[-1]
    x = (low + high) / 2
    below = np.arange(k)[None, :] <= np.arange(k)[:, None]
    rows = np.arange(k)
    active = np.ones(k, dtype=bool)
    for _ in range(120):
        away = gaps - x[:, None]
        away = np.where(away == 0, np.finfo(float).tiny, away)
        parts = rho * z2 / away
        f = 1 + parts.sum(axis=1)
        active &= np.abs(f) > 8 * _EPS * (1 + np.abs(parts).sum(axis=1))
        active &= high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if not active.any():
            break
        low = np.where(f < 0, x, low)
        high = np.where(f >= 0, x, high)
        with np.errstate(all="ignore"):
            slopes = parts / away
        psi, phi = np.where(below, parts, 0).sum(axis=1), np.where(below, 0, parts).sum(axis=1)
        psi1, phi1 = np.where(below, slopes, 0).sum(axis=1), np.where(below, 0, slopes).sum(axis=1)
        # The interpolating poles: the root's own pole and the next one.
        left = away[rows, rows]
        right = np.where(rows + 1 < k, away[rows, np.minimum(rows + 1, k - 1)], np.inf)
        with np.errstate(all="ignore"):
            s = left * left * psi1
            c = 1 + psi - left * psi1
            finite = np.isfinite(right)
            t = np.where(finite, right * right * phi1, 0.0)
            c = c + np.where(finite, phi - right * phi1, phi)
            # c + s / (left - y) + t / (right - y) = 0 in the step y
            r = np.where(finite, right, 0.0)
            a = c
            b = -(c * (left + r) + s + t)
            e = c * left * r + s * r + t * left
            root = np.sqrt(np.maximum(b * b - 4 * a * e, 0))
            y1 = 2 * e / (-b + np.where(b <= 0, root, -root))
            y2 = (-b + np.where(b <= 0, root, -root)) / (2 * a)
            single = left + s / c
            y1, y2 = np.where(finite, y1, single), np.where(finite, y2, single)
            guess1, guess2 = x + y1, x + y2
            inside1 = np.isfinite(guess1) & (guess1 > low) & (guess1 <= high)
            inside2 = np.isfinite(guess2) & (guess2 > low) & (guess2 <= high)
        step = np.where(inside1, guess1, np.where(inside2, guess2, (low + high) / 2))
        x = np.where(active, step, x)
    return origin, x


def rank_one(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of q diag(d) qᵀ + rho z zᵀ; ``q`` may be changed."""
    inner = q.T @ z
    inner, moved = _deflated(d, inner, q, rho)
    at = np.flatnonzero(moved)
    if not len(at):
        return d, q
    poles, w = d[at], inner[at]
    origin, x = secular_roots(poles, w * w, rho)
    # away[i, j] = pole i minus root j, without cancellation
    away = (poles[:, None] - poles[origin][None, :]) - x[None, :]
    away = np.where(away == 0, -np.finfo(float).tiny, away)
    # z for which the roots are exact (Gu and Eisenstat): keeps the eigenvectors orthogonal.
    apart = poles[:, None] - poles[None, :]
    np.fill_diagonal(apart, 1.0)
    k = len(at)
    ratio = np.ones((k, k))
    # Root j is paired with pole j where that is below i, else with pole j + 1; the last with rho.
    beyond = np.arange(k)[:, None] > np.arange(k - 1)[None, :]
    ratio[:, : k - 1] = away[:, : k - 1] / np.where(beyond, apart[:, : k - 1], apart[:, 1:])
    ratio[:, k - 1] = -away[:, k - 1] / rho
    exact = np.sqrt(np.abs(ratio.prod(axis=1)))
    vectors = np.where(w >= 0, exact, -exact)[:, None] / away
    vectors /= np.linalg.norm(vectors, axis=0)
    d, q = d.copy(), q.copy()
    d[at] = poles[origin] + x
    q[:, at] = q[:, at] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter (sum of centred squares) of some vectors."""

    def __init__(self, dimensions: int):
        self.n = 0
        self.mean = np.zeros(dimensions)
        self.d, self.q = np.zeros(dimensions), np.eye(dimensions)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """The rank-one term and the new mean that joining ``n`` vectors with this mean brings."""
        away = mean - self.mean
        both = self.n + n
        self.d, self.q = rank_one(self.d, self.q, away, self.n * n / both)
        self.mean = self.mean + away * (n / both)
        self.n = both

    def _terms(self, terms: np.ndarray) -> None:
        for z in terms:
            if z.any():
                self.d, self.q = rank_one(self.d, self.q, z)

    def add(self, rows: np.ndarray) -> None:
        if len(rows) == 0:
            return
        mean = rows.mean(axis=0)
        centred = rows - mean
        self._terms(np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred)
        self._shift(len(rows), mean)

    def join(self, n: int, mean: np.ndarray, terms: np.ndarray) -> None:
        """Another spectrum, its eigenvectors (rows) scaled by the roots of their eigenvalues."""
        self._terms(terms)
        self._shift(n, mean)

    def terms(self) -> np.ndarray:
        return (self.q * np.sqrt(np.maximum(self.d, 0))).T

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean.tolist(), "terms": self.terms().ravel().tolist()}


_SPECTRUM = "part long, n long, mean array<double>, terms array<double>"
_SPECTRUM_ARROW = pa.schema(
    [("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("terms", pa.list_(pa.float64()))]
)


# ---- passes over the rows


def scaled(values: np.ndarray) -> np.ndarray:
    """The integer of each entry: floor(1024 * c) + 100000."""
    return np.floor(SCALE * np.clip(values, -_LARGEST, _LARGEST)).astype(np.int64) + SHIFT


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return scaled(flat.reshape(len(column), -1))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding at the end where 64 bits hold n * x."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    return (x - np.array(whole, dtype=np.int64)).astype(float) - rest


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum of (n * x - S)^2 of each row, null above the largest long."""
    whole = [s // n for s in sums]
    rest = [s - w * n for s, w in zip(sums, whole)]
    away = x - np.array(whole, dtype=np.int64)
    largest = n * (int(np.abs(away).max(initial=0)) + 1)
    if largest * largest * len(sums) <= _LONG:
        gaps = away * np.int64(n) - np.array(rest, dtype=np.int64)
        return pa.array((gaps * gaps).sum(axis=1))
    out = []
    for row in away.tolist():
        total = sum((n * a - r) ** 2 for a, r in zip(row, rest))
        out.append(total if total <= _LONG else None)
    return pa.array(out, pa.int64())


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of this partition and the sum of each dimension, in two halves that cannot overflow."""
    n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        x = _matrix(batch["vector"])
        n += len(x)
        high += (x >> 20).sum(axis=0)
        low += (x & ((1 << 20) - 1)).sum(axis=0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, n, np.int64)), pa.array(high), pa.array(low)],
        names=["at", "n", "high", "low"],
    )


def _spectra(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    spectrum = Spectrum(size)
    for batch in batches:
        spectrum.add(_matrix(batch["vector"]).astype(float))
    if spectrum.n:
        yield pa.RecordBatch.from_pylist([spectrum.row(_part())], schema=_SPECTRUM_ARROW)


def _joined(table: pa.Table, size: int) -> pa.Table:
    """The spectra of a group, joined in the order of their parts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    spectrum = Spectrum(size)
    for r in rows:
        spectrum.join(r["n"], np.array(r["mean"]), np.array(r["terms"]).reshape(-1, size))
    return pa.Table.from_pylist([spectrum.row(rows[0]["part"])], schema=_SPECTRUM_ARROW)


def _products(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This partition's share of (scatter x basis), one row a dimension."""
    size, width = basis.shape
    total, rows = np.zeros((size, width)), 0
    for batch in batches:
        centred = _centred(_matrix(batch["vector"]), n, sums)
        total += centred.T @ (centred @ basis)
        rows += len(centred)
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, _part()), pa.int64()), pa.array(np.arange(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
            names=["part", "at", "share"],
        )


def _covered(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This partition's share of (whitened x whitened), one row a component."""
    width = turn.shape[1]
    total, rows = np.zeros((width, width)), 0
    for batch in batches:
        white = _centred(_matrix(batch["vector"]), n, sums) @ turn
        total += white.T @ white
        rows += len(white)
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(width, _part()), pa.int64()), pa.array(np.arange(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
            names=["part", "at", "share"],
        )


def _added(shares: DataFrame, length: int) -> np.ndarray:
    """The sum of all partitions' shares, added up row by row in Spark; as large as one share."""

    def one(key, table):
        order = np.argsort(table["part"].to_numpy(), kind="stable")
        rows = table["share"].combine_chunks().take(pa.array(order)).to_pylist()
        total = reduce(np.add, map(np.array, rows))
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "share": pa.array([total.tolist()], pa.list_(pa.float64()))})

    rows = shares.groupBy("at").applyInArrow(one, "at int, share array<double>").collect()
    out = np.zeros((length, len(rows[0]["share"])))
    for r in rows:
        out[r["at"]] = r["share"]
    return out


def _combined(vectors: DataFrame, size: int) -> Spectrum:
    """The spectrum of all rows."""
    spectra = checkpointed(vectors.mapInArrow(lambda batches: _spectra(batches, size), _SPECTRUM))
    count = spectra.count()
    while count > 1:
        groups = -(-count // FAN_IN)
        ranked = spectra.withColumn("group", F.pmod(F.hash("part"), F.lit(groups)))
        spectra = checkpointed(ranked.groupBy("group").applyInArrow(lambda table: _joined(table.drop(["group"]), size), _SPECTRUM))
        count = spectra.count()
    row = spectra.first()
    spectrum = Spectrum(size)
    spectrum.join(row["n"], np.array(row["mean"]), np.array(row["terms"]).reshape(-1, size))
    return spectrum


def _refined(vectors: DataFrame, n: int, sums: list[int], basis: np.ndarray, wanted: int):
    """(eigenvalues, falling, and eigenvectors) of the covariance by Rayleigh-Ritz steps over all rows."""
    before = np.inf
    while True:
        shares = vectors.mapInArrow(lambda batches, b=basis: _products(batches, n, sums, b), "part long, at int, share array<double>")
        image = _added(shares, len(basis)) / n
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        ritz = basis @ turn
        residual = np.abs(image @ turn - ritz * values)[:, :wanted].max()
        if residual <= 64 * _EPS * max(values[0], 0) or residual > before / 2:
            return values[:wanted], ritz[:, :wanted]
        before = residual
        basis, _ = np.linalg.qr(image @ turn)


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, embedding)."""
    ship_package(vectors.sparkSession)
    number = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("vector")).where(
        F.coalesce(
            (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))),
            F.lit(False),
        )
    )
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], out)
    size = common["size"]
    rows = rows.where(F.size("vector") == size)
    only = rows.select("vector")
    total = (
        only.mapInArrow(lambda batches: _sums(batches, size), "at int, n long, high long, low long")
        .groupBy("at")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
        .collect()
    )
    n = total[0]["n"]
    sums = [(int(r["high"]) << 20) + int(r["low"]) for r in sorted(total, key=lambda r: r["at"])]

    spectrum = _combined(only, size)
    trace = float(spectrum.d.sum()) / n
    wanted = min(components, size)
    start = spectrum.q[:, ::-1][:, : min(size, wanted + SPARE)]
    values, axes = _refined(only, n, sums, np.ascontiguousarray(start), wanted)
    varied = values > 1e-12 * max(values[0], 1e-300)
    explained = np.where(varied, values / trace if trace > 0 else 0.0, 0.0)
    turn = np.where(varied, axes / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    shares = only.mapInArrow(lambda batches: _covered(batches, n, sums, turn), "part long, at int, share array<double>")
    away = np.abs(_added(shares, wanted) / n - np.eye(wanted))
    error = float(away[np.ix_(varied, varied)].max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["vector"])
            white = _centred(x, n, sums) @ turn
            again = np.repeat(np.arange(len(x)), wanted)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, wanted + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(again), n, np.int64)),
                    _deviations(x, n, sums).take(pa.array(again)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(again), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, out)
