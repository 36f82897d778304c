"""Whitening of embeddings by their principal components.

Method: incremental eigendecomposition. Components c become whole numbers
x = floor(256 * c). Each partition of the fit list (every different x vector
once) starts from nothing and takes its vectors in by centred rank-one updates
of a spectrum (``secular.py``): with n vectors so far, the scatter grows by
n / (n + 1) times the square of the vector's distance from their mean. ``LANES``
spectra of a partition are updated side by side. Two spectra are combined by an
update for each eigenvector of the second and one for the distance of the means;
eight partitions at a time, then eight such groups, and so on.
The last spectrum is a basis for a Rayleigh-Ritz step: one more pass sums the
exactly centred scatter projected on it, and that matrix's eigenvectors give
the components to double precision. A third pass over the fit list
measures the covariance of the whitened vectors.

Counts and sums are exact integers throughout. A task holds ``LANES`` or
eight spectra (dimension squared each), never vectors of more than a batch; the
driver gets one spectrum and one projected matrix for each dimension. No
key has more than one row a partition, so no skew can arise; equal vectors
are combined before the shuffle that finds the different ones.

Defined results: vectors that are null, empty, or hold null or non-finite entries
(or entries whose x is beyond 2**53) are dropped. Vectors of different lengths are
fitted apart. Rows that repeat a vec_id or have none are rows of their own. A
component whose eigenvalue is nothing beside the trace (fewer different vectors
than components, constant dimensions) has null ``whitened`` and
counts neither for ``identity_error``, which is null if all are such;
``explained`` is null if all vectors are equal. A ``deviation`` beyond
a long is null. Ties among eigenvalues are broken by the fit. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import secular

SCALE, COMPONENTS = 256, 4
LANES, FAN_IN = 8, 8
#: Vectors that one matrix step takes.
STEP_ROWS = 4096
#: Share of the trace below which an eigenvalue is nothing.
NOTHING = 1e-13

_SPECTRUM = "part long, dim int, n long, sums binary, eigenvalues binary, vectors binary"
_MATRIX = "part long, dim int, matrix binary"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of whole numbers) of the vectors that take part."""
    entries = F.col("embedding").cast("array<double>")
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0 ** 53 / SCALE)))
    return (vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")).alias("x")))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places of the rows and their matrix of whole numbers, at most STEP_ROWS rows each."""
    x = batch.column("x")
    sizes = pc.list_value_length(x).to_numpy()
    flat = x.flatten().to_numpy()
    first = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for a in range(0, len(rows), STEP_ROWS):
            part = rows[a:a + STEP_ROWS]
            yield dim, part, flat[first[part][:, None] + np.arange(dim)]


class _Lanes:
    """Spectra of one partition's vectors of one length, side by side."""

    def __init__(self, dim: int):
        self.n, self.sums = np.zeros(LANES, np.int64), np.zeros((LANES, dim), np.int64)
        self.values, self.vectors = np.zeros((LANES, dim)), np.repeat(np.eye(dim)[None], LANES, axis=0)

    def take(self, x: np.ndarray) -> None:
        """One vector to each of the first lanes."""
        k = len(x)
        n = self.n[:k].astype(np.float64)
        away = x - self.sums[:k] / np.maximum(n, 1)[:, None]
        self.values[:k], self.vectors[:k] = secular.update(self.values[:k], self.vectors[:k], n / (n + 1), away)
        self.n[:k] += 1
        self.sums[:k] += x

    def combined(self) -> tuple:
        return _combined([(int(n), *rest) for n, *rest in zip(self.n, self.sums, self.values, self.vectors, strict=True) if n])


def _combined(spectra: list[tuple]) -> tuple:
    """One (n, sums, values, vectors) of several: their spectra, and their means' distances, as updates of the first."""
    n, sums, values, vectors = spectra[0]
    for m, more, *spectrum in spectra[1:]:
        away = more / m - sums / n
        values, vectors = secular.merge((values, vectors), tuple(spectrum))
        values, vectors = (x[0] for x in secular.update(values[None], vectors[None], np.array([n * m / (n + m)]), away[None]))
        n, sums = n + m, sums + more
    return n, sums, values, vectors


def _packed(part: int, dim: int, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([dim], pa.int32()), pa.array([n]), pa.array([sums.astype("<i8").tobytes()], pa.binary()),
         pa.array([values.astype("<f8").tobytes()], pa.binary()), pa.array([vectors.astype("<f8").tobytes()], pa.binary())],
        ["part", "dim", "n", "sums", "eigenvalues", "vectors"])


def _unpacked(row: dict) -> tuple:
    return (row["n"], np.frombuffer(row["sums"], "<i8"), np.frombuffer(row["eigenvalues"], "<f8"),
            np.frombuffer(row["vectors"], "<f8").reshape(row["dim"], row["dim"]))


def _fit_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fits: dict[int, _Lanes] = {}
    for batch in batches:
        for dim, _, x in _by_length(batch):
            lanes = fits.setdefault(dim, _Lanes(dim))
            for a in range(0, len(x), LANES):
                lanes.take(x[a:a + LANES])
    for dim, lanes in fits.items():
        yield _packed(TaskContext.get().partitionId(), dim, *lanes.combined())


def _merge_spectra(rows: pa.Table) -> pa.Table:
    held = rows.sort_by("part").to_pylist()
    return pa.Table.from_batches([_packed(held[0]["part"] // FAN_IN, held[0]["dim"], *_combined([_unpacked(r) for r in held]))])


def _add_matrices(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(r["matrix"], "<f8") for r in rows.sort_by("part").to_pylist())
    return pa.table([pa.array([rows["part"][0].as_py() // FAN_IN]), pa.array([rows["dim"][0].as_py()], pa.int32()),
                     pa.array([total.tobytes()], pa.binary())], names=["part", "dim", "matrix"])


def _tree(rows: DataFrame, merge: Callable[[pa.Table], pa.Table], schema: str) -> list[dict]:
    """The one row of each dimension that is left when FAN_IN neighbouring partitions are merged again and again."""
    rows = pin(rows)
    width = rows.agg(F.max("part")).first()[0] or 0
    while True:
        rows = pin(rows.groupBy("dim", F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(merge, schema))
        width //= FAN_IN
        if not width:
            return [r.asDict() for r in rows.collect()]                 # one row a dimension


def _scatter(project: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Sums over a partition of y * y', where y is a vector less the mean, on the columns of a matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                mean, columns = project[dim]
                y = (x - mean) @ columns
                total[dim] = total.get(dim, 0) + y.T @ y
        part = TaskContext.get().partitionId()
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([dim], pa.int32()), pa.array([m.astype("<f8").tobytes()], pa.binary())],
                                             ["part", "dim", "matrix"])
    return run


@dataclass
class Whitening:
    """A fit for vectors of one length: components in columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scaled(self) -> np.ndarray:
        """The columns that whiten; those of no variance are zero."""
        some = self.eigenvalues > NOTHING * self.trace
        return np.where(some, self.components / np.sqrt(np.where(some, self.eigenvalues, 1.0)), 0.0)


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of the vectors ``x``, every different one of which counts once."""
    distinct = pin(x.select("x").distinct())
    spectra = _tree(distinct.mapInArrow(_fit_partition, _SPECTRUM), _merge_spectra, _SPECTRUM)
    if not spectra:
        return {}
    first = {r["dim"]: _unpacked(r) for r in spectra}
    # Products of many rotations have drifted from orthogonal by some rounding; the basis has not.
    basis = {dim: (sums / n, np.linalg.qr(vectors[:, ::-1])[0]) for dim, (n, sums, _, vectors) in first.items()}
    fits = {}
    for r in _tree(distinct.mapInArrow(_scatter(basis), _MATRIX), _add_matrices, _MATRIX):
        dim = r["dim"]
        n, sums, *_ = first[dim]
        ritz = np.frombuffer(r["matrix"], "<f8").reshape(dim, dim) / n
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        falling = np.argsort(-values, kind="stable")[:components]
        fits[dim] = Whitening(n, sums, values[falling], basis[dim][1] @ turn[:, falling], float(np.trace(ritz)))
    made = {dim: (w.sums / w.n, w.scaled) for dim, w in fits.items()}
    for r in _tree(distinct.mapInArrow(_scatter(made), _MATRIX), _add_matrices, _MATRIX):
        w = fits[r["dim"]]
        some = np.flatnonzero((w.scaled != 0).any(axis=0))
        covariance = np.frombuffer(r["matrix"], "<f8").reshape(w.scaled.shape[1], -1)[np.ix_(some, some)] / w.n
        w.identity_error = float(np.abs(covariance - np.eye(len(some))).max()) if len(some) else None
    return fits


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sums) ** 2, exact; None beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most * most * x.shape[1] < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def transform(vectors: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """A row for each vector (``vec_id, x``) and component: its whitened value, with the fit's figures."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)          # components x dimension numbers for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for dim, rows, x in _by_length(batch):
                w = shared.value[dim]
                k = len(w.eigenvalues)
                white = (x - w.sums / w.n) @ w.scaled
                none = np.tile(~(w.scaled != 0).any(axis=0), len(rows))
                deviation = [v for v in _deviations(x, w.n, w.sums) for _ in range(k)]
                explained = [float(e) / w.trace for e in w.eigenvalues] if w.trace > 0 else [None] * k
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                     pa.array(np.full(len(rows) * k, w.n)), pa.array(deviation, pa.int64()), pa.array(white.ravel(), mask=none),
                     pa.array(explained * len(rows), pa.float64()), pa.array([w.identity_error] * (len(rows) * k), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return vectors.mapInArrow(run, _OUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whiten ``vec_id long, embedding array<float or double>`` on its first components.

    Returns vec_id, component (from 1), n (different vectors), deviation, whitened,
    explained (share of the trace) and identity_error for each row that takes part.
    """
    x = whole_vectors(vectors)
    return transform(x, fit(x, components))
