"""Embedding whitening: the leading eigenvectors of a covariance that is never built.

Vectors are turned into integers ``x = floor(1024 c) + 100000`` and laid down once
(``cut``), so that every pass sees the same rows. The covariance ``V`` of ``x`` is only
ever applied to a block of vectors: a *pass* centres each row, ``r = (n x - S) / n`` from
exact integers, and adds up ``r' (r Q)`` over all rows, a small matrix a task, summed by
``FAN_IN`` tasks before the driver sees it. Block Lanczos with full reorthogonalisation
runs on those passes: each new block is orthogonalised twice against the whole basis;
directions that vanish (a *breakdown*: the Krylov space is invariant) are replaced by
fresh random ones orthogonal to the basis, so the search restarts in what it has not
seen; Rayleigh-Ritz on the basis gives the eigenpairs, and the search stops when the
residual ``|V u - e u|`` of each wanted pair is below ``tol`` times the greatest
eigenvalue, or when the basis spans the space and the pairs are exact. ``trace(V)`` comes
from the deviations, so the shares of variance need no further eigenvalue. The driver
holds the basis, dimensions times dimensions at most, whatever the number of rows.

Defined results: vectors that are null, or hold null or entries that are not finite
(or of 2**43 and more, whose ``x`` no double holds), are left out; so are vectors of
another length than most have (of two equally common lengths the longer counts), as they
have no covariance with the others. A null id is an id; repeated rows each get a result
and each count in the fit. Components whose eigenvalue is nought (to rounding) are not
given, so equal vectors, a single vector and empty vectors give no rows, and there are at
most as many components as dimensions. Equal eigenvalues: any orthonormal basis, the same
for all rows. ``deviation`` is exact and null where a long does not hold it. A vector of any
length is read whole; no rows give none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut

COMPONENTS = 8
BLOCK = 16
TOL = 1e-13
FAN_IN = 16
SEED = 20240229
SCALE, SHIFT = 1024, 100_000
_LARGEST = float(1 << 43)


def integers(vector: Column) -> Column:
    """``vector`` as ``x``; null for what is left out."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < _LARGEST, F.lit(False)))  # NaN is above all numbers
    return F.when(fits, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, exact: int64, or Python integers where those would overflow."""
    most = max((int(np.abs(x).max()) if x.size else 0) * n, max(map(abs, sums), default=0))
    if most < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(numerators: np.ndarray) -> list[int]:
    """Sum over dimensions of the squares, exact."""
    wide = numerators.astype(np.float64)
    if (np.square(wide).sum(1) < float(1 << 62)).all() and numerators.dtype != object:
        return np.square(numerators).sum(1).tolist()
    return np.square(numerators.astype(object)).sum(1).tolist()


def _total(table: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum of ``of(x)``, an array of fixed shape, over batches of rows: an array a task, then one each of ``FAN_IN`` tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                own = of(_matrix(batch.column(0), d))
                held = own if held is None else held + own
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["sum"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for own in batch.column(0):
                value = np.frombuffer(own.as_py())
                held = value if held is None else held + value
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["sum"])

    parts = table.select("x").mapInArrow(part, "sum binary").withColumn("at", F.spark_partition_id())
    return sum(np.frombuffer(r["sum"]) for r in parts.repartition(FAN_IN, "at").select("sum").mapInArrow(whole, "sum binary").collect())


def _sums(table: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            held += (x if not x.size or int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object)).sum(0).astype(object)
        total = pa.array([None if not n else int(v) for v in held], pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), total], names=["pos", "n", "s"])

    rows = table.select("x").mapInArrow(part, "pos int, n long, s decimal(38,0)").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("pos").collect()
    return (int(rows[0]["n"]), [int(r["s"] or 0) for r in rows]) if rows else (0, [0] * d)


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Columns that span what ``block`` adds to ``basis``; those that vanish are replaced
    by random ones, as far as the space has room."""
    d = len(basis)
    new = np.zeros((d, 0))
    for column in block.T[: d - basis.shape[1]]:
        size = np.linalg.norm(column)
        while True:
            for _ in range(2):
                column = column - basis @ (basis.T @ column)
                column = column - new @ (new.T @ column)
            left = np.linalg.norm(column)
            if left > 1e-10 * size and left > 0:
                break
            column = rng.standard_normal(d)  # breakdown: start again from what is not in the basis
            size = np.linalg.norm(column)
        new = np.column_stack([new, column / left])
    return new


@dataclass
class Eigenpairs:
    values: np.ndarray  # falling
    vectors: np.ndarray  # dimensions x components
    residuals: np.ndarray
    passes: int


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, tol: float = TOL, seed: int = SEED) -> Eigenpairs:
    """The ``k`` greatest eigenpairs of the symmetric matrix that ``apply`` multiplies blocks with."""
    k = min(k, d)
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new, passes = _orthonormal(rng.standard_normal((d, max(block, k))), basis, rng), 0
    while True:
        basis = np.column_stack([basis, new])
        image = np.column_stack([image, apply(new)])
        passes += 1
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:k], mix[:, ::-1][:, :k]
        vectors = basis @ mix
        residuals = np.linalg.norm(image @ mix - vectors * values, axis=0)
        if basis.shape[1] == d or (residuals <= tol * max(values[0], 0)).all():
            vectors = vectors / np.linalg.norm(vectors, axis=0)
            sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
            return Eigenpairs(values, vectors * sign, residuals, passes)
        new = _orthonormal(image[:, -new.shape[1] :], basis, rng)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values

    def whitened(self, numerators: np.ndarray) -> np.ndarray:
        return (numerators.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def fit(table: DataFrame, d: int, components: int = COMPONENTS, block: int = BLOCK, tol: float = TOL, seed: int = SEED) -> Whitening:
    """The whitening of a table of integer vectors ``x`` of length ``d``."""
    n, sums = _sums(table, d) if d else (0, [])
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((d, 0)), 0.0, None, 0)

    def centred(x: np.ndarray) -> np.ndarray:
        return _numerators(x, n, sums).astype(np.float64) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            r = centred(x)
            return (r.T @ (r @ q)).ravel()

        return _total(table, of, d).reshape(d, -1) / n

    trace = float(_total(table, lambda x: np.array([np.square(centred(x)).sum()]), d)[0]) / n
    found = block_lanczos(apply, d, components, block, tol, seed)
    real = found.values > d * np.finfo(float).eps * max(found.values[0], 0.0)
    made = Whitening(n, sums, found.values[real], found.vectors[:, real], trace, None, found.passes)
    k = int(real.sum())
    if k:

        def products(x: np.ndarray) -> np.ndarray:
            w = made.whitened(_numerators(x, n, sums))
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        both = _total(table, products, d) / n
        covariance = both[k:].reshape(k, k) - np.outer(both[:k], both[:k])
        made.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return made


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, **options) -> DataFrame:
    """A row for each vector and component: ``id, component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    rows = vectors.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")).filter("x is not null")
    table = cut(rows, "vectors")
    lengths = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    same = table.filter(F.size("x") == d)
    fitted = fit(same, d, components, **options)
    k = len(fitted.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            numerators = _numerators(_matrix(batch.column(1), d), fitted.n, fitted.sums)
            deviation = [v if v < 1 << 63 else None for v in _deviations(numerators)]
            rows = batch.num_rows
            at = np.repeat(np.arange(rows), k)
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, fitted.n)),
                pa.array(deviation, pa.int64()).take(pa.array(at)),
                pa.array(fitted.whitened(numerators).ravel()),
                pa.array(np.tile(fitted.explained, rows)),
                pa.array(np.full(rows * k, fitted.identity_error or 0.0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    numbers = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), *[T.StructField(c, t) for c, t in numbers.items()]])
    return same.select("id", "x").mapInArrow(project, schema)
