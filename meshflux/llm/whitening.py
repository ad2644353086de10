"""Whitening of embeddings: components by spectral divide and conquer, polar factors by the QDWH iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm.common import Lineage, shuffle_partitions

#: Entries become whole numbers: this many steps a unit, and what is added.
STEPS, LIFT = 64.0, 1_000_000
#: Components that a row is projected on at most.
MOST = 16
#: Rows that are multiplied at a time.
_SLICE = 1 << 12


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: dynamically weighted Halley steps, by QR while badly conditioned, then by Cholesky.

    For a symmetric matrix it is the matrix sign: 1 and -1 on the spaces of
    positive and of negative eigenvalues.
    """
    n = len(a)
    x = a / max(np.abs(a).sum(0).max(), np.finfo(float).tiny)  # the largest column sum bounds the norm
    eye, low = np.eye(n), np.finfo(float).eps
    while low < 1 - 1e-15:
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
            x = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        else:
            lower = np.linalg.cholesky(eye + r * x.T @ x)
            x = q / r * x + (p - q / r) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces above and below a shift that parts the eigenvalues; None if no shift does."""
    n = len(a)
    diagonal = np.diag(a)
    draw = np.random.Generator(np.random.PCG64(n))
    low, high = diagonal.min(), diagonal.max()
    # A shift that hits an eigenvalue gives no projector; then the next is tried.
    for shift in (np.median(diagonal), diagonal.mean(), *(low + (high - low) * np.array([0.37, 0.61, 0.17, 0.83]))):
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(float(np.trace(above)))
        if not 0 < rank < n or np.abs(above @ above - above).max() > 1e-11:
            continue
        bases = []
        for projector, width in ((above, rank), (np.eye(n) - above, n - rank)):
            basis = np.linalg.qr(projector @ draw.standard_normal((n, width)))[0]
            for _ in range(2):  # projected again, a basis is as exact as the projector
                basis = np.linalg.qr(projector @ basis)[0]
            bases.append(basis)
        return bases[0], bases[1]
    return None


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    A polar factor of the shifted matrix gives the projector on the space above
    the shift; the two spaces are split again until each has one dimension or the
    matrix is diagonal there. The largest entry of a vector is positive.
    """
    scale = np.abs(v).max() if v.size else 0.0
    open_, values, vectors = [np.eye(len(v))] if len(v) else [], [], []
    while open_:
        basis = open_.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        rest = np.abs(a - np.diag(np.diag(a))).max()
        parts = None if rest <= 1e-16 * scale else _halves(a)
        if parts is None:
            if rest > 1e-13 * scale:
                raise ArithmeticError(f"no shift parts a space of {len(a)} dimensions")
            values.extend(np.diag(a))
            vectors.extend(basis.T)
        else:
            open_.extend(np.linalg.qr(basis @ part)[0] for part in parts)
    if not values:
        return np.zeros(0), np.zeros((0, 0))
    order = np.argsort(-np.array(values), kind="stable")
    found = np.array(vectors)[order].T
    found = found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1.0, 1.0)
    return np.array(values)[order], found


def lifted(column: str) -> tuple[Column, Column]:
    """Whether a vector is whole and finite, and its entries as whole numbers."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # What no long can hold stays at the ends of its range.
    return F.coalesce(F.col(column).isNotNull() & finite, F.lit(False)), F.transform(
        column, lambda c: F.least(F.greatest(F.floor(F.lit(STEPS) * c.cast("double")), F.lit(-(1 << 62))), F.lit(1 << 62)) + F.lit(LIFT)
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moved(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in Python integers where 64 bits might not hold it."""
    if n * max(1, int(np.abs(x).max(initial=0))) < 1 << 61:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def _squares(moved: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond 64 bits."""
    if moved.dtype != object and int(np.abs(moved).max(initial=0)) ** 2 * moved.shape[1] < 1 << 63:
        return (moved * moved).sum(1).tolist()
    exact = moved.astype(object)
    return [s if s < 1 << 63 else None for s in (exact * exact).sum(1).tolist()]


def _added(partial: DataFrame) -> dict[int, np.ndarray]:
    """Rows (i, values) of a matrix, added up over the tasks that have part of them; the sums come to the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = values.values.to_numpy(zero_copy_only=False)
                sums[i] = sums[i] + row if i in sums else row.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "values"])

    dealt = partial.repartition(shuffle_partitions(partial.sparkSession), "i").mapInArrow(add, "i int, values array<double>")
    return {r.i: np.array(r["values"]) for r in dealt.collect()}


def _gram(fit: DataFrame, dims: int, n: int, sums: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of outer products of centred vectors, or of their products with ``onto`` and a one."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for k in range(0, len(x), _SLICE):
                centred = _moved(x[k : k + _SLICE], n, sums).astype(float) / n
                if onto is not None:
                    centred = np.hstack([centred @ onto, np.ones((len(centred), 1))])
                total = total + centred.T @ centred
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "values"])

    rows = _added(fit.mapInArrow(multiply, "i int, values array<double>"))
    return np.array([rows[i] for i in range(len(rows))])


def whiten(spark: SparkSession, rows: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = MOST) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): every usable row on up to ``most`` components.

    Vectors that are null, empty or hold null or non-finite entries are left
    out, and those whose length is not the length that most have (of two such
    lengths the greater). Entries become whole numbers; the fit list has each
    vector once, however often it is repeated. Sums and ``deviation`` are exact;
    a deviation beyond 64 bits is null. Components are those whose eigenvalue is
    beyond rounding error of the largest, so a single distinct vector has none
    and gives no rows. Null and repeated keys go through; other columns are
    ignored; an empty table gives an empty result.

    Tasks hold one matrix of dims x dims and the driver their sum, whatever the
    number of rows; what is sent to tasks is a matrix of dims x ``most``.
    """
    lineage = Lineage(spark)
    kind = rows.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable, x = lifted(column)
    whole = lineage.cut(rows.where(usable & (F.size(column) > 0)).select(F.col(key).alias("id"), x.alias("x")))
    lengths = whole.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["dims"]
    whole = whole.where(F.size("x") == dims).select("id", "x")
    fit = lineage.cut(whole.select("x").distinct())
    n = fit.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, np.int64)
        for batch in batches:
            total = total + _matrix(batch.column(0), dims).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["x"])

    places = fit.mapInArrow(count, "x array<long>").select(F.posexplode("x").alias("place", "x"))
    sums = np.array([r.x for r in places.groupBy("place").agg(F.sum("x").alias("x")).orderBy("place").collect()], np.int64)
    covariance = _gram(fit, dims, n, sums) / n
    values, vectors = eigen(covariance)
    trace = float(np.trace(covariance))
    kept = int((values[:most] > dims * np.finfo(float).eps * max(values[0], 0.0)).sum())
    if not kept:
        return spark.createDataFrame([], schema)
    onto = vectors[:, :kept] / np.sqrt(values[:kept])
    products = _gram(fit, dims, n, sums, onto)
    means = products[:kept, kept] / n
    error = float(np.abs(products[:kept, :kept] / n - np.outer(means, means) - np.eye(kept)).max())
    lineage.drop(fit)
    explained = values[:kept] / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                moved = _moved(_matrix(part.column(1), dims), n, sums)
                white = (moved.astype(float) / n) @ onto
                rows_, again = part.num_rows, np.repeat(np.arange(part.num_rows), kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * kept, n)),
                     pa.array(_squares(moved), pa.int64()).take(pa.array(again)), pa.array(white.ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * kept, error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(project, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whiten`` over all embeddings, 16 components."""
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
