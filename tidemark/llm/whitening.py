"""Whitening of embeddings by LOBPCG on distributed covariance products.

Vectors become whole numbers, x = floor(256 c). The fit list is each distinct x once: n vectors with sums S.
Their covariance V = 1/n sum (x - S/n)(x - S/n)' is never built: an iteration needs V times
a block of some directions, and each task multiplies its centred rows by the block,
then by themselves. The tasks' partial products are added up by Spark; the driver gets one product
of dimension x block. There the Rayleigh-Ritz step looks for the best block in the span
of the iterate, its residuals and the directions of the step before, until the residuals
of the wanted components certify them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.vectors import common_size, matrix

COMPONENTS = 4
#: Directions that are iterated beside the wanted ones: the more, the fewer iterations where eigenvalues lie close.
GUARDS = 12
#: Certificate: a residual of at most this share of the largest eigenvalue, and of at most `ANGLE` of the gap to the next eigenvalue.
RESIDUAL, ANGLE = 1e-13, 1e-10
ITERATIONS = 200
ROWS = 2048


class Fit:
    """n and sums S of the fit list; unit components as columns, their eigenvalues, the trace of V, and the residuals that certify them."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, residuals: np.ndarray, iterations: int):
        self.n, self.sums, self.values, self.vectors, self.trace, self.residuals, self.iterations = n, sums, values, vectors, trace, residuals, iterations


def whole_vectors(embeddings: DataFrame, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns ``keep`` and x, without the rows whose vector is null, empty or holds null or non-finite entries.

    Rows with another number of entries than the most frequent one (of ties the smallest) have no place in a common space: they go too.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.coalesce(finite & (F.size("embedding") > 0), F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))
    rows = rows.select(*keep, x.alias("x"))
    return rows.where(F.size("x") == common_size(rows.select(F.col("x").alias("vector"))))


def _moments(fit_list: DataFrame, size: int) -> tuple[int, list[int], list[int]]:
    """n, and for each dimension the exact sums of x and of its square."""
    entries = fit_list.select(F.posexplode("x").alias("i", "v")).select("i", F.col("v").cast("decimal(19,0)").alias("v"))
    got = {r.i: r for r in entries.groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum((F.col("v") * F.col("v")).cast("decimal(38,0)")).alias("q")).collect()}
    return got[0].n, [int(got[i].s) for i in range(size)], [int(got[i].q) for i in range(size)]


def _centred(column: pa.Array, n: int, sums: list[int]) -> Iterator[np.ndarray]:
    """Blocks of rows x - S/n as doubles: the whole part of S/n is taken off as whole numbers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    for low in range(0, len(column), ROWS):
        rows = column.slice(low, ROWS)
        yield (rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) - whole) - rest


def _product(fit_list: DataFrame, n: int, sums: list[int], left: np.ndarray | None, right: np.ndarray) -> np.ndarray:
    """1/n of the sum over the centred rows c of (c left)' (c right); without ``left`` of c' (c right)."""
    k = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for c in _centred(batch.column(0), n, sums):
                part = (c if left is None else c @ left).T @ (c @ right)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(col)) for col in total.T)], ["i", *(f"p{j}" for j in range(k))])

    parts = fit_list.select("x").mapInArrow(run, "i int, " + ", ".join(f"p{j} double" for j in range(k)))
    # One row for each dimension, whatever the number of vectors.
    got = parts.groupBy("i").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(k)]).orderBy("i").toArrow()
    return np.stack([got[f"p{j}"].to_numpy() for j in range(k)], axis=1) / n


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns in their order; what lies in the span of those before is dropped."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        for v in block.T:
            length = np.linalg.norm(v)
            if not length:
                continue
            v = v / length
            for _ in (0, 1, 2):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-8 and basis.shape[1] < len(v):
                v = v / left
                v = v - basis @ (basis.T @ v)
                basis = np.column_stack([basis, v / np.linalg.norm(v)])
    return basis


def certified(values: np.ndarray, residuals: np.ndarray, wanted: int) -> bool:
    """Whether the first components are certain: small residuals, also against the gaps to their neighbours.

    Eigenvalues that are the same to the last digits span a space of which any basis will do.
    """
    top = max(values[0], 1e-300)
    if not (residuals[:wanted] <= max(RESIDUAL, 4e-16 * len(values)) * top).all():
        gaps = np.abs(np.diff(values))
        for k in range(wanted):
            near = min([gaps[j] for j in (k - 1, k) if 0 <= j < len(gaps)], default=top)
            if residuals[k] > 1e-11 * top or residuals[k] > ANGLE * near:
                return False
    return True


def lobpcg(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, guards: int = GUARDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors, residual norms, iterations) of the largest ``wanted`` of a symmetric map given by its block product.

    A step multiplies an orthonormal basis of the iterate, its residuals and the directions before: one
    pass over the rows. Where eigenvalues are the same to the last digits no gap can certify a
    direction: it ends when residuals stay at the rounding of the products.
    """
    block = min(wanted + guards, size)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, block)))[0]
    ax = product(x)
    p = np.zeros((size, 0))
    best, stalled = np.inf, 0
    for step in range(1, ITERATIONS + 1):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        r = ax - x * values
        norms = np.linalg.norm(r, axis=0)
        if certified(values, norms, wanted):
            break
        worst = norms[:wanted].max()
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        if stalled >= 8 and best <= 1e-11 * max(values[0], 1e-300):
            break
        basis = _orthonormal([x, r, p])
        if basis.shape[1] == x.shape[1]:
            break
        whole = product(basis)
        inner, turn = np.linalg.eigh((basis.T @ whole + whole.T @ basis) / 2)
        turn = turn[:, ::-1][:, :block]
        old = x
        x, ax = basis @ turn, whole @ turn
        p = x - old @ (old.T @ x)
    return values[:wanted], x[:, :wanted], norms[:wanted], step


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Fit, DataFrame] | None:
    """The components of the distinct x of ``vectors``, and the written fit list; None where there are no vectors."""
    fit_list = materialize(vectors.select("x").distinct(), "whitening-fit")
    first = fit_list.first()
    if first is None:
        return None
    size = len(first.x)
    n, sums, squares = _moments(fit_list, size)
    trace = sum(n * q - s * s for s, q in zip(sums, squares, strict=True)) / n**2
    if trace == 0:
        return Fit(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0, np.zeros(0), 0), fit_list
    values, found, residuals, steps = lobpcg(lambda right: _product(fit_list, n, sums, None, right), size, min(components, size))
    # Directions without variance can't be scaled to unit variance.
    real = values > 1e-12 * values[0]
    return Fit(n, sums, values[real], found[:, real], trace, residuals[real], steps), fit_list


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error.

    See `whole_vectors` for the vectors that take part; zero vectors do. Vectors that repeat are one of the fit list, but each
    has its rows. Components whose eigenvalue is 0 (fewer distinct vectors than components, or all the same) have no rows, and an empty table
    has none. deviation is exact; one that does not fit a long raises an error. Further columns are not read.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    # Read once: the conversion is part of the first pass only.
    rows = materialize(whole_vectors(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), "whitening-x")
    found = fit(rows, components)
    if found is None or not len(found[0].values):
        return spark.createDataFrame([], schema)
    model, fit_list = found
    n, sums = model.n, model.sums
    scaled = model.vectors / np.sqrt(model.values)
    error = float(np.abs(_product(fit_list, n, sums, scaled, scaled) - np.eye(scaled.shape[1])).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in enumerate(_centred(batch.column("x"), n, sums)):
                part = batch.slice(k * ROWS, ROWS)
                w = c @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), lists], ["vec_id", "x", "w"])

    out = rows.mapInArrow(project, "vec_id long, x array<long>, w array<double>")
    # Exact in decimals of 38 digits; under Spark's ANSI rules a cast that does not fit raises an error.
    squares = F.aggregate(
        F.zip_with("x", F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums]), lambda v, s: (v.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(19,0)")),
        F.lit(0).cast("decimal(38,0)"),
        lambda a, d: (a + d * d).cast("decimal(38,0)"),
    )
    out = out.select("vec_id", squares.cast("long").alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values]), F.col("k") + 1)
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
