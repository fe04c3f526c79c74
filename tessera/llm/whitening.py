"""Whitening of embeddings by matrix-free block Lanczos.

The covariance of the distinct vectors is never formed. A pass over them gives
``V W`` for a block ``W`` of a few columns: each task centres its rows, takes
``C (C' W)`` apart into two thin products and hands in one block, and blocks are
summed by dimension. A Krylov basis grows by such blocks, is orthogonalised
in full and twice against all before it, and replaces directions that break
down by new random ones. Ritz pairs come from the basis and its images, and
the passes end when the true residuals of the wanted pairs are small beside the
largest eigenvalue, or when the basis spans the whole space. A basis that has
reached ``MOST_BASIS`` columns starts again from its best Ritz vectors.

Entries are whole numbers, so sums, deviations and the trace are exact; the
driver holds blocks of dimensions by columns, and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SCALE = 256
COMPONENTS = 4
#: Columns of a block and, in all, of a basis before it starts again.
BLOCK = 8
MOST_BASIS = 256
MOST_PASSES = 2000
#: Residuals of wanted pairs and directions that count as none, beside the largest eigenvalue.
TOLERANCE = 1e-13
BREAKDOWN = 1e-12
#: Entries from here on are not exact as doubles and count as not finite.
TOO_LARGE = float(1 << 53)
LONG = 1 << 63
#: Sums of squares can outgrow a decimal and travel in two parts.
LIMB = 10**28


class Whitening(NamedTuple):
    """n fit vectors with sums by dimension, the trace of their covariance, eigenvalues and vectors (columns), and how many passes it took."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x, the entries floor(scale * c) as longs, of every usable row.

    Null vectors and those with a null, NaN or infinite entry, or one beyond
    2^53 once scaled, are left out; null and repeated ids stay.
    """
    scaled = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale))
    usable = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * scale < TOO_LARGE), F.lit(False)))
    return df.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), scaled.cast("array<long>").alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch, shorter ones filled with zeros."""
    lists = batch.column(batch.schema.get_field_index("x"))
    sizes, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs where nothing can exceed them, squares summed over dimensions included, else as Python's integers."""
    most = 2 * n * max(1, int(np.abs(x).max(initial=1)), max(map(abs, sums), default=0) // n + 1)
    if most * most * max(1, x.shape[1]) < LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _by_dimension(fit: DataFrame, dims: int, of_batch, width: int) -> np.ndarray:
    """The sum over all batches of ``of_batch``'s arrays (dims x width), a row for each task and dimension on the way."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                found = of_batch(_matrix(b, dims))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), *[pa.array(total[:, j]) for j in range(width)]], ["i", *names])

    names = [f"c{j}" for j in range(width)]
    parts = fit.mapInArrow(partial, "i long, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((dims, width))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # dims rows
        out[r["i"]] = [r[c] for c in names]
    return out


def _new_directions(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors that span the block beside the basis. A direction of which
    nothing is left has broken down: a random one restarts it, as long as
    the space has room."""
    found = basis
    for column in block.T:
        if found.shape[1] == len(column):
            break
        least = BREAKDOWN * scale
        while True:
            for _ in range(2):
                column = column - found @ (found.T @ column)
            size = np.linalg.norm(column)
            if size > least:
                break
            column, least = rng.standard_normal(len(column)), 1e-8
        found = np.column_stack([found, column / size])
    return found[:, basis.shape[1] :]


def lanczos(apply, dims: int, wanted: int, block: int = BLOCK, most_basis: int = MOST_BASIS, tolerance: float = TOLERANCE, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues, falling, their vectors and the number
    of passes, for a symmetric matrix known by ``apply(block) -> matrix @ block``."""
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, dims), min(max(block, wanted), dims)
    most_basis = min(max(most_basis, 3 * block), dims)
    start, passes = rng.standard_normal((dims, block)), 0
    while True:
        basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
        new = _new_directions(start, basis, np.abs(start).max(), rng)
        while True:
            basis, images, passes = np.column_stack([basis, new]), np.column_stack([images, apply(new)]), passes + 1
            small = basis.T @ images
            values, ritz = np.linalg.eigh((small + small.T) / 2)
            values, ritz = values[::-1], ritz[:, ::-1]
            vectors = basis @ ritz[:, :wanted]
            residuals = np.linalg.norm(images @ ritz[:, :wanted] - vectors * values[:wanted], axis=0)
            done = basis.shape[1] == dims or basis.shape[1] > 2 * block and residuals.max() <= tolerance * max(values[0], 0)
            if done or passes >= MOST_PASSES:
                if not done:
                    raise ArithmeticError(f"no convergence in {passes} passes; residuals {residuals.tolist()}")
                return values[:wanted], vectors, passes
            if basis.shape[1] + block > most_basis and most_basis < dims:
                start = basis @ ritz[:, :block]
                break
            new = _new_directions(images[:, -new.shape[1] :], basis, max(values[0], np.finfo(float).tiny), rng)


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK, most_basis: int = MOST_BASIS) -> tuple[Whitening, DataFrame] | None:
    """The whitening of a table with a column x of longs, and its distinct
    vectors, shorter ones filled with zeros; None for an empty table.

    Only components whose eigenvalue is above rounding are kept: at most the
    rank of the covariance, none if all vectors are alike.
    """
    most = vectors.agg(F.max(F.size("x"))).first()[0]
    if most is None:
        return None
    dims = max(most, 1)
    filled = F.when(F.size("x") == dims, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    fit = written(vectors.select(filled.alias("x")).distinct(), "whitening-fit")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for b in batches:
            x = _matrix(b, dims)
            n += len(x)
            total = total + (x.sum(axis=0) if np.abs(x).max(initial=0) * (len(x) + 1) < LONG else x.astype(object).sum(axis=0)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array([n] * dims), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "n", "s"])

    rows = fit.mapInArrow(add_up, "i long, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            total += sum(map(int, (_from_mean(_matrix(b, dims), n, sums) ** 2).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(part)], pa.decimal128(38, 0)) for part in divmod(total, LIMB)], ["high", "low"])

    both = fit.mapInArrow(spread, "high decimal(38,0), low decimal(38,0)").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).first()
    trace = (int(both["high"]) * LIMB + int(both["low"])) / n**3

    def apply(w: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            centred = (_from_mean(x, n, sums) / n).astype(float)
            return centred.T @ (centred @ w)

        return _by_dimension(fit, dims, product, w.shape[1]) / n

    values, found, passes = lanczos(apply, dims, components, block, most_basis)
    real = values > max(trace, 0) * dims * np.finfo(float).eps
    return Whitening(n, sums, trace, values[real], found[:, real], passes), fit


def identity_error(model: Whitening, fit: DataFrame) -> float:
    """The largest absolute entry of the whitened fit vectors' covariance minus the identity."""
    n, sums, scaled = model.n, model.sums, model.vectors / np.sqrt(model.values)
    k = len(model.values)
    if not k:
        return 0.0

    def product(x: np.ndarray) -> np.ndarray:
        z = (_from_mean(x, n, sums) / n).astype(float) @ scaled
        out = np.zeros((len(sums), k + 1))
        out[:k, :k], out[:k, k] = z.T @ z, z.sum(axis=0)
        return out

    both = _by_dimension(fit, len(sums), product, k + 1)[:k] / n
    return float(np.abs(both[:, :k] - np.outer(both[:, k], both[:, k]) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK, most_basis: int = MOST_BASIS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error:
    for every usable row one row a component, the largest eigenvalue first.

    n counts the distinct vectors, which alone are fitted; deviation is the
    exact sum over dimensions of (n * x - S)^2, null if a long cannot hold it;
    whitened is the projection of x - S / n on the component over the root of
    its eigenvalue, explained the eigenvalue over the trace. Rows with null,
    repeated ids or repeated vectors each have their own results; vectors
    shorter than the longest are filled with zeros; a rank below ``components``
    gives fewer of them, and a table without usable rows or with all vectors
    alike gives no rows. Other columns are ignored. Components are the same
    up to rounding when run again.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(whole_vectors(df, id_col, vector_col, scale), "whitening-rows")
    fitted = fit_whitening(rows, components, block, most_basis)
    if fitted is None or not len(fitted[0].values):
        return df.sparkSession.createDataFrame([], schema)
    model, fit = fitted
    error = identity_error(model, fit)
    n, sums, scaled, shares = model.n, model.sums, model.vectors / np.sqrt(model.values), model.values / model.trace
    dims, k = scaled.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _from_mean(_matrix(b, dims), n, sums)
            deviation = [d if d < LONG else None for d in map(int, (x**2).sum(axis=1))]
            m = len(x)
            own = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("vec_id")).take(pa.array(own)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(own)),
                    pa.array(((x / n).astype(float) @ scaled).ravel()),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
