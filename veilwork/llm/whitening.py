"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance come from products with it alone.  A pass over the
vectors multiplies a small block of columns by the centred covariance in the tasks and adds
the parts up; a polynomial of such products, by the Chebyshev recurrence, damps the part
of the spectrum that is not wanted.  QR and Rayleigh-Ritz then give approximate eigenpairs, and
their residuals say when these are good to double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.session import materialized

COMPONENTS = 4
# Columns beyond the wanted ones, which separate these from the rest of the spectrum.
SPARE_COLUMNS = 28
# Degree of the polynomial, and the most that it may amplify one direction against another.
DEGREE, SPREAD = 14, 1e7
SEED = 7
# A residual of this many roundings of the largest eigenvalue certifies an eigenpair.
ROUNDINGS = 50
MOST_ROUNDS = 200
# Numbers that a task multiplies at a time.
PIECE = 1 << 20

_LONG = 1 << 63


# --- vectors ------------------------------------------------------------------------------------


def whole_numbers(batch: pa.RecordBatch, column: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has ``dimension`` finite entries, and floor(256 * entry) of these.

    What does not fit a long becomes the nearest one.
    """
    vectors = batch.column(column)
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dimension)
    entries = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    entries = entries.astype(np.float64).reshape(len(rows), dimension)
    fine = np.isfinite(entries).all(1)
    with np.errstate(over="ignore"):
        x = np.floor(256 * entries[fine])
    big = np.abs(x) >= 2.0**62
    if not big.any():
        return rows[fine], x.astype(np.int64)
    exact = np.where(big, 0, x).astype(np.int64)
    exact[big] = [min(max(int(v), -_LONG), _LONG - 1) if math.isfinite(v) else (_LONG - 1 if v > 0 else -_LONG) for v in x[big]]
    return rows[fine], exact


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes in the narrowest of four widths, which comes first: equal rows, equal bytes."""
    size = np.maximum(x.max(1, initial=0), -1 - x.min(1, initial=0))
    width = np.where(size < 1 << 7, 1, np.where(size < 1 << 15, 2, np.where(size < 1 << 31, 4, 8)))
    out: list[bytes] = [b""] * len(x)
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        held = x[rows].astype(f"<i{w}")
        for k, row in zip(rows.tolist(), held):
            out[k] = bytes([w]) + row.tobytes()
    return out


def unpacked(column: pa.Array, dimension: int) -> Iterator[np.ndarray]:
    """Whole numbers of packed rows, a bounded number at a time; rows of a width together."""
    rows = max(1, PIECE // dimension)
    for k in range(0, len(column), rows):
        piece = column.slice(k, rows)
        lengths = np.asarray(pc.binary_length(piece))
        for w in (1, 2, 4, 8):
            chosen = np.flatnonzero(lengths == 1 + w * dimension)
            if len(chosen):
                data = b"".join(piece.take(pa.array(chosen)).to_pylist())
                held = np.frombuffer(data, np.uint8).reshape(len(chosen), -1)[:, 1:]
                yield np.ascontiguousarray(held).view(f"<i{w}").astype(np.int64)


@dataclass
class FitList:
    """Each distinct vector once, as a stored table, with its exact sums."""

    rows: DataFrame
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def added(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over all vectors of what ``part`` makes of a piece of centred ones.

        A pass over the stored table.  Tasks add up their own pieces, Spark the tasks' sums.
        """
        dimension, mean = len(self.sums), self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for x in unpacked(batch.column(0), dimension):
                    total += part(x - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

        sums = self.rows.mapInArrow(run, "slot bigint, value double").groupBy("slot").agg(F.sum("value").alias("value"))
        found = sums.toArrow()
        out = np.zeros(shape[0] * shape[1])
        out[found.column("slot").to_numpy()] = found.column("value").to_numpy()
        return out.reshape(shape)


def fit_list(rows: DataFrame, dimension: int) -> FitList:
    """Distinct vectors of ``rows`` (x: packed), and their number and sums."""
    kept = materialized(rows.select("x").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(dimension, object)
        for batch in batches:
            for x in unpacked(batch.column(0), dimension):
                count += len(x)
                # halves of the numbers, so that no sum overflows
                total += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        slots = pa.array(range(dimension + 1), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [slots, pa.array([int(v) for v in total] + [count], pa.decimal128(38, 0))], names=["slot", "value"]
        )

    sums = kept.mapInArrow(run, "slot bigint, value decimal(38,0)").groupBy("slot").agg(F.sum("value").alias("value"))
    values = {r.slot: int(r.value) for r in sums.collect()}
    return FitList(kept, values.get(dimension, 0), [values.get(k, 0) for k in range(dimension)])


# --- eigenpairs ---------------------------------------------------------------------------------


@dataclass
class Spectrum:
    values: np.ndarray  # falling
    vectors: np.ndarray  # one column each
    residuals: np.ndarray
    passes: int


def _ritz(times: Callable, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenpairs of the operator within the span of the block, and the operator on them."""
    q, _ = np.linalg.qr(block)
    on_q = times(q)
    projected = q.T @ on_q
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], q @ turn[:, order], on_q @ turn[:, order]


def _filtered(times: Callable, q: np.ndarray, on_q: np.ndarray, end: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of a degree on [0, ``end``], of the operator, times ``q``.

    The first product is known already.
    """
    half = end / 2
    before, now = q, (on_q - half * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (times(now) - half * now) / half - before
        scale = np.linalg.norm(now, axis=0)
        before, now = before / scale, now / scale
    return now


def leading_eigenpairs(times: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int) -> Spectrum:
    """The largest eigenpairs of a positive semidefinite operator, given by its products with a block.

    The block has more columns than are wanted.  The interval that the polynomial damps ends at
    the smallest Ritz value of the block, and its degree is bounded so that no direction grows
    so much against another that digits are lost.  Rounds go on until every wanted residual is
    at the rounding of the largest eigenvalue, or no longer falls within a tenth of a billionth of it.
    """
    columns = min(dimension, wanted + SPARE_COLUMNS)
    passes = 0

    def counted(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(block)

    block = np.random.default_rng(SEED).standard_normal((dimension, columns))
    last = math.inf
    for _ in range(MOST_ROUNDS):
        values, q, on_q = _ritz(counted, block)
        residuals = np.linalg.norm(on_q - q * values, axis=0)[:wanted]
        largest, worst = max(values[0], 0.0), residuals.max(initial=0.0)
        done = worst <= ROUNDINGS * np.finfo(float).eps * largest
        stuck = worst <= 1e-10 * largest and worst > last / 2
        end = values[-1]
        if done or stuck or columns == dimension or end <= 1e-13 * largest:
            return Spectrum(values[:wanted], q[:, :wanted], residuals, passes)
        last = worst
        grows = math.acosh(max(2 * largest / end - 1, 1 + 1e-12))
        degree = min(DEGREE, max(2, int(math.log(SPREAD) / grows)))
        block = _filtered(counted, q, on_q, end, degree)
    raise ArithmeticError(f"no eigenpairs after {MOST_ROUNDS} rounds: residual {worst:.3g} of {largest:.3g}")


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n * x - sum)², exact; null where a long cannot hold one."""
    bound = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if x.shape[1] * bound * bound < _LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    whole = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1).tolist()
    return [v if v < _LONG else None for v in whole]


def whiten(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Whitened coordinates of every vector along the leading components.

    One row for each kept row and component (from 1 by falling eigenvalue e): id, component, n and
    deviation (sum over the dimensions of (n * x - S)²), whitened ((x - S / n) on the component, over the root
    of e), explained (e over the trace of the covariance), identity_error (largest entry of the whitened
    covariance less the identity).  x is floor(256 * entry); n, S and the covariance are those of the
    list of distinct x vectors.

    Rows go whose vector is null, has a null or non-finite entry, or another length than
    most vectors have (the longest of equally frequent lengths).  Rows that repeat an id or a
    vector, and null ids, stay.  There are as many components as dimensions at most.  Where e is zero to
    rounding, ``whitened`` is null and takes no part in ``identity_error``; with one distinct vector
    ``explained`` and ``identity_error`` are null too.  A deviation beyond a long is null; x beyond
    a long is the nearest long.  Other columns are ignored, an empty table gives an empty one.
    """
    schema = (
        f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, component int, n bigint, deviation bigint, "
        "whitened double, explained double, identity_error double"
    )
    given = rows.select(rows[id_column].alias("id"), rows[vector_column].cast("array<double>").alias("v"))
    lengths = given.where("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], schema)
    dimension = most.d

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, x = whole_numbers(batch, 0, dimension)
        return pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], names=["x"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(pack, batches)

    fit = fit_list(given.select("v").mapInArrow(packs, "x binary"), dimension)
    if not fit.n:
        return rows.sparkSession.createDataFrame([], schema)
    n, mean, sums = fit.n, fit.mean, fit.sums
    trace = float(fit.added(lambda x: (x * x).sum(0)[:, None], (dimension, 1)).sum()) / n

    def times(block: np.ndarray) -> np.ndarray:
        return fit.added(lambda x: x.T @ (x @ block), block.shape) / n

    wanted = min(components, dimension)
    found = leading_eigenpairs(times, dimension, wanted)
    e, vectors = found.values, _signed(found.vectors)
    real = e > max(trace, 0.0) * dimension * np.finfo(float).eps
    scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), np.nan)
    project = vectors * scale
    error = None
    if real.any():
        kept = project[:, real]
        k = kept.shape[1]

        def moments(x: np.ndarray) -> np.ndarray:
            y = x @ kept
            return np.vstack([y.T @ y, y.sum(0)])

        both = fit.added(moments, (k + 1, k)) / n
        error = float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())
    explained = [float(v) / trace if trace > 0 else None for v in np.maximum(e, 0.0)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), size := max(1, PIECE // dimension)):
                piece = batch.slice(k, size)
                chosen, x = whole_numbers(piece, 1, dimension)
                m = len(chosen)
                ids = piece.column(0).take(pa.array(np.repeat(chosen, wanted)))
                whitened = ((x - mean) @ project).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, wanted + 1), m), pa.int32()),
                        pa.array(np.full(m * wanted, n), pa.int64()),
                        pa.array([v for v in _deviations(x, n, sums) for _ in range(wanted)], pa.int64()),
                        pa.array(whitened, pa.float64(), from_pandas=True),
                        pa.array(explained * m, pa.float64()),
                        pa.array([error] * (m * wanted), pa.float64()),
                    ],
                    names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return given.mapInArrow(apply, schema)
