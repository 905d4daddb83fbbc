"""Whitening of embeddings along the leading eigenvectors of their covariance, found by slicing its spectrum.

Sums and centred products are added up by tasks, in whole numbers, so they are exact and the same in every run. The
covariance (a matrix as wide as a vector) comes to the driver. There the count of negative pivots in an LDL^T factor of
``V - s I`` tells how many eigenvalues lie below ``s``: bisection on these counts fences in each leading eigenvalue,
Rayleigh quotient iteration converges to it, and counts on both sides of the result certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm.rows import pick

SCALE = 1024.0
OFFSET = 100000
#: Entries beyond this, scaled, are set to it: far beyond any embedding, and sums of squares stay within 38 digits.
MOST = 2.0 ** 40
MOST_COMPONENTS = 8
#: Eigenvalues up to this share of the trace are the rounding of zero; nothing can be scaled by them.
RANK_SHARE = 1e-12
BATCH_ROWS = 4096
WIDE = "decimal(38,0)"


class Spectrum(NamedTuple):
    """Fit of the whole table: rows, centre (whole numbers) and sums around it, trace, eigenvalues and vectors (a row each)."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """Negative, zero and positive eigenvalues of a symmetric matrix, from the pivots of LDL^T.

    Pivots of one or two rows are chosen as large as the rest of the matrix allows (the threshold keeps growth least), so
    that indefinite matrices do no harm.
    """
    a = np.array(matrix, dtype=np.float64)
    scale = np.abs(a).max(initial=0.0)
    alpha = (1 + 17 ** 0.5) / 8
    signs = {-1: 0, 0: 0, 1: 0}
    while len(a):
        diagonal = np.abs(a.diagonal())
        one = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0.0)
        most = off.max(initial=0.0)
        if max(diagonal[one], most) <= scale * 1e-300:
            signs[0] += len(a)
            break
        if diagonal[one] >= alpha * most:
            rest = np.delete(np.arange(len(a)), one)
            signs[int(np.sign(a[one, one]))] += 1
            column = a[rest, one]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[one, one])
            continue
        pair = np.array(np.unravel_index(int(off.argmax()), off.shape))
        rest = np.delete(np.arange(len(a)), pair)
        signs[-1] += 1  # such a block has a negative determinant: one eigenvalue of each sign
        signs[1] += 1
        columns = a[np.ix_(rest, pair)]
        a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(pair, pair)], columns.T)
        a = (a + a.T) / 2
    return signs[-1], signs[0], signs[1]


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than ``shift``."""
    return inertia(matrix - shift * np.eye(len(matrix)))[2]


def _fence(matrix: np.ndarray, k: int, low: float, high: float, least: float) -> tuple[float, float]:
    """Narrow ``low, high`` round the k-th greatest eigenvalue until it stands alone even in three times the gap, or the gap is at most ``least``.

    Seen from the middle, no other eigenvalue is then less than three times as far away as this one.
    """
    at_low, at_high = above(matrix, low), above(matrix, high)
    while (gap := high - low) > least:
        if at_low == k and at_high == k - 1 and above(matrix, low - gap) == k and above(matrix, high + gap) == k - 1:
            break
        middle = (low + high) / 2
        if not low < middle < high:
            break
        count = above(matrix, middle)
        if count >= k:
            low, at_low = middle, count
        else:
            high, at_high = middle, count
    return low, high


def _rayleigh(matrix: np.ndarray, low: float, high: float, known: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray]:
    """Eigenvalue between ``low`` and ``high`` and its unit vector, at right angles to the rows of ``known``."""
    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - known.T @ (known @ v)
        return v / np.linalg.norm(v)

    identity, size = np.eye(len(matrix)), np.linalg.norm(matrix, 2)
    shift, vector = (low + high) / 2, clean(start)
    best, edge = (np.inf, shift, vector), size * 1e-13
    for step in range(60):
        try:
            vector = clean(np.linalg.solve(matrix - shift * identity, vector))
        except np.linalg.LinAlgError:  # the shift is the eigenvalue itself
            vector = clean(np.linalg.solve(matrix - (shift + size * 2.0 ** -50) * identity, vector))
        value = float(vector @ matrix @ vector)
        error = float(np.linalg.norm(matrix @ vector - value * vector))
        inside = low - edge <= value <= high + edge
        if inside and error < best[0]:
            best = (error, value, vector)
        elif best[0] <= size * 1e-14 * len(matrix):
            break
        # the first steps keep to the middle of the fence; then the quotient leads, as long as it stays inside
        shift = value if step >= 2 and low <= value <= high else (low + high) / 2
    return best[1], best[2]


def leading(matrix: np.ndarray, most: int = MOST_COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` greatest eigenvalues, falling, and their unit vectors as rows; those that are zero but for rounding are left out.

    Equal eigenvalues (closer than rounding can tell) get vectors at right angles from their common space. Raises if the
    counts do not certify a number.
    """
    d = len(matrix)
    values, vectors = [], np.zeros((0, d))
    trace = float(np.trace(matrix))
    if d == 0 or trace <= 0:
        return np.zeros(0), vectors
    radius = float(np.abs(matrix).sum(axis=1).max())
    least = radius * 1e-13
    pull = np.random.default_rng(12)
    for k in range(1, min(most, d) + 1):
        floor = max(trace * RANK_SHARE, least)
        if above(matrix, floor) < k:
            break
        low, high = _fence(matrix, k, floor, radius * 1.01, least)
        value, vector = _rayleigh(matrix, low, high, vectors, pull.standard_normal(d))
        slack = max((high - low) * 1e-6, least * 4)
        if not (above(matrix, value - slack) >= k > above(matrix, value + slack)):
            raise ArithmeticError(f"eigenvalue {k} was not certified: {value} between {low} and {high}")
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values), vectors


def _scaled(batch: pa.RecordBatch, place: int, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that count, and their whole-number vectors; of ``width`` entries, or of any one width."""
    column = batch.column(place)
    sizes = np.diff(column.offsets.to_numpy())
    present = np.asarray(column.is_valid())
    valid = present & (sizes > 0)
    if width is not None:
        valid &= sizes == width
    floats = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)  # without what null lists hold
    starts = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(np.where(present, sizes, 0), out=starts[1:])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(floats))])
    valid &= bad[starts[1:]] == bad[starts[:-1]]
    rows = np.flatnonzero(valid)
    if width is None or not len(rows):
        return rows, np.zeros((0, width or 0), dtype=np.int64)
    entries = floats[starts[rows][:, None] + np.arange(width)]
    return rows, np.clip(np.floor(entries * SCALE), -MOST, MOST).astype(np.int64) + OFFSET


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, _ = _scaled(batch, 0, None)
        if len(rows):
            sizes, counts = np.unique(np.diff(batch.column(0).offsets.to_numpy())[rows], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["width", "n"])


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            _, x = _scaled(batch, 0, width)
            for start in range(0, len(x), BATCH_ROWS):
                total += x[start:start + BATCH_ROWS].sum(axis=0).astype(object)
            n += len(x)
        if n:
            yield _line([n, *total])

    return run


def _line(numbers: list) -> pa.RecordBatch:
    values = pa.array([Decimal(int(v)) for v in numbers], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int64()), values], ["at", "v"])


def _products(centre: np.ndarray):
    """Sums of the upper triangle of centred products; exact: factors are cut in halves of 24 bits where products might not fit."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d), dtype=object), 0
        for batch in batches:
            _, x = _scaled(batch, 0, d)
            for start in range(0, len(x), BATCH_ROWS):
                y = x[start:start + BATCH_ROWS] - centre
                n += len(y)
                if np.abs(y).max(initial=0) < 2 ** 20:  # products and their sums are whole numbers below 2^53, exact in floating point
                    f = y.astype(np.float64)
                    total += (f.T @ f).astype(np.int64).astype(object)
                else:
                    o = y.astype(object)
                    total += o.T @ o
        if n:
            yield _line(list(total[upper]))

    return run


def _added(rows: DataFrame, run) -> dict[int, int]:
    """Sums of what the tasks found, place by place: as many numbers as a matrix has entries, whatever the table holds."""
    found = rows.mapInArrow(run, f"at long, v {WIDE}").groupBy("at").agg(F.sum("v").cast(WIDE).alias("v"))
    return {r.at: int(r.v) for r in found.collect()}


def fit(vectors: DataFrame, most: int = MOST_COMPONENTS) -> Spectrum | None:
    """The spectrum of column ``embedding``; None where no vector counts. Three passes over the table, no shuffle but of sums."""
    widths = vectors.mapInArrow(_widths, "width long, n long").groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return None
    d = int(widths.width)
    sums = _added(vectors, _sums(d))
    n, total = sums[0], [sums[i + 1] for i in range(d)]
    centre = np.array([round(Fraction(s, n)) for s in total], dtype=np.int64)
    products = _added(vectors, _products(centre))
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    upper = np.triu_indices(d)
    matrix = np.zeros((d, d))
    for at, (i, j) in enumerate(zip(*upper)):
        matrix[i, j] = matrix[j, i] = float(Fraction(n * products[at] - rest[i] * rest[j], n * n))
    values, components = leading(matrix, most)
    return Spectrum(n, centre, np.array(rest, dtype=object), float(np.trace(matrix)), values, components)


def _white(spectrum: Spectrum, x: np.ndarray) -> np.ndarray:
    """Centred rows on the components, over the root of their eigenvalues. Summed entry by entry: the same in every batch."""
    mean = np.array([float(Fraction(int(r), spectrum.n)) for r in spectrum.rest])
    y = (x - spectrum.centre).astype(np.float64) - mean
    out = np.zeros((len(x), len(spectrum.values)))
    for i in range(y.shape[1]):
        out += y[:, i:i + 1] * spectrum.vectors[:, i]
    return out / np.sqrt(spectrum.values)


def _white_products(spectrum: Spectrum):
    k = len(spectrum.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x = _scaled(batch, 0, len(spectrum.centre))
            for start in range(0, len(x), BATCH_ROWS):
                w = _white(spectrum, x[start:start + BATCH_ROWS])
                n, sums, products = n + len(w), sums + w.sum(axis=0), products + w.T @ w
        if n:
            values = np.concatenate([sums, products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "v"])

    return run


def identity_error(vectors: DataFrame, spectrum: Spectrum) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, measured over the whole table."""
    k = len(spectrum.values)
    found = vectors.mapInArrow(_white_products(spectrum), "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    values = np.array([v for _, v in sorted((r.at, r.v) for r in found.collect())]) / spectrum.n
    mean, products = values[:k], values[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(spectrum: Spectrum, x: np.ndarray) -> list[int]:
    """Sum of squares of ``n x - S`` per row, exact."""
    y = x - spectrum.centre
    bound = spectrum.n * (int(np.abs(y).max(initial=0)) + 1)
    if bound * bound * max(1, x.shape[1]) < 2 ** 63:
        gaps = spectrum.n * y - spectrum.rest.astype(np.int64)
        return (gaps * gaps).sum(axis=1).tolist()
    gaps = spectrum.n * y.astype(object) - spectrum.rest
    return (gaps * gaps).sum(axis=1).tolist()


def _rows(spectrum: Spectrum, error: float):
    k = len(spectrum.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _scaled(batch, 0, len(spectrum.centre))
            for start in range(0, len(rows), BATCH_ROWS):
                part = x[start:start + BATCH_ROWS]
                ids = batch.column(1).take(pa.array(rows[start:start + BATCH_ROWS]))
                each = np.repeat(np.arange(len(part)), k)
                exact = _deviation(spectrum, part)
                narrow = pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())
                m = len(each)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(m, spectrum.n, dtype=np.int64)),
                     narrow.take(pa.array(each)), pa.array(_white(spectrum, part).ravel()), pa.array(np.tile(spectrum.values / spectrum.trace, len(part))),
                     pa.array(np.full(m, error)), pa.array([str(v) for v in exact], pa.string()).take(pa.array(each))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` per remaining row and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are vectors of another length
    than the commonest (the longer one of equals): they have no place in one covariance. Components whose
    eigenvalue is zero but for rounding are left out: with one row, equal rows, or fewer rows than components there are fewer
    than ``most``, possibly none. Null ids stay null, repeated rows each count and come back. An empty table gives an empty
    result. Entries beyond 2^30 are taken as that. ``deviation`` is null where it does not fit 64 bits; ``deviation_exact``
    has its decimal digits always.
    """
    rows = pick(vectors, embedding=vector_col, vec_id=id_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    only = rows.select("embedding")
    spectrum = fit(only, most)
    if spectrum is None or not len(spectrum.values):
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_rows(spectrum, identity_error(only, spectrum)), schema)
