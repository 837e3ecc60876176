"""Linear operators on frames: a small matrix built once on the driver and sent to the tasks, or the same as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_matrix(window: int, order: int, derivative: int = 0) -> np.ndarray:
    """H of a least-squares polynomial over -h .. h: row i gives the fitted value (or derivative) at place i from the window."""
    h = window // 2
    x = np.arange(-h, h + 1, dtype=float)
    basis = np.vander(x, order + 1, increasing=True)
    coefficients = np.linalg.pinv(basis)
    at = basis
    for _ in range(derivative):
        at = np.hstack([np.zeros((window, 1)), at[:, :-1] * np.arange(1, order + 1)])
    return at @ coefficients


def smoothing_matrix(length: int, window: int, order: int) -> np.ndarray:
    """length x length: polynomial smoothing inside a vector; the ends use the first and last full window."""
    if length < window:
        raise ValueError("the window is longer than the vector")
    h, out = fit_matrix(window, order), np.zeros((length, length))
    for i in range(length):
        start = min(max(i - window // 2, 0), length - window)
        out[i, start : start + window] = h[i - start]
    return out


def resample_matrix(length: int, target: int) -> np.ndarray:
    """target x length: Fourier resampling, the Nyquist term split when growing and summed when shrinking."""
    spectrum = np.fft.rfft(np.eye(length), axis=0)
    m = min(length, target)
    kept = np.zeros((target // 2 + 1, length), complex)
    kept[: m // 2 + 1] = spectrum[: m // 2 + 1]
    if m % 2 == 0 and length != target:
        kept[m // 2] *= 2.0 if target < length else 0.5
    return np.fft.irfft(kept, target, axis=0) * target / length


def cubic_matrix(length: int, target: int) -> np.ndarray:
    """target x length: cubic spline through the points with not-a-knot ends, read on an even grid from 0 to length - 1."""
    n = length
    a, rhs = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        rhs[i, i - 1 : i + 2] = 6, -12, 6
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    second = np.linalg.solve(a, rhs)
    out = np.zeros((target, n))
    for r, at in enumerate(np.linspace(0, n - 1, target)):
        i = min(int(at), n - 2)
        t = at - i
        out[r, i] += 1 - t
        out[r, i + 1] += t
        out[r] += ((1 - t) ** 3 - (1 - t)) / 6 * second[i] + (t**3 - t) / 6 * second[i + 1]
    return out


def apply_matrix(frames: DataFrame, matrix: np.ndarray, vec: str = "vec") -> DataFrame:
    """Each frame's vector times the matrix, in Arrow batches. The matrix is a few MB at most: its sides are frame lengths."""
    held = frames.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(vec)
            x = np.asarray(batch.column(at).flatten(), np.float64).reshape(-1, held.value.shape[0])
            y = x @ held.value
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.reshape(-1)))
            yield batch.set_column(at, batch.schema.field(at).name, made)

    return frames.mapInArrow(run, frames.schema)


def apply_matrix_native(frames: DataFrame, matrix: np.ndarray, vec: str = "vec") -> DataFrame:
    """The same by expressions: one constant row of weights for each output place."""
    rows = ",".join("array(" + ",".join(f"{w!r}D" for w in map(float, row)) + ")" for row in matrix)
    return frames.withColumn(vec, F.expr(f"transform(array({rows}), r -> aggregate(zip_with(r, {vec}, (a, b) -> a * b), 0D, (s, x) -> s + x))"))


#: Frames of a series that one task smooths at once.
BLOCK = 2048


def _column_matrix(col: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists, or of numbers, as rows of a matrix."""
    col = col.combine_chunks()
    flat = col.flatten() if pa.types.is_list(col.type) else col
    return np.asarray(flat, np.float64).reshape(len(col), -1)


def _with_column(table: pa.Table, name: str, values: np.ndarray, vectors: bool) -> pa.Table:
    made = pa.array(values.reshape(-1))
    if vectors:
        made = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), made)
    at = table.schema.get_field_index(name)
    return table.append_column(name, made) if at < 0 else table.set_column(at, name, made)


def _schema_with(frames: DataFrame, name: str, kind: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != name]
    at = frames.columns.index(name) if name in frames.columns else len(fields)
    return ", ".join([*fields[:at], f"`{name}` {kind}", *fields[at:]])


def _polynomial(frames: DataFrame, window: int, order: int, derivative: int, column: str, out: str, vectors: bool, short: str, block: int) -> DataFrame:
    """out: column after a polynomial over window frames, along each series, block by block.

    Each frame goes to its block and, near a border, to the next one, so a long series spreads over all tasks. Inside a block the window is
    a few scaled additions of whole columns; the ends of a series use the polynomial of the first and last full window.
    """
    h, half, reach = fit_matrix(window, order, derivative), window // 2, window - 1
    at = F.col("frame_index")
    last = F.floor((at + reach) / block)
    spread = frames.withColumn("_block", F.explode(F.sequence(F.greatest(F.floor((at - reach) / block), F.lit(0)), last)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = key[1].as_py() * block
        table = table.sort_by("frame_index")
        place = np.asarray(table["frame_index"].combine_chunks()).astype(np.int64)
        own = np.flatnonzero((place >= first) & (place < first + block))
        low, high = int(place[0]), int(place[-1])
        # frames are dense, so a series that ends before the reach of this block ends at its last frame here
        ends = high < first + block - 1 + reach
        if len(own) and ends and high + 1 < window and short == "error":
            raise ValueError("the series is shorter than the window")
        x = _column_matrix(table[column])
        if not len(own) or ends and high + 1 < window:
            return _with_column(table.slice(0, 0), out, np.zeros((0, x.shape[1])), vectors).drop_columns(["_block"])
        middle = place[own] - half
        start = np.clip(middle, 0, high - window + 1 if ends else None)
        y = np.zeros((len(own), x.shape[1]))
        usual = start == middle
        for k in range(window):
            y[usual] += h[half, k] * x[start[usual] + k - low]
        for i in np.flatnonzero(~usual).tolist():
            y[i] = h[place[own[i]] - start[i]] @ x[start[i] - low : start[i] - low + window]
        return _with_column(table.take(pa.array(own)), out, y, vectors).drop_columns(["_block"])

    return spread.groupBy("series_id", "_block").applyInArrow(run, _schema_with(frames, out, "array<double>" if vectors else "double"))


def smooth_over_time(frames: DataFrame, window: int = 7, order: int = 3, derivative: int = 0, vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """Polynomial smoothing along frames, position by position; frame numbers must be dense from 0 and at least window (else an error)."""
    return _polynomial(frames.select("series_id", "frame_index", vec), window, order, derivative, vec, vec, True, "error", block)


def smooth_series(frames: DataFrame, window: int = 7, order: int = 3, derivative: int = 0, value: str = "value", out: str = "smoothed", block: int = BLOCK) -> DataFrame:
    """smooth_over_time for a series of scalars; the input stays beside the result. Series shorter than window are left out."""
    return _polynomial(frames.withColumn(value, F.col(value).cast("double")), window, order, derivative, value, out, False, "leave out", block)


def derive_series(frames: DataFrame, window: int = 5, order: int = 2, value: str = "value", out: str = "slope") -> DataFrame:
    """Local polynomial slope at every frame; NaN and null count as 0."""
    clean = frames.withColumn(value, F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.lit(0.0)))
    return smooth_series(clean, window, order, 1, value, out)


def spectrogram(frames: DataFrame, bins: int, truncate: bool = True, vec: str = "vec") -> DataFrame:
    """Magnitudes of a windowed transform of the first bins - 2 samples of each frame; the lower half of them if truncate."""
    m = bins - 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    keep = m // 2 if truncate else m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(vec)
            col = batch.column(at)
            x = np.asarray(col.flatten(), np.float64).reshape(len(col), -1)[:, :m] * window
            y = np.abs(np.fft.fft(x, axis=1))[:, :keep]
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * keep, pa.int32()), pa.array(np.ascontiguousarray(y).reshape(-1)))
            yield batch.set_column(at, batch.schema.field(at).name, made)

    return frames.mapInArrow(run, frames.schema)
