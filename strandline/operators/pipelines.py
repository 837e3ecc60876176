"""Signal and blend pipelines over frames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import blend, decibel, promote, quantise, remap, rotate_left, splice_depth
from strandline.operators.aggregates import compressed_size, frame_rms, minmax_scale, with_range
from strandline.operators.frames import repeat_frames
from strandline.operators.generators import noise_like
from strandline.operators.linear import apply_matrix, derive_series, resample_matrix, smooth_over_time, smooth_series, smoothing_matrix, spectrogram
from strandline.operators.sides import join_small, kept
from strandline.operators.windows import circular_smooth, rolling_max, rolling_mean, rolling_sum


def spectrogram_db(frames: DataFrame, bins: int, truncate: bool = True) -> DataFrame:
    """spectrogram() in decibels against the largest magnitude of the series."""
    raw = kept(spectrogram(frames, bins, truncate), "spectrum")
    top = raw.groupBy("series_id").agg(F.max(F.array_max("vec")).alias("_top"))
    return join_small(raw, top, "series_id").withColumn("vec", F.transform("vec", lambda x: decibel(x, F.col("_top")))).drop("_top")


def spectrogram_vectors(frames: DataFrame, bins: int, length: int, amplitude: tuple[float, float] | None = None) -> DataFrame:
    """spectrogram_db() with each frame resampled to length, and all samples scaled to amplitude if given."""
    db = spectrogram_db(frames, bins)
    out = apply_matrix(db, resample_matrix((bins - 2) // 2, length))
    return minmax_scale(out, *amplitude) if amplitude else out


def smooth_spectrogram(frames: DataFrame, length: int, amplitude: tuple[float, float] | None = None) -> DataFrame:
    """spectrogram_vectors() smoothed over time (7, 3) and then inside each frame (5, 3)."""
    return apply_matrix(smooth_over_time(spectrogram_vectors(frames, length, length, amplitude), 7, 3), smoothing_matrix(length, 5, 3))


def power_series(frames: DataFrame) -> DataFrame:
    """(series_id, frame_index, value): root mean square of each frame."""
    return frame_rms(frames, "value")


def reduce_rolling_max(frames: DataFrame, share: int = 80) -> DataFrame:
    """Power and its centred rolling maximum, as columns value and reduced."""
    return rolling_max(power_series(frames), share, out="reduced")


def reduce_rolling_average(series: DataFrame, size: int = 3, window: int = 7, order: int = 3) -> DataFrame:
    """value, its rolling mean (rolled) and that smoothed (reduced)."""
    return smooth_series(rolling_mean(series, size), window, order, value="rolled", out="reduced")


def reduce_compressed(frames: DataFrame, size: int = 3, window: int = 7, order: int = 3) -> DataFrame:
    """The same of the frames' compressed size."""
    return reduce_rolling_average(compressed_size(frames), size, window, order)


def levels_of(reduced: DataFrame, levels: int, value: str = "reduced", out: str = "model_index") -> DataFrame:
    """(series_id, frame_index, out): value quantised over the range of its series."""
    return with_range(kept(reduced.select("series_id", "frame_index", value), "reduced"), value).select("series_id", "frame_index", quantise(F.col(value), F.col("lo"), F.col("hi"), levels).alias(out))


def spectrum_layer(frames: DataFrame, length: int, amplitude: tuple[float, float], roll: bool) -> DataFrame:
    """smooth_spectrogram(), and if roll each frame turned left by the running total of its power level (0 .. 2) and smoothed (51, 2)."""
    spectrum = smooth_spectrogram(frames, length, amplitude)
    if not roll:
        return spectrum
    from strandline.operators.windows import running_total

    turns = running_total(levels_of(reduce_rolling_average(power_series(frames)), 3, out="value"), out="turn")
    turned = spectrum.join(turns.select("series_id", "frame_index", "turn"), ["series_id", "frame_index"])
    turned = turned.withColumn("vec", rotate_left(F.col("vec"), F.col("turn").cast("long"))).drop("turn")
    return apply_matrix(turned, smoothing_matrix(length, min(51, length - 1 + length % 2), 2))


#: Frames of the normal kernel that smooths the noise of a blend.
NOISE_SIGMA = 50.0


def scaled_noise(frames: DataFrame, length: int, sigma: float, seed: int, lo: float, hi: float) -> DataFrame:
    """gaussian_noise() scaled to lo .. hi; its root mean square, least and most value come from one pass over the smoothed noise."""
    smooth = kept(circular_smooth(noise_like(frames, length, seed), sigma), "noise")
    energy = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    stats = smooth.groupBy("series_id").agg(F.sqrt(F.sum(energy) / F.sum(F.size("vec"))).alias("_rms"), F.min(F.array_min("vec")).alias("_lo"), F.max(F.array_max("vec")).alias("_hi"))
    rms = F.col("_rms")
    placed = lambda x: F.when(F.col("_hi") == F.col("_lo"), F.lit(lo)).otherwise(remap(x / rms, F.col("_lo") / rms, F.col("_hi") / rms, lo, hi))
    return join_small(smooth, stats, "series_id").withColumn("vec", F.transform("vec", placed)).drop("_rms", "_lo", "_hi")


def noise_blend(frames: DataFrame, length: int, alpha: float, amplitude: tuple[float, float], models: int, roll: bool = False, seed: int = 1234) -> DataFrame:
    """Per frame: noise (a_vec), spectrum (b_vec), their blend (combined), and the model that the frame's power picks.

    The noise is smoothed over NOISE_SIGMA frames, brought to unit root mean square and scaled to -4 .. 4.
    """
    frames = kept(frames, "frames")
    spectrum = spectrum_layer(frames, length, amplitude, roll).withColumnRenamed("vec", "b_vec")
    noise = scaled_noise(frames, length, NOISE_SIGMA, seed, -4.0, 4.0).withColumnRenamed("vec", "a_vec")
    index = levels_of(reduce_rolling_average(power_series(frames)), models)
    both = noise.join(spectrum, ["series_id", "frame_index"]).join(index, ["series_id", "frame_index"])
    return both.withColumn("combined", blend(F.col("a_vec"), F.col("b_vec"), alpha))


def projection_blend(latents: DataFrame, frames: DataFrame, length: int, alpha: float, amplitude: tuple[float, float], depth: int, blend_depth: int, factor: int, models: int, roll: bool = False, shared_signal: bool = False) -> DataFrame:
    """Latents repeated factor times and promoted to depth rows, the first blend_depth rows blended with the spectrum of frames.

    latents: (series_id, frame_index, vec), one row a frame. Each series has its own signal, or with shared_signal all have the one series
    of frames. Frames that either side lacks are left out.
    """
    on = ["frame_index"] if shared_signal else ["series_id", "frame_index"]
    spectrum = spectrum_layer(frames, length, amplitude, roll).select(*on, F.col("vec").alias("b_vec"))
    repeated = repeat_frames(latents, factor).withColumnRenamed("vec", "a_vec")
    index = levels_of(reduce_rolling_average(power_series(frames), 3, 3, 2), models).select(*on, "model_index")
    both = repeated.join(spectrum.join(index, on), on)
    return both.withColumn("mat", splice_depth(promote(F.col("a_vec"), depth), blend(F.col("a_vec"), F.col("b_vec"), alpha), blend_depth))


def blend_gate(projections: DataFrame, output_fps: float) -> DataFrame:
    """(projection_id, factor, output_frames) of complete projections; an error where output_fps isn't a multiple of the projection's rate."""
    ratio = F.lit(output_fps) / F.col("projection_fps")
    factor = F.when(ratio == F.floor(ratio), ratio.cast("int")).otherwise(F.raise_error(F.lit("output rate is not a multiple")).cast("int"))
    return projections.where("complete").select("projection_id", factor.alias("factor"), (factor * F.col("projection_frame_count")).alias("output_frames"))


def complexity_mask(frames: DataFrame, window: int, threshold: float) -> DataFrame:
    """Frames to skip: the rolling sum of the absolute slope of the compressed size is over threshold, or not full yet."""
    reduced = reduce_compressed(frames)
    slopes = derive_series(reduced.select("series_id", "frame_index", F.col("reduced").alias("value")))
    summed = rolling_sum(slopes.withColumn("value", F.abs("slope")), window)
    return summed.select("series_id", "frame_index", over_threshold(F.col("rolled"), threshold).alias("skip"))


def over_threshold(x, threshold: float):
    """x > threshold, a missing x counting as infinite."""
    return F.coalesce(x, F.lit(float("inf"))) > threshold


@lru_cache(maxsize=64)
def _sinc_weights(phases: bytes, cut: float, half_width: int, reach: int) -> np.ndarray:
    """places x (2 reach + 1): the normalised kernel for outputs that lie at phases between two inputs."""
    d = (np.arange(-reach, reach + 1)[None, :] - np.frombuffer(phases)[:, None]) * cut
    weights = np.sinc(d) * np.where(np.abs(d) <= half_width, 0.5 + 0.5 * np.cos(np.pi * d / half_width), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def _resampled(start: int, x: np.ndarray, first: int, last: int, ratio: float, cut: float, half_width: int, reach: int) -> np.ndarray:
    """Outputs first .. last - 1 of a signal of which x, from place start on, is what their kernels reach; beyond x it is zero."""
    centre = np.arange(first, last) / ratio
    floor = np.floor(centre).astype(np.int64)
    # outputs with the same place between two inputs share their weights; of a simple ratio there are few such places
    phases, which = np.unique(np.round(centre - floor, 9), return_inverse=True)
    weights = _sinc_weights(phases.tobytes(), cut, half_width, reach)
    before, behind = max(0, start - int(floor[0]) + reach), max(0, int(floor[-1]) + reach + 1 - start - len(x))
    padded = np.pad(x, (before, behind))
    at = floor - reach - start + before
    y = np.zeros(len(floor))
    for k in range(2 * reach + 1):
        y += weights[which, k] * padded[at + k]
    return y


def sinc_resample(samples: DataFrame, ratio: float, half_width: int = 16, block: int = 65_536) -> DataFrame:
    """Band-limited resampling by ratio with a windowed-sinc kernel; int(n ratio) samples come out. Sample numbers must be dense from 0.

    Overlap and save: samples are gathered to blocks, arrays of block samples, where they stand; a block sends its first and last samples,
    as far as a kernel reaches, to its neighbours, and makes the outputs whose centres it holds. A block is one row of every exchange, and
    one long signal spreads over all tasks.
    """
    cut = min(1.0, ratio)
    reach = int(np.ceil(half_width / cut))
    block = max(block, reach)
    kind = samples.schema["series_id"].dataType.simpleString()
    item = F.struct((F.col("sample_index") % block).cast("int").alias("pos"), F.col("value").cast("double").alias("value"))
    gathered = samples.groupBy("series_id", F.expr(f"sample_index div {block}").alias("blk")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = kept(gathered.select("series_id", "blk", F.transform("items", lambda i: i["value"]).alias("x")), "blocks")
    n = blocks.groupBy("series_id").agg(F.max(F.col("blk") * block + F.size("x")).alias("n"))
    part = lambda to, start, x: F.struct(to.cast("long").alias("blk"), start.cast("long").alias("start"), x.alias("x"))
    b, x = F.col("blk"), F.col("x")
    edge = F.least(F.size("x"), F.lit(reach))
    sent = F.array(part(b, b * block, x), part(b - 1, b * block, F.slice(x, F.lit(1), edge)), part(b + 1, b * block + F.size("x") - edge, F.slice(x, F.size("x") - edge + 1, edge)))
    fed = join_small(blocks, n, "series_id").select("series_id", "n", F.explode(sent).alias("p")).where(F.col("p.blk").between(0, F.expr(f"(n - 1) div {block}")))
    met = fed.groupBy("series_id", "n", F.col("p.blk").alias("blk")).agg(F.array_sort(F.collect_list(F.struct("p.start", "p.x"))).alias("parts"))
    whole = met.select("series_id", "n", "blk", F.col("parts")[0]["start"].alias("start"), F.flatten(F.transform("parts", lambda p: p["x"])).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, blk, start = (batch[c][i].as_py() for c in ("n", "blk", "start"))
                first, last = int(np.ceil(blk * block * ratio)), min(int(n * ratio), int(np.ceil((blk + 1) * block * ratio)))
                if first < last:
                    y = _resampled(start, np.asarray(batch["x"][i].values), first, last, ratio, cut, half_width, reach)
                    yield pa.RecordBatch.from_arrays([batch["series_id"].take(pa.array(np.full(len(y), i))), pa.array(np.arange(first, last)), pa.array(y)], ["series_id", "sample_index", "value"])

    return whole.mapInArrow(run, f"series_id {kind}, sample_index long, value double")


def scale_audio(samples: DataFrame, sample_rate: float, length: int, fps: float | None = None, count: int | None = None, pad: bool = False) -> DataFrame:
    """A signal resampled so that frames of length samples come fps a second, or count in all; exactly one of the two. One series.

    With pad zeros follow up to a whole number of frames.
    """
    if (fps is None) == (count is None):
        raise ValueError("give either a frame rate or a frame count")
    n = samples.agg((F.max("sample_index") + 1).alias("n")).first()["n"]
    # with a frame rate the new rate is a whole number of samples a second
    ratio = int(round(length * fps, 6)) / sample_rate if fps is not None else count * length / n
    scaled = sinc_resample(samples, ratio)
    total = int(n * ratio)
    if not pad or total % length == 0:
        return scaled
    missing = F.sequence(F.lit(total).cast("long"), F.lit(-(-total // length) * length - 1).cast("long"))
    rest = samples.select("series_id").limit(1).select("series_id", F.explode(missing).alias("sample_index"), F.lit(0.0).alias("value"))
    return scaled.unionByName(rest)

