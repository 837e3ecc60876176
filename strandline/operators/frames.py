"""Frames of a signal: cutting, padding, ranges, repetition, interpolation and alignment. All keyed on (series_id, frame_index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_signal(samples: DataFrame, length: int, pad: bool = True) -> DataFrame:
    """(series_id, frame_index, vec): consecutive frames of length samples.

    The last frame is filled with zeros, or, without pad, a signal that length doesn't divide is an error. Each frame is a group of its
    own, so one long series spreads over all tasks.
    """
    place = F.struct((F.col("sample_index") % length).cast("int").alias("pos"), "value")
    framed = samples.groupBy("series_id", F.expr(f"sample_index div {length}").alias("frame_index")).agg(F.array_sort(F.collect_list(place)).alias("items"))
    short = F.size("items") < length
    fill = F.map_from_entries("items")
    vec = F.when(~short, F.transform("items", lambda i: i["value"]))
    if pad:
        filled = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.coalesce(F.element_at(fill, p), F.lit(0.0)))
        return framed.select("series_id", "frame_index", F.coalesce(vec, filled).alias("vec"))
    return framed.select("series_id", "frame_index", F.when(short, F.raise_error(F.lit("signal length is not a multiple of the frame length")).cast("array<double>")).otherwise(vec).alias("vec"))


def explode_frames(frames: DataFrame, vec: str = "vec") -> DataFrame:
    """(position, frame, value) triples of every frame."""
    return frames.select("series_id", "frame_index", F.posexplode(vec).alias("pos", "value"))


def pad_vector(vec: Column, size: int) -> Column:
    """vec with zeros up to size; an error if it is longer."""
    return F.when(F.size(vec) > size, F.raise_error(F.lit("vector is longer than the padded size")).cast("array<double>")).otherwise(F.concat(vec, F.array_repeat(F.lit(0.0), size - F.size(vec))))


def whole_quotient(numerator: float, denominator: float) -> int:
    """numerator / denominator if that is whole, else an error."""
    if numerator % denominator:
        raise ValueError(f"{numerator} is not a multiple of {denominator}")
    return int(numerator // denominator)


def reduce_rate(frames: DataFrame, original_fps: float, new_fps: float | None) -> DataFrame:
    """Every n-th frame, renumbered; n = original_fps / new_fps must be whole. None keeps all."""
    n = 1 if new_fps is None else whole_quotient(original_fps, new_fps)
    return frames if n == 1 else frames.where(F.col("frame_index") % n == 0).withColumn("frame_index", F.expr(f"frame_index div {n}"))


def frame_range(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames start <= index < end."""
    return frames.where((F.col("frame_index") >= start) & (F.col("frame_index") < end))


def repeat_frames(frames: DataFrame, factor: int) -> DataFrame:
    """Each frame factor times in a row."""
    again = frames.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return again.withColumn("frame_index", F.col("frame_index") * factor + F.col("_copy")).drop("_copy")


def interpolate_frames(frames: DataFrame, target: int) -> DataFrame:
    """target frames on an even grid from the first to the last frame, linear between neighbours. Frame numbers must be dense from 0."""
    length = frames.groupBy("series_id").agg((F.max("frame_index") + 1).alias("n"))
    grid = length.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(target - 1))))
    at = F.col("out") * (F.col("n") - 1) / float(max(1, target - 1))
    grid = grid.select("series_id", F.col("out").cast("long").alias("out"), F.floor(at).alias("lo"), F.least(F.floor(at) + 1, F.col("n") - 1).alias("hi"), (at - F.floor(at)).alias("part"))
    low = frames.select("series_id", F.col("frame_index").alias("lo"), F.col("vec").alias("vec_lo"))
    high = frames.select("series_id", F.col("frame_index").alias("hi"), F.col("vec").alias("vec_hi"))
    both = grid.join(low, ["series_id", "lo"]).join(high, ["series_id", "hi"])
    return both.select("series_id", F.col("out").alias("frame_index"), F.zip_with("vec_lo", "vec_hi", lambda a, b: a * (1 - F.col("part")) + b * F.col("part")).alias("vec"))


def between_vectors(ends: DataFrame, count: int) -> DataFrame:
    """count frames from start_vec to end_vec, both included; one frame is the start."""
    steps = ends.withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    part = F.col("frame_index") / float(max(1, count - 1))
    return steps.select("series_id", "frame_index", F.zip_with("start_vec", "end_vec", lambda a, b: a + (b - a) * part).alias("vec"))


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames with the same number of both streams; the longer one is cut."""
    return left.join(right, ["series_id", "frame_index"])


def count_windows(frames: DataFrame, size: int, value: str = "value") -> DataFrame:
    """(series_id, window_id, items): consecutive windows of size frames, the last one shorter."""
    return frames.groupBy("series_id", F.expr(f"frame_index div {size}").alias("window_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", value))), lambda i: i[value]).alias("items"))


def context_windows(frames: DataFrame, width: int, value: str = "value") -> DataFrame:
    """Each frame with the zero-padded window around it: window_id and surrounding."""
    windows = count_windows(frames, width, value).select("series_id", "window_id", F.concat("items", F.array_repeat(F.lit(0).cast("double"), width - F.size("items"))).alias("surrounding"))
    return frames.withColumn("window_id", F.expr(f"frame_index div {width}")).join(windows, ["series_id", "window_id"])
