"""Generated frames: sweeps, waves and seeded noise. Values depend on keys alone, never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalar import portable_hash
from strandline.operators.aggregates import unit_rms
from strandline.operators.windows import circular_smooth


def line_sweep(spark: SparkSession, start: float, stop: float, length: int, count: int) -> DataFrame:
    """count frames of length samples; sample s of the whole is place s div count of an even grid from start to stop."""
    step = (stop - start) / max(1, length - 1)
    return spark.range(count).select(F.lit(0).alias("series_id"), F.col("id").alias("frame_index"), F.expr(f"transform(sequence(0, {length - 1}), p -> {start}D + ((id * {length} + p) div {count}) * {step!r}D)").alias("vec"))


def square_wave(length: int, rise: Column, fall: Column, offset: Column, amplitude: Column) -> Column:
    """amplitude from rise to fall, both included, and offset elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.when((p >= rise) & (p <= fall), amplitude).otherwise(offset).cast("double"))


def horizontal_sweep(spark: SparkSession, length: int, width: int, offset: int = 0, amplitude: int = 10) -> DataFrame:
    """One frame for each integer from offset to amplitude (not included), which is where its pulse of width rises."""
    at = F.col("id") + offset
    return spark.range(max(0, amplitude - offset)).select(F.lit(0).alias("series_id"), F.col("id").alias("frame_index"), square_wave(length, at, at + width, F.lit(offset), F.lit(amplitude)).alias("vec"))


def vertical_sweep(spark: SparkSession, length: int, rise: int, width: int, offset: float = -10.0, amplitude: float = 10.0, step: float = 1.0) -> DataFrame:
    """One frame for each amplitude from offset to amplitude (not included) by step."""
    n = max(0, math.ceil((amplitude - offset) / step))
    level = F.col("id") * step + offset
    return spark.range(n).select(F.lit(0).alias("series_id"), F.col("id").alias("frame_index"), square_wave(length, F.lit(rise), F.lit(rise + width), F.lit(offset), level).alias("vec"))


def add_where_set(a: Column, b: Column) -> Column:
    """a + b where a isn't 0, else 0."""
    return F.zip_with(a, b, lambda x, y: F.when(x != 0, x + y).otherwise(F.lit(0.0)))


def sine(length: int, amplitude: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.sin(i.cast("double")) * amplitude)


def hash_normal(key: Column, seed: int) -> Column:
    """A standard normal number that key and seed decide."""
    u = (portable_hash(key, seed) + 1) / 2147483648.0
    v = portable_hash(key, seed + 1) / 2147483648.0
    return F.sqrt(F.log(u) * -2) * F.cos(v * (2 * math.pi))


def noise_like(frames: DataFrame, length: int, seed: int = 1234, vec: str = "vec") -> DataFrame:
    """A frame of normal noise for each frame of a table, by (frame_index, position)."""
    made = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: hash_normal(F.col("frame_index") * length + p, seed))
    return frames.select("series_id", "frame_index", made.alias(vec))


def gaussian_noise(frames: DataFrame, length: int, sigma: float = 20.0, seed: int = 1234, vec: str = "vec") -> DataFrame:
    """noise_like() smoothed over frames by a normal kernel of sigma frames, wrapped at the ends, each series brought to unit root mean square."""
    return unit_rms(circular_smooth(noise_like(frames, length, seed, vec), sigma, vec), vec)
