"""Aggregates over frames and series."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import remap, rms
from strandline.operators.sides import join_small


def frame_rms(frames: DataFrame, out: str = "rms") -> DataFrame:
    """Root mean square of each frame."""
    return frames.withColumn(out, rms(F.col("vec"))).drop("vec")


def hop_rms(samples: DataFrame, length: int, hop: int) -> DataFrame:
    """Root mean square of windows of length samples every hop samples; only full windows."""
    ends = samples.groupBy("series_id").agg((F.max("sample_index") + 1).alias("_n"))
    i = F.col("sample_index")
    first, last = F.greatest(F.ceil((i - length + 1) / hop), F.lit(0)), F.least(F.floor(i / hop), F.floor((F.col("_n") - length) / hop))
    fed = join_small(samples, ends, "series_id").withColumn("_lo", first).withColumn("_hi", last).where("_lo <= _hi")
    fed = fed.select("series_id", F.explode(F.sequence("_lo", "_hi")).alias("frame_index"), "value")
    return fed.groupBy("series_id", "frame_index").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def series_range(frames: DataFrame, vec: str = "vec") -> DataFrame:
    """(series_id, lo, hi) over all positions of all frames."""
    return frames.groupBy("series_id").agg(F.min(F.array_min(vec)).alias("lo"), F.max(F.array_max(vec)).alias("hi"))


def with_range(frames: DataFrame, value: str = "value") -> DataFrame:
    """Scalar frames with lo and hi, the least and most value of their series."""
    return join_small(frames, frames.groupBy("series_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "series_id")


def minmax_scale(frames: DataFrame, lo: float, hi: float, vec: str = "vec") -> DataFrame:
    """All samples of a series linearly to lo .. hi; a constant series becomes lo. Two passes."""
    scaled = F.transform(vec, lambda x: F.when(F.col("hi") == F.col("lo"), F.lit(lo)).otherwise(remap(x, F.col("lo"), F.col("hi"), lo, hi)))
    return join_small(frames, series_range(frames, vec), "series_id").withColumn(vec, scaled).drop("lo", "hi")


def context_ranges(frames: DataFrame, width: int, value: str = "value", margin: float = 5.0, empty: tuple[float, float] = (-5.0, 5.0)) -> DataFrame:
    """Per window of width frames: least - margin, most + margin, mean, and mean +- 2 population deviations; zeros and nulls don't count."""
    x = F.nullif(F.col(value), F.lit(0.0))
    out = frames.groupBy("series_id", F.expr(f"frame_index div {width}").alias("window_id")).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("_sd"))
    return out.select("series_id", "window_id", F.coalesce(F.col("_lo") - margin, F.lit(empty[0])).alias("lo"), F.coalesce(F.col("_hi") + margin, F.lit(empty[1])).alias("hi"), "mean", (F.col("mean") - 2 * F.col("_sd")).alias("band_lo"), (F.col("mean") + 2 * F.col("_sd")).alias("band_hi"))


def unit_rms(frames: DataFrame, vec: str = "vec") -> DataFrame:
    """Each series divided by the root mean square of all its samples."""
    energy = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)
    norms = frames.groupBy("series_id").agg(F.sqrt(F.sum(energy) / F.sum(F.size(vec))).alias("_norm"))
    return join_small(frames, norms, "series_id").withColumn(vec, F.transform(vec, lambda x: x / F.col("_norm"))).drop("_norm")


def require_one(df: DataFrame, column: str) -> DataFrame:
    """One row (n, values): an error when read if column has more than one distinct value."""
    seen = df.groupBy(column).count().orderBy(column).limit(10).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col(column).cast("string"))).alias("values"))
    return seen.select("n", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("more than one value: "), F.array_join("values", ", "))).cast("string")).otherwise(F.array_join("values", ", ")).alias("values"))


def compressed_size(frames: DataFrame, out: str = "value") -> DataFrame:
    """Bytes of each frame (single precision) after zlib at its default level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [float(len(zlib.compress(np.asarray(v.values, np.float32).tobytes()))) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes)], ["series_id", "frame_index", out])

    kind = frames.schema["series_id"].dataType.simpleString()
    return frames.select("series_id", "frame_index", "vec").mapInArrow(run, f"series_id {kind}, frame_index long, {out} double")


def tier_counts(selected: DataFrame) -> DataFrame:
    """Rows taken from each tier, and their total in the row with a null tier."""
    return selected.rollup("tier").agg(F.count("*").alias("rows_taken"))


def frame_accounts(projections: DataFrame, frames: DataFrame, output_fps: float) -> DataFrame:
    """Expected and actual frames of each projection, and frames after repetition to output_fps."""
    actual = frames.groupBy("projection_id").agg(F.count("*").alias("actual_frames"))
    expected = (F.col("original_frame_count") * F.col("projection_fps") / F.col("original_fps")).cast("long")
    return projections.join(actual, "projection_id", "left").select("projection_id", expected.alias("expected_frames"), F.coalesce("actual_frames", F.lit(0)).alias("actual_frames"), (F.coalesce("actual_frames", F.lit(0)) * (output_fps / F.col("projection_fps")).cast("long")).alias("output_frames"))
