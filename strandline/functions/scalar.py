"""Column functions on frames, names and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPTURE = "MM-dd-yyyy_HH-mm-ss-SSSSSS"


def capture_time(name: Column) -> Column:
    """Time at the end of an image name, `..._MM-dd-yyyy_HH-mm-ss-SSSSSS`, with or without the extension."""
    stem = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    return F.to_timestamp(F.substring_index(stem, "_", -2), CAPTURE)


def image_name(dataset: Column, when: Column) -> Column:
    return F.concat(F.concat_ws("_", dataset, F.date_format(when, CAPTURE)), F.lit(".jpeg"))


def item_name(group: Column, index: Column, step: Column | None = None) -> Column:
    """`group_index`, or `group_index_step_n`."""
    base = F.concat_ws("_", group, index.cast("string"))
    return base if step is None else F.concat(base, F.lit("_step_"), step.cast("string"))


def trailing_number(name: Column) -> Column:
    """The number behind the last underscore, by which names sort naturally."""
    return F.regexp_extract(name, r"_(\d+)$", 1).cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def remap(x: Column, lo: Column, hi: Column, to_lo: float, to_hi: float, strict: bool = False) -> Column:
    """Linear map of [lo, hi] to [to_lo, to_hi]; outside it null, or an error if strict."""
    mapped = (x - lo) / (hi - lo) * (to_hi - to_lo) + to_lo
    outside = F.raise_error(F.lit("value outside the input range")).cast("double") if strict else F.lit(None).cast("double")
    return F.when((x >= lo) & (x <= hi), mapped).otherwise(outside)


def quantise(x: Column, lo: Column, hi: Column, levels: int) -> Column:
    """x from [lo, hi] to 0 .. levels - 1, halves to even; 0 where lo = hi."""
    return F.when(hi == lo, F.lit(0)).otherwise(F.rint((x - lo) / (hi - lo) * (levels - 1)).cast("int"))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """Element-wise a (1 - alpha) + b alpha."""
    return F.zip_with(a, b, lambda x, y: x * (1 - alpha) + y * alpha)


def decibel(x: Column, top: Column, floor: float = 1e-10) -> Column:
    """20 log10(x / top), not below that of floor."""
    return F.log10(F.greatest(x / top, F.lit(floor))) * 20


def nan_to_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def rms(vec: Column) -> Column:
    """Root of the mean square of a frame."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(vec))


def promote(vec: Column, depth: int) -> Column:
    """A matrix of depth equal rows."""
    return F.array_repeat(vec, depth)


def demote(mat: Column, row: int = 0) -> Column:
    return F.element_at(mat, row + 1)


def rotate_left(vec: Column, by: Column) -> Column:
    """vec turned left by a number of places, modulo its size."""
    r = F.pmod(by, F.size(vec)).cast("int")
    return F.concat(F.slice(vec, r + 1, F.size(vec) - r), F.slice(vec, F.lit(1), r))


def splice_depth(mat: Column, row: Column, depth: int) -> Column:
    """The first depth rows of mat replaced by row."""
    return F.concat(F.array_repeat(row, depth), F.slice(mat, F.lit(depth + 1), F.greatest(F.size(mat) - depth, F.lit(0))))


def centre(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / F.lit(2.0), y + h / F.lit(2.0)


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("left"), y.alias("top"), (x + w).alias("right"), (y + h).alias("bottom"))


def tight_box(xs: Column, ys: Column) -> Column:
    """The least integer box over points: x, y, w, h with both ends included."""
    lo_x, lo_y = F.array_min(xs), F.array_min(ys)
    return F.struct(lo_x.alias("x"), lo_y.alias("y"), (F.array_max(xs) - lo_x + 1).alias("w"), (F.array_max(ys) - lo_y + 1).alias("h"))


def portable_hash(key: Column, seed: int) -> Column:
    """An integer hash below 2^31 from modular steps that any SQL engine repeats exactly."""
    step = (key * 48271 + seed * 69621 + 12345) % 2147483647
    step = (step * step + 97) % 2147483647
    return (step * 40692 + 7) % 2147483647


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def whole_quotient(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator of whole numbers, an error where a remainder is left."""
    return F.when(numerator % denominator == 0, ((numerator - numerator % denominator) / denominator).cast("long")).otherwise(F.raise_error(F.lit("a remainder is left")).cast("long"))


def with_absolute(value: str, out: str = "absolute") -> list[Column]:
    """A value as a layer and its absolute value beside it."""
    return [F.col(value), F.abs(value).alias(out)]


def flatten_parts(parts: Column) -> Column:
    """A list of arrays laid end to end, and the size of each, from which they can be cut again."""
    return F.struct(F.flatten(parts).alias("flat"), F.transform(parts, lambda p: F.size(p)).alias("sizes"))


def scaled_rate(rate: int, length: int, samples: Column, fps: float | None = None, count: int | None = None) -> Column:
    """The sample rate at which a signal of so many samples gives frames of length samples at fps a second (a whole number), or count frames in all."""
    if (fps is None) == (count is None):
        raise ValueError("give either a frame rate or a frame count")
    if fps is not None:
        return F.round(F.lit(rate) * (F.lit(length) * (F.lit(fps) * (samples / F.lit(float(rate))))) / samples, 6).cast("long")
    return F.lit(rate) * F.lit(count) / (samples / F.lit(float(length)))


def output_label(prefix: str, path: Column, index: Column) -> Column:
    """`prefix_name_index`, name being the last part of path."""
    return F.concat_ws("_", F.lit(prefix), base_name(path), index.cast("string"))
