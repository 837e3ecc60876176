"""Rolling and run-length operators over frame order, keyed on (series_id, frame_index).

Each takes a block size: a long series is cut into blocks of so many frames, every frame also goes to the neighbouring blocks whose windows
reach it, and windows run per block. With None windows run per series, for series that are known to be short.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.placement import placed
from strandline.operators.sides import join_small, kept

#: Frames of a series that one window task takes.
BLOCK = 16_384


def with_halo(frames: DataFrame, block: int, before: int, after: int) -> DataFrame:
    """Frames with _block, each also in the blocks within before / after frames of it; _own marks the one that owns it."""
    at = F.col("frame_index")
    first, last = F.greatest(F.floor((at - after) / block), F.lit(0)), F.floor((at + before) / block)
    spread = frames.withColumn("_block", F.explode(F.sequence(first, last)))
    return spread.withColumn("_own", F.col("_block") == F.floor(at / block))


def rolling(frames: DataFrame, before: int, after: int, columns, block: int | None = BLOCK) -> DataFrame:
    """frames with columns(window) added, window being before .. after rows around each frame; frame numbers must be dense."""
    if block is None:
        over = Window.partitionBy("series_id").orderBy("frame_index").rowsBetween(-before, after)
        return frames.withColumns(columns(over))
    over = Window.partitionBy("series_id", "_block").orderBy("frame_index").rowsBetween(-before, after)
    return with_halo(frames, block, before, after).withColumns(columns(over)).where("_own").drop("_block", "_own")


def full_window(agg, value: str, over, size: int) -> Column:
    """agg(value) where the window holds size values that are not null, else null."""
    return F.when(F.count(value).over(over) == size, agg(value).over(over))


def rolling_mean(frames: DataFrame, size: int = 3, value: str = "value", out: str = "rolled", block: int | None = BLOCK) -> DataFrame:
    """Trailing mean; where the window isn't full, the mean of the series."""
    means = frames.groupBy("series_id").agg(F.avg(value).alias("_mean"))
    done = rolling(frames, size - 1, 0, lambda w: {out: full_window(F.avg, value, w, size)}, block)
    return join_small(done, means, "series_id").withColumn(out, F.coalesce(out, "_mean")).drop("_mean")


def rolling_sum(frames: DataFrame, size: int, value: str = "value", out: str = "rolled", block: int | None = BLOCK) -> DataFrame:
    """Trailing sum, null until the window is full."""
    return rolling(frames, size - 1, 0, lambda w: {out: full_window(F.sum, value, w, size)}, block)


def rolling_max(frames: DataFrame, share: int = 80, value: str = "value", out: str = "rolled", size: int | None = None, block: int | None = BLOCK) -> DataFrame:
    """Centred maximum over int(n / share) frames of an n-frame series (or size frames); size 0 is the value itself.

    With size the windows are row frames, in blocks. Without it the size differs by series: frames are cut into blocks of so many frames
    (or of the window, if that is shorter), and a window is the rest of the block where it starts, the whole blocks between, and the start
    of the block where it ends. Every frame sends its block's maxima up to it and from it to the two windows that they belong to; maxima of
    runs of whole blocks come from a table of the blocks, one row each, with the maxima of 1, 2, 4 ... blocks from each on. Frame numbers
    must be dense from 0.
    """
    if size is not None:
        if size == 0:
            return frames.withColumn(out, F.col(value))
        return rolling(frames, size // 2, size - size // 2 - 1, lambda w: {out: F.max(value).over(w)}, block)
    sizes = frames.groupBy("series_id").agg((F.max("frame_index") + 1).cast("long").alias("_n"))
    sizes = kept(sizes.withColumn("_s", F.greatest(F.expr(f"_n div {share}"), F.lit(1))).withColumn("_b", F.least("_s", F.lit(block or BLOCK))), "sizes")
    at, before = F.col("frame_index"), F.expr("_s div 2")
    behind = F.col("_s") - before - 1
    placed = join_small(frames.select("series_id", "frame_index", value), sizes, "series_id").withColumn("_block", F.expr("frame_index div _b"))
    over = Window.partitionBy("series_id", "_block")
    upto = F.max(value).over(over.orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0))
    onward = F.max(value).over(over.orderBy(F.desc("frame_index")).rowsBetween(Window.unboundedPreceding, 0))
    sent = lambda to, v: F.struct(to.cast("long").alias("to"), F.col(v).alias("v"))
    maxima = placed.withColumns({"_upto": upto, "_onward": onward})
    both = F.array(sent(at + before, "_onward"), sent(at - behind, "_upto"))
    widest = sizes.agg(F.max(F.ceil(F.col("_s") / F.col("_b")))).first()[0] or 1
    if widest == 1:
        # no window is longer than a block, so those cut off at the end need the last frame's maximum alone: at most half a block of them
        first, last = F.col("_n") - behind, F.least(F.col("_n") - 1, F.expr("(_n - 1) div _s * _s") + before)
        ends = F.when((at == F.col("_n") - 1) & (first <= last), F.transform(F.sequence(first, last), lambda t: sent(t, "_upto")))
        both = F.concat(both, F.coalesce(ends, F.array().cast(f"array<struct<to:bigint,v:{frames.schema[value].dataType.simpleString()}>>")))
    fed = maxima.select("series_id", "_n", F.explode(both).alias("m"))
    edges = fed.where("m.to >= 0 and m.to < _n").groupBy("series_id", F.col("m.to").alias("frame_index")).agg(F.max("m.v").alias("_edge"))
    if widest == 1:
        return frames.drop(out).join(edges.withColumnRenamed("_edge", out), ["series_id", "frame_index"])

    steps = int(widest + 1).bit_length()
    order = Window.partitionBy("series_id").orderBy("_block")
    table = placed.groupBy("series_id", "_block").agg(F.max(value).alias("_m0"))
    for k in range(steps):
        table = table.withColumn(f"_m{k + 1}", F.greatest(f"_m{k}", F.lead(f"_m{k}", 1 << k).over(order)))
    runs = table.select("series_id", "_block", F.array(*[f"_m{k}" for k in range(steps + 1)]).alias("_runs"))

    lo, hi = at - before, at + behind
    low = F.when(lo < 0, F.lit(0)).otherwise(F.floor(lo / F.col("_b")) + 1)
    high = F.when(hi >= F.col("_n"), F.expr("(_n - 1) div _b")).otherwise(F.floor(hi / F.col("_b")) - 1)
    spans = join_small(frames, sizes, "series_id").withColumns({"_low": low.cast("long"), "_high": high.cast("long")})
    many = F.col("_high") - F.col("_low") + 1
    power = F.when(many > 0, F.floor(F.log2(many.cast("double"))).cast("int"))
    spans = spans.withColumn("_k", power).withColumn("_second", F.when(many > 0, F.col("_high") - F.pow(F.lit(2.0), F.col("_k")).cast("long") + 1))
    side = lambda name: runs.select("series_id", F.col("_block").alias(name), F.col("_runs").alias(f"_runs{name}"))
    joined = join_small(join_small(spans, side("_low"), ["series_id", "_low"], "left"), side("_second"), ["series_id", "_second"], "left")
    inside = F.greatest(F.element_at("_runs_low", F.col("_k") + 1), F.element_at("_runs_second", F.col("_k") + 1))
    found = joined.withColumn("_inside", F.when(F.col("_k").isNotNull(), inside)).join(edges, ["series_id", "frame_index"])
    return found.withColumn(out, F.greatest("_inside", "_edge")).select(*[c for c in frames.columns if c != out], out)


def running_total(frames: DataFrame, value: str = "value", out: str = "total", block: int = 4096) -> DataFrame:
    """Sum from frame 0 on, as sums inside blocks plus the totals of the earlier blocks of the series."""
    blocked = frames.withColumn("_block", F.expr(f"frame_index div {block}"))
    sums = blocked.groupBy("series_id", "_block").agg(F.sum(value).alias("_sum"))
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(Window.partitionBy("series_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_sum")
    inside = F.sum(value).over(Window.partitionBy("series_id", "_block").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0))
    return blocked.withColumn(out, inside).join(ahead, ["series_id", "_block"]).withColumn(out, F.col(out) + F.col("_ahead")).drop("_block", "_ahead")


def run_lengths(frames: DataFrame, flag: str = "flag", out: str = "run_length", block: int | None = BLOCK) -> DataFrame:
    """Frames with the length of the run of equal flags that each lies in.

    With block, runs are counted inside blocks of so many frame numbers and joined where the flag stays the same from one block to the next.
    """
    keys = ["series_id"] if block is None else ["series_id", "_block"]
    blocked = frames if block is None else frames.withColumn("_block", F.floor(F.col("frame_index") / block))
    order = Window.partitionBy(*keys).orderBy("frame_index")
    changed = F.coalesce((F.col(flag) != F.lag(flag).over(order)).cast("int"), F.lit(0))
    runs = blocked.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(order))
    if block is None:
        return runs.withColumn(out, F.count("*").over(Window.partitionBy("series_id", "_run"))).drop("_changed", "_run")
    by_block = Window.partitionBy("series_id").orderBy("_block")
    ends = runs.groupBy(*keys).agg(F.min_by(flag, "frame_index").alias("_first"), F.max_by(flag, "frame_index").alias("_last"), F.max("_run").alias("_runs"))
    step = F.coalesce((F.col("_first") != F.lag("_last").over(by_block)).cast("long"), F.lit(0)) + F.coalesce(F.lag("_runs").over(by_block), F.lit(0))
    ahead = ends.withColumn("_step", step).withColumn("_ahead", F.sum("_step").over(by_block)).select(*keys, "_ahead")
    parts = runs.groupBy(*keys, "_run").agg(F.count("*").alias("_n")).join(ahead, keys).withColumn("_whole", F.col("_run") + F.col("_ahead"))
    lengths = parts.withColumn(out, F.sum("_n").over(Window.partitionBy("series_id", "_whole"))).select(*keys, "_run", out)
    return runs.join(lengths, [*keys, "_run"]).drop("_changed", "_run", "_block")


def keep_long_tracks(frames: DataFrame, least: int, flag: str = "flag", out: str = "kept", block: int | None = BLOCK) -> DataFrame:
    """out is true where flag is and its run is least frames or longer."""
    return run_lengths(frames, flag, "_length", block).withColumn(out, F.col(flag) & (F.col("_length") >= least)).drop("_length")


def near_matches(rows: DataFrame, by: str, order: list[str], match: str = "has_face", reach: int = 2, strict_window: bool = False, out: str = "near", block: int = BLOCK) -> DataFrame:
    """All rows with out: does a match lie within reach rows, in order inside each by.

    strict_window: a match counts only if reach rows stand on both sides of it. Rows get their places in ranges (placed()), and windows run
    on blocks of so many places that also hold the reach last and first rows of their neighbours, so a directory of any size uses all tasks.
    """
    at = placed(rows, order, [by], "frame_index", first=0).withColumn("series_id", F.col(by))
    counts = F.col(match)
    if strict_window:
        sizes = at.groupBy(F.col(by).alias("_dir")).agg(F.count("*").alias("_rows"))
        at = at.join(sizes, F.col(by).eqNullSafe(F.col("_dir"))).drop("_dir")
        counts = counts & (F.col("frame_index") >= reach) & (F.col("frame_index") < F.col("_rows") - reach)
    marked = at.withColumn("_counts", counts.cast("int"))
    seen = rolling(marked, reach, reach, lambda w: {out: F.coalesce(F.max("_counts").over(w), F.lit(0)) == 1}, block)
    return seen.select(*[c for c in rows.columns if c != out], out)


def around_matches(rows: DataFrame, by: str, order: list[str], match: str = "has_face", reach: int = 2, strict_window: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows that are no match but lie within reach rows of one, in order inside each by; see near_matches()."""
    return near_matches(rows, by, order, match, reach, strict_window, "_near", block).where(F.col("_near") & ~F.coalesce(F.col(match), F.lit(False))).drop("_near")


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    """(offset, weight) of a normal kernel cut at four sigma, weights summing to 1; sigma 0 is the identity."""
    radius = int(4 * sigma + 0.5)
    raw = [(k, math.exp(-k * k / (2 * sigma * sigma)) if sigma else 1.0) for k in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def circular_smooth(frames: DataFrame, sigma: float, vec: str = "vec", block: int = 2048) -> DataFrame:
    """Normal smoothing over frames, wrapped at the ends; frame numbers must be dense from 0.

    Every frame stands at its number plus any multiple of the series' length; each place goes to the blocks whose kernels reach it, and a
    block is a few scaled additions of whole columns.
    """
    from strandline.operators.linear import _column_matrix, _with_column

    weights = [w for _, w in gaussian_kernel(sigma)]
    radius = len(weights) // 2
    n = frames.groupBy("series_id").agg((F.max("frame_index") + 1).cast("long").alias("_n"))
    at = F.col("frame_index")
    turns = F.sequence(F.ceil((-radius - at) / F.col("_n")), F.floor((F.col("_n") - 1 + radius - at) / F.col("_n")))
    placed = join_small(frames.select("series_id", "frame_index", vec), n, "series_id").withColumn("_turn", F.explode(turns)).withColumn("_at", at + F.col("_turn") * F.col("_n"))
    first, last = F.greatest(F.floor((F.col("_at") - radius) / block), F.lit(0)), F.least(F.floor((F.col("_at") + radius) / block), F.floor((F.col("_n") - 1) / block))
    spread = placed.withColumn("_block", F.explode(F.sequence(first, last)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        place, own = np.asarray(table["_at"].combine_chunks()), np.asarray(table["frame_index"].combine_chunks())
        mine = np.flatnonzero((place == own) & (own // block == key[1].as_py()))
        x = _column_matrix(table[vec])
        start = place[mine] - radius - int(place[0])
        y = np.zeros((len(mine), x.shape[1]))
        for k, w in enumerate(weights):
            y += w * x[start + k]
        return _with_column(table.take(pa.array(mine)), vec, y, True).select(["series_id", "frame_index", vec])

    kind = {f.name: f.dataType.simpleString() for f in frames.schema}
    return spread.groupBy("series_id", "_block").applyInArrow(run, f"series_id {kind['series_id']}, frame_index {kind['frame_index']}, {vec} array<double>")
