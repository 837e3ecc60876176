"""Joins between frames, boxes, models, files and histories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import centre, dot, l1_distance
from strandline.operators.placement import placed
from strandline.operators.sides import MOST_ROWS, join_small, kept


def nearest_boxes(boxes: DataFrame) -> DataFrame:
    """Per frame: the nearest pair of box centres of sides a and b, the first in (a, b) order at ties; nulls where a side is empty."""
    cx, cy = centre(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    placed = boxes.select("frame_index", "side", "box_no", cx.alias("cx"), cy.alias("cy"))
    a = placed.where("side = 'a'").select("frame_index", F.col("box_no").alias("a_no"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = placed.where("side = 'b'").select("frame_index", F.col("box_no").alias("b_no"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    apart = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    best = a.join(b, "frame_index").groupBy("frame_index").agg(F.min(F.struct(apart.alias("distance"), "a_no", "b_no")).alias("m"))
    found = best.select("frame_index", "m.distance", "m.a_no", "m.b_no")
    return boxes.select("frame_index").distinct().join(found, "frame_index", "left")


def in_set(rows: DataFrame, keys: DataFrame, on: str | list[str], inside: bool = True) -> DataFrame:
    """Rows whose key is (or isn't) among keys; copies stay."""
    return rows.join(keys, on, "left_semi" if inside else "left_anti")


def copy_plan(files: DataFrame, existing: DataFrame, order: list[str], skip_name: str = "submit_config.pkl") -> DataFrame:
    """Destination `{count}_{parent}_{name}` of each file, without those that exist with the same hash; skipped files count as well.

    The running number is that of the parent directory, counted over ranges of it (placed()).
    """
    counted = placed(files, order, ["parent"], "_count", first=0)
    named = counted.withColumn("destination", F.concat_ws("_", F.col("_count").cast("string"), "parent", "name")).drop("_count")
    return named.where(F.col("name") != skip_name).join(existing, ["destination", "md5"], "left_anti")


def files_by_models(files: DataFrame, models: DataFrame, parts: int = 8, most: int = MOST_ROWS) -> DataFrame:
    """Every file with every model, and the name of the result.

    The model list is counted: up to most models it goes to all tasks and files stay where they are; above, it is joined in parts, so that
    neither side is one task's.
    """
    named = F.concat(F.lit("network_"), F.col("model_name"), F.lit("_"), F.col("file_hash")).alias("output_name")
    listed = kept(models.select("model_index", "model_name").distinct(), "models")
    if listed.count() <= most:
        return files.crossJoin(F.broadcast(listed)).select(*files.columns, "model_index", named)
    cut = listed.withColumn("_part", F.pmod(F.xxhash64("model_index", "model_name"), F.lit(parts)))
    each = files.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return each.join(cut, "_part").select(*files.columns, "model_index", named)


def hash_mismatches(given: DataFrame, projections: DataFrame, waived: bool = False) -> DataFrame:
    """Projections whose stored model hash isn't the given one; none if waived."""
    both = projections.join(given, "projection_id", "left")
    return both.where(~F.col("network_md5_hash").eqNullSafe(F.col("given_md5")) & (not waived)).select("projection_id", "network_md5_hash", "given_md5")


def score_by_model(frames: DataFrame, models: DataFrame) -> DataFrame:
    """(series_id, frame_index, model_index, out_dim, score): each frame's vector under every output row of its model."""
    return frames.join(models, "model_index").select("series_id", "frame_index", "model_index", "out_dim", dot(F.col("vec"), F.col("weights")).alias("score"))


def score_in_chunks(frames: DataFrame, load: Callable[[int], Callable[[np.ndarray], np.ndarray]], salts: int = 8) -> DataFrame:
    """Any scorer: load(model_index) gives a function from (n, L) to (n, outputs); frames come sorted by model, so a model loads once a task.

    A popular model is spread over salts tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scorer = None, None
        for batch in batches:
            model = np.asarray(batch["model_index"])
            for m in np.unique(model):
                if m != now:
                    now, scorer = m, load(int(m))
                part = batch.filter(pa.array(model == m))
                col = part["vec"]
                y = scorer(np.asarray(col.flatten(), np.float64).reshape(len(col), -1))
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(np.ascontiguousarray(y).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part["series_id"], part["frame_index"], part["model_index"], made], ["series_id", "frame_index", "model_index", "scores"])

    salted = frames.repartition("model_index", F.pmod(F.xxhash64("frame_index"), F.lit(salts))).sortWithinPartitions("model_index", "frame_index")
    s = frames.schema
    return salted.select("series_id", "frame_index", "model_index", "vec").mapInArrow(run, f"series_id {s['series_id'].dataType.simpleString()}, frame_index {s['frame_index'].dataType.simpleString()}, model_index {s['model_index'].dataType.simpleString()}, scores array<double>")


def with_final(steps: DataFrame, frames: DataFrame, first: int | None = None) -> DataFrame:
    """Each step with its frame's final latent; only the first frames if asked for."""
    if first is not None:
        steps = steps.where(F.col("frame_index") < first)
    return steps.join(frames.withColumnRenamed("latent", "final"), ["projection_id", "frame_index"])


def convergence(steps: DataFrame, frames: DataFrame) -> DataFrame:
    """L1 distance of every step to the final latent."""
    return with_final(steps, frames).select("projection_id", "frame_index", "step", l1_distance(F.col("final"), F.col("latent")).alias("line"))


def settling_points(lines: DataFrame, share: float = 0.2) -> DataFrame:
    """Per projection: mean and population deviation (truncated) of the first step at or under share of the line's range, and less one and two deviations.

    A frame without such a step counts for nothing; without any the results are null.
    """
    w = Window.partitionBy("projection_id", "frame_index")
    limit = share * (F.max("line").over(w) - F.min("line").over(w))
    points = lines.withColumn("_limit", limit).groupBy("projection_id", "frame_index").agg(F.min(F.when(F.col("line") <= F.col("_limit"), F.col("step"))).alias("point"))
    stats = points.groupBy("projection_id").agg(F.count("point").alias("n_points"), F.avg("point").alias("m"), F.stddev_pop("point").alias("s"))
    return stats.select("projection_id", "n_points", F.expr("cast(m as int)").alias("mean_step"), F.expr("cast(s as int)").alias("std_step"), F.expr("cast(m - s as int)").alias("less_one"), F.expr("cast(m - 2 * s as int)").alias("less_two"))


def history_at_step(steps: DataFrame, step: int) -> DataFrame:
    """Each frame's latent at step, up to the first frame of the projection whose history is too short; later frames are left out."""
    last = steps.groupBy("projection_id", "frame_index").agg(F.max("step").alias("_last"))
    stop = last.groupBy("projection_id").agg(F.min(F.when(F.col("_last") < step, F.col("frame_index"))).alias("_stop"))
    return steps.where(F.col("step") == step).join(stop, "projection_id").where(F.col("_stop").isNull() | (F.col("frame_index") < F.col("_stop"))).drop("_stop")


def check_projections(projections: DataFrame, frames: DataFrame, tolerance: int = 2) -> DataFrame:
    """Per projection: are all depth rows of each matrix equal, is the file complete, and does the frame count fit; usable is all three."""
    rows = frames.groupBy("projection_id").agg(F.bool_and(F.forall("mat", lambda r: r == F.col("mat")[0])).alias("rows_equal"), F.count("*").alias("n"))
    both = projections.join(rows, "projection_id", "left")
    fits = F.abs(F.coalesce("n", F.lit(0)) - F.col("projection_frame_count")) <= tolerance
    return both.select("projection_id", F.coalesce("rows_equal", F.lit(True)).alias("rows_equal"), "complete", fits.alias("count_fits"), (F.coalesce("rows_equal", F.lit(True)) & F.col("complete") & fits).alias("usable"))


def signature(frames: DataFrame, words: int = 4) -> DataFrame:
    """(…, s0 … s3): one bit for each of 16 x words values, set where it is over the frame's median, in 16-bit integers."""
    ordered = F.array_sort("vec")
    mid = (F.element_at(ordered, 8 * words) + F.element_at(ordered, 8 * words + 1)) / 2
    bits = frames.withColumn("_median", mid)
    word = lambda k: F.aggregate(F.slice("vec", 16 * k + 1, 16), F.lit(0), lambda acc, x: acc * 2 + (x > F.col("_median")).cast("int"))
    return bits.select(*[c for c in frames.columns if c != "vec"], *[word(k).alias(f"s{k}") for k in range(words)])


def hamming(left: str, right: str, words: int = 4):
    return sum((F.bit_count(F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))) for k in range(1, words)), F.bit_count(F.col(f"{left}.s0").bitwiseXOR(F.col(f"{right}.s0"))))


def signature_distances(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """pairs (left_id, right_id) with hash_distance, the differing bits of their signatures (id, s0 ... s3); null where one is missing."""
    sides = [signed.select(F.col("id").alias(f"{side}_id"), F.struct("s0", "s1", "s2", "s3").alias(side)) for side in ("left", "right")]
    return pairs.join(sides[0], "left_id", "left").join(sides[1], "right_id", "left").withColumn("hash_distance", hamming("left", "right").cast("int")).drop("left", "right")


#: Signatures of a label that one cell compares with as many others.
CELL = 2048
WORD_BITS = 16
#: Parts of a label that is looked up: fewer where they would be smaller than SMALL, more only where they would be larger than LARGE.
PARTS, SMALL, LARGE = 16, 512, 1 << 20
#: Comparisons that take as long as one value asked for, and as one signature met by it (measured on cells of 6,400 and 38,000).
ASKING, MEETING = 7, 35
#: Signatures, and values or signatures, of one step inside a cell; candidates of one step.
STEP, ACROSS, MOST_MET = 32, 2048, 1 << 16


def word_shares(limit: int, words: int = 4) -> list[int]:
    """How many bits of each word may differ so that signatures within limit bits meet in some word: were all words further apart, the sum would be."""
    return [limit // words - (k > limit % words) for k in range(words)]


def near_signatures(signed: DataFrame, block: str, limit: int, cell: int = CELL, lookup_from: int | None = None) -> DataFrame:
    """Pairs of a label (block) whose signatures differ in at most limit bits.

    Such pairs differ in some 16-bit word by no more than its share of limit, so every signature looks up the values within that share of
    each of its words: 4 x 17 values for limits under 8, 4 x 137 under 12, 4 x 697 under 16, about 23,000 for 22. Labels with more rows than
    that (or than lookup_from) are cut into up to PARTS parts by hash, and each part meets each other one in a cell of its own, where values are
    looked up; unless lookup_from is given, a cell compares all its pairs where that is less work. So a signature is sent PARTS times,
    however many values it asks for. Smaller labels are cut by cell, and all pairs are compared, so no task gets more than cell^2 pairs.
    """
    shares = word_shares(limit)
    masks = [_within(share) for share in shares]
    signed = kept(signed, "signed")
    least = sum(map(len, masks)) if lookup_from is None else lookup_from
    sizes = kept(signed.groupBy(block).agg(F.count("*").alias("_rows")), "labels")
    sized = join_small(signed, sizes, block)
    return _met_by_words(sized.where(F.col("_rows") > least), block, limit, shares, masks, lookup_from is not None).unionByName(_met_in_cells(sized.where(F.col("_rows") <= least), block, limit, cell))


def _met_by_words(sized: DataFrame, block: str, limit: int, shares: list[int], masks: list[np.ndarray], always: bool) -> DataFrame:
    """Pairs within limit of cells of two parts, looked up by words inside the cell; always, or where that is less work than to compare them."""
    kind = sized.schema["frame_index"].dataType.simpleString()
    values = sum(map(len, masks))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        frames, first = rows["frame_index"].combine_chunks(), np.asarray(rows["_first"])
        codes = np.asarray(rows["code"]).view(np.uint64)
        # a part's own cell has rows of one side only, and meets itself
        asks, has = np.flatnonzero(first), np.flatnonzero(~first) if not first.all() else np.arange(len(first))
        asking, having = codes[asks], codes[has]
        look = always or ASKING * values + MEETING * values / (1 << WORD_BITS) * len(having) < len(having)
        for left, right in _gathered(_looked_up(asking, having, limit, shares, masks) if look else _compared(asking, having, limit)):
            far = np.bitwise_count(asking[left] ^ having[right]).astype(np.int32)
            a, b = frames.take(pa.array(asks[left])), frames.take(pa.array(has[right]))
            ordered = pc.less(a, b)
            if first.all():
                made = [x.filter(ordered) for x in (a, b, pa.array(far))]
            else:
                made = [pc.if_else(ordered, a, b), pc.if_else(ordered, b, a), pa.array(far)]
            yield pa.RecordBatch.from_arrays(made, ["left_frame", "right_frame", "distance"])

    last = len(shares) - 1
    code = sum((F.shiftleft(F.col(f"s{k}").cast("long"), WORD_BITS * (last - k)) for k in range(last)), F.col(f"s{last}").cast("long"))
    coded = sized.select(block, "frame_index", "_rows", code.alias("code")).where("frame_index is not null and code is not null")
    celled = _in_pairs_of_parts(coded, F.greatest(F.least(F.lit(PARTS), F.ceil(F.col("_rows") / SMALL)), F.ceil(F.col("_rows") / LARGE)).cast("int"))
    dealt = celled.select(block, "_lo", "_hi", (F.col("_mine") == F.col("_lo")).alias("_first"), "frame_index", "code")
    # by number, as partitions that were put together again because they are small would be few tasks with all the work
    keys, tasks = [block, "_lo", "_hi"], int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *keys).groupBy(*keys).applyInArrow(meet, f"left_frame {kind}, right_frame {kind}, distance int")


def _within(share: int) -> np.ndarray:
    """All differences of a word of at most share bits."""
    every = np.arange(1 << WORD_BITS)
    return every[np.bitwise_count(every) <= share].astype(np.uint16)


def _compared(asking: np.ndarray, having: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within limit, some at a time."""
    for i in range(0, len(asking), STEP):
        for j in range(0, len(having), ACROSS):
            far = np.bitwise_count(asking[i : i + STEP, None] ^ having[None, j : j + ACROSS])
            at, to = np.divmod(np.flatnonzero(far <= limit), far.shape[1])
            yield at + i, to + j


def _looked_up(asking: np.ndarray, having: np.ndarray, limit: int, shares: list[int], masks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same by values: a signature asks for all values within its share of each word, and a pair counts at the first word within its share."""
    word = lambda codes, k: (codes >> np.uint64(WORD_BITS * (len(shares) - 1 - k))).astype(np.uint16)
    step = STEP * ACROSS // max(1, min(len(asking), ACROSS))
    for k, differences in enumerate(masks):
        own, held = word(asking, k), word(having, k)
        order = np.argsort(held, kind="stable")
        counts = np.bincount(held, minlength=1 << WORD_BITS)
        starts = np.cumsum(counts) - counts
        for i in range(0, len(asking), ACROSS):
            for m in range(0, len(differences), step):
                values = differences[m : m + step, None] ^ own[None, i : i + ACROSS]
                hit = np.flatnonzero(counts[values.ravel()])
                found, at = values.ravel()[hit], hit % values.shape[1] + i
                ends = np.cumsum(counts[found])
                done = 0
                while done < len(hit):
                    met = ends[done - 1] if done else 0
                    upto = max(done + 1, int(np.searchsorted(ends, met + MOST_MET, "right")))
                    n = counts[found[done:upto]]
                    left = np.repeat(at[done:upto], n)
                    right = order[np.arange(met, ends[upto - 1]) + np.repeat(starts[found[done:upto]] - ends[done:upto] + n, n)]
                    done = upto
                    differ = asking[left] ^ having[right]
                    near = np.flatnonzero(np.bitwise_count(differ) <= limit)
                    for earlier in range(k):
                        near = near[np.bitwise_count(word(differ[near], earlier)).astype(int) > shares[earlier]]
                    yield left[near], right[near]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in lists of MOST_MET or some more."""
    lists, size = [], 0
    for pair in pairs:
        if len(pair[0]):
            lists.append(pair)
            size += len(pair[0])
        if size >= MOST_MET:
            yield tuple(map(np.concatenate, zip(*lists, strict=True)))
            lists, size = [], 0
    if lists:
        yield tuple(map(np.concatenate, zip(*lists, strict=True)))


def _in_pairs_of_parts(sized: DataFrame, parts: Column) -> DataFrame:
    """Every row in the cells (_lo, _hi) that its part (_mine) has with each part of its label."""
    mine = F.pmod(F.xxhash64("frame_index"), parts).cast("int")
    placed = sized.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return placed.withColumn("_lo", F.least("_mine", "_other")).withColumn("_hi", F.greatest("_mine", "_other")).drop("_rows", "_other")


def _met_in_cells(sized: DataFrame, block: str, limit: int, cell: int) -> DataFrame:
    """All pairs of a label compared, part against part."""
    celled = _in_pairs_of_parts(sized, F.ceil(F.col("_rows") / cell).cast("int"))
    a, b = celled.alias("a"), celled.alias("b")
    far = hamming("a", "b")
    # in a cell of two parts, pairs inside one part belong to that part's own cell
    once = (F.col("a._lo") == F.col("a._hi")) | (F.col("a._mine") != F.col("b._mine"))
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (block, "_lo", "_hi")] + [F.col("a.frame_index") < F.col("b.frame_index"), once, far <= limit])
    return met.select(F.col("a.frame_index").alias("left_frame"), F.col("b.frame_index").alias("right_frame"), far.cast("int").alias("distance"))


# The band around a region, in shares of the image: above and below its centre, of the width; beyond its sides, of the height.
BAND_OF_WIDTH, BAND_OF_HEIGHT = 0.058, 0.098


def overlay_points(points: DataFrame, regions: DataFrame, width: int, height: int, cell: int = 32) -> DataFrame:
    """Points (frame_index, x, y, fg, bg) of images of width x height with the value shown: fg inside any region band of the frame, else bg.

    A band is BAND_OF_WIDTH * width above and below the centre of the box and BAND_OF_HEIGHT * height beyond both its sides, edges included;
    it grows with the image and not with the box. Regions are spread over the cells they touch, so points meet only regions nearby.
    """
    mid, up, aside = F.col("y") + F.col("h") / 2, BAND_OF_WIDTH * width, BAND_OF_HEIGHT * height
    band = regions.select("frame_index", (F.col("x") - aside).alias("x0"), (F.col("x") + F.col("w") + aside).alias("x1"), (mid - up).alias("y0"), (mid + up).alias("y1"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    near = band.withColumn("gx", cells("x0", "x1")).withColumn("gy", cells("y0", "y1")).withColumnRenamed("frame_index", "f2")
    placed = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    p, r = placed.alias("p"), near.alias("r")
    meets = (F.col("p.frame_index") == F.col("r.f2")) & (F.col("p.gx") == F.col("r.gx")) & (F.col("p.gy") == F.col("r.gy")) & F.col("p.x").between(F.col("r.x0"), F.col("r.x1")) & F.col("p.y").between(F.col("r.y0"), F.col("r.y1"))
    hit = p.join(r, meets, "left_semi").select("frame_index", "x", "y").distinct().withColumn("_in", F.lit(True))
    return points.join(hit, ["frame_index", "x", "y"], "left").select("frame_index", "x", "y", F.when(F.col("_in"), F.col("fg")).otherwise(F.col("bg")).alias("shown"))


def overlay_decision(distances: DataFrame, hashes: DataFrame, max_distance: float, max_hash: int) -> DataFrame:
    """Per frame: distance, hash distance (only where the boxes are near enough, else null) and the overlay flag; skipped frames are all null and not shown.

    Near is distance < max_distance; the hash may equal max_hash.
    """
    near = F.coalesce(~F.col("skip") & (F.col("distance") < max_distance), F.lit(False))
    joined = distances.join(hashes, "frame_index", "left")
    measured = joined.withColumn("hash_distance", F.when(near, F.col("hash_distance"))).withColumn("distance", F.when(~F.col("skip"), F.col("distance")))
    return measured.select("frame_index", "skip", "distance", "hash_distance", F.coalesce(F.col("hash_distance") <= max_hash, F.lit(False)).alias("overlay"))
