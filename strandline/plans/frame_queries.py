"""Queries on frames, scalars and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import scalar as S
from strandline.operators import aggregates, frames, linear, sides, windows
from strandline.plans import fixtures as fx
from strandline.plans.fixtures import FRAME, with_tables
from strandline.plans.registry import query


def r6(column, name: str):
    """Rounded to six places, never -0.0."""
    return (F.round(column, 6) + 0.0).alias(name)


def _frames(spark, sf):
    return frames.split_signal(fx.evt(spark, sf).withColumn("value", F.col("value")), FRAME)


def _rms(spark, sf):
    return aggregates.frame_rms(_frames(spark, sf), "value")


@query(with_tables("evtx", "SELECT 0 AS series_id, frame_index, CAST(pos AS INTEGER) AS pos, v AS value FROM evtx"))
def p1_split_signal(spark, sf):
    return frames.explode_frames(_frames(spark, sf))


@query(with_tables("embx", "SELECT series_id, frame_index // 4 AS frame_index, CAST(pos AS INTEGER) AS pos, v AS value FROM embx WHERE frame_index % 4 = 0"))
def p2_reduce_rate(spark, sf):
    return frames.explode_frames(frames.reduce_rate(fx.emb(spark, sf), 60, 15))


@query(with_tables("embx", "SELECT series_id, frame_index, CAST(pos AS INTEGER) AS pos, v AS value FROM embx WHERE frame_index >= 10 AND frame_index < 200"))
def p3_frame_range(spark, sf):
    return frames.explode_frames(frames.frame_range(fx.emb(spark, sf), 10, 200))


@query(with_tables("pf", "SELECT projection_id AS series_id, frame_index, CAST(generate_subscripts(latent, 1) - 1 AS INTEGER) AS pos, unnest(latent) AS value FROM pf WHERE frame_index = 5"))
def p4_frame_lookup(spark, sf):
    latents = fx.proj_frames(spark, sf).select(F.col("projection_id").alias("series_id"), "frame_index", F.col("latent").alias("vec"))
    return frames.explode_frames(frames.frame_range(latents, 5, 6))


@query(with_tables("evtx rms", "SELECT 0 AS series_id, frame_index, round(rms, 6) + 0.0 AS rms FROM rms"))
def a1_frame_rms(spark, sf):
    return _rms(spark, sf).select("series_id", "frame_index", r6("value", "rms"))


@query(with_tables("evt", "SELECT w.i AS frame_index, round(sqrt(avg(value * value)), 6) + 0.0 AS rms FROM (SELECT unnest(range(0, (SELECT (max(sample_index) + 1 - 64) // 100 + 1 FROM evt))) AS i) w JOIN evt ON sample_index >= w.i * 100 AND sample_index < w.i * 100 + 64 GROUP BY 1"))
def a1_hop_rms(spark, sf):
    return aggregates.hop_rms(fx.evt(spark, sf), 64, 100).select("frame_index", r6("rms", "rms"))


@query(with_tables("embx", "SELECT frame_index, CAST(pos AS INTEGER) AS pos, round((v - lo) / (hi - lo) * 8 - 4, 6) + 0.0 AS value FROM embx, (SELECT min(v) AS lo, max(v) AS hi FROM embx)"))
def a2_minmax_scale(spark, sf):
    return aggregates.minmax_scale(fx.emb(spark, sf), -4, 4).select("frame_index", F.posexplode("vec").alias("pos", "v")).select("frame_index", "pos", r6("v", "value"))


@query(with_tables("evtx rms", "SELECT 0 AS series_id, frame_index // 10 AS window_id, round(coalesce(min(nullif(rms, 0)) - 5, -5), 6) + 0.0 AS lo, round(coalesce(max(nullif(rms, 0)) + 5, 5), 6) + 0.0 AS hi, round(avg(nullif(rms, 0)), 6) + 0.0 AS mean, round(avg(nullif(rms, 0)) - 2 * stddev_pop(nullif(rms, 0)), 6) + 0.0 AS band_lo, round(avg(nullif(rms, 0)) + 2 * stddev_pop(nullif(rms, 0)), 6) + 0.0 AS band_hi FROM rms GROUP BY 2"))
def a3_context_ranges(spark, sf):
    return aggregates.context_ranges(_rms(spark, sf), 10).select("series_id", "window_id", *(r6(c, c) for c in ("lo", "hi", "mean", "band_lo", "band_hi")))


@query(with_tables("embx", "SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(v / (SELECT sqrt(avg(v * v)) FROM embx), 6) + 0.0 AS value FROM embx"))
def a8_unit_rms(spark, sf):
    return aggregates.unit_rms(fx.emb(spark, sf)).select("frame_index", F.posexplode("vec").alias("pos", "v")).select("frame_index", "pos", r6("v", "value"))


@query("SELECT count(DISTINCT l_linestatus IS NULL) AS n, 'false' AS values FROM lineitem")
def a9_require_one(spark, sf):
    checked = fx.table(spark, sf, "lineitem").select(F.col("l_linestatus").isNull().alias("missing"))
    return aggregates.require_one(checked, "missing")


@query()
def a7_compressed_size(spark, sf):
    return aggregates.compressed_size(frames.split_signal(fx.line(spark, sf), FRAME))


ROLLED = "CASE WHEN count(value) OVER w = 3 THEN {f}(value) OVER w END"


@query(with_tables("evtu", "SELECT series_id, frame_index, round(coalesce(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END, avg(value) OVER (PARTITION BY series_id)), 6) + 0.0 AS rolled FROM evtu WINDOW w AS (PARTITION BY series_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"))
def w1_rolling_mean(spark, sf):
    return windows.rolling_mean(fx.evtu(spark, sf)).select("series_id", "frame_index", r6("rolled", "rolled"))


@query(with_tables("evtx rms", "SELECT frame_index, round(coalesce(CASE WHEN count(rms) OVER w = 3 THEN avg(rms) OVER w END, avg(rms) OVER ()), 6) + 0.0 AS rolled FROM rms WINDOW w AS (ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"))
def w1_rolling_mean_blocks(spark, sf):
    return windows.rolling_mean(_rms(spark, sf), block=256).select("frame_index", r6("rolled", "rolled"))


@query(with_tables("evtu", "SELECT series_id, frame_index, round(CASE WHEN count(value) OVER w = 5 THEN sum(value) OVER w END, 6) + 0.0 AS rolled FROM evtu WINDOW w AS (PARTITION BY series_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"))
def w2_rolling_sum(spark, sf):
    return windows.rolling_sum(fx.evtu(spark, sf), 5).select("series_id", "frame_index", r6("rolled", "rolled"))


@query(with_tables("evtx rms", "SELECT r.frame_index, round(max(o.rms), 6) + 0.0 AS rolled FROM rms r, rms o, (SELECT greatest(count(*) // 80, 1) AS s FROM rms) z WHERE o.frame_index BETWEEN r.frame_index - s // 2 AND r.frame_index + s - s // 2 - 1 GROUP BY 1"))
def w3_rolling_max(spark, sf):
    return windows.rolling_max(_rms(spark, sf)).select("frame_index", r6("rolled", "rolled"))


@query(with_tables("evtx rms", "SELECT frame_index, round(max(rms) OVER (ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), 6) + 0.0 AS rolled FROM rms"))
def w3_rolling_max_blocks(spark, sf):
    return windows.rolling_max(_rms(spark, sf), size=8, block=128).select("frame_index", r6("rolled", "rolled"))


def _matrix(name: str, m) -> str:
    """A matrix as a SQL table (out, pos, w)."""
    rows = ", ".join(f"({i}, {j}, CAST({float(w)!r} AS DOUBLE))" for i, row in enumerate(m) for j, w in enumerate(row) if w)
    return f"{name}(i, j, w) AS (VALUES {rows})"


def _over_time(source: str, h, window: int, value: str = "v", keys: str = "pos", tag: str = "") -> str:
    """SQL of the polynomial filter along frames of source(series_id, frame_index, keys, value): table f + tag with column out."""
    half = window // 2
    return f"""{_matrix('h' + tag, h)}, n{tag} AS (SELECT series_id, max(frame_index) + 1 AS n FROM {source} GROUP BY 1),
    b{tag} AS (SELECT s.series_id, s.frame_index, s.{keys}, least(greatest(s.frame_index - {half}, 0), z.n - {window}) AS b FROM {source} s JOIN n{tag} z USING (series_id) WHERE z.n >= {window}),
    f{tag} AS (SELECT y.series_id, y.frame_index, y.{keys}, sum(x.w * s.{value}) AS out FROM b{tag} y JOIN h{tag} x ON x.i = y.frame_index - y.b JOIN {source} s ON s.series_id = y.series_id AND s.{keys} = y.{keys} AND s.frame_index = y.b + x.j GROUP BY ALL)"""


@query(f"WITH {fx.SQL['embx']}, {_over_time('embx', linear.fit_matrix(7, 3), 7)} SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(out, 6) + 0.0 AS value FROM f")
def w4_smooth_over_time(spark, sf):
    return linear.smooth_over_time(fx.emb(spark, sf)).select("frame_index", F.posexplode("vec").alias("pos", "v")).select("frame_index", "pos", r6("v", "value"))


EVTU0 = "evtu0 AS (SELECT series_id, frame_index, 0 AS pos, value AS v FROM evtu)"


@query(f"WITH {fx.SQL['evtu']}, {EVTU0}, {_over_time('evtu0', linear.fit_matrix(7, 3), 7)} SELECT f.series_id, f.frame_index, round(v, 6) + 0.0 AS value, round(out, 6) + 0.0 AS smoothed FROM f JOIN evtu0 USING (series_id, frame_index)")
def w5_smooth_series(spark, sf):
    return linear.smooth_series(fx.evtu(spark, sf)).select("series_id", "frame_index", r6("value", "value"), r6("smoothed", "smoothed"))


@query(with_tables("evt", "SELECT sample_index AS frame_index, round(sum(value) OVER (ORDER BY sample_index), 4) + 0.0 AS total FROM evt"))
def w6_running_total(spark, sf):
    return windows.running_total(fx.evt(spark, sf).withColumnRenamed("sample_index", "frame_index")).select("frame_index", (F.round("total", 4) + 0.0).alias("total"))


@query(with_tables("evtu", ", c AS (SELECT *, value >= 50 AS flag, frame_index - row_number() OVER (PARTITION BY series_id, value >= 50 ORDER BY frame_index) AS g FROM evtu) SELECT series_id, frame_index, flag, flag AND count(*) OVER (PARTITION BY series_id, flag, g) >= 3 AS kept FROM c"))
def w7_keep_long_tracks(spark, sf):
    return windows.keep_long_tracks(fx.evtu(spark, sf).withColumn("flag", F.col("value") >= 50), 3).select("series_id", "frame_index", "flag", "kept")


@query(with_tables("evtx rms", "SELECT 0 AS series_id, frame_index // 7 AS window_id, count(*) AS n, round(sum(rms), 6) + 0.0 AS total FROM rms GROUP BY 2"))
def w9_count_windows(spark, sf):
    out = frames.count_windows(_rms(spark, sf), 7)
    return out.select("series_id", "window_id", F.size("items").cast("long").alias("n"), r6(F.aggregate("items", F.lit(0.0), lambda a, x: a + x), "total"))


@query(f"WITH {fx.SQL['evtu']}, {EVTU0}, {_over_time('evtu0', linear.fit_matrix(5, 2, 1), 5)} SELECT series_id, frame_index, round(out, 6) + 0.0 AS slope FROM f")
def w10_derive_series(spark, sf):
    return linear.derive_series(fx.evtu(spark, sf)).select("series_id", "frame_index", r6("slope", "slope"))


KERNEL = ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in windows.gaussian_kernel(2.0))


@query(f"WITH {fx.SQL['embx']}, k(o, w) AS (VALUES {KERNEL}), n AS (SELECT max(frame_index) + 1 AS n FROM embx) SELECT (frame_index + o + n) % n AS frame_index, CAST(pos AS INTEGER) AS pos, round(sum(w * v), 6) + 0.0 AS value FROM embx, k, n GROUP BY 1, 2")
def w11_circular_smooth(spark, sf):
    return windows.circular_smooth(fx.emb(spark, sf), 2.0).select("frame_index", F.posexplode("vec").alias("pos", "v")).select("frame_index", "pos", r6("v", "value"))


@query(with_tables("embx", "SELECT a.frame_index, CAST(a.pos AS INTEGER) AS pos, round(a.v + 2 * b.v, 6) + 0.0 AS mixed FROM embx a JOIN embx b ON b.frame_index = a.frame_index AND b.pos = 63 - a.pos WHERE b.frame_index % 3 = 0"))
def j1_align(spark, sf):
    right = fx.emb(spark, sf).where("frame_index % 3 = 0").withColumnRenamed("vec", "other")
    both = frames.align(fx.emb(spark, sf), right).withColumn("vec", F.zip_with("vec", F.reverse("other"), lambda a, b: a + b * 2))
    return frames.explode_frames(both).select("frame_index", "pos", r6("value", "mixed"))


@query(with_tables("evtx rms", "SELECT r.frame_index, r.frame_index // 9 AS window_id, round(sum(o.rms), 6) + 0.0 AS around FROM rms r JOIN rms o ON o.frame_index // 9 = r.frame_index // 9 GROUP BY 1, 2"))
def j2_context_windows(spark, sf):
    out = frames.context_windows(_rms(spark, sf), 9)
    return out.select("frame_index", "window_id", r6(F.aggregate("surrounding", F.lit(0.0), lambda a, x: a + x), "around"))


@query(with_tables("emb", ", n AS (SELECT count(*) AS n FROM emb), g AS (SELECT i AS t, i * (n - 1) / 299.0 AS pt, n FROM (SELECT unnest(range(0, 300)) AS i), n) SELECT t AS frame_index, CAST(p AS INTEGER) AS pos, round(a.vec[p + 1] * (1 - (pt - floor(pt))) + b.vec[p + 1] * (pt - floor(pt)), 6) + 0.0 AS value FROM g JOIN emb a ON a.frame_index = CAST(floor(pt) AS BIGINT) JOIN emb b ON b.frame_index = least(CAST(floor(pt) AS BIGINT) + 1, n - 1), (SELECT unnest(range(0, 64)) AS p)"))
def v4_interpolate_frames(spark, sf):
    return frames.explode_frames(frames.interpolate_frames(fx.emb(spark, sf), 300)).select("frame_index", "pos", r6("value", "value"))


@query(with_tables("embx", "SELECT frame_index * 3 + k AS frame_index, CAST(pos AS INTEGER) AS pos, v AS value FROM embx, (SELECT unnest(range(0, 3)) AS k)"))
def v5_repeat_frames(spark, sf):
    return frames.explode_frames(frames.repeat_frames(fx.emb(spark, sf), 3)).select("frame_index", "pos", "value")


@query(with_tables("embx", "SELECT a.frame_index AS series_id, k AS frame_index, CAST(a.pos AS INTEGER) AS pos, round(a.v + (b.v - a.v) * k / 4.0, 6) + 0.0 AS value FROM embx a JOIN embx b ON b.frame_index = a.frame_index + 1 AND b.pos = a.pos, (SELECT unnest(range(0, 5)) AS k)"))
def v6_between_vectors(spark, sf):
    nxt = fx.emb(spark, sf).select((F.col("frame_index") - 1).alias("frame_index"), F.col("vec").alias("end_vec"))
    ends = fx.emb(spark, sf).join(nxt, "frame_index").select(F.col("frame_index").alias("series_id"), F.col("vec").alias("start_vec"), "end_vec")
    return frames.explode_frames(frames.between_vectors(ends, 5)).select("series_id", "frame_index", "pos", r6("value", "value"))


def _per_frame(m) -> str:
    return f"WITH {fx.SQL['embx']}, {_matrix('m', m)} SELECT frame_index, m.i AS pos, round(sum(m.w * v), 6) + 0.0 AS value FROM embx JOIN m ON m.j = embx.pos GROUP BY 1, 2"


def _applied(spark, sf, matrix):
    return linear.apply_matrix(fx.emb(spark, sf), matrix).select("frame_index", F.posexplode("vec").alias("pos", "v")).select("frame_index", "pos", r6("v", "value"))


@query(_per_frame(linear.smoothing_matrix(64, 51, 2)))
def v1_smooth_each_vector(spark, sf):
    return _applied(spark, sf, linear.smoothing_matrix(64, 51, 2))


@query(_per_frame(linear.resample_matrix(64, 96)))
def v2_resample(spark, sf):
    return _applied(spark, sf, linear.resample_matrix(64, 96))


@query(_per_frame(linear.cubic_matrix(64, 40)))
def v3_cubic(spark, sf):
    return _applied(spark, sf, linear.cubic_matrix(64, 40))


@query(with_tables("evtu", ", r AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM evtu GROUP BY 1) SELECT series_id, frame_index, round((value - lo) / (hi - lo) * 2 - 1, 6) + 0.0 AS mapped FROM evtu JOIN r USING (series_id) WHERE hi > lo"))
def f4_remap(spark, sf):
    return aggregates.with_range(fx.evtu(spark, sf)).where("hi > lo").select("series_id", "frame_index", r6(S.remap(F.col("value"), F.col("lo"), F.col("hi"), -1, 1), "mapped"))


@query(with_tables("evtu", ", r AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM evtu GROUP BY 1) SELECT series_id, frame_index, value, CASE WHEN hi = lo THEN 0 ELSE CAST(round_even((value - lo) / (hi - lo) * 4, 0) AS INTEGER) END AS level FROM evtu JOIN r USING (series_id)"))
def f5_quantise(spark, sf):
    return aggregates.with_range(fx.evtu(spark, sf)).select("series_id", "frame_index", "value", S.quantise(F.col("value"), F.col("lo"), F.col("hi"), 5).alias("level"))


@query(with_tables("embx", ", n AS (SELECT count(*) // 64 AS n FROM embx) SELECT a.frame_index, CAST(a.pos AS INTEGER) AS pos, round(a.v * 0.75 + b.v * 0.25, 6) + 0.0 AS value FROM embx a, n, embx b WHERE b.pos = a.pos AND b.frame_index = (a.frame_index + 1) % n"))
def f6_blend(spark, sf):
    src = fx.emb(spark, sf)
    n = src.count()
    other = src.select(F.pmod(F.col("frame_index") - 1, F.lit(n)).alias("frame_index"), F.col("vec").alias("b"))
    mixed = src.join(other, "frame_index").select("frame_index", S.blend(F.col("vec"), F.col("b"), 0.25).alias("vec"))
    return mixed.select("frame_index", F.posexplode("vec").alias("pos", "v")).select("frame_index", "pos", r6("v", "value"))


@query(with_tables("embx", ", t AS (SELECT max(abs(v)) AS top FROM embx) SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(20 * log10(greatest(abs(v) / top, 1e-10)), 6) + 0.0 AS db FROM embx, t"))
def f7_decibel(spark, sf):
    long = frames.explode_frames(fx.emb(spark, sf)).withColumn("value", F.abs("value"))
    return sides.join_small(long, long.groupBy("series_id").agg(F.max("value").alias("top")), "series_id").select("frame_index", "pos", r6(S.decibel(F.col("value"), F.col("top")), "db"))


@query("SELECT o_orderkey, (o_orderkey * 6) // 3 AS quotient FROM orders")
def f8_whole_quotient(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", S.whole_quotient(F.col("o_orderkey") * 6, F.lit(3)).alias("quotient"))


@query(with_tables("evtu", "SELECT series_id, frame_index, CASE WHEN frame_index % 5 = 0 THEN 0.0 ELSE value END AS value FROM evtu"))
def f9_nan_to_zero(spark, sf):
    holed = F.when(F.col("frame_index") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return fx.evtu(spark, sf).select("series_id", "frame_index", S.nan_to_zero(holed).alias("value"))


@query(with_tables("evtu", "SELECT series_id, frame_index, value - 50 AS value, abs(value - 50) AS absolute FROM evtu"))
def f10_absolute(spark, sf):
    return fx.evtu(spark, sf).withColumn("value", F.col("value") - 50).select("series_id", "frame_index", *S.with_absolute("value"))


@query(with_tables("emb", "SELECT frame_index, CAST(len(vec) AS INTEGER) AS length, 4 AS depth, vec[3] AS third, len(vec) * 4 AS cells FROM emb"))
def f11_f12_f13_shapes(spark, sf):
    mat = fx.emb(spark, sf).withColumn("mat", S.promote(F.col("vec"), 4))
    return mat.select("frame_index", F.size("vec").alias("length"), F.size("mat").alias("depth"), S.demote(F.col("mat"), 2)[2].alias("third"), F.size(F.flatten("mat")).cast("long").alias("cells"))


@query(with_tables("embx", "SELECT frame_index, CAST((pos - (3 * frame_index) % 64 + 64) % 64 AS INTEGER) AS pos, v AS value FROM embx"))
def f14_rotate(spark, sf):
    turned = fx.emb(spark, sf).withColumn("vec", S.rotate_left(F.col("vec"), F.col("frame_index") * 3))
    return frames.explode_frames(turned).select("frame_index", "pos", "value")


@query(with_tables("embx", "SELECT frame_index, d AS row_no, CAST(pos AS INTEGER) AS pos, CASE WHEN d < 2 THEN -1.0 ELSE v END AS value FROM embx, (SELECT unnest(range(0, 4)) AS d)"))
def f15_splice_depth(spark, sf):
    spliced = fx.emb(spark, sf).withColumn("mat", S.splice_depth(S.promote(F.col("vec"), 4), F.array_repeat(F.lit(-1.0), 64), 2))
    return spliced.select("frame_index", F.posexplode("mat").alias("d", "row")).select("frame_index", F.col("d").cast("long").alias("row_no"), F.posexplode("row").alias("pos", "value"))


@query(with_tables("emb", "SELECT frame_index, 80 AS padded, round(list_sum(vec), 6) + 0.0 AS total FROM emb"))
def f16_pad_vector(spark, sf):
    padded = fx.emb(spark, sf).withColumn("vec", frames.pad_vector(F.col("vec"), 80))
    return padded.select("frame_index", F.size("vec").alias("padded"), r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), "total"))


@query(with_tables("box", "SELECT frame_index, side, box_no, x + w / 2.0 AS cx, y + h / 2.0 AS cy, x + w AS right, y + h AS bottom FROM box"))
def f17_box_scalars(spark, sf):
    cx, cy = S.centre(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    c = S.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return fx.box(spark, sf).select("frame_index", "side", "box_no", cx.alias("cx"), cy.alias("cy"), c["right"].alias("right"), c["bottom"].alias("bottom"))


@query(with_tables("box", "SELECT frame_index, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM box GROUP BY 1"))
def f17_tight_box(spark, sf):
    points = fx.box(spark, sf).groupBy("frame_index").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    return points.select("frame_index", S.tight_box(F.col("xs"), F.col("ys")).alias("b")).select("frame_index", "b.x", "b.y", "b.w", "b.h")


@query(with_tables("embx", "SELECT frame_index, CAST(pos AS INTEGER) AS pos, v AS value, '64,32' AS shapes FROM embx UNION ALL SELECT frame_index, CAST(pos + 64 AS INTEGER), v, '64,32' FROM embx WHERE pos < 32"))
def f18_flatten(spark, sf):
    """Two arrays of each frame laid end to end, every value, and their sizes."""
    flat = fx.emb(spark, sf).select("frame_index", S.flatten_parts(F.array("vec", F.slice("vec", 1, 32))).alias("p"))
    return flat.select("frame_index", F.array_join(F.transform("p.sizes", lambda n: n.cast("string")), ",").alias("shapes"), F.posexplode("p.flat").alias("pos", "value"))


@query(with_tables("line", "SELECT series_id, CAST(8000 * (64 * (30 * (count(*) / 8000.0))) / count(*) AS BIGINT) AS by_rate, round(8000 * 12 / (count(*) / 64.0), 6) + 0.0 AS by_count FROM line GROUP BY 1"))
def f19_scaled_rate(spark, sf):
    sizes = fx.line(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"))
    return sizes.select("series_id", S.scaled_rate(8000, 64, F.col("n"), fps=30).alias("by_rate"), r6(S.scaled_rate(8000, 64, F.col("n"), count=12), "by_count"))


@query(with_tables("evtx rms", ", w AS (SELECT frame_index, rms, coalesce(CASE WHEN count(rms) OVER x = 3 THEN avg(rms) OVER x END, avg(rms) OVER ()) AS rolled FROM rms WINDOW x AS (ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), r AS (SELECT min(rolled) AS lo, max(rolled) AS hi FROM w) SELECT frame_index, round(rms, 6) + 0.0 AS rms, round(rolled, 6) + 0.0 AS rolled, CASE WHEN hi = lo THEN 0 ELSE CAST(round_even((rolled - lo) / (hi - lo) * 3, 0) AS INTEGER) END AS model_index FROM w, r"))
def m0_model_index(spark, sf):
    """Model number of each frame: rolling mean of the frames' power, quantised."""
    rolled = windows.rolling_mean(_rms(spark, sf), 3, block=1024)
    return aggregates.with_range(sides.kept(rolled), "rolled").select("frame_index", r6("value", "rms"), r6("rolled", "rolled"), S.quantise(F.col("rolled"), F.col("lo"), F.col("hi"), 4).alias("model_index"))
