"""Queries on spectra, blends, projections, boxes and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import aggregates, extension, frames, generators, joins, linear, pipelines, windows
from strandline.functions import scalar as S
from strandline.plans import fixtures as fx
from strandline.plans.catalogue_queries import _hash
from strandline.plans.fixtures import FRAME, with_tables
from strandline.plans.frame_queries import _matrix, _over_time, r6
from strandline.plans.registry import query
from strandline.sources import files, store
from strandline.sources.shared import shared_folder

M = FRAME - 2


def _long(df, vec="vec", name="value"):
    return df.select("frame_index", F.posexplode(vec).alias("pos", "v")).select("frame_index", "pos", r6("v", name))


def _evt_frames(spark, sf):
    return frames.split_signal(fx.evt(spark, sf), FRAME)


HANN = f"(0.5 - 0.5 * cos(2 * pi() * pos / {M}))"


def _spectrum(source: str) -> str:
    """SQL tables db(series_id, frame_index, b, v): decibels of the first M // 2 bins of each frame of source."""
    return f"""bins AS (SELECT unnest(range(0, {M // 2})) AS b),
    mag AS (SELECT 0 AS series_id, frame_index, b, sqrt(pow(sum(v * {HANN} * cos(2 * pi() * b * pos / {M})), 2) + pow(sum(v * {HANN} * sin(2 * pi() * b * pos / {M})), 2)) AS m FROM {source}, bins WHERE pos < {M} GROUP BY ALL),
    db AS (SELECT series_id, frame_index, b, 20 * log10(greatest(m / (SELECT max(m) FROM mag), 1e-10)) AS v FROM mag)"""


#: The chain of the smoothed spectrum of the event signal, in SQL.
CHAIN = f"""{fx.SQL['evtx']}, {_spectrum('evtx')}, {_matrix('rs', linear.resample_matrix(M // 2, FRAME))},
re AS (SELECT series_id, frame_index, rs.i AS pos, sum(rs.w * v) AS v FROM db JOIN rs ON rs.j = b GROUP BY ALL),
sc AS (SELECT series_id, frame_index, pos, (v - lo) / (hi - lo) * 2 - 1 AS v FROM re, (SELECT min(v) AS lo, max(v) AS hi FROM re)),
{_over_time('sc', linear.fit_matrix(7, 3), 7)}, {_matrix('sm', linear.smoothing_matrix(FRAME, 5, 3))},
d3 AS (SELECT frame_index, sm.i AS pos, sum(sm.w * out) AS v FROM f JOIN sm ON sm.j = f.pos GROUP BY ALL)"""

#: Power, rolling mean, polynomial smoothing and range of the event frames, in SQL.
POWER = f"""rms AS (SELECT 0 AS series_id, frame_index, 0 AS zero, sqrt(avg(v * v)) AS rms FROM evtx GROUP BY frame_index),
ro AS (SELECT series_id, frame_index, zero, rms, coalesce(CASE WHEN count(rms) OVER w = 3 THEN avg(rms) OVER w END, avg(rms) OVER ()) AS rolled FROM rms WINDOW w AS (ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
{_over_time('ro', linear.fit_matrix(7, 3), 7, 'rolled', 'zero', '2')},
lv AS (SELECT frame_index, CASE WHEN hi = lo THEN 0 ELSE CAST(round_even((out - lo) / (hi - lo) * 3, 0) AS INTEGER) END AS model_index FROM f2, (SELECT min(out) AS lo, max(out) AS hi FROM f2))"""


@query(with_tables("embx", f", {_spectrum('embx')} SELECT frame_index, CAST(b AS INTEGER) AS pos, round(v, 6) + 0.0 AS value FROM db"))
def d1_spectrogram(spark, sf):
    return _long(pipelines.spectrogram_db(fx.emb(spark, sf), FRAME))


@query(with_tables("embx", f", {_spectrum('embx')}, {_matrix('rs', linear.resample_matrix(M // 2, FRAME))} SELECT frame_index, rs.i AS pos, round(sum(rs.w * v), 6) + 0.0 AS value FROM db JOIN rs ON rs.j = b GROUP BY 1, 2"))
def d2_spectrogram_vectors(spark, sf):
    return _long(pipelines.spectrogram_vectors(fx.emb(spark, sf), FRAME, FRAME))


@query(f"WITH {CHAIN} SELECT frame_index, pos, round(v, 6) + 0.0 AS value FROM d3")
def d3_smooth_spectrogram(spark, sf):
    return _long(pipelines.smooth_spectrogram(_evt_frames(spark, sf), FRAME, (-1.0, 1.0)))


TURNED = f"""{CHAIN}, {POWER}, l3 AS (SELECT frame_index, CASE WHEN hi = lo THEN 0 ELSE round_even((out - lo) / (hi - lo) * 2, 0) END AS v FROM f2, (SELECT min(out) AS lo, max(out) AS hi FROM f2)),
tu AS (SELECT frame_index, CAST(sum(v) OVER (ORDER BY frame_index) AS BIGINT) AS turn FROM l3),
d3t AS (SELECT frame_index, (pos - turn % {FRAME} + {FRAME}) % {FRAME} AS pos, v FROM d3 JOIN tu USING (frame_index)), {_matrix('sw', linear.smoothing_matrix(FRAME, 51, 2))}"""


@query(f"WITH {TURNED} SELECT frame_index, sw.i AS pos, round(sum(sw.w * v), 6) + 0.0 AS value FROM d3t JOIN sw ON sw.j = d3t.pos GROUP BY 1, 2")
def d4_rolled_spectrum(spark, sf):
    return _long(pipelines.spectrum_layer(_evt_frames(spark, sf), FRAME, (-1.0, 1.0), True))


_U, _V = _hash("k", 1234), _hash("k", 1235)


def _smoothed(source: str, sigma: float) -> str:
    """SQL tables z(frame_index, pos, z), normal noise at the places of source, and nu(frame_index, pos, v): that smoothed over frames, wrapped, at unit RMS."""
    kernel = ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in windows.gaussian_kernel(sigma))
    return f"""nz AS (SELECT frame_index, pos, frame_index * {FRAME} + pos AS k FROM {source}),
z AS (SELECT frame_index, pos, sqrt(-2 * ln(({_U} + 1) / 2147483648.0)) * cos(2 * pi() * ({_V}) / 2147483648.0) AS z FROM nz),
gk(k, w) AS (VALUES {kernel}), zn AS (SELECT max(frame_index) + 1 AS n FROM z), gw AS (SELECT f.frame_index, ((f.frame_index + gk.k) % n + n) % n AS at, sum(gk.w) AS w FROM (SELECT DISTINCT frame_index FROM z) f, gk, zn GROUP BY ALL),
zs AS (SELECT gw.frame_index, z.pos, sum(gw.w * z.z) AS v FROM gw JOIN z ON z.frame_index = gw.at GROUP BY ALL),
nu AS (SELECT frame_index, pos, v / (SELECT sqrt(avg(v * v)) FROM zs) AS v FROM zs)"""


NOISE = f"""{_smoothed('evtx', pipelines.NOISE_SIGMA)}, ns AS (SELECT frame_index, pos, (v - lo) / (hi - lo) * 8 - 4 AS v FROM nu, (SELECT min(v) AS lo, max(v) AS hi FROM nu))"""


@query(f"WITH {CHAIN}, {POWER}, {NOISE} SELECT d3.frame_index, d3.pos, round(ns.v * 0.75 + d3.v * 0.25, 5) + 0.0 AS combined, model_index FROM d3 JOIN ns ON ns.frame_index = d3.frame_index AND ns.pos = d3.pos JOIN lv ON lv.frame_index = d3.frame_index")
def d5_noise_blend(spark, sf):
    """The flagship pipeline: smoothed noise blended with the smoothed spectrum, and a model number for each frame."""
    out = pipelines.noise_blend(_evt_frames(spark, sf), FRAME, 0.25, (-1.0, 1.0), 4)
    return out.select("frame_index", "model_index", F.posexplode("combined").alias("pos", "v")).select("frame_index", "pos", (F.round("v", 5) + 0.0).alias("combined"), "model_index")


POWER3 = POWER.replace(_matrix("h2", linear.fit_matrix(7, 3)), _matrix("h2", linear.fit_matrix(3, 2))).replace("z.n - 7", "z.n - 3").replace("s.frame_index - 3", "s.frame_index - 1").replace("z.n >= 7", "z.n >= 3")


@query(f"""WITH {CHAIN}, {POWER3}, {fx.SQL['pf']}, px AS (SELECT projection_id, 2 * frame_index + r.k AS frame_index, generate_subscripts(latent, 1) - 1 AS pos, unnest(latent) AS a FROM pf, (SELECT unnest([0, 1]) AS k) r)
SELECT projection_id, px.frame_index, model_index, CAST(dp.i AS INTEGER) AS depth, CAST(px.pos AS INTEGER) AS pos, round(CASE WHEN dp.i < 2 THEN a * 0.75 + d3.v * 0.25 ELSE a END, 5) + 0.0 AS value
FROM px JOIN d3 ON d3.frame_index = px.frame_index AND d3.pos = px.pos JOIN lv ON lv.frame_index = px.frame_index, (SELECT unnest(range(0, 4)) AS i) dp""")
def d6_projection_blend(spark, sf):
    """All projections, each blended with the one event signal."""
    latents = fx.proj_frames(spark, sf).select(F.col("projection_id").alias("series_id"), "frame_index", F.col("latent").alias("vec"))
    out = pipelines.projection_blend(latents, _evt_frames(spark, sf), FRAME, 0.25, (-1.0, 1.0), 4, 2, 2, 4, shared_signal=True)
    rows = out.select(F.col("series_id").alias("projection_id"), "frame_index", "model_index", F.posexplode("mat").alias("depth", "row"))
    return rows.select("projection_id", "frame_index", "model_index", "depth", F.posexplode("row").alias("pos", "v")).select("projection_id", "frame_index", "model_index", "depth", "pos", (F.round("v", 5) + 0.0).alias("value"))


@query(with_tables("pr", "SELECT projection_id, 2 AS factor, 2 * projection_frame_count AS output_frames FROM pr WHERE complete"))
def d7_blend_gate(spark, sf):
    return pipelines.blend_gate(fx.projections(spark, sf), 60.0)


@query(with_tables("evtx rms", "SELECT r.frame_index, round(r.rms, 6) + 0.0 AS value, round(max(o.rms), 6) + 0.0 AS reduced FROM rms r, rms o, (SELECT greatest(count(*) // 80, 1) AS s FROM rms) z WHERE o.frame_index BETWEEN r.frame_index - s // 2 AND r.frame_index + s - s // 2 - 1 GROUP BY 1, 2"))
def d8a_reduce_rolling_max(spark, sf):
    return pipelines.reduce_rolling_max(_evt_frames(spark, sf)).select("frame_index", r6("value", "value"), r6("reduced", "reduced"))


@query(f"WITH {fx.SQL['evtx']}, {POWER} SELECT ro.frame_index, round(rms, 6) + 0.0 AS value, round(rolled, 6) + 0.0 AS rolled, round(out, 6) + 0.0 AS reduced FROM ro JOIN f2 USING (frame_index)")
def d8b_reduce_rolling_average(spark, sf):
    out = pipelines.reduce_rolling_average(pipelines.power_series(_evt_frames(spark, sf)))
    return out.select("frame_index", r6("value", "value"), r6("rolled", "rolled"), r6("reduced", "reduced"))


@query()
def d8c_reduce_compressed(spark, sf):
    return pipelines.reduce_compressed(frames.split_signal(fx.line(spark, sf), FRAME)).select("series_id", "frame_index", "value", r6("reduced", "reduced"))


@query()
def d9_complexity_mask(spark, sf):
    return pipelines.complexity_mask(frames.split_signal(fx.line(spark, sf), FRAME), 3, 4.0)


NEAREST = """, a AS (SELECT frame_index, box_no, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM box WHERE side = 'a'), b AS (SELECT frame_index, box_no, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM box WHERE side = 'b'),
p AS (SELECT a.frame_index, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS distance, a.box_no AS a_no, b.box_no AS b_no FROM a JOIN b ON a.frame_index = b.frame_index),
m AS (SELECT frame_index, distance, a_no, b_no FROM p QUALIFY row_number() OVER (PARTITION BY frame_index ORDER BY distance, a_no, b_no) = 1),
nb AS (SELECT f.frame_index, distance, a_no, b_no FROM (SELECT DISTINCT frame_index FROM box) f LEFT JOIN m ON m.frame_index = f.frame_index)"""


@query(with_tables("box", NEAREST + " SELECT frame_index, round(distance, 6) + 0.0 AS distance, a_no, b_no FROM nb"))
def j3_nearest_boxes(spark, sf):
    return joins.nearest_boxes(fx.box(spark, sf)).select("frame_index", r6("distance", "distance"), "a_no", "b_no")


@query(with_tables("pr", "SELECT projection_id, network_md5_hash, md5('x') AS given_md5 FROM pr WHERE projection_id = 4"))
def j7_hash_mismatches(spark, sf):
    p = fx.projections(spark, sf)
    given = p.select("projection_id", F.when(F.col("projection_id") == 4, F.md5(F.lit("x"))).otherwise(F.col("network_md5_hash")).alias("given_md5"))
    return joins.hash_mismatches(given, p)


@query(with_tables("embx models", "SELECT frame_index, CAST(frame_index % 4 AS INTEGER) AS model_index, CAST(out_dim AS INTEGER) AS out_dim, round(sum(v * weight), 6) + 0.0 AS score FROM embx JOIN models ON models.model_index = frame_index % 4 AND models.pos = embx.pos GROUP BY 1, 2, 3"))
def j8_score_by_model(spark, sf):
    src = fx.emb(spark, sf).withColumn("model_index", (F.col("frame_index") % 4).cast("int"))
    return joins.score_by_model(src, fx.models(spark)).select("frame_index", "model_index", "out_dim", r6("score", "score"))


def _linear_model(m: int):
    w = np.array([[(((m * 31 + d * 17 + p * 7) % 13) - 6) / 6.0 for p in range(FRAME)] for d in range(8)])
    return lambda x: x @ w.T


@query(with_tables("embx models", "SELECT frame_index, CAST(frame_index % 4 AS INTEGER) AS model_index, CAST(out_dim AS INTEGER) AS out_dim, round(sum(v * weight), 6) + 0.0 AS score FROM embx JOIN models ON models.model_index = frame_index % 4 AND models.pos = embx.pos GROUP BY 1, 2, 3"))
def j8_score_in_chunks(spark, sf):
    src = fx.emb(spark, sf).withColumn("model_index", (F.col("frame_index") % 4).cast("int"))
    return joins.score_in_chunks(src, _linear_model).select("frame_index", "model_index", F.posexplode("scores").alias("out_dim", "s")).select("frame_index", "model_index", "out_dim", r6("s", "score"))


@query(with_tables("box", """, r AS (SELECT frame_index, x - 0.098 * 144 AS x0, x + w + 0.098 * 144 AS x1, y + h / 2.0 - 0.058 * 256 AS y0, y + h / 2.0 + 0.058 * 256 AS y1 FROM box WHERE side = 'a'),
pt AS (SELECT DISTINCT frame_index, x + w // 2 AS x, y + h // 2 + 1 AS y FROM box)
SELECT pt.frame_index, pt.x, pt.y, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.frame_index = pt.frame_index AND pt.x BETWEEN x0 AND x1 AND pt.y BETWEEN y0 AND y1) THEN 1 ELSE 0 END AS shown FROM pt"""))
def j9_overlay_points(spark, sf):
    b = fx.box(spark, sf)
    points = b.select("frame_index", (F.col("x") + F.expr("w div 2")).alias("x"), (F.col("y") + F.expr("h div 2") + 1).alias("y")).distinct().withColumn("fg", F.lit(1)).withColumn("bg", F.lit(0))
    return joins.overlay_points(points, b.where("side = 'a'"), 256, 144)


SIGNED = """, md AS (SELECT frame_index, median(v) AS m FROM embx GROUP BY 1),
sg AS (SELECT e.frame_index, """ + ", ".join(f"CAST(sum(CASE WHEN pos >= {16 * k} AND pos < {16 * k + 16} AND v > m THEN pow(2, {16 * k + 15} - pos) ELSE 0 END) AS INTEGER) AS s{k}" for k in range(4)) + " FROM embx e JOIN md USING (frame_index) GROUP BY 1)"


@query(with_tables("embx", SIGNED + ", s AS (SELECT sg.*, e.label FROM sg JOIN embeddings e ON e.vec_id = frame_index), p AS (SELECT a.frame_index AS left_frame, b.frame_index AS right_frame, CAST(" + " + ".join(f"bit_count(xor(a.s{k}, b.s{k}))" for k in range(4)) + " AS INTEGER) AS distance FROM s a JOIN s b ON a.label = b.label AND a.frame_index < b.frame_index) SELECT * FROM p WHERE distance <= 22"))
def j10_near_signatures(spark, sf):
    src = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_index"), "label", F.expr("transform(embedding, x -> cast(x as double))").alias("vec"))
    return joins.near_signatures(joins.signature(src), "label", 22)


@query(with_tables("embx", SIGNED + ", s AS (SELECT sg.*, e.label FROM sg JOIN embeddings e ON e.vec_id = frame_index), p AS (SELECT a.frame_index AS left_frame, b.frame_index AS right_frame, CAST(" + " + ".join(f"bit_count(xor(a.s{k}, b.s{k}))" for k in range(4)) + " AS INTEGER) AS distance FROM s a JOIN s b ON a.frame_index < b.frame_index) SELECT * FROM p WHERE distance <= 15"))
def j10_signature_lookup(spark, sf):
    """Near pairs of the whole table as one label, all looked up by words."""
    signed = joins.signature(fx.emb(spark, sf).withColumnRenamed("series_id", "label"))
    return joins.near_signatures(signed, "label", 15, lookup_from=0)


LINES = ", li AS (SELECT projection_id, frame_index, step, sum(abs(fin - v)) AS line FROM psx GROUP BY ALL)"


@query(with_tables("pf ps", LINES + " SELECT projection_id, frame_index, CAST(step AS INTEGER) AS step, round(line, 6) + 0.0 AS line FROM li"))
def a4_convergence(spark, sf):
    return joins.convergence(fx.proj_steps(spark, sf), fx.proj_frames(spark, sf)).select("projection_id", "frame_index", "step", r6("line", "line"))


@query(with_tables("pf ps", LINES + ", lm AS (SELECT projection_id, frame_index, 0.2 * (max(line) - min(line)) AS l FROM li GROUP BY ALL), pt AS (SELECT projection_id, frame_index, min(CASE WHEN line <= l THEN step END) AS point FROM li JOIN lm USING (projection_id, frame_index) GROUP BY ALL) SELECT projection_id, count(point) AS n_points, CAST(trunc(avg(point)) AS INTEGER) AS mean_step, CAST(trunc(stddev_pop(point)) AS INTEGER) AS std_step, CAST(trunc(avg(point) - stddev_pop(point)) AS INTEGER) AS less_one, CAST(trunc(avg(point) - 2 * stddev_pop(point)) AS INTEGER) AS less_two FROM pt GROUP BY 1"))
def a5_settling_points(spark, sf):
    return joins.settling_points(joins.convergence(fx.proj_steps(spark, sf), fx.proj_frames(spark, sf)))


@query(with_tables("pr pf", ", c AS (SELECT projection_id, count(*) AS n FROM pf GROUP BY 1) SELECT projection_id, CAST(original_frame_count * projection_fps / original_fps AS BIGINT) AS expected_frames, n AS actual_frames, 2 * n AS output_frames FROM pr JOIN c USING (projection_id)"))
def a10_frame_accounts(spark, sf):
    return aggregates.frame_accounts(fx.projections(spark, sf), fx.proj_frames(spark, sf), 60.0)


@query(with_tables("pf ps", "SELECT projection_id, frame_index, round(sum(v), 6) + 0.0 AS total FROM psx WHERE step = 6 AND NOT (projection_id = 3 AND frame_index >= 7) GROUP BY 1, 2"))
def p5_history_at_step(spark, sf):
    return joins.history_at_step(fx.proj_steps(spark, sf), 6).select("projection_id", "frame_index", r6(F.aggregate("latent", F.lit(0.0), lambda a, x: a + x), "total"))


@query(with_tables("pr", "SELECT projection_id, projection_id <> 2 AS rows_equal, complete, true AS count_fits, complete AND projection_id <> 2 AS usable FROM pr"))
def p10_check_projections(spark, sf):
    mat = S.promote(F.col("latent"), 4)
    odd = F.when((F.col("projection_id") == 2) & (F.col("frame_index") == 0), F.concat(F.slice(mat, 1, 3), F.array(F.array(F.lit(0.0))))).otherwise(mat)
    return joins.check_projections(fx.projections(spark, sf), fx.proj_frames(spark, sf).withColumn("mat", odd))


@query(with_tables("pf ps", "SELECT projection_id, frame_index, CAST(step AS INTEGER) AS step, round(sum(fin), 6) + 0.0 AS final_total, round(sum(v), 6) + 0.0 AS step_total FROM psx WHERE frame_index < 10 GROUP BY ALL"))
def j11_with_final(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return joins.with_final(fx.proj_steps(spark, sf), fx.proj_frames(spark, sf), 10).select("projection_id", "frame_index", "step", r6(total("final"), "final_total"), r6(total("latent"), "step_total"))


@query(with_tables("pf", "SELECT projection_id, frame_index, generate_subscripts(latent, 1) - 1 AS pos, unnest(latent) AS value, projection_id <> 3 AS complete FROM pf"))
def s5_store_read(spark, sf):
    """A store in the shared folder, written and read again; projection 3 stays open."""
    path, projections = shared_folder(spark, "store"), fx.projections(spark, sf)
    writer = store.begin_store(path, projections)
    writer.add(fx.proj_frames(spark, sf))
    writer.finish(projections.where("projection_id <> 3"))
    done = store.read_store(spark, path, "projections").select("projection_id", "complete")
    rows = store.read_store(spark, path).join(done, "projection_id")
    return rows.select("projection_id", "frame_index", F.posexplode("latent").alias("pos", "value"), "complete").withColumn("pos", F.col("pos").cast("long"))


@query(with_tables("pf ps", "SELECT projection_id, frame_index, CASE WHEN projection_id % 3 = 0 THEN 2 ELSE 1 END AS written, projection_id <> 6 AS complete, round(sum(unnested * CASE WHEN projection_id % 3 = 0 THEN 2 ELSE 1 END), 6) + 0.0 AS total, CASE WHEN projection_id % 3 = 0 THEN 0 ELSE 10 END AS steps FROM (SELECT projection_id, frame_index, unnest(latent) AS unnested FROM pf) GROUP BY projection_id, frame_index"))
def s6_store_rewrite(spark, sf):
    """A store that is written, then rewritten for every third projection with doubled latents and no histories; projection 6 breaks off unfinished."""
    path, projections, frames_ = shared_folder(spark, "store"), fx.projections(spark, sf), fx.proj_frames(spark, sf).withColumn("written", F.lit(1))
    store.write_store(path, projections, frames_, fx.proj_steps(spark, sf))
    third = projections.where("projection_id % 3 = 0")
    again = frames_.where("projection_id % 3 = 0").withColumn("latent", F.transform("latent", lambda x: x * 2)).withColumn("written", F.lit(2))
    writer = store.begin_store(path, third)
    writer.add(again, part="all")
    writer.add(again, part="all")
    writer.finish(third.where("projection_id <> 6"))
    steps = store.read_store(spark, path, "steps").groupBy("projection_id", "frame_index").agg(F.count("*").alias("steps"))
    done = store.read_store(spark, path, "projections").select("projection_id", "complete")
    total = F.aggregate("latent", F.lit(0.0), lambda a, x: a + x)
    rows = store.read_store(spark, path).join(done, "projection_id").join(steps, ["projection_id", "frame_index"], "left")
    return rows.select("projection_id", "frame_index", "written", "complete", r6(total, "total"), F.coalesce("steps", F.lit(0)).cast("int").alias("steps"))


@query(with_tables("pf ps", "SELECT projection_id, frame_index, CAST(step AS INTEGER) AS step, round(sqrt(sum(v * v)), 6) + 0.0 AS norm FROM psx WHERE step % 2 = 0 GROUP BY ALL"))
def x4_for_each_step(spark, sf):
    """A caller's function over every step of every history: the norm of even steps."""
    norm = lambda projection, frame, step, latent: (projection, frame, step, float(np.sqrt(latent @ latent))) if step % 2 == 0 else None
    return extension.for_each_step(fx.proj_steps(spark, sf), norm, "projection_id int, frame_index long, step int, norm double").withColumn("norm", F.round("norm", 6) + 0.0)


#: Event values as samples from -1 to 1 after 16-bit rounding; values are 0 to about 560.
SAMPLES = "s AS (SELECT event_id AS sample_index, greatest(-32768, least(32767, round_even((least(value / 500 - 1, 1) + 1) / 2 * 65535 - 32768, 0))) AS raw FROM events)"


def _recorded(spark, sf):
    """The event signal written as WAV files of 5,000 samples to the shared folder."""
    path = shared_folder(spark, "wavs")
    files.write_wavs(fx.evt(spark, sf).withColumn("value", F.least(F.col("value") / 500 - 1, F.lit(1.0))), path, 8000, 5000)
    return path


@query(f"WITH {SAMPLES} SELECT sample_index // 5000 AS file_no, (sample_index % 5000) // 512 AS block, (sample_index % 5000) % 512 AS pos, 8000 AS sample_rate, round((raw + 32768) / 65535 * 2 - 1, 6) + 0.0 AS value FROM s")
def s1_read_wavs(spark, sf):
    """Every sample of WAV files, read in ranges of two blocks."""
    blocks = files.read_wavs(spark, _recorded(spark, sf), block=512, range_bytes=2048)
    number = F.regexp_extract("path", r"-(\d+)\.wav$", 1).cast("long")
    return blocks.select(number.alias("file_no"), "block", "sample_rate", F.posexplode("samples").alias("pos", "v")).select("file_no", "block", F.col("pos").cast("long").alias("pos"), "sample_rate", r6("v", "value"))


@query(f"WITH {SAMPLES} SELECT sample_index, 8000 AS sample_rate, round((raw + 32768) / 65535 * 2 - 1, 6) + 0.0 AS value FROM s")
def s2_joined_signal(spark, sf):
    """All WAV files joined in path order."""
    return files.joined_signal(files.read_wavs(spark, _recorded(spark, sf))).select("sample_index", "sample_rate", r6("value", "value"))


@query(with_tables("embx", "SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY frame_index)), 6) + 0.0 AS value FROM embx"))
def x5_map_vectors(spark, sf):
    """A caller's function over every vector: each scaled to length 1."""
    return _long(extension.map_vectors(fx.emb(spark, sf), lambda x: x / np.sqrt(x @ x)))


def _spread(frames_, length):
    """A caller's reducer: most less least sample of each frame, with the length of its frames as a layer."""
    return frames_.select("series_id", "frame_index", (F.array_max("vec") - F.array_min("vec")).alias("value"), F.lit(length).alias("frame_length"))


@query(with_tables("evtx", "SELECT frame_index, round(sqrt(avg(v * v)), 6) + 0.0 AS power, round(max(v) - min(v), 6) + 0.0 AS spread FROM evtx GROUP BY 1"))
def x1_reduce_frames(spark, sf):
    """A library reducer and a caller's own one beside each other."""
    out = extension.reduce_frames(_evt_frames(spark, sf), FRAME, {"power": lambda f, _: pipelines.power_series(f), "spread": _spread})
    return out.select("frame_index", r6("power", "power"), r6("spread", "spread"))


def _mirrored(frames_, length, index):
    """A caller's layer: a frame, itself backwards, and their mean weighted by the frame's model number."""
    both = frames_.withColumn("b_vec", F.reverse("vec")).join(index, ["series_id", "frame_index"])
    return both.select("series_id", "frame_index", F.col("vec").alias("a_vec"), "b_vec", F.zip_with("vec", "b_vec", lambda a, b: (a * F.col("model_index") + b) / (F.col("model_index") + 1)).alias("combined"))


@query(with_tables("evtx", "SELECT a.frame_index, CAST(a.frame_index % 4 AS INTEGER) AS model_index, CAST(a.pos AS INTEGER) AS pos, round(a.v, 6) + 0.0 AS a, round(b.v, 6) + 0.0 AS b, round((a.v * (a.frame_index % 4) + b.v) / (a.frame_index % 4 + 1), 6) + 0.0 AS combined FROM evtx a JOIN evtx b ON b.frame_index = a.frame_index AND b.pos = 63 - a.pos"))
def x2_layer_frames(spark, sf):
    """A caller's layer function on the event frames, every value of its three layers."""
    src = _evt_frames(spark, sf)
    index = src.select("series_id", "frame_index", (F.col("frame_index") % 4).cast("int").alias("model_index"))
    out = extension.layer_frames(src, FRAME, index, _mirrored)
    return out.select("frame_index", "model_index", F.posexplode(F.arrays_zip("a_vec", "b_vec", "combined")).alias("pos", "z")).select("frame_index", "model_index", "pos", r6("z.a_vec", "a"), r6("z.b_vec", "b"), r6("z.combined", "combined"))


@query(with_tables("evtu", ", s AS (SELECT series_id, frame_index, CASE WHEN count(value) OVER w = 5 THEN sum(value) OVER w END AS rolled FROM evtu WINDOW w AS (PARTITION BY series_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT series_id, frame_index, coalesce(rolled, 1e308) > 250 AS skip FROM s"))
def p7_skip_mask(spark, sf):
    return windows.rolling_sum(fx.evtu(spark, sf), 5).select("series_id", "frame_index", pipelines.over_threshold(F.col("rolled"), 250).alias("skip"))


@query(with_tables("emb", "SELECT frame_index FROM emb WHERE vec[1] > 0 ORDER BY frame_index LIMIT 25"))
def p8_first_matching(spark, sf):
    from strandline.operators.selection import first_matching

    return first_matching(fx.emb(spark, sf).withColumn("ok", F.col("vec")[0] > 0), "ok", True, 25).select("frame_index")


#: The boxes of a pair get signatures of embeddings, picked by frame and box number; the hash distance is theirs.
DECIDED = NEAREST + SIGNED + """, ne AS (SELECT count(*) AS n FROM embeddings),
de AS (SELECT nb.frame_index, nb.frame_index % 7 = 0 AS skip, distance, """ + " + ".join(f"bit_count(xor(l.s{k}, r.s{k}))" for k in range(4)) + """ AS hd
FROM nb CROSS JOIN ne LEFT JOIN sg l ON l.frame_index = (nb.frame_index * 5 + a_no) % n LEFT JOIN sg r ON r.frame_index = (nb.frame_index * 5 + 3 * b_no) % n),
dd AS (SELECT frame_index, skip, CASE WHEN NOT skip THEN distance END AS distance, CASE WHEN NOT skip AND distance < 60 THEN CAST(hd AS INTEGER) END AS hash_distance FROM de)"""


def _decided(spark, sf):
    near = joins.nearest_boxes(fx.box(spark, sf)).withColumn("skip", F.col("frame_index") % 7 == 0)
    vectors = fx.emb(spark, sf).select("frame_index", "vec")
    n = vectors.count()
    pick = F.col("frame_index") * 5
    pairs = near.select("frame_index", F.pmod(pick + F.col("a_no"), F.lit(n)).alias("left_id"), F.pmod(pick + 3 * F.col("b_no"), F.lit(n)).alias("right_id"))
    hashes = joins.signature_distances(pairs, joins.signature(vectors).withColumnRenamed("frame_index", "id")).select("frame_index", "hash_distance")
    return joins.overlay_decision(near.select("frame_index", "skip", "distance"), hashes, 60.0, 30)


@query(with_tables("box embx", DECIDED + " SELECT frame_index, skip, round(distance, 6) + 0.0 AS distance, hash_distance, coalesce(hash_distance <= 30, false) AS overlay FROM dd"))
def p9_overlay_predicate(spark, sf):
    return _decided(spark, sf).select("frame_index", "skip", r6("distance", "distance"), "hash_distance", "overlay")


TRACKS = DECIDED + ", fl AS (SELECT frame_index, NOT skip AND distance IS NOT NULL AS flag, coalesce(hash_distance <= 30, false) AS overlay FROM dd), g AS (SELECT *, row_number() OVER (ORDER BY frame_index) - row_number() OVER (PARTITION BY flag ORDER BY frame_index) AS g FROM fl)"


@query(with_tables("box embx", TRACKS + " SELECT frame_index, overlay, flag AND count(*) OVER (PARTITION BY flag, g) >= 2 AS kept FROM g"))
def d10_overlay_tracks(spark, sf):
    """Overlay decision of each frame, and whether it lies in a track of two or more usable frames of the one sequence."""
    d = _decided(spark, sf).withColumn("series_id", F.lit(0)).withColumn("flag", ~F.col("skip") & F.col("distance").isNotNull())
    return windows.keep_long_tracks(d, 2).select("frame_index", "overlay", "kept")


@query(with_tables("box embx", TRACKS + " SELECT frame_index, overlay, flag AND count(*) OVER (PARTITION BY flag, g) >= 2 AS kept FROM g"))
def d10_overlay_tracks_whole(spark, sf):
    """d10_overlay_tracks with smaller blocks: tracks run on from block to block."""
    d = _decided(spark, sf).withColumn("series_id", F.lit(0)).withColumn("flag", ~F.col("skip") & F.col("distance").isNotNull())
    return windows.keep_long_tracks(d, 2, block=4096).select("frame_index", "overlay", "kept")


@query(with_tables("line", "SELECT series_id, CAST(floor(count(*) * 1.5) AS BIGINT) AS samples FROM line GROUP BY 1"))
def d11_resample_lengths(spark, sf):
    return pipelines.sinc_resample(fx.line(spark, sf), 1.5).groupBy("series_id").agg(F.count("*").alias("samples"))


@query(with_tables("line", """, k AS (SELECT unnest(range(-32, 33)) AS k), kw AS (SELECT k, CASE WHEN k = 0 THEN 1.0 ELSE sin(pi() * k * 0.5) / (pi() * k * 0.5) END * (0.5 + 0.5 * cos(pi() * k * 0.5 / 16)) AS w FROM k),
e AS (SELECT series_id, max(sample_index) + 1 AS n FROM line GROUP BY 1)
SELECT l.series_id, (l.sample_index - k) // 2 AS sample_index, round(sum(l.value * w) / (SELECT sum(w) FROM kw), 6) + 0.0 AS value FROM line l, kw JOIN e ON e.series_id = l.series_id
WHERE (l.sample_index - k) % 2 = 0 AND l.sample_index - k >= 0 AND (l.sample_index - k) // 2 < n // 2 GROUP BY 1, 2"""))
def d11_sinc_resample(spark, sf):
    return pipelines.sinc_resample(fx.line(spark, sf), 0.5).select("series_id", "sample_index", r6("value", "value"))


@query(with_tables("embx", f", z AS (SELECT frame_index, pos, frame_index * 64 + pos AS k FROM embx) SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(sqrt(-2 * ln(({_U} + 1) / 2147483648.0)) * cos(2 * pi() * ({_V}) / 2147483648.0), 6) + 0.0 AS value FROM z"))
def g2_noise_like(spark, sf):
    return _long(generators.noise_like(fx.emb(spark, sf), FRAME))


@query(f"WITH {fx.SQL['embx']}, {_smoothed('embx', 20.0)} SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(v, 6) + 0.0 AS value FROM nu")
def g2_gaussian_noise(spark, sf):
    """Noise smoothed over 20 frames at unit root mean square, one frame for each embedding."""
    return _long(generators.gaussian_noise(fx.emb(spark, sf), FRAME))


@query(with_tables("embx", "SELECT frame_index, CAST(pos AS INTEGER) AS pos, CASE WHEN v > 0 THEN CASE WHEN pos BETWEEN frame_index % 40 AND frame_index % 40 + 8 THEN v + 10.0 ELSE v END WHEN v < 0 THEN CASE WHEN pos BETWEEN frame_index % 40 AND frame_index % 40 + 8 THEN v + 10.0 ELSE v END ELSE 0.0 END AS value FROM embx"))
def g3_square_wave_added(spark, sf):
    rise = F.col("frame_index") % 40
    added = fx.emb(spark, sf).withColumn("wave", generators.square_wave(FRAME, rise, rise + 8, F.lit(0), F.lit(10))).withColumn("vec", generators.add_where_set(F.col("vec"), F.col("wave")))
    return frames.explode_frames(added).select("frame_index", "pos", "value")


@query(with_tables("embx", "SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(v + sin(pos) * 2, 6) + 0.0 AS value FROM embx"))
def g6_sine_added(spark, sf):
    added = fx.emb(spark, sf).withColumn("vec", F.zip_with("vec", generators.sine(FRAME, 2.0), lambda a, b: a + b))
    return _long(added)


def _added(spark, sf, sweep):
    """Embeddings with the frame of the same number of a sweep added, one frame for each embedding."""
    both = fx.emb(spark, sf).join(sweep.select("frame_index", F.col("vec").alias("sweep")), "frame_index")
    return _long(both.withColumn("vec", F.zip_with("vec", "sweep", lambda a, b: a + b)))


COUNTED = "embx, (SELECT count(*) AS n FROM embeddings)"


@query(with_tables("embx", f"SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(v + ((frame_index * {FRAME} + pos) // n) * (9.0 / {FRAME - 1}), 6) + 0.0 AS value FROM {COUNTED}"))
def g1_line_sweep_added(spark, sf):
    return _added(spark, sf, generators.line_sweep(spark, 0, 9, FRAME, fx.emb(spark, sf).count()))


@query(with_tables("embx", f"SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(v + CASE WHEN pos BETWEEN frame_index AND frame_index + 3 THEN n ELSE 0 END, 6) + 0.0 AS value FROM {COUNTED}"))
def g4_horizontal_sweep_added(spark, sf):
    return _added(spark, sf, generators.horizontal_sweep(spark, FRAME, 3, 0, fx.emb(spark, sf).count()))


@query(with_tables("embx", f"SELECT frame_index, CAST(pos AS INTEGER) AS pos, round(v + CASE WHEN pos BETWEEN 5 AND 8 THEN frame_index * (20.0 / n) - 10 ELSE -10 END, 6) + 0.0 AS value FROM {COUNTED}"))
def g5_vertical_sweep_added(spark, sf):
    return _added(spark, sf, generators.vertical_sweep(spark, FRAME, 5, 3, step=20.0 / max(1, fx.emb(spark, sf).count())))
