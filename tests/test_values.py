"""Queries and operators that SQL doesn't check, against numpy; long series in small blocks against the plain definition."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.operators import extension, generators, joins, linear, pipelines, sides, windows
from strandline.operators import frames as frame_ops
from strandline.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def line_frames(spark):
    """{series: frames of 64 quantities, the last one padded with zeros}, and the bytes of each after zlib."""
    rows = fx.line(spark, SF).toPandas().sort_values(["series_id", "sample_index"])
    frames = {}
    for s, part in rows.groupby("series_id"):
        x = part["value"].to_numpy()
        frames[s] = np.pad(x, (0, -len(x) % 64)).reshape(-1, 64)
    return frames, {s: np.array([float(len(zlib.compress(f.astype(np.float32).tobytes()))) for f in x]) for s, x in frames.items()}


def polynomial(x, window, order, derivative=0):
    """Least-squares polynomial at every place, from the window around it, or at the ends from the first and last whole window."""
    out = np.zeros(len(x))
    for i in range(len(x)):
        a = min(max(i - window // 2, 0), len(x) - window)
        p = np.polynomial.Polynomial.fit(np.arange(window), x[a : a + window], order, domain=[0, window], window=[0, window])
        out[i] = (p.deriv(derivative) if derivative else p)(i - a)
    return out


def rolled(x, size):
    return np.array([x[i - size + 1 : i + 1].mean() if i >= size - 1 else x.mean() for i in range(len(x))])


def test_compressed_sizes_and_what_builds_on_them(spark):
    _, sizes = line_frames(spark)
    q = entry.queries()
    got = {(r["series_id"], r["frame_index"]): r["value"] for r in q["a7_compressed_size"](spark, SF).collect()}
    assert got == {(s, i): v for s, x in sizes.items() for i, v in enumerate(x.tolist())}
    reduced = {s: polynomial(rolled(x, 3), 7, 3) for s, x in sizes.items() if len(x) >= 7}
    found = q["d8c_reduce_compressed"](spark, SF).collect()
    assert len(found) == sum(map(len, reduced.values()))
    assert all(np.isclose(r["reduced"], reduced[r["series_id"]][r["frame_index"]], atol=2e-6) and r["value"] == sizes[r["series_id"]][r["frame_index"]] for r in found)
    masks = {}
    for s, x in reduced.items():
        slope = np.abs(polynomial(x, 5, 2, 1))
        masks[s] = [i < 2 or slope[i - 2 : i + 1].sum() > 4.0 for i in range(len(x))]
    found = q["d9_complexity_mask"](spark, SF).collect()
    assert {(r["series_id"], r["frame_index"]): r["skip"] for r in found} == {(s, i): v for s, m in masks.items() for i, v in enumerate(m)}


def series(spark, lengths, width=3, seed=1):
    rng = np.random.default_rng(seed)
    data = {s: rng.normal(size=(n, width)) for s, n in enumerate(lengths)}
    rows = [(s, i, x[i].tolist(), float(x[i, 0]), bool(x[i, 1] > -0.5)) for s, x in data.items() for i in range(len(x))]
    return data, spark.createDataFrame(rows, "series_id int, frame_index long, vec array<double>, value double, flag boolean").repartition(5)


@pytest.mark.parametrize("block", [7, 8, 16, 4096])
def test_smoothing_in_blocks(spark, block):
    data, df = series(spark, [7, 8, 9, 15, 16, 17, 40])
    got = {(r["series_id"], r["frame_index"]): r["vec"] for r in linear.smooth_over_time(df, block=block).collect()}
    assert set(got) == {(s, i) for s, x in data.items() for i in range(len(x))}
    for s, x in data.items():
        want = np.stack([polynomial(x[:, k], 7, 3) for k in range(x.shape[1])], axis=1)
        assert np.allclose(np.stack([got[s, i] for i in range(len(x))]), want)


def test_short_series(spark):
    _, df = series(spark, [6, 9])
    with pytest.raises(Exception, match="shorter than the window"):
        linear.smooth_over_time(df).collect()
    got = linear.smooth_series(df)
    assert got.columns == [*df.columns, "smoothed"] and {r["series_id"] for r in got.collect()} == {1}


@pytest.mark.parametrize("block", [3, 8, 2048])
def test_circular_smoothing_in_blocks(spark, block):
    data, df = series(spark, [1, 2, 5, 8, 9, 30])
    got = {(r["series_id"], r["frame_index"]): r["vec"] for r in windows.circular_smooth(df, 1.5, block=block).collect()}
    for s, x in data.items():
        for i in range(len(x)):
            want = sum(w * x[(i + k) % len(x)] for k, w in windows.gaussian_kernel(1.5))
            assert np.allclose(got[s, i], want)


@pytest.mark.parametrize("share", [3, 7, 80])
def test_rolling_maximum_by_share(spark, share):
    data, df = series(spark, [1, 2, 3, 20, 21, 23, 100, 161])
    got = {(r["series_id"], r["frame_index"]): r["rolled"] for r in windows.rolling_max(df, share).collect()}
    for s, x in data.items():
        n = len(x)
        size = max(1, n // share)
        for i in range(n):
            assert got[s, i] == x[max(0, i - size // 2) : i + size - size // 2, 0].max(), (s, i)
    assert len(got) == sum(map(len, data.values()))


@pytest.mark.parametrize("block", [4, None, 16384])
def test_runs_and_means_in_blocks(spark, block):
    data, df = series(spark, [1, 4, 30])
    runs = {(r["series_id"], r["frame_index"]): r["run_length"] for r in windows.run_lengths(df, block=block).collect()}
    means = {(r["series_id"], r["frame_index"]): r["rolled"] for r in windows.rolling_mean(df, 3, block=block).collect()}
    for s, x in data.items():
        flags = x[:, 1] > -0.5
        for i in range(len(x)):
            a = b = i
            while a and flags[a - 1] == flags[i]:
                a -= 1
            while b + 1 < len(x) and flags[b + 1] == flags[i]:
                b += 1
            assert runs[s, i] == b - a + 1
        assert np.allclose([means[s, i] for i in range(len(x))], rolled(x[:, 0], 3))


def test_near_signatures_in_cells(spark):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 16, (60, 4))
    words[30:] = words[:30] ^ (rng.random((30, 4)) < 0.5).astype(int)
    df = spark.createDataFrame([(i, i % 2, *map(int, w)) for i, w in enumerate(words)], "frame_index long, label int, s0 int, s1 int, s2 int, s3 int")
    bits = np.unpackbits(words.astype(">u2").view(np.uint8).reshape(60, -1), axis=1)
    want = {(i, j, d) for i in range(60) for j in range(i + 1, 60) for d in [int((bits[i] != bits[j]).sum())] if i % 2 == j % 2 and d <= 25}
    for cell in (5, 2048):
        assert {tuple(r) for r in joins.near_signatures(df, "label", 25, cell).collect()} == want


def test_every_file_with_every_model(spark):
    files = spark.createDataFrame([(i, f"h{i}") for i in range(5)], "id int, file_hash string")
    models = spark.createDataFrame([(i, f"m{i}") for i in range(300)] + [(0, "m0")], "model_index int, model_name string")
    got = joins.files_by_models(files, models)
    assert got.columns == ["id", "file_hash", "model_index", "output_name"]
    assert sorted(r["output_name"] for r in got.collect()) == sorted(f"network_m{m}_h{i}" for m in range(300) for i in range(5))
    assert joins.files_by_models(files, models.where("false")).count() == 0


def test_extension_points(spark):
    data, df = series(spark, [5, 9])

    def total(frames, length):
        return frames.select("series_id", "frame_index", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("value"))

    def even(frames, length):
        return total(frames, length).where("frame_index % 2 = 0")

    got = {(r["series_id"], r["frame_index"]): (r["t"], r["e"]) for r in extension.reduce_frames(df, 3, {"t": total, "e": even}).collect()}
    assert all(np.isclose(got[s, i][0], x[i].sum()) and (got[s, i][1] is None) == (i % 2 == 1) for s, x in data.items() for i in range(len(x)))
    index = df.select("series_id", "frame_index", (F.col("frame_index") % 2).cast("int").alias("model_index"))
    layer = lambda frames, length, index: frames.select("series_id", "frame_index", F.col("vec").alias("a_vec"), F.col("vec").alias("b_vec"), F.slice("vec", 1, 1).alias("combined"))
    assert extension.layer_frames(df, 3, index, layer).where("model_index = frame_index % 2 and size(combined) = 1").count() == 14
    longer = extension.map_vectors(df, lambda x: np.append(x, x.sum())).collect()
    assert all(np.isclose(r["vec"][3], sum(r["vec"][:3])) for r in longer)


def hashed_normal(frames, length, seed):
    """The generator's normal numbers: two modular hashes of frame * length + position, by Box and Muller."""

    def uniform(k, s):
        a = (k * 48271 + s * 69621 + 12345) % 2147483647
        a = (a * a + 97) % 2147483647
        return (a * 40692 + 7) % 2147483647

    return np.array([[np.sqrt(-2 * np.log((uniform(f * length + p, seed) + 1) / 2**31)) * np.cos(2 * np.pi * uniform(f * length + p, seed + 1) / 2**31) for p in range(length)] for f in range(frames)])


def wrapped_smooth(x, sigma):
    """Normal smoothing of the first axis through its transform of the wrapped kernel."""
    kernel, n, radius = np.zeros(len(x)), len(x), int(4 * sigma + 0.5)
    for k in range(-radius, radius + 1):
        kernel[k % n] += np.exp(-k * k / (2 * sigma * sigma))
    return np.fft.ifft(np.fft.fft(x, axis=0) * np.fft.fft(kernel / kernel.sum())[:, None], axis=0).real


@pytest.mark.parametrize(("n", "sigma"), [(150, 20.0), (37, 50.0)])
def test_gaussian_noise_is_smooth_and_of_unit_power(spark, n, sigma):
    frames = spark.range(n).select(F.lit(4).alias("series_id"), F.col("id").alias("frame_index"))
    rows = sorted(generators.gaussian_noise(frames, 8, sigma).collect(), key=lambda r: r["frame_index"])
    got = np.array([r["vec"] for r in rows])
    want = wrapped_smooth(hashed_normal(n, 8, 1234), sigma)
    assert np.isclose(np.mean(got**2), 1) and np.allclose(got, want / np.sqrt(np.mean(want**2)))


def test_blend_uses_smoothed_noise(spark):
    """The noise part of the flagship: what is left of its blend after the spectrum, against noise smoothed over 50 frames and scaled to -4 .. 4."""
    frames = frame_ops.split_signal(fx.evt(spark, SF), 64)
    rows = sorted(pipelines.noise_blend(frames, 64, 0.25, (-1.0, 1.0), 4).collect(), key=lambda r: r["frame_index"])
    noise = wrapped_smooth(hashed_normal(len(rows), 64, 1234), 50.0)
    noise /= np.sqrt(np.mean(noise**2))
    noise = (noise - noise.min()) / (noise.max() - noise.min()) * 8 - 4
    assert np.allclose([r["a_vec"] for r in rows], noise)
    assert np.allclose([r["combined"] for r in rows], 0.75 * noise + 0.25 * np.array([r["b_vec"] for r in rows]))


def test_overlay_bands_grow_with_the_image(spark):
    """A pixel grid of two image sizes around two boxes, by the definition."""
    boxes = [(1, 30, 40, 10, 6), (1, 90, 10, 4, 20), (2, 0, 0, 5, 5)]
    regions = spark.createDataFrame(boxes, "frame_index long, x int, y int, w int, h int")
    points = spark.createDataFrame([(f, x, y, 1, 0) for f in (1, 2, 3) for x in range(0, 120, 3) for y in range(0, 90, 2)], "frame_index long, x int, y int, fg int, bg int")
    for width, height in ((120, 90), (200, 40)):
        got = {(r["frame_index"], r["x"], r["y"]) for r in joins.overlay_points(points, regions, width, height).where("shown = 1").collect()}
        want = set()
        for f, x, y, w, h in boxes:
            for px in range(0, 120, 3):
                for py in range(0, 90, 2):
                    if x - 0.098 * height <= px <= x + w + 0.098 * height and abs(py - (y + h / 2)) <= 0.058 * width:
                        want.add((f, px, py))
        assert got == want


def test_small_sides_are_broadcast_only_below_a_bound(spark):
    series = fx.evtu(spark, SF)
    stats = series.groupBy("series_id").agg(F.avg("value").alias("m"))
    for most, kind in ((10_000, "BroadcastHashJoin"), (3, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            out = sides.join_small(series, stats, "series_id", most=most)
            assert kind in out._jdf.queryExecution().executedPlan().toString() and out.count() == series.count()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block", [3, 16, 100_000])
def test_rolling_maximum_from_blocks(spark, block):
    """Windows of many whole blocks, of part of one block, and cut off at both ends."""
    rng = np.random.default_rng(6)
    data = {s: rng.normal(size=n) for s, n in enumerate([1, 5, 90, 400])}
    frames = spark.createDataFrame([(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)], "series_id int, frame_index long, value double")
    for share in (2, 4, 80):
        got = {(r["series_id"], r["frame_index"]): r["m"] for r in windows.rolling_max(frames, share, out="m", block=block).collect()}
        want = {}
        for s, x in data.items():
            size = max(1, len(x) // share)
            for i in range(len(x)):
                want[s, i] = x[max(0, i - size // 2) : i + size - size // 2].max()
        assert got == want


@pytest.mark.parametrize("limit", [0, 3, 6, 9, 13, 15])
def test_signature_lookup_is_all_pairs(spark, limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 1 << 16, (12, 4))
    rows = []
    for i in range(150):
        word = base[i % 12].copy()
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            word[bit // 16] ^= 1 << (bit % 16)
        rows.append((i, i % 2, *word.tolist()))
    signed = spark.createDataFrame(rows, "frame_index long, label int, s0 int, s1 int, s2 int, s3 int")
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a[2:], b[2:], strict=True))
    want = sorted((a[0], b[0], apart(a, b)) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and apart(a, b) <= limit)
    assert len(want) > 5 or limit < 3
    for lookup in (0, 10**9, 75 if limit > 3 else 74):
        assert sorted(tuple(r) for r in joins.near_signatures(signed, "label", limit, cell=20, lookup_from=lookup).collect()) == want


@pytest.mark.parametrize("ratio", [2.5, 0.7, 0.125])
def test_resampling_in_blocks_is_resampling_at_once(spark, ratio):
    rng = np.random.default_rng(1)
    data = {s: rng.normal(size=n) for s, n in enumerate([1, 37, 900])}
    samples = spark.createDataFrame([(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)], "series_id int, sample_index long, value double").repartition(4)
    cut, reach = min(1, ratio), int(np.ceil(16 / min(1, ratio)))
    for block in (64, 65_536):
        got = {(r["series_id"], r["sample_index"]): r["value"] for r in pipelines.sinc_resample(samples, ratio, block=block).collect()}
        assert set(got) == {(s, t) for s, x in data.items() for t in range(int(len(x) * ratio))}
        for (s, t), v in got.items():
            x, mid = data[s], int(np.floor(t / ratio))
            d = (np.arange(mid - reach, mid + reach + 1) - t / ratio) * cut
            w = np.sinc(d) * np.where(np.abs(d) <= 16, 0.5 + 0.5 * np.cos(np.pi * d / 16), 0)
            inside = [(k, a) for k, a in zip(range(mid - reach, mid + reach + 1), w, strict=True) if 0 <= k < len(x)]
            assert abs(v - sum(a * x[k] for k, a in inside) / w.sum()) < 1e-8


def _shuffled(spark, run):
    """Rows that the stages of run() write to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    none, full = jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(jvm.double, 0)

    def written():
        store.listenerBus().waitUntilEmpty(30_000)
        found = store.statusStore().stageList(none, False, False, full, none)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = written()
    run()
    return written() - before


def _signed(spark, codes, frame="frame_index long"):
    words = [[int(c) >> s & 0xFFFF for s in (48, 32, 16, 0)] for c in codes]
    return spark.createDataFrame([(i, 0, *w) for i, w in enumerate(words)], f"{frame}, label int, s0 int, s1 int, s2 int, s3 int")


def test_signature_lookup_sends_few_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL", 4, raising=False)
    codes = np.random.default_rng(8).integers(0, 1 << 63, 240)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = [_shuffled(spark, _signed(spark, codes[:n]).transform(joins.near_signatures, "label", 15, lookup_from=0).collect) for n in (120, 240)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 16 * 240 <= sent[1] <= 18 * 240 and sent[1] <= 2 * sent[0]


@pytest.mark.parametrize("limit, lookup_from", [(6, None), (6, 0), (11, 0), (22, 0), (15, 0)])
def test_signature_lookup_in_pairs_of_parts(spark, monkeypatch, limit, lookup_from):
    monkeypatch.setattr(joins, "SMALL", 40)
    rng = np.random.default_rng(limit)
    codes = rng.integers(0, 1 << 63, 150, dtype=np.uint64) << np.uint64(1)
    codes[60:] = codes[rng.integers(0, 60, 90)] ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64))
    codes[120:] = codes[0]
    far = np.bitwise_count(codes[:, None] ^ codes[None])
    want = sorted((i, j, int(far[i, j])) for i in range(150) for j in range(i + 1, 150) if far[i, j] <= limit)
    assert sorted(map(tuple, joins.near_signatures(_signed(spark, codes), "label", limit, lookup_from=lookup_from).collect())) == want
    missing = _signed(spark, codes).withColumns({"s1": F.expr("if(frame_index = 7, null, s1)"), "label": F.expr("if(frame_index = 8, null, label)")})
    named = missing.withColumn("frame_index", F.format_string("%03d", "frame_index"))
    named = named.withColumn("frame_index", F.expr("if(frame_index = '009', null, frame_index)"))
    got = sorted((int(a), int(b), d) for a, b, d in joins.near_signatures(named, "label", limit, lookup_from=lookup_from).collect())
    assert got == [w for w in want if not {7, 8, 9} & set(w[:2])]


@pytest.mark.parametrize("limit", [2, 9, 15])
def test_lookup_inside_a_cell_is_comparison(monkeypatch, limit):
    monkeypatch.setattr(joins, "MOST_MET", 50)
    monkeypatch.setattr(joins, "STEP", 3)
    monkeypatch.setattr(joins, "ACROSS", 64)
    rng = np.random.default_rng(limit)
    a = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    b = np.concatenate([a[:70] ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64)), a[:40], np.repeat(a[:1], 90)])
    shares = joins.word_shares(limit)
    every = np.argwhere(np.bitwise_count(a[:, None] ^ b[None]) <= limit).tolist()
    for found in (joins._compared(a, b, limit), joins._looked_up(a, b, limit, shares, [joins._within(s) for s in shares])):
        assert sorted([int(i), int(j)] for left, right in found for i, j in zip(left, right, strict=True)) == every
    assert list(joins._compared(a[:0], b, limit)) == [] and not sum(len(i) for i, _ in joins._looked_up(a[:0], b, limit, shares, [joins._within(s) for s in shares]))
