"""Golden cases and numpy differentials of the frame operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalar as S
from strandline.operators import frames, generators, linear, pipelines, selection, windows

# A 19-value series, and the rows kept for (threshold, least run).
SERIES = [0, 0, 0, 5, 10, 10, 10, 5, 0, 0, 0, 10, 11, 12, 11, 10, 5, 0, 0]


def series(spark, values, cast=float):
    return spark.createDataFrame([(0, i, cast(v)) for i, v in enumerate(values)], "series_id int, frame_index long, value double")


def vectors(spark, x):
    return spark.createDataFrame([(0, i, [float(v) for v in row]) for i, row in enumerate(x)], "series_id int, frame_index long, vec array<double>")


def matrix(df):
    return np.array([r["vec"] for r in df.orderBy("series_id", "frame_index").collect()])


@pytest.mark.parametrize("threshold,least", [(4, 6), (4, 3), (10, 4), (10, 3)])
def test_long_tracks(spark, threshold, least):
    got = windows.keep_long_tracks(series(spark, SERIES).withColumn("flag", F.col("value") >= threshold), least).orderBy("frame_index").collect()
    flags, want = [v >= threshold for v in SERIES], []
    for i, f in enumerate(flags):
        a = b = i
        while a > 0 and flags[a - 1] == f:
            a -= 1
        while b + 1 < len(flags) and flags[b + 1] == f:
            b += 1
        want.append(f and b - a + 1 >= least)
    assert [r["kept"] for r in got] == want


@pytest.mark.parametrize("values,slope", [([7 - 0.5 * i for i in range(23)], -0.5), ([3.25 * i + 1 for i in range(8)], 3.25), ([float("nan"), None] * 7, 0.0)])
def test_slopes(spark, values, slope):
    got = linear.derive_series(series(spark, values, lambda v: v if v is None else float(v))).collect()
    assert len(got) == len(values) and np.allclose([r["slope"] for r in got], slope)


@pytest.mark.parametrize("length,count,out", [(12, 3, 36), (9, 1, 270)])
def test_resample_passes_through(spark, length, count, out):
    x = np.sin(np.arange(length * count)).reshape(count, length)
    y = matrix(linear.apply_matrix(vectors(spark, x), linear.resample_matrix(length, out)))
    assert np.abs(y[:, :: out // length] - x).max() < 0.5 and abs(y.max() - x.max()) < 0.2


def test_resample_matches_identity_and_constant():
    assert np.allclose(linear.resample_matrix(16, 16), np.eye(16))
    assert np.allclose(linear.resample_matrix(64, 24).sum(axis=1), 1) and np.allclose(linear.resample_matrix(31, 64).sum(axis=1), 1)


def test_cubic_reproduces_cubics():
    x = np.arange(12.0)
    at = np.linspace(0, 11, 40)
    assert np.allclose(linear.cubic_matrix(12, 40) @ (x**3 - 4 * x**2 + x), at**3 - 4 * at**2 + at)


def test_smoothing_weights():
    assert np.allclose(linear.fit_matrix(7, 3)[3] * 21, [-2, 3, 6, 7, 6, 3, -2])


def test_native_and_arrow_forms_agree(spark):
    x = np.random.default_rng(0).normal(size=(20, 16))
    m = linear.smoothing_matrix(16, 5, 3)
    assert np.allclose(matrix(linear.apply_matrix(vectors(spark, x), m)), x @ m.T, atol=1e-9)
    assert np.allclose(matrix(linear.apply_matrix_native(vectors(spark, x), m)), x @ m.T, atol=1e-9)


def test_smooth_over_time_is_the_matrix(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    assert np.allclose(matrix(linear.smooth_over_time(vectors(spark, x), 7, 3)), linear.smoothing_matrix(30, 7, 3) @ x, atol=1e-9)


def test_block_windows_equal_series_windows(spark):
    x = series(spark, np.random.default_rng(2).normal(size=101))
    pick = lambda df: [r["rolled"] for r in df.orderBy("frame_index").collect()]
    for block in (7, 50):
        assert np.allclose(pick(windows.rolling_max(x, size=8)), pick(windows.rolling_max(x, size=8, block=block)))
        assert np.allclose(pick(windows.rolling_mean(x, 3)), pick(windows.rolling_mean(x, 3, block=block)))
    total = [r["total"] for r in windows.running_total(x, block=9).orderBy("frame_index").collect()]
    assert np.allclose(total, np.cumsum([r["value"] for r in x.orderBy("frame_index").collect()]))


def test_circular_smoothing_wraps(spark):
    x = np.random.default_rng(3).normal(size=(5, 2))
    want = sum(w * np.roll(x, k, axis=0) for k, w in windows.gaussian_kernel(3.0))
    assert np.allclose(matrix(windows.circular_smooth(vectors(spark, x), 3.0)), want)


def test_split_and_pad(spark):
    samples = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "series_id int, sample_index long, value double")
    assert matrix(frames.split_signal(samples, 4)).tolist() == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 0, 0]]
    with pytest.raises(Exception, match="multiple"):
        frames.split_signal(samples, 4, pad=False).collect()


def test_rates(spark):
    x = vectors(spark, np.arange(52)[:, None])
    assert [frames.reduce_rate(x, 30, r).count() for r in (30, 15, 7.5)] == [52, 26, 13]
    with pytest.raises(ValueError):
        frames.reduce_rate(x, 30, 15.1)


def test_interpolation(spark):
    x = np.random.default_rng(4).normal(size=(9, 3))
    want = np.stack([np.interp(np.linspace(0, 8, 20), np.arange(9), x[:, k]) for k in range(3)], axis=1)
    assert np.allclose(matrix(frames.interpolate_frames(vectors(spark, x), 20)), want)


def test_names(spark):
    name = "june_3_harbour_take_2_06-03-2022_09-17-05-250013"
    assert spark.range(1).select(S.capture_time(F.lit(name)).cast("string")).first()[0] == "2022-06-03 09:17:05.250013"


@pytest.mark.parametrize("ratio", [3.0, 1.25, 0.4, 0.15, 7])
def test_resampled_length_and_tone(spark, ratio):
    n = 400
    samples = spark.createDataFrame([(0, i, float(np.sin(i / 40))) for i in range(n)], "series_id int, sample_index long, value double")
    got = pipelines.sinc_resample(samples, ratio, block=97).orderBy("sample_index").collect()
    assert [r["sample_index"] for r in got] == list(range(int(n * ratio)))
    inner = [(r["sample_index"], r["value"]) for r in got if n * ratio * 0.45 < r["sample_index"] < n * ratio * 0.55]
    if ratio >= 0.3:
        assert max(abs(v - np.sin(i / ratio / 40)) for i, v in inner) < 0.02


def test_generators(spark):
    assert matrix(generators.line_sweep(spark, 0, 9, 10, 10)).tolist() == [[float(k)] * 10 for k in range(10)]
    assert generators.horizontal_sweep(spark, 20, 3).count() == 10 and matrix(generators.horizontal_sweep(spark, 20, 3))[4][4:8].tolist() == [10.0] * 4
    assert matrix(generators.vertical_sweep(spark, 8, 2, 3))[:, 3].tolist() == list(range(-10, 10))
    z = matrix(generators.noise_like(vectors(spark, np.zeros((200, 1))), 32))
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05


@pytest.mark.parametrize("target", [4, 6])
@pytest.mark.parametrize("counts", [(2, 3, 4, 1), (0, 5, 2, 2), (5, 0, 3, 0), (1, 9, 0, 4), (0, 0, 0, 8)])
def test_tiered_selection(spark, counts, target):
    """Counts of matches and others in the primary and in the other directory; targets that cut a tier."""
    rows = []
    for group, n in enumerate(counts):
        for _ in range(n):
            i = len(rows)
            rows.append((i, 0 if group < 2 else 3, f"x_s1_07-14-2022_09-05-{i:02d}-000000.jpeg", group % 2 == 0))
    catalogue = spark.createDataFrame(rows, "event_id long, dir_no int, name string, has_face boolean")
    got = selection.select_in_tiers(catalogue, target).collect()
    assert len(got) == len({r["event_id"] for r in got}) == min(target, len(rows))
    assert [r["tier"] for r in got] == sorted(r["tier"] for r in got)
    faces = [r["event_id"] for r in got if r["has_face"]]
    assert faces == [r[0] for r in rows if r[3]][:target]
    near = {r[0] for r in rows if not r[3] and any(f[3] and f[1] == r[1] and abs(f[0] - r[0]) <= 2 for f in rows)}
    left = target - len(faces)
    assert {r["event_id"] for r in got if r["tier"] == 3} <= near and sum(r["tier"] == 3 for r in got) == min(left, len(near))


def test_runs_across_blocks(spark):
    rng = np.random.default_rng(11)
    flags = [None if v == 0 else bool(v > 3) for v in rng.integers(0, 7, 60)] + [True] * 40 + [False] + [True] * 2
    rows = [(s, i, f) for s in (0, 1) for i, f in enumerate(flags[s * 7 :]) if not 20 <= i < 33] + [(2, 4095, True), (2, 4096, True)]
    df = spark.createDataFrame(rows, "series_id int, frame_index long, flag boolean")
    whole = sorted(map(tuple, windows.run_lengths(df).collect()))
    for block in (1, 5, 4096):
        got = windows.run_lengths(df, block=block).select("series_id", "frame_index", "flag", "run_length")
        assert sorted(map(tuple, got.collect())) == whole
    kept = windows.keep_long_tracks(df.where("series_id = 2"), 2, block=4096).collect()
    assert len(kept) == 2 and all(r["kept"] for r in kept)


def test_places_cover_the_whole_table(spark):
    from strandline.plans import catalogue_queries as q
    from strandline.plans import fixtures as fx

    cat = fx.cat(spark, "/root/testdata/sf0.01")
    for f, rows in ((q.o1_capture_sorted_all, cat.where("has_face")), (q.o2_natural_sort_all, cat), (q.o5_shuffled_all, cat), (q.o6_path_sort_all, cat)):
        got = sorted(r["place"] for r in f(spark, "/root/testdata/sf0.01").select("place").collect())
        assert got == list(range(1, rows.count() + 1)) and len(got) > 500
