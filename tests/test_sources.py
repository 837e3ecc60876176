"""Sources and sinks on files that the tests write."""

import hashlib
import json
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import files, store


def png(path, width=4, height=4, cut=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(range(3 * width)) for _ in range(height))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    path.write_bytes(data if cut is None else data[:cut])


def wav(path, samples, rate=8000, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())


def test_wav_blocks(spark, tmp_path):
    wav(tmp_path / "a.wav", [-32768, 0, 32767])
    wav(tmp_path / "b.wav", [100, 300, -32768, -32768], channels=2)
    blocks = files.read_wavs(spark, str(tmp_path), block=2)
    a = [v for r in blocks.where("path like '%a.wav'").orderBy("block").collect() for v in r["samples"]]
    assert np.allclose(a, [-1, 2 * 32768 / 65535 - 1, 1])
    joined = files.joined_signal(blocks, 2).orderBy("sample_index").collect()
    assert [r["sample_index"] for r in joined] == [0, 1, 2, 3, 4] and np.isclose(joined[4]["value"], -1)
    wav(tmp_path / "c.wav", [1], rate=44100)
    with pytest.raises(ValueError, match="sample rates"):
        files.joined_signal(files.read_wavs(spark, str(tmp_path)))


def float_wav(path, samples, rate=8000, extensible=False):
    raw = np.asarray(samples, "<f4").tobytes()
    tag = struct.pack("<HHIIHH", 0xFFFE if extensible else 3, 1, rate, 4 * rate, 4, 32)
    form = tag + (struct.pack("<HHIH", 22, 32, 4, 3) + b"\0" * 14 if extensible else b"")
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(raw)) + raw
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


def test_float_wav_passes_through(spark, tmp_path):
    float_wav(tmp_path / "a.wav", [0.5, -0.25, 1.5])
    float_wav(tmp_path / "b.wav", [0.125], extensible=True)
    got = {r["path"][-5]: r["samples"] for r in files.read_wavs(spark, str(tmp_path)).collect()}
    assert got == {"a": [0.5, -0.25, 1.5], "b": [0.125]}
    (tmp_path / "c.wav").write_bytes(b"RIFFxxxxWAVEjunk")
    with pytest.raises(Exception, match="no samples"):
        files.read_wavs(spark, str(tmp_path), "c.wav").collect()


def test_a_long_wav_is_read_in_ranges(spark, tmp_path):
    """One recording by many tasks, each reading its own range, equal to the whole file read by one."""
    rng = np.random.default_rng(2)
    wav(tmp_path / "long.wav", rng.integers(-32768, 32768, 2 * 50_001), channels=2)
    wav(tmp_path / "none.wav", [])
    listed = spark.read.format("binaryFile").load(str(tmp_path))
    ranged = files.read_wavs(spark, str(tmp_path), block=1000, range_bytes=16_000)
    tasks = {r["t"] for r in ranged.select(F.spark_partition_id().alias("t")).distinct().collect()}
    key = lambda df: sorted((r["path"], r["block"], r["channels"], r["samples"]) for r in df.collect())
    assert key(ranged) == key(files._read_whole(listed, 1000)) and len(tasks) > 5
    assert ranged.agg(F.sum(F.size("samples"))).first()[0] == 50_001


def test_load_signal(spark, tmp_path):
    rng = np.random.default_rng(3)
    x, y = rng.integers(-9000, 9000, 500), rng.integers(-9000, 9000, 300)
    wav(tmp_path / "z.wav", x), wav(tmp_path / "a.wav", y)
    paths = [str(tmp_path / "z.wav"), str(tmp_path / "a.wav")]
    got = files.load_signal(spark, paths, 64, count=25).orderBy("sample_index").toPandas()
    whole = (np.concatenate([x, y]) + 32768.0) / 65535 * 2 - 1
    assert len(got) == 1600 and set(got["sample_rate"]) == {8000} and np.allclose(got["value"][0:1600:2], whole, atol=1e-9)
    slow = files.load_signal(spark, paths, 64, fps=30).orderBy("sample_index").toPandas()
    assert len(slow) == -(-int(800 * 1920 / 8000) // 64) * 64 and (slow["value"][192:] == 0).all()
    assert files.load_signal(spark, paths, 64, fps=30, pad=False).count() == 192
    for wrong in ({}, {"fps": 1, "count": 1}):
        with pytest.raises(ValueError):
            files.load_signal(spark, paths, 64, **wrong)


def test_records(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"model_path": "m", "model_hash": "h", "image_path": "i", "image_hash": "j", "vector": [[1.0, 2.0]]}))
    (tmp_path / "1.json").write_text(json.dumps({"version": 1, "model_path": "m1", "model_hash": "h", "image_path": "i", "image_hash": "j", "vector": [3.0]}))
    (tmp_path / "2.json").write_text(json.dumps({"version": 2, "network_path": "n", "network_hash": "h", "image_path": "i", "image_hash": "j", "vector": [4.0]}, indent=1))
    got = {r["version"]: r for r in files.read_records(spark, str(tmp_path / "*.json")).collect()}
    assert got[0]["vec"] == [1.0, 2.0] and got[1]["network_path"] == "m1" and got[2]["network_path"] == "n"
    files.write_records(files.read_records(spark, str(tmp_path / "2.json")), str(tmp_path / "out"))
    assert {r["version"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {2}


def test_catalogue_and_manifests(spark, tmp_path):
    for n in ("b.pkl", "a.pkl", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "list.json").write_text(json.dumps(["z.pkl", "z.pkl"]))
    got = files.model_catalogue(spark, str(tmp_path), ["p.pkl"], str(tmp_path / "list.json")).orderBy("model_index").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in got] == ["a.pkl", "b.pkl", "p.pkl", "z.pkl", "z.pkl"]
    with pytest.raises(ValueError):
        files.model_catalogue(spark)
    assert files.batch_manifest(spark, str(tmp_path), "txt", "/o", "p_").first()["destination"] == "/o/p_c.hdf5"
    assert files.batch_manifest(spark, None, None, None, None).count() == 0
    with pytest.raises(ValueError):
        files.batch_manifest(spark, "x", None, None, None)
    assert files.hashed_files(spark, str(tmp_path), "a.pkl").first()["md5"] == hashlib.md5(b"a.pkl").hexdigest()


def test_images(spark, tmp_path):
    png(tmp_path / "good.png")
    png(tmp_path / "half.png", 64, 64, cut=60)
    (tmp_path / "junk.png").write_bytes(b"junk")
    assert files.images(spark, str(tmp_path), "*.png").count() == 1
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in files.broken_images(spark, str(tmp_path)).collect()) == ["half.png", "junk.png"]


def test_store(spark, tmp_path):
    frames = spark.range(6).select((F.col("id") % 2).alias("projection_id"), (F.col("id") / 2).cast("long").alias("frame_index"), F.array(F.col("id").cast("double")).alias("latent"))
    attributes = spark.range(2).select(F.col("id").alias("projection_id"), F.lit(False).alias("complete"))
    store.write_store(str(tmp_path / "s"), attributes, frames, frames.withColumn("step", F.lit(0)))
    assert store.read_store(spark, str(tmp_path / "s")).where("projection_id = 1 and frame_index = 2").first()["latent"] == [5.0]
    assert all(r["complete"] for r in store.read_store(spark, str(tmp_path / "s"), "projections").collect())
    open_one = str(tmp_path / "open")
    writer = store.begin_store(open_one, attributes.withColumn("model_md5_hash", F.lit("h")))
    writer.add(frames)
    assert {(r["complete"], r["network_md5_hash"]) for r in store.read_store(spark, open_one, "projections").collect()} == {(False, "h")}
    writer.finish(attributes.where("projection_id = 1"))
    assert {r["projection_id"]: r["complete"] for r in store.read_store(spark, open_one, "projections").collect()} == {0: False, 1: True}
    names = spark.createDataFrame([("x_10",), ("x_9",)], "name string")
    assert [r["name"] for r in store.item_order(names).collect()] == ["x_9", "x_10"]


def state(spark, path):
    """({projection: complete}, {(projection, frame): latent}) as a reader sees them."""
    complete = {r["projection_id"]: r["complete"] for r in store.read_store(spark, path, "projections").collect()}
    rows = store.read_store(spark, path).collect()
    frames = {(r["projection_id"], r["frame_index"]): r["latent"][0] for r in rows}
    assert len(frames) == len(rows)
    return complete, frames


def test_store_is_written_twice(spark, tmp_path):
    """A second write of some projections replaces them, and is not complete before its end."""
    path = str(tmp_path / "s")
    make = lambda ids, value: spark.createDataFrame([(p, f, [value]) for p in ids for f in range(3)], "projection_id long, frame_index long, latent array<double>")
    attributes = lambda ids: spark.createDataFrame([(p, "h") for p in ids], "projection_id long, network_md5_hash string")
    store.write_store(path, attributes([0, 1, 2]), make([0, 1, 2], 1.0), make([0, 1, 2], 1.0).withColumn("step", F.lit(0)))
    before = state(spark, path)
    assert before == ({0: True, 1: True, 2: True}, {(p, f): 1.0 for p in range(3) for f in range(3)})
    writer = store.begin_store(path, attributes([1, 5]))
    assert state(spark, path)[0] == {0: True, 1: False, 2: True, 5: False}
    writer.add(make([1], 2.0), part="a")
    writer.add(make([1], 3.0), part="a")  # the same part again: a retried job
    complete, frames = state(spark, path)
    assert not complete[1] and {v for (p, _), v in frames.items() if p == 1} == {3.0} and len(frames) == 9
    writer.add(make([5], 4.0))
    writer.finish()
    complete, frames = state(spark, path)
    assert all(complete.values()) and frames == {(p, f): {0: 1.0, 1: 3.0, 2: 1.0, 5: 4.0}[p] for p in (0, 1, 2, 5) for f in range(3)}
    assert {r["projection_id"] for r in store.read_store(spark, path, "steps").collect()} == {0, 2}


def test_broken_writes_leave_no_trace_in_finished_projections(spark, tmp_path):
    path = str(tmp_path / "s")
    attributes = spark.createDataFrame([(7, "h")], "projection_id long, network_md5_hash string")
    good = spark.createDataFrame([(7, 0, [1.0])], "projection_id long, frame_index long, latent array<double>")
    with pytest.raises(ValueError, match="no store"):
        store.read_store(spark, path)
    broken = store.begin_store(path, attributes)
    with pytest.raises(Exception, match="broken"):
        broken.add(good.withColumn("latent", F.array(F.raise_error(F.lit("broken")).cast("double"))))
    assert {r["complete"] for r in store.read_store(spark, path, "projections").collect()} == {False}
    store.begin_store(path, attributes).add(good)
    store.write_store(path, attributes, good)
    assert state(spark, path) == ({7: True}, {(7, 0): 1.0})
    assert [c["version"] for c in store.commits(spark, path)] == [1, 2, 3, 4]
    assert len(store.vacuum_store(spark, path)) == 2 and state(spark, path) == ({7: True}, {(7, 0): 1.0})


def test_writers_take_different_versions(spark, tmp_path, monkeypatch):
    """Two writers that both read the same last commit: the second one finds its number taken and goes on to the next."""
    path = str(tmp_path / "s")
    attributes = lambda p: spark.createDataFrame([(p, "h")], "projection_id long, network_md5_hash string")
    store.begin_store(path, attributes(1))
    stale = store.commits(spark, path)
    store.begin_store(path, attributes(2))
    monkeypatch.setattr(store, "commits", lambda *_: stale)
    late = store.begin_store(path, attributes(3))
    monkeypatch.undo()
    assert [c["version"] for c in store.commits(spark, path)] == [1, 2, 3] and store.commits(spark, path)[2]["attempt"] == late.attempt
