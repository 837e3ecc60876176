"""Stream forms give what the batch forms give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import joins, windows
from strandline.streaming import ops


def write_parts(frames, path, parts):
    for lo, hi in parts:
        frames.where((F.col("frame_index") >= lo) & (F.col("frame_index") < hi)).coalesce(1).write.mode("append").parquet(path)


def drain(writer, checkpoint):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)


def flags(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(s, i, bool(rng.random() < 0.7)) for s in range(3) for i in range(40)], "series_id long, frame_index long, flag boolean")


def test_run_lengths(spark, tmp_path):
    src = flags(spark)
    write_parts(src, str(tmp_path / "in"), [(0, 13), (13, 40)])
    stream = ops.frame_source(spark, str(tmp_path / "in"), src.schema, 1)
    drain(ops.run_lengths(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "c"))
    got = {(r["series_id"], r["frame_index"]): r["run_length"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = windows.run_lengths(src).where("flag").groupBy("series_id").agg(F.max("run_length").alias("m")).collect()
    assert len(got) == 120
    assert {r["series_id"]: r["m"] for r in batch} == {s: max(v for (k, _), v in got.items() if k == s) for s in range(3)}


def test_windowed_rms(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value", F.col("event_id").alias("frame_index"))
    write_parts(events, str(tmp_path / "in"), [(0, 400), (400, 10**9)])
    out = ops.windowed_rms(ops.frame_source(spark, str(tmp_path / "in"), events.schema, 1), "1 day", "1 hour")
    drain(out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "c"))
    want = {r["d"]: r["rms"] for r in events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).agg(F.sqrt(F.avg(F.col("value") ** 2)).alias("rms")).collect()}
    got = {r["start"]: r["rms"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and all(abs(want[k] - v) < 1e-9 for k, v in got.items())


def test_forward_tee_and_score(spark, tmp_path):
    src = flags(spark)
    write_parts(src, str(tmp_path / "in"), [(0, 20), (20, 40)])
    stream = ops.frame_source(spark, str(tmp_path / "in"), src.schema, 1)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    drain(ops.forward(stream, ops.batch_folder(a), ops.batch_folder(b, lambda d: d.where("flag"))), str(tmp_path / "c"))
    assert spark.read.parquet(a).count() == 120 and spark.read.parquet(b).count() == src.where("flag").count()
    for n in (1, 3):
        copies = ops.tee(src, n)
        assert len(copies) == n + 1 and all(c.exceptAll(src).count() == 0 for c in copies)
        copies[0].unpersist()


def test_an_empty_source_is_an_error(spark, tmp_path):
    src = flags(spark)
    write_parts(src, str(tmp_path / "in"), [(0, 20), (20, 40)])
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks = ops.batch_folder(a), ops.batch_folder(b)
    assert ops.run_forward(ops.frame_source(spark, str(tmp_path / "in"), src.schema, 1), *sinks, str(tmp_path / "c")) == 120
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 120
    src.where("false").write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="empty"):
        ops.run_forward(ops.frame_source(spark, str(tmp_path / "none"), src.schema, 1), *sinks, str(tmp_path / "c2"))


def test_scoring_a_stream_is_scoring_in_chunks(spark, tmp_path):
    src = spark.range(60).select(F.lit(0).alias("series_id"), F.col("id").alias("frame_index"), (F.col("id") % 3).cast("int").alias("model_index"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    write_parts(src, str(tmp_path / "in"), [(0, 25), (25, 60)])
    load = lambda m: lambda x: x @ np.array([[m + 1.0, 2.0], [0.5, m]])
    drain(ops.score_stream(ops.frame_source(spark, str(tmp_path / "in"), src.schema, 1), load, str(tmp_path / "s")), str(tmp_path / "c"))
    want = sorted(map(str, joins.score_in_chunks(src, load).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "s")).select("series_id", "frame_index", "model_index", "scores").collect())) == want


def forget_last_commit(checkpoint):
    """What a checkpoint looks like if the driver is lost after a batch's sinks ran and before it was committed: that batch runs again."""
    commits = sorted((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (checkpoint / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)


def test_a_batch_that_runs_again_adds_no_row(spark, tmp_path):
    src, a, b, c = flags(spark), str(tmp_path / "a"), str(tmp_path / "b"), tmp_path / "c"
    write_parts(src, str(tmp_path / "in"), [(0, 10), (10, 20), (20, 40)])
    stream = lambda: ops.frame_source(spark, str(tmp_path / "in"), src.schema, 1)
    run = lambda: ops.run_forward(stream(), ops.batch_folder(a), ops.batch_folder(b, lambda d: d.where("flag")), str(c))
    assert run() == 120
    assert run() == 120  # nothing new is no empty source
    forget_last_commit(c)
    ran = []
    assert ops.run_forward(stream(), lambda d, i: (ran.append(i), ops.batch_folder(a)(d, i)), ops.batch_folder(b, lambda d: d.where("flag")), str(c)) == 120
    assert ran == [2]
    assert spark.read.parquet(a).count() == 120 and spark.read.parquet(b).count() == src.where("flag").count()


def test_rows_of_many_batches_are_counted(spark, tmp_path):
    """More batches than a query keeps progress reports of."""
    src = flags(spark)
    write_parts(src, str(tmp_path / "in"), [(i, i + 8) for i in range(0, 40, 8)])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        nothing = lambda d, i: None
        assert ops.run_forward(ops.frame_source(spark, str(tmp_path / "in"), src.schema, 1), nothing, nothing, str(tmp_path / "c")) == 120
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_scores_of_a_batch_that_runs_again(spark, tmp_path):
    src = spark.range(30).select(F.lit(0).alias("series_id"), F.col("id").alias("frame_index"), (F.col("id") % 2).cast("int").alias("model_index"), F.array(F.col("id").cast("double")).alias("vec"))
    write_parts(src, str(tmp_path / "in"), [(0, 10), (10, 30)])
    load = lambda m: lambda x: x * (m + 1)
    for _ in range(2):
        drain(ops.score_stream(ops.frame_source(spark, str(tmp_path / "in"), src.schema, 1), load, str(tmp_path / "s")), str(tmp_path / "c"))
        forget_last_commit(tmp_path / "c")
    assert sorted(r["frame_index"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == list(range(30))


def test_run_lengths_of_a_shuffled_stream(spark, tmp_path):
    """Frames that come up to ten seconds late, over several batches, against the batch form; a far later frame of each series moves the watermark."""
    rng = np.random.default_rng(11)
    rows = [(s, i, bool(rng.random() < 0.7), 1_600_000_000 + 2 * i) for s in range(3) for i in range(60)]
    order = np.argsort([r[3] + rng.uniform(0, 9) for r in rows])
    shuffled = [rows[i] for i in order]
    kind = "series_id long, frame_index long, flag boolean, sec long"
    made = lambda part: spark.createDataFrame(part, kind).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    for k in range(0, 180, 30):
        made(shuffled[k : k + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made([(9, 0, False, 1_600_000_000 + 100_000)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ops.frame_source(spark, str(tmp_path / "in"), made(rows).schema, 1)
    drain(ops.ordered_run_lengths(stream, "10 seconds").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "c"))
    want = {}
    for s in range(3):
        length = 0
        for _, i, flag, _ in sorted(r for r in rows if r[0] == s):
            length = length + 1 if flag else 0
            want[s, i] = length
    got = [(r["series_id"], r["frame_index"], r["run_length"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["series_id"] != 9]
    assert len(got) == 180 and {(s, i): v for s, i, v in got} == want


def test_run_lengths_say_when_frames_come_out_of_order(spark, tmp_path):
    src = flags(spark)
    write_parts(src, str(tmp_path / "in"), [(13, 40), (0, 13)])
    with pytest.raises(Exception, match="comes after frame"):
        drain(ops.run_lengths(ops.frame_source(spark, str(tmp_path / "in"), src.schema, 1)).writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "c"))
