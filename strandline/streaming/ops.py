"""Stream forms: bounded sources, forwarding sinks, disk tees, windowed power, run lengths and chunked scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from strandline.operators.joins import score_in_chunks


def frame_source(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 4) -> DataFrame:
    """A stream of the Parquet files below path, at most files_per_batch in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


Sink = Callable[[DataFrame, int], None]


def batch_folder(path: str, make: Callable[[DataFrame], DataFrame] | None = None) -> Sink:
    """A sink that writes each micro-batch (or what make gives for it) to a folder of its own below path, named by the batch's number.

    A batch that Spark runs again after a failure has the same number and replaces its folder, so path holds every row once. Read it with
    spark.read.parquet(path); batch_id is a column then.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch if make is None else make(batch)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def forward(stream: DataFrame, first: Sink, derived: Sink, counts: str | None = None) -> DataStreamWriter:
    """Each micro-batch goes to both sinks, with its number, and is computed once. counts: a folder that gets the rows of each batch by number."""

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows = batch.count()
            first(batch, batch_id)
            derived(batch, batch_id)
            if counts is not None:
                batch.sparkSession.range(1).select(F.lit(rows).cast("long").alias("rows")).coalesce(1).write.mode("overwrite").json(f"{counts}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(both)


def run_forward(stream: DataFrame, first: Sink, derived: Sink, checkpoint: str) -> int:
    """forward() over all that the source holds now; the rows passed on since the checkpoint began, over any number of batches and restarts.

    The rows of each batch are kept beside the checkpoint under the batch's number, so a batch that runs again counts once, and a restart
    that finds nothing new gives the same number. A source that never had a row is an error.
    """
    counts = f"{checkpoint.rstrip('/')}-rows"
    query = forward(stream, first, derived, counts).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(counts)
    rows = 0
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = spark.read.schema("rows long").json(counts).agg(F.sum("rows")).first()[0] or 0
    if not rows:
        raise ValueError("the source is empty")
    return rows


def tee(frames: DataFrame, copies: int) -> list[DataFrame]:
    """1 + copies DataFrames over one spilled result; the caller unpersists the first when done."""
    kept = frames.persist(StorageLevel.DISK_ONLY)
    return [kept, *(kept.select("*") for _ in range(copies))]


def windowed_rms(stream: DataFrame, window: str, late: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Root mean square by tumbling event-time window; rows later than the watermark are dropped."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    grouped = timed.groupBy(F.window("_ts", window).alias("w")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rms", "n")


def run_lengths(stream: DataFrame, key: str = "series_id") -> DataFrame:
    """Length of the run of true flags that ends at each frame, carried across micro-batches, for streams that deliver a series in order.

    In a batch the frames of a series are taken in frame order. A frame that comes after a later one of its series was counted is an error;
    ordered_run_lengths() takes such streams.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("frame_index")
        if last is not None and rows["frame_index"].iloc[0] <= last:
            raise ValueError(f"frame {rows['frame_index'].iloc[0]} of {k[0]} comes after frame {last}")
        out = []
        for flag in rows["flag"]:
            length = length + 1 if flag else 0
            out.append(length)
        state.update((length, int(rows["frame_index"].iloc[-1])))
        yield pd.DataFrame({key: k[0], "frame_index": rows["frame_index"].to_numpy(), "run_length": out})

    return stream.select(key, "frame_index", "flag").groupBy(key).applyInPandasWithState(step, f"{key} long, frame_index long, run_length long", "length long, last long", "append", GroupStateTimeout.NoTimeout)


def ordered_run_lengths(stream: DataFrame, late: str, ts: str = "ts", key: str = "series_id") -> DataFrame:
    """run_lengths() of a stream that may deliver frames out of order, in one batch or over several, by up to late of event time.

    ts must rise with frame_index inside a series. Frames wait in the state of their series until the watermark has passed them, which
    means that no earlier one can come any more, and leave in order; a timer wakes a series that gets no more frames. Frames later than
    that are dropped by the watermark. Waiting frames are those of the last late of a series, so state stays bounded; they come out once
    the stream has moved on by that much.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, frames, times, flags = state.get if state.exists else (0, [], [], [])
        rows = pd.DataFrame({"frame_index": list(frames), "ms": list(times), "flag": list(flags)})
        if not state.hasTimedOut:
            came = pd.concat(list(batches))
            rows = pd.concat([rows, pd.DataFrame({"frame_index": came["frame_index"], "ms": came["_ms"], "flag": came["flag"]})])
        rows = rows.sort_values("frame_index", kind="stable")
        out = rows["ms"].astype("int64") <= state.getCurrentWatermarkMs()
        ready, rows = rows[out], rows[~out]
        lengths = []
        for flag in ready["flag"]:
            length = length + 1 if flag else 0
            lengths.append(length)
        state.update((length, rows["frame_index"].astype("int64").tolist(), rows["ms"].astype("int64").tolist(), rows["flag"].astype(bool).tolist()))
        if len(rows):
            state.setTimeoutTimestamp(int(rows["ms"].min()))
        yield pd.DataFrame({key: pd.Series([k[0]] * len(ready), dtype="int64"), "frame_index": ready["frame_index"].astype("int64").to_numpy(), "run_length": pd.Series(lengths, dtype="int64")})

    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).select(key, "frame_index", "flag", "_ts", F.unix_millis("_ts").alias("_ms"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} long, frame_index long, run_length long", "length long, frames array<long>, times array<long>, flags array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def score_stream(stream: DataFrame, load: Callable[[int], Callable[[np.ndarray], np.ndarray]], path: str, salts: int = 8) -> DataStreamWriter:
    """Each micro-batch scored by score_in_chunks(), frames grouped by model inside it, and written by batch_folder(): a batch that runs again adds nothing."""
    return stream.writeStream.foreachBatch(batch_folder(path, lambda batch: score_in_chunks(batch, load, salts)))
