"""Extension points: what a caller's own function must look like, and the operators that take one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FrameReducer(Protocol):
    """Frames (series_id, frame_index, vec) to one value a frame: series_id, frame_index, value, and further columns as layers."""

    def __call__(self, frames: DataFrame, length: int) -> DataFrame: ...


class FrameLayer(Protocol):
    """Frames and the model number of each (series_id, frame_index, model_index) to frames with columns a_vec, b_vec and combined."""

    def __call__(self, frames: DataFrame, length: int, index: DataFrame) -> DataFrame: ...


class StepFunction(Protocol):
    """(projection, frame, step, latent) of one step of a history to a row, or None for no row. It runs in the tasks."""

    def __call__(self, projection_id: int, frame_index: int, step: int, latent: np.ndarray) -> tuple | None: ...


VectorFunction = Callable[[np.ndarray], np.ndarray]


def reduce_frames(frames: DataFrame, length: int, reducers: dict[str, FrameReducer]) -> DataFrame:
    """(series_id, frame_index) and the value of each reducer under its name; frames that a reducer leaves out have a null there."""
    out = frames.select("series_id", "frame_index")
    for name, reducer in reducers.items():
        out = out.join(reducer(frames, length).select("series_id", "frame_index", F.col("value").alias(name)), ["series_id", "frame_index"], "left")
    return out


def layer_frames(frames: DataFrame, length: int, index: DataFrame, layer: FrameLayer) -> DataFrame:
    """layer's frames with the model number of each."""
    made = layer(frames, length, index)
    return made.select("series_id", "frame_index", "a_vec", "b_vec", "combined").join(index.select("series_id", "frame_index", "model_index"), ["series_id", "frame_index"])


def for_each_step(steps: DataFrame, function: StepFunction, schema: str) -> DataFrame:
    """The rows (of schema) that function gives for the steps of all histories, in the tasks that hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [function(*key, np.asarray(latent)) for *key, latent in pdf.itertuples(index=False)]
            yield pd.DataFrame([r for r in rows if r is not None], columns=names)

    names = [part.split()[0] for part in schema.split(",")]
    return steps.select("projection_id", "frame_index", "step", "latent").mapInPandas(run, schema)


def map_vectors(frames: DataFrame, function: VectorFunction, vec: str = "vec") -> DataFrame:
    """frames with function applied to each vector; the result may be of another length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(vec)
            made = [np.asarray(function(np.asarray(v.values, np.float64)), np.float64) for v in batch.column(at)]
            ends = np.cumsum([0, *map(len, made)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made) if made else np.zeros(0)))
            yield batch.set_column(at, vec, lists)

    return frames.mapInArrow(run, frames.schema)
