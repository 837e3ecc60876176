"""The projection store: attributes, frames and step histories as Parquet, made visible by a log of commits.

    store/log/000000000001.json                       {"attempt": ..., "table": ...}: one file a commit, never changed
    store/attributes/<attempt>-<n>                    the attribute rows that a commit makes valid, with complete
    store/frames/attempt=<attempt>/part=<part>        frames of one write, by projection_id
    store/steps/attempt=<attempt>/part=<part>         step histories of one write, by projection_id

The latest commit that has a projection decides which attempt it is read from. So a second write of a projection replaces the first one and
never adds to it, a write that breaks off leaves a projection that isn't complete, and a part that is written again takes its own place.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.sources.shared import delete

#: Names of attributes in stores of version 1, and what they are now.
RENAMED = {"model_md5_hash": "network_md5_hash", "original_model_path": "original_network_path"}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits of a store in order: version, attempt and table. There is one for each begin and finish, so the list is the driver's."""
    at, fs = _file_system(spark, f"{path}/log")
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.endswith(".json"):
            stream = fs.open(status.getPath())
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found.append({"version": int(name[:-5]), **json.loads(text)})
    return sorted(found, key=lambda c: c["version"])


def _commit(spark: SparkSession, path: str, attempt: str, table: str) -> int:
    """Add a commit behind the last one. The file is created only if it isn't there; of two writers the later one takes the next number.

    The text goes to a file of its own first and is renamed, so that no reader sees half a commit.
    """
    at, fs = _file_system(spark, f"{path}/log/.{uuid.uuid4().hex}")
    stream = fs.create(at, True)
    try:
        stream.write(json.dumps({"attempt": attempt, "table": table}).encode())
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.isAbsolute() and at.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    version = max([c["version"] for c in commits(spark, path)], default=0) + 1
    none = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log/{version:012d}.json")
        try:
            context.rename(fs.makeQualified(at), fs.makeQualified(target), none)  # refuses to replace a file
            return version
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            version += 1


class StoreWriter:
    """One attempt at writing projections. begin() has made it the one that is read; add() may be repeated; finish() makes it complete."""

    def __init__(self, spark: SparkSession, path: str, attempt: str):
        self.spark, self.path, self.attempt, self._parts, self._tables = spark, path, attempt, 0, 0

    def _say(self, attributes: DataFrame) -> None:
        self._tables += 1
        table = f"attributes/{self.attempt}-{self._tables}"
        attributes.write.parquet(f"{self.path}/{table}")
        _commit(self.spark, self.path, self.attempt, table)

    def add(self, frames: DataFrame, steps: DataFrame | None = None, part: str | None = None) -> None:
        """Frames, and histories if there are any. A part (by default the next number) that is written once more replaces what it held."""
        self._parts += 1
        part = f"{self._parts:06d}" if part is None else part
        for name, rows in (("frames", frames), ("steps", steps)):
            if rows is not None:
                rows.write.mode("overwrite").partitionBy("projection_id").parquet(f"{self.path}/{name}/attempt={self.attempt}/part={part}")

    def finish(self, only: DataFrame | None = None) -> None:
        """complete becomes true for all projections of the attempt, or for those in only (projection_id)."""
        done = self.spark.read.parquet(f"{self.path}/attributes/{self.attempt}-1").withColumn("complete", F.lit(True))
        self._say(done if only is None else done.join(only.select("projection_id").distinct(), "projection_id", "left_semi"))


def begin_store(path: str, projections: DataFrame) -> StoreWriter:
    """Start to write projections (attribute rows): from now on they are read from this attempt, and aren't complete."""
    writer = StoreWriter(projections.sparkSession, path, uuid.uuid4().hex)
    writer._say(projections.withColumn("complete", F.lit(False)))
    return writer


def write_store(path: str, projections: DataFrame, frames: DataFrame, steps: DataFrame | None = None) -> None:
    """The whole sequence: begin, frames and histories, finish."""
    writer = begin_store(path, projections)
    writer.add(frames, steps)
    writer.finish()


def _current(spark: SparkSession, path: str) -> DataFrame:
    """Of each projection, its attributes, complete and attempt after the latest commit that has it."""
    out = None
    for c in commits(spark, path):
        rows = spark.read.parquet(f"{path}/{c['table']}")
        rows = rows.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in rows.columns and v not in rows.columns})
        rows = rows.withColumn("attempt", F.lit(c["attempt"])).withColumn("_version", F.lit(c["version"]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"{path} holds no store")
    latest = F.row_number().over(Window.partitionBy("projection_id").orderBy(F.desc("_version")))
    return out.withColumn("_place", latest).where("_place = 1").drop("_place", "_version")


def read_store(spark: SparkSession, path: str, part: str = "frames") -> DataFrame:
    """One of projections, frames and steps; only the columns and projections asked for are read.

    Of projections, one row each: complete is true once its latest write was finished. Attributes of version 1 get their present names.
    Frames and steps are those of the latest write of each projection, finished or not.
    """
    current = _current(spark, path)
    if part == "projections":
        return current.drop("attempt")
    found = spark.read.parquet(f"{path}/{part}")
    return found.join(current.select("projection_id", "attempt"), ["projection_id", "attempt"], "left_semi").drop("attempt", "part")


def vacuum_store(spark: SparkSession, path: str) -> list[str]:
    """Delete the frames and steps of attempts that no projection is read from any more, and name those attempts. No write may be going on."""
    used = {r["attempt"] for r in _current(spark, path).select("attempt").distinct().collect()}
    gone = sorted({c["attempt"] for c in commits(spark, path)} - used)
    for attempt in gone:
        for name in ("frames", "steps"):
            delete(spark, f"{path}/{name}/attempt={attempt}")
    return gone


def item_order(items: DataFrame, name: str = "name") -> DataFrame:
    """Items by the number behind their last underscore."""
    return items.orderBy(F.regexp_extract(name, r"_(\d+)$", 1).cast("long"))
