"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.shared import delete, shared_folder

#: Texts with a letter.
LETTER = r"\p{L}"
#: Bytes of one Arrow batch in this subpackage's own queries and stages: a batch stands in the JVM and in Python at once.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on bytes of an Arrow batch to BATCH_BYTES. For applications: operators leave the session as it is.

    Spark's own bound is 64 MB, which two cores of a small executor can just hold; results are the same under any bound.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_CONF))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


class Scratch:
    """Tables written to the shared folder to cut lineage: they survive the loss of any executor.

    drop() deletes one that no plan reads any more; the rest go when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_folder(spark, name)
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it again."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that keep() returned and that no later plan reads."""
        for df in tables:
            delete(self.spark, df._scratch_path)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between long or binary ids to (node, root): root is the smallest id reachable. Nodes without a link are not returned.

    Alternating large-star and small-star steps; each step is two shuffles on ids and is written to the shared folder. A hub's
    neighbours are never gathered in one row, only their minimum. Raises if max_rounds don't suffice.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = scratch.keep(links)
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b")
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low2, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        new = scratch.keep(small)
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(now)
        now = new
        if mark == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        seen = mark
    raise RuntimeError("connected_components: no fixed point; raise max_rounds")


def blob_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls: one flat uint8 array and where each value starts and ends."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
