"""The folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN_ROOT: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; without one only a local master may use its own folder.

    What is written below it is deleted when the driver's Python ends, or earlier by delete().
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN_ROOT.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="strandline-")
        _OWN_ROOT[spark.sparkContext.applicationId] = root
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session may be gone
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
