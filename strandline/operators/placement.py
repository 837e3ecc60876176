"""Places in any sort order, counted by all tasks: sampled range splitters, a sort inside each range, and the counts of earlier ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.shared import shared_folder

#: monotonically_increasing_id() has the partition above so many bits and the row's number in it below.
_PART_BITS = 33


def in_ranges(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """rows with _id and _part: sorted by keys in ranges that Spark's sampled splitters make about equally long, written to the shared folder.

    _part numbers the ranges in order, and _id the rows of a range.
    """
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "placed")
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_id", _PART_BITS))


def placed(rows: DataFrame, order: list[str | Column], by: list[str] | None = None, out: str = "place", first: int = 1, ties: bool = False) -> DataFrame:
    """rows with out, their place in order (from first on), inside each by if that is given.

    Spark samples the keys for splitters, so ranges are about equally long whatever the keys look like, and one directory or language of
    any size spreads over all tasks. The sorted ranges are written to the shared folder with the number of each row in its range; the
    count of every range and by (one row each) then gives what stands before it. Nulls sort as order says, null values of by are one
    group. Rows that are equal in all of order stand in any order; if they may be many, ties writes rows with a number of their own first,
    which splits them as well. An empty table gives an empty result.
    """
    spark, keys = rows.sparkSession, [*(by or []), *order]
    if ties:
        path = shared_folder(spark, "ties")
        numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
        numbered.write.parquet(path)
        rows, keys = spark.read.schema(numbered.schema).parquet(path), [*keys, "_tie"]
    found = in_ranges(rows, keys)
    groups = [f"_by{i}" for i in range(len(by or []))]
    named = found.withColumns({g: F.col(b) for g, b in zip(groups, by or [], strict=True)})
    sizes = named.groupBy("_part", *groups).agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least") + first).drop("_least", "_n")
    f, a = named.alias("f"), ahead.alias("a")
    same = F.col("f._part") == F.col("a._part")
    for g in groups:
        same = same & F.col(f"f.{g}").eqNullSafe(F.col(f"a.{g}"))
    kept = [F.col(f"f.`{c}`") for c in rows.columns if c not in ("_tie", out)]
    return f.join(a, same).select(*kept, (F.col("f._id") + F.col("a._shift")).alias(out))
