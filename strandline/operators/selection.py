"""Catalogue sorting, tiers and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import capture_time, portable_hash
from strandline.operators.placement import placed
from strandline.operators.windows import near_matches


def capture_sorted(rows: DataFrame) -> DataFrame:
    """Rows in directory order, then capture time, then name."""
    return rows.withColumn("capture_ts", capture_time(F.col("name"))).orderBy("dir_no", "capture_ts", "name")


def first_matching(candidates: DataFrame, flag: str, wanted: bool, count: int, order: str = "frame_index") -> DataFrame:
    """The first count candidates in order whose flag is as wanted."""
    return candidates.where(F.col(flag) == wanted).orderBy(order).limit(count)


def tiers(catalogue: DataFrame, primary: int = 3, reach: int = 2, seed: int = 7) -> DataFrame:
    """Every row with its tier: 1 matches in primary directories (dir_no < primary), 2 matches in the others, 3 rows around matches, 4 the rest."""
    timed = catalogue.withColumn("capture_ts", capture_time(F.col("name")))
    near = F.col("_near") & ~F.col("has_face")
    tier = F.when(F.col("has_face") & (F.col("dir_no") < primary), 1).when(F.col("has_face"), 2).when(near, 3).otherwise(4)
    seen = near_matches(timed, "dir_no", ["capture_ts", "name", "event_id"], "has_face", reach, out="_near")
    return seen.withColumn("tier", tier).withColumn("shuffle_key", portable_hash(F.col("event_id"), seed)).drop("_near")


def _inside() -> list[Column]:
    """The order inside a tier: capture order in tiers 1 to 3, seeded hash order in tier 4."""
    return [F.when(F.col("tier") == 4, F.col("shuffle_key")).otherwise(F.lit(0)), *map(F.col, ("dir_no", "capture_ts", "name", "event_id"))]


def select_in_tiers(catalogue: DataFrame, target: int | None, primary: int = 3) -> DataFrame:
    """At most target rows, tier by tier: in capture order in tiers 1 to 3, in seeded hash order in tier 4. None takes all.

    The tiers are counted first: those before the cut are taken whole and those behind it left out, and only the rows of the tier that the
    target cuts get places (placed()), so no task sorts or limits the selection, however large the target.
    """
    ranked = tiers(catalogue, primary)
    if target is not None:
        left, whole, cut = target, [], None
        for tier, n in sorted((r["tier"], r["count"]) for r in ranked.groupBy("tier").count().collect()):
            if n <= left:
                whole.append(tier)
                left -= n
            elif left > 0:
                cut, need = tier, left
                left = 0
            else:
                break
        taken = ranked.where(F.col("tier").isin(whole))
        if cut is not None:
            taken = taken.unionByName(placed(ranked.where(F.col("tier") == cut), _inside(), out="_place").where(F.col("_place") <= need).drop("_place"))
        ranked = taken
    return ranked.orderBy("tier", *_inside())


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that only key and seed decide."""
    return rows.withColumn("shuffle_key", portable_hash(F.col(key), seed)).orderBy("shuffle_key", key)


def path_sorted(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows by path, byte by byte."""
    return rows.orderBy(path)


def distinct_by(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key."""
    return rows.dropDuplicates(list(keys))


def chain(*sources: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """All rows of the sources, copies kept, with source_no in the order given; with order also position, the place in the whole chain from 0."""
    out = sources[0].withColumn("source_no", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("source_no", F.lit(i)))
    return out if order is None else placed(out, ["source_no", *order], out="position", first=0, ties=True)


def numbered(rows: DataFrame, by: str, order: list[str], out: str = "position") -> DataFrame:
    """Zero-based position in order inside each by, however many rows it has."""
    return placed(rows, order, [by], out, first=0)
