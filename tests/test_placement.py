"""Places over any order: equal to a plain sort, and ranges of about the same length on skewed keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.operators import joins, placement, selection, windows


def rows(spark, n=6000, seed=3):
    """Half of the rows in one directory with one name stem, some null names and null directories."""
    rng = random.Random(seed)
    made = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), "/very/long/common/prefix/" + str(rng.randrange(400)) if rng.random() < 0.95 else None, rng.random() < 0.1) for i in range(n)]
    rng.shuffle(made)
    return made, spark.createDataFrame(made, "event_id long, dir_no string, name string, has_face boolean")


def key(v):
    return (v is not None, v or "")


def test_places_are_those_of_a_sort(spark):
    made, df = rows(spark)
    got = {r["event_id"]: r["place"] for r in placement.placed(df, ["name", "event_id"]).collect()}
    want = {r[0]: i for i, r in enumerate(sorted(made, key=lambda r: (key(r[2]), r[0])), 1)}
    assert got == want
    down = {r["event_id"]: r["place"] for r in placement.placed(df, [F.desc_nulls_first("event_id")]).collect()}
    assert down == {i: len(made) - i for i in range(len(made))}


def test_places_inside_groups_and_nulls(spark):
    made, df = rows(spark)
    got = {r["event_id"]: r["position"] for r in selection.numbered(df, "dir_no", ["name", "event_id"]).collect()}
    want, seen = {}, Counter()
    for r in sorted(made, key=lambda r: (key(r[2]), r[0])):
        want[r[0]] = seen[r[1]]
        seen[r[1]] += 1
    assert got == want
    assert placement.placed(df.where("false"), ["name"]).collect() == []


def test_equal_rows_and_clashing_names(spark):
    df = spark.createDataFrame([("x", 7)] * 300 + [("w", 8)], "path string, place long")
    got = placement.placed(df, ["path"], ties=True)
    assert got.columns == ["path", "place"] and sorted(r["place"] for r in got.collect()) == list(range(1, 302))
    assert [r["place"] for r in got.where("path = 'w'").collect()] == [1]


def test_ranges_are_even_on_skewed_keys(spark):
    """One path has all rows: its ranges are split by what follows in the order."""
    skewed = spark.range(40_000).select(F.when(F.col("id") < 30_000, "one").otherwise(F.col("id").cast("string")).alias("path"), (F.col("id") * 7919 % 40_009).alias("event_id"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in placement.in_ranges(skewed, ["path", "event_id"]).groupBy("_part").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) >= 3 and sizes[-1] < 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("strict", [False, True])
def test_matches_around_across_blocks(spark, strict):
    made, df = rows(spark, 700, 5)
    got = {r["event_id"] for r in windows.around_matches(df, "dir_no", ["event_id"], reach=2, strict_window=strict, block=16).collect()}
    want = set()
    for d in {r[1] for r in made}:
        own = sorted((r for r in made if r[1] == d), key=lambda r: r[0])
        for i, r in enumerate(own):
            if r[3] and (not strict or 2 <= i < len(own) - 2):
                want |= {own[j][0] for j in range(max(0, i - 2), min(len(own), i + 3)) if not own[j][3]}
    assert got == want


def test_copy_numbers_count_skipped_files(spark):
    files = spark.createDataFrame([("p", n, n) for n in ("b", "a", "submit_config.pkl", "c")] + [("q", "z", "z")], "parent string, name string, md5 string")
    existing = spark.createDataFrame([("0_p_a", "a"), ("1_p_b", "other")], "destination string, md5 string")
    got = sorted(r["destination"] for r in joins.copy_plan(files, existing, ["name"]).collect())
    assert got == ["0_q_z", "1_p_b", "2_p_c"]


@pytest.mark.parametrize("target", [0, 1, 5, 40, 250, 10_000, None])
def test_selection_cuts_one_tier(spark, target):
    made, _ = rows(spark, 300, 8)
    named = [(i, i % 6, f"s_{1 + i % 12:02d}-01-2021_00-00-{i % 60:02d}-{i:06d}.jpeg", f) for i, _, _, f in made]
    df = spark.createDataFrame(named, "event_id long, dir_no int, name string, has_face boolean")
    ranked = sorted(selection.tiers(df).collect(), key=lambda r: (r["tier"], r["shuffle_key"] if r["tier"] == 4 else 0, r["dir_no"], r["capture_ts"], r["name"], r["event_id"]))
    got = [(r["event_id"], r["tier"]) for r in selection.select_in_tiers(df, target).collect()]
    assert got == [(r["event_id"], r["tier"]) for r in ranked[:target]]
