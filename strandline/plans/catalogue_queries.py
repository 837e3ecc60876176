"""Queries on the image catalogue: sorting, tiers, names, copies, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import scalar as S
from strandline.operators import aggregates, joins, selection, windows
from strandline.operators.placement import placed
from strandline.plans import fixtures as fx
from strandline.plans.fixtures import with_tables
from strandline.plans.registry import query
from strandline.sources import files, store
from strandline.sources.shared import shared_folder

def _hash(key: str, seed: int) -> str:
    first = f"(({key} * 48271 + {seed} * 69621 + 12345) % 2147483647)"
    return f"((({first} * {first} + 97) % 2147483647) * 40692 + 7) % 2147483647"


#: Tiers in SQL: rows around matches are those within two places of one in a directory.
TIERS = """, o AS (SELECT *, row_number() OVER (PARTITION BY dir_no ORDER BY ts, name, event_id) AS place FROM cat),
nr AS (SELECT *, max(CAST(has_face AS INTEGER)) OVER (PARTITION BY dir_no ORDER BY place ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM o),
t AS (SELECT event_id, dir_no, name, ts, has_face, CASE WHEN has_face AND dir_no < 3 THEN 1 WHEN has_face THEN 2 WHEN near = 1 THEN 3 ELSE 4 END AS tier, """ + _hash("event_id", 7) + """ AS shuffle_key FROM nr)"""


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def s8_content_hash(spark, sf):
    return files.content_hash(fx.table(spark, sf, "documents"), "text").select("doc_id", "content_hash")


@query(with_tables("cat", "SELECT event_id, '/data/good/' || name AS destination FROM cat WHERE has_face"))
def s13_copy_manifest(spark, sf):
    src = fx.cat(spark, sf).where("has_face").withColumn("path", F.concat(F.lit("/raw/"), F.col("dir_no"), F.lit("/"), F.col("name")))
    return files.copy_manifest(src, "/data/good").select("event_id", "destination")


@query(with_tables("cat", "SELECT event_id, 1 AS boxes FROM cat WHERE has_face"))
def p6_face_filter(spark, sf):
    boxes = F.when(F.col("has_face"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return files.with_boxes(fx.cat(spark, sf).withColumn("bounding_boxes", boxes)).select("event_id", F.size("bounding_boxes").alias("boxes"))


@query(with_tables("cat", "SELECT event_id, epoch_us(ts) AS capture_us FROM cat"))
def f1_capture_time(spark, sf):
    return fx.cat(spark, sf).select("event_id", F.unix_micros(S.capture_time(F.col("name"))).alias("capture_us"))


@query("SELECT event_id, event_type || '_' || strftime(ts, '%m-%d-%Y_%H-%M-%S-%f') || '.jpeg' AS name FROM events")
def f2_image_name(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", S.image_name(F.col("event_type"), F.col("ts")).alias("name"))


@query("SELECT event_id, 'item_' || event_id || '_step_' || (event_id % 17) AS name, CAST(event_id AS INTEGER) AS number FROM events")
def f3_item_names(spark, sf):
    i = F.col("event_id")
    return fx.table(spark, sf, "events").select("event_id", S.item_name(F.lit("item"), i, i % 17).alias("name"), S.trailing_number(S.item_name(F.lit("item"), i)).alias("number"))


@query(with_tables("cat", "SELECT event_id, 'network_' || name || '_' || dir_no AS label FROM cat"))
def f20_labels(spark, sf):
    path = F.concat(F.lit("/a/"), F.col("dir_no"), F.lit("/"), F.col("name"))
    return fx.cat(spark, sf).select("event_id", S.output_label("network", path, F.col("dir_no")).alias("label"))


@query(with_tables("cat", TIERS + " SELECT event_id, dir_no, tier FROM t WHERE tier = 3"))
def w8_around_matches(spark, sf):
    return selection.tiers(fx.cat(spark, sf)).where("tier = 3").select("event_id", "dir_no", "tier")


@query(with_tables("cat", ", o AS (SELECT *, row_number() OVER (PARTITION BY dir_no ORDER BY name, event_id) AS place, count(*) OVER (PARTITION BY dir_no) AS n FROM cat), m AS (SELECT *, max(CAST(has_face AND place > 2 AND place <= n - 2 AS INTEGER)) OVER (PARTITION BY dir_no ORDER BY place ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM o) SELECT event_id FROM m WHERE near = 1 AND NOT has_face"))
def w8_around_matches_strict(spark, sf):
    return windows.around_matches(fx.cat(spark, sf), "dir_no", ["name", "event_id"], strict_window=True).select("event_id")


@query(with_tables("cat", "SELECT event_id, CAST(row_number() OVER (PARTITION BY dir_no ORDER BY name, event_id) - 1 AS INTEGER) AS position FROM cat"))
def w12_numbered(spark, sf):
    return selection.numbered(fx.cat(spark, sf), "dir_no", ["name", "event_id"]).select("event_id", F.col("position").cast("int").alias("position"))


@query(with_tables("cat", "SELECT event_id, dir_no, ts AS capture_ts FROM cat WHERE has_face ORDER BY dir_no, ts, name"))
def o1_capture_sorted(spark, sf):
    """All matches in capture order."""
    return selection.capture_sorted(fx.cat(spark, sf).where("has_face")).select("event_id", "dir_no", F.col("capture_ts").cast("timestamp_ntz").alias("capture_ts"))


@query(with_tables("cat", "SELECT event_id, dir_no, row_number() OVER (ORDER BY dir_no, ts, name, event_id) AS place FROM cat WHERE has_face"))
def o1_capture_sorted_all(spark, sf):
    """All matches with their place in capture order."""
    timed = fx.cat(spark, sf).where("has_face").withColumn("capture_ts", S.capture_time(F.col("name")))
    return placed(timed, ["dir_no", "capture_ts", "name", "event_id"]).select("event_id", "dir_no", "place")


@query("SELECT event_id AS number, 'item_' || event_id AS name FROM events ORDER BY event_id")
def o2_natural_sort(spark, sf):
    """All names by their number."""
    named = fx.table(spark, sf, "events").select(S.item_name(F.lit("item"), F.col("event_id")).alias("name"))
    return store.item_order(named).select(S.trailing_number(F.col("name")).cast("long").alias("number"), "name")


@query("SELECT event_id AS number, 'item_' || event_id AS name, row_number() OVER (ORDER BY event_id DESC) AS place FROM events")
def o2_natural_sort_all(spark, sf):
    """All names with their place by number, the largest first."""
    named = fx.table(spark, sf, "events").select(S.item_name(F.lit("item"), F.col("event_id")).alias("name"))
    numbered = named.withColumn("number", S.trailing_number(F.col("name")).cast("long"))
    return placed(numbered, [F.desc("number")]).select("number", "name", "place")


@query(with_tables("cat", TIERS + " SELECT event_id, tier FROM t ORDER BY tier, CASE WHEN tier = 4 THEN shuffle_key ELSE 0 END, dir_no, ts, name, event_id LIMIT 3000"))
def o4_select_in_tiers(spark, sf):
    return selection.select_in_tiers(fx.cat(spark, sf), 3000).select("event_id", "tier")


@query(with_tables("cat", "SELECT event_id, " + _hash("event_id", 11) + " AS shuffle_key FROM cat ORDER BY 2, 1"))
def o5_shuffled(spark, sf):
    """All rows in shuffled order."""
    return selection.shuffled(fx.cat(spark, sf), "event_id", 11).select("event_id", "shuffle_key")


@query(with_tables("cat", ", k AS (SELECT event_id, " + _hash("event_id", 11) + " AS shuffle_key FROM cat) SELECT event_id, shuffle_key, row_number() OVER (ORDER BY shuffle_key, event_id) AS place FROM k"))
def o5_shuffled_all(spark, sf):
    """All rows with their place in the shuffled order."""
    keyed = fx.cat(spark, sf).withColumn("shuffle_key", S.portable_hash(F.col("event_id"), 11))
    return placed(keyed, ["shuffle_key", "event_id"]).select("event_id", "shuffle_key", "place")


@query(with_tables("cat", "SELECT dir_no || '/' || name AS path FROM cat ORDER BY 1"))
def o6_path_sort(spark, sf):
    """All paths in binary order."""
    return selection.path_sorted(fx.cat(spark, sf).select(F.concat_ws("/", F.col("dir_no").cast("string"), "name").alias("path")))


@query(with_tables("cat", "SELECT path, row_number() OVER (ORDER BY path) AS place FROM (SELECT dir_no || '/' || name AS path FROM cat)"))
def o6_path_sort_all(spark, sf):
    """All paths with their place in binary order."""
    paths = fx.cat(spark, sf).select(F.concat_ws("/", F.col("dir_no").cast("string"), "name").alias("path"))
    return placed(paths, ["path"], ties=True).select("path", "place")


@query(with_tables("cat", TIERS + ", s AS (SELECT tier FROM t ORDER BY tier, CASE WHEN tier = 4 THEN shuffle_key ELSE 0 END, dir_no, ts, name, event_id LIMIT 3000) SELECT tier, count(*) AS rows_taken FROM s GROUP BY ROLLUP (tier)"))
def a6_tier_counts(spark, sf):
    return aggregates.tier_counts(selection.select_in_tiers(fx.cat(spark, sf), 3000))


@query(with_tables("cat", "SELECT event_id, source_no, row_number() OVER (ORDER BY source_no, name, event_id) - 1 AS position FROM (SELECT event_id, name, 0 AS source_no FROM cat WHERE dir_no < 3 UNION ALL SELECT event_id, name, 1 FROM cat WHERE dir_no >= 3 UNION ALL SELECT event_id, name, 2 FROM cat WHERE has_face)"))
def u1_chain(spark, sf):
    """Three sources one after another, each in its own order, with the place of every row in the chain."""
    c = fx.cat(spark, sf)
    return selection.chain(c.where("dir_no < 3"), c.where("dir_no >= 3"), c.where("has_face"), order=["name", "event_id"]).select("event_id", "source_no", "position")


@query(with_tables("cat", "SELECT DISTINCT name FROM cat"))
def u2_distinct(spark, sf):
    c = fx.cat(spark, sf)
    return selection.distinct_by(selection.chain(c, c.where("has_face")), "name").select("name")


@query(with_tables("cat", TIERS + " SELECT event_id FROM t WHERE tier = 4"))
def u3_difference(spark, sf):
    ranked = selection.tiers(fx.cat(spark, sf))
    return joins.in_set(ranked, ranked.where("tier < 4").select("event_id"), "event_id", inside=False).select("event_id")


@query(with_tables("cat", "SELECT event_id, has_face FROM cat WHERE event_id IN (SELECT event_id FROM cat WHERE has_face)"))
def j4_semi(spark, sf):
    c = fx.cat(spark, sf)
    return joins.in_set(c, c.where("has_face").select("event_id"), "event_id").select("event_id", "has_face")


@query(with_tables("cat", "SELECT event_id FROM cat WHERE event_id NOT IN (SELECT event_id FROM cat WHERE has_face)"))
def j4_anti(spark, sf):
    c = fx.cat(spark, sf)
    return joins.in_set(c, c.where("has_face").select("event_id"), "event_id", inside=False).select("event_id")


@query(with_tables("cat", ", d AS (SELECT *, (row_number() OVER (PARTITION BY dir_no ORDER BY name, event_id) - 1) || '_' || dir_no || '_' || name AS destination FROM cat) SELECT event_id, destination FROM d WHERE event_id % 4 <> 0"))
def j5_copy_plan(spark, sf):
    named = fx.cat(spark, sf).withColumn("parent", F.col("dir_no").cast("string")).withColumn("md5", F.md5("name"))
    everything = joins.copy_plan(named, spark.createDataFrame([], "destination string, md5 string"), ["name", "event_id"])
    existing = everything.where("event_id % 4 = 0").select("destination", "md5")
    return joins.copy_plan(named, existing, ["name", "event_id"]).select("event_id", "destination")


@query(with_tables("cat", "SELECT event_id, m AS model_index, 'network_model' || m || '_' || md5(name) AS output_name FROM cat, (SELECT unnest(range(0, 4)) AS m) WHERE has_face"))
def j6_files_by_models(spark, sf):
    src = fx.cat(spark, sf).where("has_face").select("event_id", F.md5("name").alias("file_hash"))
    names = fx.models(spark).select(F.col("model_index").cast("long").alias("model_index"), F.concat(F.lit("model"), F.col("model_index")).alias("model_name"))
    return joins.files_by_models(src, names).select("event_id", "model_index", "output_name")


@query(with_tables("cat", TIERS + " SELECT CAST(tier AS INTEGER) AS tier, count(*) AS rows_taken FROM t GROUP BY ROLLUP (tier)"))
def s12_summary(spark, sf):
    """The summary of all tiers, written to the shared folder and read again."""
    path = shared_folder(spark, "summary")
    files.write_summary(aggregates.tier_counts(selection.select_in_tiers(fx.cat(spark, sf), None)), path)
    return files.read_summary(spark, path)


@query("SELECT row_number() OVER (ORDER BY s, k) - 1 AS model_index, path FROM (SELECT 1 AS s, n_nationkey AS k, '/models/' || n_name || '.pkl' AS path FROM nation UNION ALL SELECT 2, r_regionkey, '/listed/' || r_name || '.pkl' FROM region)")
def s7_model_catalogue(spark, sf):
    """Given paths, then those of a JSON list in the shared folder. Neither list passes through the driver."""
    named = lambda table, key, folder, name: fx.table(spark, sf, table).select(F.col(key).alias("at"), F.concat(F.lit(folder), name, F.lit(".pkl")).alias("path"))
    path = shared_folder(spark, "models")
    listed = named("region", "r_regionkey", "/listed/", "r_name").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("l"))
    listed.select(F.to_json(F.transform("l", lambda r: r["path"]))).write.text(path)
    return files.model_catalogue(spark, paths=named("nation", "n_nationkey", "/models/", "n_name"), json_path=path)


def _records(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(F.lit("net.pkl").alias("network_path"), F.md5(F.lit("net")).alias("network_hash"), F.concat(F.lit("/img/"), "vec_id").alias("image_path"), F.md5(F.col("vec_id").cast("string")).alias("image_hash"), F.expr("transform(embedding, x -> cast(x as double))").alias("vec"))
    path = shared_folder(spark, "records")
    files.write_records(rows, path)
    return path


@query("SELECT '/img/' || vec_id AS image_path, md5(CAST(vec_id AS VARCHAR)) AS image_hash, 'net.pkl' AS network_path, 2 AS version, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i)")
def s3_read_records(spark, sf):
    """Records written as JSON lines to the shared folder and read again, every value of every vector."""
    got = files.read_records(spark, _records(spark, sf), lines=True)
    return got.select("image_path", "image_hash", "network_path", "version", F.posexplode("vec").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT '/img/' || vec_id AS image_path, 2 AS version, len(embedding) AS n FROM embeddings")
def s4_write_records(spark, sf):
    """What the written lines hold, read as plain JSON."""
    return spark.read.json(_records(spark, sf)).select("image_path", F.col("version").cast("int").alias("version"), F.size("vector").cast("long").alias("n"))
