"""Frame, signal, catalogue, box and projection tables derived from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one series of frames."""
    return table(spark, sf_dir, "embeddings").selectExpr("0 as series_id", "vec_id as frame_index", "transform(embedding, x -> cast(x as double)) as vec")


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as one long signal."""
    return table(spark, sf_dir, "events").selectExpr("0 as series_id", "event_id as sample_index", "value")


def evtu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as one series of scalars for each user."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), place.cast("long").alias("frame_index"), "value")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as one signal for each supplier."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")) - 1
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id"), place.cast("long").alias("sample_index"), F.col("l_quantity").alias("value"))


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an image catalogue: six directories, three primary and three secondary, and a capture time in each name."""
    name = F.concat("event_type", F.lit("_s1_"), F.date_format("ts", "MM-dd-yyyy_HH-mm-ss-SSSSSS"), F.lit(".jpeg"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 6).cast("int").alias("dir_no"), name.alias("name"), (F.col("event_type") == "purchase").alias("has_face"))


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as bounding boxes on two sides of a frame."""
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")) - 1
    return table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").select(
        F.col("l_orderkey").alias("frame_index"), F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("side"), place.cast("long").alias("box_no"),
        (F.col("l_partkey") % 200).cast("int").alias("x"), (F.col("l_suppkey") % 200).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("w"), (F.col("l_linenumber") * 5).cast("int").alias("h"),
    )


def proj_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("projection_id"), place.cast("long").alias("frame_index"), F.expr("transform(embedding, x -> cast(x as double))").alias("latent"))


def proj_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten steps that approach each frame's latent; frame 7 of projection 3 stops at step 5."""
    steps = proj_frames(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(9))))
    grown = F.expr("transform(latent, x -> x * (1 + pow(step + 1, -(1 + (frame_index % 3) * 0.5D))))")
    return steps.where("not (projection_id = 3 and frame_index = 7 and step >= 5)").select("projection_id", "frame_index", "step", grown.alias("latent"))


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("projection_id")).agg(F.count("*").alias("projection_frame_count"))
    return counts.select(
        "projection_id", (F.col("projection_id") != 9).alias("complete"), F.lit(60.0).alias("original_fps"), F.lit(30.0).alias("projection_fps"),
        (F.col("projection_frame_count") * 2).alias("original_frame_count"), "projection_frame_count", F.md5(F.col("projection_id").cast("string")).alias("network_md5_hash"),
    )


def models(spark: SparkSession, count: int = 4, dims: int = 8) -> DataFrame:
    """Linear scoring models with weights by formula."""
    weights = F.expr(f"transform(sequence(0, {FRAME - 1}), p -> (((model_index * 31 + out_dim * 17 + p * 7) % 13) - 6) / 6.0D)")
    return spark.range(count * dims).select((F.col("id") / dims).cast("int").alias("model_index"), (F.col("id") % dims).cast("int").alias("out_dim")).withColumn("weights", weights)


SQL = {
    "emb": "emb AS (SELECT 0 AS series_id, vec_id AS frame_index, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)",
    "embx": "embx AS (SELECT 0 AS series_id, vec_id AS frame_index, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "evt": "evt AS (SELECT 0 AS series_id, event_id AS sample_index, value FROM events)",
    "evtx": "evtx AS (SELECT g.i // 64 AS frame_index, g.i % 64 AS pos, coalesce(e.value, 0.0) AS v FROM (SELECT unnest(range(0, (SELECT CAST(ceil((max(event_id) + 1) / 64.0) AS BIGINT) * 64 FROM events))) AS i) g LEFT JOIN events e ON e.event_id = g.i)",
    "rms": "rms AS (SELECT frame_index, sqrt(avg(v * v)) AS rms FROM evtx GROUP BY 1)",
    "evtu": "evtu AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, value FROM events)",
    "line": "line AS (SELECT l_suppkey AS series_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS sample_index, l_quantity AS value FROM lineitem)",
    "cat": "cat AS (SELECT event_id, CAST(user_id % 6 AS INTEGER) AS dir_no, event_type || '_s1_' || strftime(ts, '%m-%d-%Y_%H-%M-%S-%f') || '.jpeg' AS name, event_type = 'purchase' AS has_face, ts FROM events)",
    "box": "box AS (SELECT l_orderkey AS frame_index, CASE l_returnflag WHEN 'A' THEN 'a' ELSE 'b' END AS side, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS box_no, CAST(l_partkey % 200 AS INTEGER) AS x, CAST(l_suppkey % 200 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) AS w, CAST(5 * l_linenumber AS INTEGER) AS h FROM lineitem WHERE l_returnflag IN ('A', 'R'))",
    "pf": "pf AS (SELECT label AS projection_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, CAST(embedding AS DOUBLE[]) AS latent FROM embeddings)",
    "ps": "ps AS (SELECT projection_id, frame_index, s.step, generate_subscripts(latent, 1) - 1 AS pos, unnest(latent) AS fin FROM pf, (SELECT unnest(range(0, 10)) AS step) s WHERE NOT (projection_id = 3 AND frame_index = 7 AND s.step >= 5)), "
    "psx AS (SELECT *, fin * (1 + pow(step + 1, -(1 + (frame_index % 3) * 0.5))) AS v FROM ps)",
    "pr": "pr AS (SELECT label AS projection_id, label <> 9 AS complete, 60.0 AS original_fps, 30.0 AS projection_fps, 2 * count(*) AS original_frame_count, count(*) AS projection_frame_count, md5(CAST(label AS VARCHAR)) AS network_md5_hash FROM embeddings GROUP BY 1)",
    "models": "models AS (SELECT m.i AS model_index, d.i AS out_dim, p.i AS pos, (((m.i * 31 + d.i * 17 + p.i * 7) % 13) - 6) / 6.0 AS weight FROM (SELECT unnest(range(0, 4)) AS i) m, (SELECT unnest(range(0, 8)) AS i) d, (SELECT unnest(range(0, 64)) AS i) p)",
}


def with_tables(names: str, body: str) -> str:
    """A WITH clause over the named derived tables (space-separated), then body."""
    return f"WITH {', '.join(SQL[n] for n in names.split())} {body}"
