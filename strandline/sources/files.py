"""File catalogues, content hashes, manifests, images, audio, JSON records and model lists."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import base_name
from strandline.operators.sides import kept

BLOCK_SAMPLES = 65_536


def content_hash(rows: DataFrame, column: str = "content", out: str = "content_hash") -> DataFrame:
    """md5 of a binary or text column, in hex."""
    return rows.withColumn(out, F.md5(F.col(column)))


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length, modified) of the files below path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def hashed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return content_hash(files).select("path", F.col("content_hash").alias("md5"))


def copy_manifest(rows: DataFrame, directory: str, path: str = "path") -> DataFrame:
    """Rows with destination = directory and file name."""
    return rows.withColumn("destination", F.concat(F.lit(directory.rstrip("/") + "/"), base_name(F.col(path))))


def write_summary(counts: DataFrame, path: str) -> None:
    """Totals by tier (rows of tier, rows_taken; the tier is null in the row for all) as one JSON record: total and one count a tier."""
    tiers = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("tier").isNotNull(), F.struct(F.concat(F.lit("tier_"), "tier"), "rows_taken")))))
    counts.agg(F.max(F.when(F.col("tier").isNull(), F.col("rows_taken"))).alias("total"), tiers.alias("tiers")).write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(tier, rows_taken) of a summary, the total with a null tier."""
    raw = spark.read.schema("total long, tiers map<string, long>").json(path)
    each = raw.select(F.explode("tiers").alias("tier", "rows_taken")).select(F.regexp_extract("tier", r"(\d+)$", 1).cast("int").alias("tier"), "rows_taken")
    return each.unionByName(raw.select(F.lit(None).cast("int").alias("tier"), F.col("total").alias("rows_taken")))


def with_boxes(rows: DataFrame, boxes: str = "bounding_boxes") -> DataFrame:
    """Rows with at least one box; a null list was never scanned and doesn't count."""
    return rows.where(F.size(boxes) > 0)


def batch_manifest(spark: SparkSession, directory: str | None, extension: str | None, out_dir: str | None, prefix: str | None) -> DataFrame:
    """(source, destination) of every file with extension: `{out_dir}/{prefix}{stem}.hdf5`. All four or none; none gives no row."""
    given = [directory, extension, out_dir, prefix]
    if any(v is None for v in given):
        if any(v is not None for v in given):
            raise ValueError("directory, extension, out_dir and prefix go together")
        return spark.createDataFrame([], "source string, destination string")
    stem = F.regexp_extract(F.col("path"), r"([^/]*)\.[^./]*$", 1)
    return listing(spark, directory, f"*.{extension.lstrip('.')}").select(F.col("path").alias("source"), F.concat(F.lit(f"{out_dir.rstrip('/')}/{prefix}"), stem, F.lit(".hdf5")).alias("destination"))


def images(spark: SparkSession, path: str, pattern: str = "*.jpeg") -> DataFrame:
    """Images that can be decoded; others are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(path)


def broken_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path) of the images that can't be decoded wholly. Nothing is deleted."""
    found = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(path)
    return found.where("image.height < 0").select(F.col("image.origin").alias("path"))


def wav_layout(read_at: Callable[[int, int], bytes], length: int, name: str) -> tuple[str, int, int, int, int]:
    """(kind, channels, sample rate, begin, end) of the samples of a WAV file; kinds are numpy's. Anything but PCM and 32-bit floats is an error.

    read_at(place, size) gives bytes of the file, fewer at its end. Only the heads of chunks and the format are read.
    """
    head = read_at(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError(f"{name}: not a WAV file")
    at, form = 12, None
    while at + 8 <= length:
        head = read_at(at, 48)
        kind, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        if kind == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, 8)
            # an extensible header names the real format in its first two bytes further on
            form = (struct.unpack_from("<H", head, 32)[0] if tag == 0xFFFE and size >= 26 else tag, bits, channels, rate)
        elif kind == b"data" and form:
            if form[:2] not in SAMPLE_KINDS:
                raise ValueError(f"{name}: {form[1]}-bit samples of format {form[0]} aren't supported")
            whole = min(size, length - at - 8) // (form[1] // 8 * form[2]) * (form[1] // 8 * form[2])
            return SAMPLE_KINDS[form[:2]][0], form[2], form[3], at + 8, at + 8 + whole
        at += 8 + size + size % 2
    raise ValueError(f"{name}: no samples")


#: By format tag (1 PCM, 3 float) and bits: numpy's kind and the range that becomes -1 .. 1; floats stay as they are.
SAMPLE_KINDS = {(1, 8): ("u1", 0.0, 255.0), (1, 16): ("<i2", -32768.0, 32767.0), (1, 32): ("<i4", -2147483648.0, 2147483647.0), (3, 32): ("<f4", -1.0, 1.0)}


#: Bytes of samples of one file that one task reads, and schemes whose files tasks can read in part.
RANGE_BYTES = 32 << 20
RANGED = ("file", "hdfs", "s3", "s3a", "gs")

WAV_ROWS = "path string, sample_rate int, channels int, block long, samples array<double>"


def _opened(path: str) -> tuple[Callable[[int, int], bytes], int]:
    """(read_at, length) of a file that tasks can read in part."""
    from pyarrow import fs

    plain = path.replace("s3a://", "s3://", 1)
    system, at = fs.FileSystem.from_uri("file://" + plain[5:] if plain.startswith("file:/") and not plain.startswith("file://") else plain)
    file = system.open_input_file(at)
    return (lambda place, size: file.read_at(max(0, min(size, file.size() - place)), place)), file.size()


def _scaled(raw: bytes, kind: str, channels: int) -> np.ndarray:
    """Samples as -1 .. 1, channels averaged."""
    x = np.frombuffer(raw, kind).reshape(-1, channels).astype(np.float64)
    lo, hi = next((lo, hi) for k, lo, hi in SAMPLE_KINDS.values() if k == kind)
    return (x if kind == "<f4" else (x - lo) / (hi - lo) * 2 - 1).mean(axis=1)


def read_wavs(spark: SparkSession, path: str | list[str], pattern: str = "*.wav", block: int = BLOCK_SAMPLES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, sample_rate, channels, block, samples): audio as -1 .. 1, channels averaged, in blocks of block samples.

    8-bit files are unsigned, 16- and 32-bit ones signed or, with 32 bits, floats that are passed on. Tasks read the heads of the files
    first; then samples are read in ranges of about range_bytes, each by a task that reads nothing else, so a recording of any length
    spreads over all of them and none holds it whole. In a store of another scheme than RANGED a file is read whole by one task.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    first = listed.select("path").first()
    if first is not None and first["path"].split(":", 1)[0] not in RANGED:
        return _read_whole(listed, block)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["path"]:
                kind, channels, rate, begin, end = wav_layout(*_opened(name), name)
                step = np.dtype(kind).itemsize * channels
                blocks = max(1, range_bytes // (step * block))
                count = (end - begin) // step
                rows += [(name, rate, channels, kind, f // block, begin + f * step, min(count, f + blocks * block) - f) for f in range(0, count, blocks * block)]
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "kind", "block", "at", "n"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, rate, channels, kind, number, at, n in pdf.itertuples(index=False):
                read_at, _ = _opened(name)
                step = np.dtype(kind).itemsize * channels
                for k, f in enumerate(range(0, n, block)):
                    y = _scaled(read_at(at + f * step, min(block, n - f) * step), kind, channels)
                    yield pd.DataFrame({"path": [name], "sample_rate": [rate], "channels": [channels], "block": [number + k], "samples": [y]})

    ranges = kept(listed.select("path").mapInPandas(plan, "path string, sample_rate int, channels int, kind string, block long, at long, n long"), "ranges")
    tasks = max(1, ranges.count())
    return ranges.repartition(min(tasks, 100_000), "path", "block").mapInPandas(read, WAV_ROWS)


def _read_whole(listed: DataFrame, block: int) -> DataFrame:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                kind, channels, rate, begin, end = wav_layout(lambda place, size, c=content: c[place : place + size], len(content), name)
                y = _scaled(content[begin:end], kind, channels)
                for f in range(0, len(y), block):
                    yield pd.DataFrame({"path": [name], "sample_rate": [rate], "channels": [channels], "block": [f // block], "samples": [y[f : f + block]]})

    return listed.select("path", "content").mapInPandas(decode, WAV_ROWS)


def write_wavs(samples: DataFrame, path: str, sample_rate: int, length: int = BLOCK_SAMPLES) -> None:
    """A signal of values from -1 to 1 as 16-bit WAV files below path, one for every length samples, named so that path order is sample order.

    Each file is one task's; a task that runs again writes the same file again. path must be of a scheme in RANGED.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        pdf = pdf.sort_values("sample_index")
        raw = np.clip(np.rint((pdf["value"].to_numpy() + 1) / 2 * 65535 - 32768), -32768, 32767).astype("<i2").tobytes()
        head = b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, sample_rate, 2 * sample_rate, 2, 16) + b"data" + struct.pack("<I", len(raw))
        name = f"{path.rstrip('/')}/{int(pdf['series_id'].iloc[0]):06d}-{int(pdf['part'].iloc[0]):012d}.wav"
        system, at = fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(at) as out:
            out.write(head + raw)
        return pd.DataFrame({"path": [name], "n": [len(pdf)]})

    parts = samples.select("series_id", "sample_index", "value").withColumn("part", F.expr(f"sample_index div {length}"))
    parts.groupBy("series_id", "part").applyInPandas(write, "path string, n long").write.format("noop").mode("overwrite").save()


def load_signal(spark: SparkSession, paths: list[str], length: int, fps: float | None = None, count: int | None = None, pad: bool = True) -> DataFrame:
    """(series_id 0, sample_index, value, sample_rate): files joined in the order given, resampled to fps or count frames, padded to whole frames.

    sample_rate stays that of the files; more than one rate is an error.
    """
    from strandline.operators.pipelines import scale_audio

    if (fps is None) == (count is None):
        raise ValueError("give either a frame rate or a frame count")
    wavs = [read_wavs(spark, p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    both = wavs[0]
    for w in wavs[1:]:
        both = both.unionByName(w)
    signal = joined_signal(both, order="file_no")
    rate = signal.select("sample_rate").first()["sample_rate"]
    return scale_audio(signal.drop("sample_rate"), rate, length, fps, count, pad).withColumn("sample_rate", F.lit(rate))


def joined_signal(wavs: DataFrame, block: int = BLOCK_SAMPLES, order: str = "path") -> DataFrame:
    """(series_id 0, sample_index, value, sample_rate): all files one after another in path order, or by another column. More than one rate is an error.

    The files' lengths are added up in one task: one row a file.
    """
    sizes = wavs.groupBy(order, "sample_rate").agg(F.sum(F.size("samples")).alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(order, "start")
    rates = [r["sample_rate"] for r in sizes.select("sample_rate").distinct().limit(2).collect()]
    if len(rates) > 1:
        raise ValueError(f"files of different sample rates: {sorted(rates)}")
    placed = wavs.join(starts, order).select("sample_rate", "start", "block", F.posexplode("samples").alias("at", "value"))
    return placed.select(F.lit(0).alias("series_id"), (F.col("start") + F.col("block") * block + F.col("at")).alias("sample_index"), "value", "sample_rate")


RECORD_FIELDS = ["network_path", "network_hash", "image_path", "image_hash"]


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON records of versions 0, 1 and 2 (one a file, or one a line): the four names, version and vec.

    No version is 0; below 2 the network names are model_path and model_hash; version 0 holds the vector inside another list.
    """
    raw = spark.read.text(path, wholetext=not lines)
    get = lambda name: F.get_json_object("value", f"$.{name}")
    version = F.coalesce(get("version").cast("int"), F.lit(0))
    vec = F.when(version == 0, F.element_at(F.from_json(get("vector"), "array<array<double>>"), 1)).otherwise(F.from_json(get("vector"), "array<double>"))
    return raw.select(F.coalesce(get("network_path"), get("model_path")).alias("network_path"), F.coalesce(get("network_hash"), get("model_hash")).alias("network_hash"), get("image_path").alias("image_path"), get("image_hash").alias("image_hash"), version.alias("version"), vec.alias("vec"))


def write_records(frames: DataFrame, path: str) -> None:
    """One JSON line a record, always of version 2."""
    frames.select(*RECORD_FIELDS, F.col("vec").alias("vector"), F.lit(2).alias("version")).write.mode("overwrite").json(path)


def model_catalogue(spark: SparkSession, directory: str | None = None, paths: list[str] | DataFrame | None = None, json_path: str | None = None, pattern: str = "*.pkl") -> DataFrame:
    """(model_index, path): the directory's entries by name, then the paths given, then those of a JSON list; copies stay. None at all is an error.

    paths is a list, or a table (at, path) in order of at. Numbers are counted over ranges (placed()), so lists may be of any length.
    """
    from strandline.operators.placement import placed

    parts = []
    if directory:
        parts.append(listing(spark, directory, pattern).select(F.lit(0).alias("source_no"), F.lit(0).cast("long").alias("at"), "path"))
    if isinstance(paths, DataFrame):
        parts.append(paths.select(F.lit(1).alias("source_no"), F.col("at").cast("long").alias("at"), "path"))
    elif paths:
        parts.append(spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)], "source_no int, at long, path string"))
    if json_path:
        raw = spark.read.text(json_path, wholetext=True).select(F.from_json(F.coalesce(F.get_json_object("value", "$.networks"), F.col("value")), "array<string>").alias("l"))
        parts.append(raw.select(F.lit(2).alias("source_no"), F.posexplode("l").alias("at", "path")).withColumn("at", F.col("at").cast("long")))
    out = parts[0] if parts else spark.createDataFrame([], "source_no int, at long, path string")
    for p in parts[1:]:
        out = out.unionByName(p)
    listed = placed(out, ["source_no", "at", "path"], out="model_index", first=0).select("model_index", "path")
    if listed.isEmpty():
        raise ValueError("no model found")
    return listed
