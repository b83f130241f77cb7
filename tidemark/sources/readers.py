"""Readers: telemetry tables, session records, JSON documents, file manifests, generated controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("first_sequence", T.LongType()), T.StructField("last_sequence", T.LongType())])
_MODEL = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "version", "artifact_id")])
_TEXTS = T.ArrayType(T.StringType())
#: Superset of all record kinds, with an explicit payload of samples.
SESSION_RECORD = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("schema_version", T.StringType()), ("record_type", T.StringType()), ("provenance", T.StringType()), ("device_time_start_us", T.LongType()), ("device_time_end_us", T.LongType()),
            ("status_flags", _TEXTS), ("crc32c", T.StringType()), ("source_stream_ids", _TEXTS), ("source_sequence_ranges", T.ArrayType(_RANGE)), ("model", _MODEL), ("decision_id", T.StringType()),
            ("actuation_evidence_ids", _TEXTS), ("dropped_first_sequence", T.LongType()), ("dropped_last_sequence", T.LongType()), ("cause", T.StringType()), ("session_id", T.StringType()), ("payload", T.MapType(T.StringType(), T.StringType())),
        )
    ]
)


def telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text: values are read by the canonicaliser, never by inference."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def session_records(spark: SparkSession, path: str, array: bool | None = None) -> DataFrame:
    """Records from a JSON array or from one object a line; without `array` the first byte of the first file decides."""
    if array is None:
        head = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").limit(1).first()
        array = bool(head) and head["v"].startswith("[")
    reader = spark.read.schema(SESSION_RECORD)
    return (reader.option("multiLine", True) if array else reader).json(path)


def samples_of(records: DataFrame) -> DataFrame:
    """Numeric payload fields of records in long form; booleans count as 0 and 1, other text is left out."""
    text = F.transform_values("payload", lambda _, v: F.when(v == "true", "1").when(v == "false", "0").otherwise(v))
    typed = F.transform_values(text, lambda _, v: F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double")))
    numeric = F.map_filter(typed, lambda _, v: v.isNotNull())
    return records.select("session_id", F.coalesce("device_time_start_us", F.lit(0)).alias("device_time_us"), F.explode(numeric).alias("stream", "value"))


def or_null_rows(rows: DataFrame, streams: Sequence[str], n: int = 10) -> DataFrame:
    """Wide samples (ts and streams), or n rows of zeros a minute apart where there are none."""
    none = rows.limit(1).agg((F.count("*") == 0).alias("none"))
    zeros = rows.sparkSession.range(n).crossJoin(F.broadcast(none)).where("none").select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), *[F.lit(0.0).alias(c) for c in streams])  # one row
    return rows.select("ts", *[F.col(c).cast("double").alias(c) for c in streams]).unionByName(zeros)


def wide_samples(samples: DataFrame, streams: Sequence[str]) -> DataFrame:
    """Long samples to one column a stream; streams are named, so no pass looks for them."""
    return samples.groupBy("session_id", "device_time_us").pivot("stream", list(streams)).agg(F.last("value", ignorenulls=True))


def null_control(spark: SparkSession, frames: int, session_id: str = "null") -> DataFrame:
    """A session of zero channels on a one-minute grid, with noise as control."""
    zero = F.lit(0.0)
    return spark.range(frames).select(
        F.lit(session_id).alias("session_id"), F.col("id").alias("frame"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), zero.alias("em_rf"), zero.alias("optical_ir"), zero.alias("consciousness_proxy"),
        F.randn(42).alias("control_baseline"), zero.alias("kp_index"), zero.alias("lunar_phase"), zero.alias("sidereal_time"), zero.alias("xray_flux"),
    )


def initial_field(spark: SparkSession, size: int, seed: int = 42) -> DataFrame:
    """Channel, x, y and a value of N(0, 0.02) for each cell."""
    cell = spark.range(4 * size * size)
    return cell.select((F.col("id") % 4).alias("channel"), (F.floor(F.col("id") / 4) % size).alias("x"), F.floor(F.col("id") / (4 * size)).alias("y"), (F.randn(seed) * 0.02).alias("value"))


def documents(spark: SparkSession, path: str, items: str | None = None) -> DataFrame:
    """JSON documents, one a file; `items` names an array to explode into rows."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode(items).alias("item")).select("item.*") if items else df


def file_manifest(spark: SparkSession, root: str, globs: Sequence[str]) -> DataFrame:
    """path, sha256 and size of every file that any glob matches, once each, in the order of paths."""
    found = None
    for g in globs:
        part = spark.read.format("binaryFile").option("pathGlobFilter", g).option("recursiveFileLookup", True).load(root)
        found = part if found is None else found.union(part)
    return found.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).dropDuplicates(["path"]).orderBy("path")


def whole_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path and whole text of files."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(list(paths)).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
