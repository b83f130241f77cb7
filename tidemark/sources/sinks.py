"""Writers: longitudinal tables, run metadata, checksummed records, manifests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import crc32c


def longitudinal_csv(rows: DataFrame, path: str) -> None:
    """Discovery history as gzip CSV; maps become JSON here and nowhere before."""
    maps = {c: F.to_json(c) for c, kind in rows.dtypes if kind.startswith("map")}
    rows.withColumns(maps).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def run_metadata(rows: DataFrame, metadata: Mapping[str, str], path: str) -> None:
    """Caller's metadata with row counts, as one JSON object with sorted keys."""
    counts = rows.agg(F.count("*").alias("row_count"), F.count_if(F.col("confidence") > 0).alias("discovery_rows"))
    fields = {**{k: F.lit(v) for k, v in metadata.items()}, "row_count": F.col("row_count"), "discovery_rows": F.col("discovery_rows")}
    counts.select(*[fields[k].alias(k) for k in sorted(fields)]).coalesce(1).write.mode("overwrite").json(path)


def json_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def model_result(summary: DataFrame, version: str, name: str, artifact: Column, start_us: Column, end_us: Column, streams: tuple[str, ...]) -> DataFrame:
    """Result records of sessions, with flags, lineage and a CRC-32C over the compact JSON with sorted keys."""
    flags = F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit("OK"), F.lit("CALIBRATED_EMERGENCE"), F.when(F.size("coherence_frames") > 0, F.lit("COHERENCE_EVENTS_OBSERVED"))))))
    ids = F.array(*[F.lit(s) for s in streams])
    ranges = F.transform(ids, lambda s: F.struct(F.lit(0).cast("long").alias("first_sequence"), F.col("frames").alias("last_sequence"), s.alias("stream_id")))
    body = {
        "device_time_end_us": end_us, "device_time_start_us": start_us, "model": F.struct(artifact.alias("artifact_id"), F.lit(name).alias("name"), F.lit(version).alias("version")), "provenance": F.lit("MODEL_INFERRED"),
        "record_type": F.lit("MODEL_RESULT"), "schema_version": F.lit(version), "source_sequence_ranges": ranges, "source_stream_ids": ids, "status_flags": flags,
    }
    rows = summary.select("session_id", F.struct(*[body[k].alias(k) for k in sorted(body)]).alias("record"))
    return rows.withColumn("crc32c", crc32c(F.to_json("record"))).select("session_id", "record.*", "crc32c")


def dashboard_line(frame: Column, total: Column, edge: Column, modulation: Column) -> Column:
    """One line a frame for a console."""
    return F.format_string("frame %6d | discoveries %8d | modulation %6.3f | %s", frame, total, modulation, F.coalesce(edge, F.lit("-")))
