"""Emission without repeats: each micro-batch is committed once, by query and batch number."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import store


def _marker(path: str, query: str, batch: int) -> str:
    return f"{path}/{query}/commits/{batch}"


def _exists(path: str) -> bool:
    from pyarrow import fs

    files, place = store(path)
    return files.get_file_info(place).type == fs.FileType.File


def committed_sink(path: str, query: str, before_commit: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each batch of a query to its own folder and then commits it.

    A batch that comes again after its commit is left alone; one that failed before is written over.  Readers see
    committed batches only, so rows appear once whatever restarts happen.
    """

    def emit(df: DataFrame, batch: int) -> None:
        marker = _marker(path, query, batch)
        if _exists(marker):
            return
        df.write.mode("overwrite").parquet(f"{path}/{query}/batches/{batch}")
        if before_commit:
            before_commit(batch)
        files, place = store(marker)
        files.create_dir(place.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{place}.tmp") as out:
            out.write(json.dumps({"query": query, "batch": batch}).encode())
        files.move(f"{place}.tmp", place)

    return emit


def committed(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of all committed batches, with their batch number."""
    from pyarrow import fs

    files, place = store(f"{path}/{query}/commits")
    found = files.get_file_info(fs.FileSelector(place, allow_not_found=True))
    batches = sorted(int(f.base_name) for f in found if f.base_name.isdigit())
    if not batches:
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(schema).parquet(*[f"{path}/{query}/batches/{b}" for b in batches])
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batches/(\d+)/", 1).cast("long"))


def emit(stream: DataFrame, path: str, query: str, **options) -> None:
    """Run a stream over what its source has now, committing each batch; a later call goes on where this one ended."""
    sink = committed_sink(path, query, **options)
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/{query}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
