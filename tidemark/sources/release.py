"""Release manifests and verification summaries that appear whole or not at all.

Entries are JSON lines in part files, one for each task and section; the document names its parts with their digests
and sizes, holds the caller's header and the counts, and is written last and renamed into place by the commit.  What
no document names does not exist for a reader, and an abort removes it.  Nothing but names and counts passes the driver.

Edge cases: an empty table gives a document with no parts; null values are JSON nulls; a part whose digest is not that
of the document makes the reader fail.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.shared import store


@dataclass
class Parts(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)


class ReleaseWriter(DataSourceWriter):
    """Rows (section, entry, passed); `passed` is false for an entry that fails the release."""

    def __init__(self, options: dict):
        self.path, self.header = options["path"], json.loads(options.get("header", "{}"))
        files, place = store(self.path)
        self.folder = f"{place}.parts-{uuid.uuid4().hex}"  # made here only: a task that outlives an abort finds none
        files.create_dir(self.folder, recursive=True)

    def write(self, iterator: Iterator) -> Parts:
        from pyspark import TaskContext

        files, _ = store(self.path)
        task = TaskContext.get()
        open_, found = {}, {}
        try:
            for row in iterator:
                section = row["section"]
                if section not in open_:
                    part = f"{section}-{task.partitionId()}-{task.taskAttemptId()}.jsonl"
                    open_[section] = (files.open_output_stream(f"{self.folder}/{part}"), hashlib.sha256())
                    found[section] = {"section": section, "part": f"{self.folder.rpartition('/')[2]}/{part}", "entries": 0, "failed": 0, "size_bytes": 0}
                line = (row["entry"] + "\n").encode()
                out, digest = open_[section]
                out.write(line)
                digest.update(line)
                about = found[section]
                about["entries"] += 1
                about["failed"] += row["passed"] is False
                about["size_bytes"] += len(line)
        finally:
            for out, _ in open_.values():
                out.close()
        return Parts([about | {"sha256": open_[s][1].hexdigest()} for s, about in found.items()])

    def commit(self, messages: list[Parts | None]) -> None:
        from pyarrow import fs

        files, place = store(self.path)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p["section"], p["part"]))
        named = {p["part"].rpartition("/")[2] for p in parts}
        for f in files.get_file_info(fs.FileSelector(self.folder)):  # of failed and of repeated tasks
            if f.base_name not in named:
                files.delete_file(f.path)
        sections = {s: sum(p["entries"] for p in parts if p["section"] == s) for s in sorted({p["section"] for p in parts})}
        document = self.header | {"verified": not any(p["failed"] for p in parts), "sections": sections, "parts": parts}
        with files.open_output_stream(f"{self.folder}/document") as out:
            out.write((json.dumps(document, indent=2, sort_keys=True) + "\n").encode())
        files.move(f"{self.folder}/document", place)

    def abort(self, messages: list[Parts | None]) -> None:
        store(self.path)[0].delete_dir(self.folder)


class Release(DataSource):
    @classmethod
    def name(cls) -> str:
        return "release_document"

    def schema(self) -> str:
        return "section string, entry string, passed boolean"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ReleaseWriter(dict(self.options))


def _written(rows: DataFrame, path: str, header: Mapping) -> None:
    rows.sparkSession.dataSource.register(Release)
    rows.write.format("release_document").mode("append").option("header", json.dumps(dict(header))).save(path)


def _entries(rows: DataFrame, section: str, passed=None) -> DataFrame:
    entry = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    return rows.select(F.lit(section).alias("section"), entry.alias("entry"), (F.lit(True) if passed is None else passed).alias("passed"))


def write_manifest(files: DataFrame, path: str, header: Mapping | None = None) -> None:
    """Manifest of files (path, sha256, size_bytes)."""
    _written(_entries(files, "files"), path, header or {})


def write_summary(steps: DataFrame, artifacts: DataFrame, placeholders: DataFrame, path: str, header: Mapping | None = None) -> None:
    """Verification summary: steps (with exit_code), artifacts and placeholders left; verified if all steps ended with 0 and none is left."""
    every = _entries(steps, "steps", F.col("exit_code") == 0).union(_entries(artifacts, "artifacts")).union(_entries(placeholders, "disallowed_placeholders", F.lit(False)))
    _written(every, path, header or {})


def document(path: str) -> dict:
    """The document itself: header, counts and parts."""
    files, place = store(path)
    with files.open_input_stream(place) as f:
        return json.loads(f.read())


def read_section(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """Entries of a section, after its parts' digests have been checked where they lie."""
    folder = path.rpartition("/")[0]
    parts = [p for p in document(path)["parts"] if p["section"] == section]
    if not parts:
        return spark.createDataFrame([], schema)
    names = [f"{folder}/{p['part']}" for p in parts]
    held = spark.read.format("binaryFile").load(names).select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("part"), F.sha2("content", 256).alias("sha256"))
    good = {(r["part"], r["sha256"]) for r in held.collect()}  # a name and a digest a part
    bad = [p["part"] for p in parts if (p["part"], p["sha256"]) not in good]
    if bad:
        raise ValueError(f"parts do not match their digests: {bad}")
    return spark.read.schema(schema).json(names)
