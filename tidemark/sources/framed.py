"""Append-oriented logs of framed records, and recovery of what stands before any damage.

A frame is MAGIC, the payload's length (32 bits), a sequence number (64 bits), a CRC-32C over length, sequence and
payload, and the payload; numbers are little-endian.  MAGIC and the greatest length are options.

Reading cuts files into splits of any size.  A split holds the frames whose magic starts in it: its task looks for the
magic at every byte until a frame checks out, then goes from frame to frame, and looks again after damage.  A payload may
hold whole frames of another log: such a frame can only be taken for one at the start of a split, and `recovered` drops
it, because it starts before the end of a frame of the split before.  `recovered` keeps the frames that follow each other
without a gap from the start of their file: what a writer had finished before the power went.  Only runs of such frames
(a few for each split) are compared across a file.

Writing makes one file for each run of rows of one log; files take their names when all tasks have ended well, and go
when one has not.

Edge cases: an empty file has no frames; an empty payload is a frame; a null payload is written as empty; a file cut in
mid-frame loses that frame only; a file whose first byte is damaged has an empty valid prefix.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.functions.checksum import crc32c_of
from tidemark.sources.shared import store

MAGIC = b"\xa5TMF"
HEAD = struct.Struct("<IQI")
FRAMES = "path string, split int, run int, offset long, next long, sequence long, payload binary"
#: Frames that are checked at once, and bytes read at a time beyond a split's end.
AHEAD, MORE = 4096, 1 << 16


def frame_of(sequences: pd.Series, payloads: pd.Series, magic: bytes = MAGIC) -> pd.Series:
    raw = [b"" if p is None else p.encode() if isinstance(p, str) else bytes(p) for p in payloads]
    heads = [struct.pack("<IQ", len(p), int(s)) for s, p in zip(sequences, raw, strict=True)]
    sums = crc32c_of([h + p for h, p in zip(heads, raw, strict=True)])
    return pd.Series([magic + h + struct.pack("<I", int(c)) + p for h, c, p in zip(heads, sums, raw, strict=True)], dtype=object)


def frame(sequence: Column | str, payload: Column | str) -> Column:
    """The bytes of one frame."""
    return F.pandas_udf(lambda s, p: frame_of(s, p), "binary")(sequence, payload)


@dataclass
class Split(InputPartition):
    path: str
    number: int
    start: int
    end: int
    size: int


class Bytes:
    """A window on a file that grows on demand."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.start, self.size = file, start, size
        file.seek(start)
        self.data = bytearray(file.read(end - start))

    def reach(self, end: int) -> bool:
        """Whether the file goes on to `end`, counted from the start of the window."""
        if self.start + end > self.size:
            return False
        while len(self.data) < end:
            self.data += self.file.read(max(MORE, end - len(self.data)))
        return True


def frames_of(window: Bytes, length: int, magic: bytes, most: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(run, offset, next, sequence, payload) of the frames that start in the first `length` bytes of the window."""
    body, at, run, last = len(magic) + HEAD.size, 0, -1, None
    while at < length:
        # Headers that follow each other are gathered first, so that their checksums are one step.
        ahead, p = [], at
        while p < length and len(ahead) < AHEAD and window.reach(p + body) and window.data.startswith(magic, p):
            n, sequence, crc = HEAD.unpack_from(window.data, p + len(magic))
            if n > most or not window.reach(p + body + n):
                break
            ahead.append((p, p + body + n, sequence, crc))
            p += body + n
        sums = crc32c_of([bytes(window.data[p + len(magic) : p + len(magic) + 12]) + bytes(window.data[p + body : q]) for p, q, *_ in ahead])
        good = 0
        for (p, q, sequence, crc), s in zip(ahead, sums.tolist(), strict=True):
            if s != crc:
                break
            run += last != p
            last, good = q, good + 1
            yield run, window.start + p, window.start + q, sequence, bytes(window.data[p + body : q])
        if good:
            at = ahead[good - 1][1]
        if good < len(ahead) or not ahead:
            # A magic that straddles the end of the window's bytes is seen as well.
            window.reach(min(length + len(magic) - 1, window.size - window.start))
            at = window.data.find(magic, at + (good < len(ahead) or window.data.startswith(magic, at)))
            if at < 0:
                return


class FramedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.magic = bytes.fromhex(options.get("magic", MAGIC.hex()))
        self.most, self.split = int(options.get("maxframe", 1 << 24)), int(options.get("splitbytes", 1 << 25))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, place = store(self.path)
        found = files.get_file_info(fs.FileSelector(place, recursive=True)) if files.get_file_info(place).type == fs.FileType.Directory else [files.get_file_info(place)]
        logs = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and "/_" not in f.path[len(place) :] and not f.base_name.startswith("."))
        return [Split(p, k, a, min(a + self.split, size), size) for p, size in logs for k, a in enumerate(range(0, size, self.split))]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        schema = pa.schema([("path", pa.string()), ("split", pa.int32()), ("run", pa.int32()), ("offset", pa.int64()), ("next", pa.int64()), ("sequence", pa.int64()), ("payload", pa.binary())])

        def batch(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array([partition.path] * len(rows), pa.string()), pa.array([partition.number] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, schema.types[2:], strict=True))]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        with files.open_input_file(partition.path) as file:
            rows = []
            for row in frames_of(Bytes(file, partition.start, partition.end, partition.size), partition.end - partition.start, self.magic, self.most):
                rows.append(row)
                if len(rows) == AHEAD:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FramedWriter(DataSourceWriter):
    """Rows (log, frame) in the order of their partition; a file for each run of one log."""

    def __init__(self, options: dict):
        self.path = options["path"]
        files, place = store(self.path)
        self.folder = f"{place}/_job-{uuid.uuid4().hex}"  # made here only: a task that outlives an abort finds none
        files.create_dir(self.folder, recursive=True)

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        files, place = store(self.path)
        task = TaskContext.get()
        attempt = f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}"
        out, log, done = None, None, []
        try:
            for row in iterator:
                if out is None or row["log"] != log:
                    if out is not None:
                        out.close()
                    log = row["log"]
                    done.append((f"{attempt}-{len(done)}", f"{place}/{log}.{task.partitionId()}.{len(done)}.log"))
                    out = files.open_output_stream(done[-1][0])
                out.write(bytes(row["frame"]))
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = store(self.path)
        for part, name in (f for m in messages if m for f in m.files):
            files.move(part, name)
        files.delete_dir(self.folder)

    def abort(self, messages: list[Written | None]) -> None:
        store(self.path)[0].delete_dir(self.folder)


class FramedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FramedReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FramedWriter(dict(self.options))


def write_log(rows: DataFrame, path: str) -> None:
    """Write rows (log, sequence, frame): a log's frames in the order of their sequence, in one file a log."""
    rows.sparkSession.dataSource.register(FramedLog)
    rows.repartition("log").sortWithinPartitions("log", "sequence").select("log", "frame").write.format("framed_log").mode("append").save(path)


def read_log(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """Every frame of the files under a path that checks out, wherever it stands."""
    spark.dataSource.register(FramedLog)
    return spark.read.format("framed_log").options(**options).load(path)


def recovered(frames: DataFrame) -> DataFrame:
    """The frames of each file's valid prefix: those that follow each other without a gap from its start."""
    runs = frames.groupBy("path", "split", "run").agg(F.min("offset").alias("first"), F.max("next").alias("last"))
    before = Window.partitionBy("path").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    chained = runs.withColumn("before", F.coalesce(F.max("last").over(before), F.lit(0)))
    cut = chained.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("first") > F.col("before"), F.col("before"))), F.max("last")).alias("cut"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = runs.groupBy("path", "split").agg(F.max("last").alias("last")).select("path", "split", F.coalesce(F.max("last").over(earlier), F.lit(0)).alias("carry"))
    whole = frames.join(cut, "path").join(carry, ["path", "split"])
    return whole.where((F.col("offset") >= F.col("carry")) & (F.col("next") <= F.col("cut"))).select(*frames.columns)
