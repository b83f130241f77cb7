"""Helpers that the corpus operators share: shared-storage tables and word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables of ids of up to this many rows are broadcast: two longs each, about 50 MB as a hash table.
BROADCAST_IDS = 500_000

#: Odd 64-bit constants of a public integer mixer (fixed values).
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Only in local mode, as in tests, may it be unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/tidemark-checkpoints"
    return path.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor costs nothing.

    The shuffle files of the write are removed when it ends, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(stashed: DataFrame) -> None:
    """Delete one stashed table that nothing reads any more."""
    _written.remove(stashed._stash)
    _delete(stashed.sparkSession, stashed._stash)


def stashed() -> list[str]:
    """Paths of the tables stashed so far and not deleted."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these stashed tables.  Only for callers who have written what reads them."""
    for path in paths:
        if path in _written:
            _written.remove(path)
            _delete(spark, path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give freed memory back to the system.  Python workers live through many tasks and would else keep the most that any took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        return


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 3_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut record batches into runs of about `limit` bytes of text; null texts become empty."""
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        ends = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start), [t or b"" for t in texts.slice(start, stop - start).to_pylist()]
            start = stop
    trim()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: (64-bit hash of each word, word count per text, first word of each text)."""
    return hash_words([t.split() for t in texts])


def hash_words(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts that are split already."""
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(parts))
    codes, unique = pd.factorize(flat)
    hashes = pd.util.hash_array(unique, categorize=False) if len(unique) else np.empty(0, np.uint64)
    return hashes[codes], counts, np.cumsum(counts) - counts


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n words; callers drop those that cross a text's end."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    acc = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        acc = mix(acc * GOLDEN + hashes[j : len(hashes) - n + 1 + j])
    return acc if n > 1 else mix(acc)
