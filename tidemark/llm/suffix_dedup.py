"""Exact substring dedup by refinement of buckets of anchored windows, after bucket-pointer refinement.

A byte goes if a string of `length` bytes that covers it starts anywhere else, in the same or another document.

Every window of `length` bytes has an anchor, the leftmost of its q-grams with the least hash; equal windows have
equal anchors at equal offsets.  The initial buckets are anchors with their surroundings: windows of one anchor
whose offsets fall into one class of 128 share a core, the bytes that all of them cover, and its hash is the bucket.
Buckets of one are done.  A bucket whose members also agree on their whole extent is done too: all their windows
repeat.  Members that differ are refined: classes of 16 offsets in the bucket, with a longer core, and then single
windows, each named by the bucket it comes from and by its own content instead of by buckets at later offsets.  One member stands for all with equal extents, so groups of copies are refined
once, and a member that is still open at any step is the only one with its extent, so results need not be sent back.
Buckets are named by hashes of their parent's name and content: equal content has the same name on every executor
without a global sort, and (bucket, extent) has 128 bits.

Per anchor about 2.5 small rows are shuffled, one row for each 75 bytes of text; texts are read again only for documents
with open members and with repeats, whose ids are broadcast up to BROADCAST_IDS and joined by shuffle beyond.

Edge cases: a null text is empty; shorter texts keep everything; rows that repeat doc_id and text repeat each other;
null doc_ids are kept; further columns are ignored; an empty table gives an empty result; a text of any length is cut
into runs of windows, so that memory does not grow with it.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_IDS, GOLDEN, discard, mix, stash

Q = 32
CLASSES = (128, 16, 1)
RUN = 1_000_000
#: Buckets of more members than this are picked out by broadcast, so that no task gets all of one.
HOT = 10_000
#: Odd multipliers of the two rolling hashes, fixed values.
_BASES = (np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F))
ROWS = "doc_id long, text_hash long, core long, extent long, offset int, start int, n int"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


class Rolling:
    """Hashes of any ranges of a buffer, from prefix sums modulo 2^64, under both bases."""

    def __init__(self, data: np.ndarray):
        values = data.astype(np.uint64) + np.uint64(1)
        self.sums, self.shift = [], []
        for base in _BASES:
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, len(data) - 1), base)]))[: len(data)]
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(values * powers, dtype=np.uint64)]))
            back = _inverse(base)
            self.shift.append(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), back)])))

    def __call__(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self.sums[which]
        return (sums[end] - sums[start]) * self.shift[which][start]


def _members(roll: Rolling, starts: np.ndarray, anchors: np.ndarray, new: np.ndarray, size: int, length: int, parents: np.ndarray):
    """Cut window starts into members: runs of one anchor and one class of `size` offsets.  new: a run must start here."""
    klass = (anchors - starts) // size
    cut = new.copy()
    cut[1:] |= (np.diff(anchors) != 0) | (np.diff(klass) != 0) | (np.diff(starts) != 1)
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(starts)) - 1
    first, p, c = starts[at], anchors[at], klass[at]
    low = p - size * c
    core = mix(mix(roll(0, low, low - (size - 1) + length) + GOLDEN * (c.astype(np.uint64) + np.uint64(size))) ^ parents[at])
    offset, n = p - first, last - at + 1
    extent = mix(roll(1, first, starts[last] + length) ^ mix((offset << 20 | n).astype(np.uint64)))
    return at, core, extent, offset, first, n


def _initial(data: np.ndarray, valid: np.ndarray, length: int):
    """Members of class 128 of the valid window starts in a buffer."""
    roll = Rolling(data)
    n, width = len(data), length - Q + 1
    where = np.arange(n - Q + 1)
    gram = mix(roll(0, where, where + Q))
    keys = (gram & np.uint64(0xFFFFFFFFFF000000)) | where.astype(np.uint64)
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(-1, width)
    ahead, behind = np.minimum.accumulate(table, axis=1).ravel(), np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(valid[: n - length + 1])
    anchors = (np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.zeros(len(starts), bool)
    if len(new):
        new[0] = True
    return _members(roll, starts, anchors, new, CLASSES[0], length, np.zeros(len(starts), np.uint64))


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def members(docs: DataFrame, length: int) -> DataFrame:
    """The initial members of all documents (docs: doc_id, text_hash, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, int, bytes]] = []  # doc_id, hash, place of the part in its text, bytes
        held = 0

        def emit() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
            sizes = np.array([len(p[3]) for p in parts])
            begin = np.cumsum(sizes) - sizes
            valid = np.ones(len(data), bool)
            for b, s in zip(begin.tolist(), sizes.tolist(), strict=True):
                valid[b + s - length + 1 : b + s] = False
            _, core, extent, offset, first, n = _initial(data, valid, length)
            which = np.searchsorted(begin, first, side="right") - 1
            place = np.array([p[2] for p in parts])
            ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(which))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.array([p[1] for p in parts], np.int64)[which]), pa.array(core.view(np.int64)), pa.array(extent.view(np.int64)), pa.array(offset.astype(np.int32)), pa.array((first - begin[which] + place[which]).astype(np.int32)), pa.array(n.astype(np.int32))], _NAMES)

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                for a in range(0, len(text) - length + 1, RUN):
                    part = text[a : a + RUN + length - 1]
                    parts.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), a, part))
                    held += len(part)
                    if held >= RUN:
                        yield emit()
                        parts, held = [], 0
        if parts:
            yield emit()

    return docs.mapInArrow(cut, ROWS)


def refined(texts: DataFrame, open_: DataFrame, size: int, length: int) -> DataFrame:
    """Members of class `size` of the open members (doc_id, text_hash, core, offset, start, n) of the level above."""
    by_doc = open_.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("core", "offset", "start", "n")).alias("open"))
    rows = texts.join(by_doc.withColumnRenamed("doc_id", "id"), (texts["doc_id"].eqNullSafe(F.col("id"))) & (texts["text_hash"] == by_doc["text_hash"]))
    rows = rows.select("doc_id", texts["text_hash"], "text", F.col("open.core").alias("core"), F.col("open.offset").alias("offset"), F.col("open.start").alias("start"), F.col("open.n").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[i].as_py().encode(), np.uint8)
                core, offset, start, n = (batch.column(k)[i].values.to_numpy() for k in (3, 4, 5, 6))
                order = np.argsort(start, kind="stable")
                for j in range(0, len(order), 2000):  # members of a stretch of the text at a time
                    some = order[j : j + 2000]
                    base, stop = int(start[some[0]]), int((start[some] + n[some]).max()) + length - 1
                    roll = Rolling(data[base:stop])
                    count = n[some].astype(np.int64)
                    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    starts = np.repeat(start[some].astype(np.int64) - base, count) + within
                    anchors = np.repeat(start[some].astype(np.int64) - base + offset[some], count)
                    parents = np.repeat(core[some].view(np.uint64), count)
                    _, c, e, o, f, m = _members(roll, starts, anchors, within == 0, size, length, parents)
                    k = len(c)
                    yield _batch([np.full(k, batch.column(0)[i].as_py()) if batch.column(0)[i].as_py() is not None else [None] * k, np.full(k, batch.column(1)[i].as_py()), c.view(np.int64), e.view(np.int64), o.astype(np.int32), (f + base).astype(np.int32), m.astype(np.int32)])

    return rows.mapInArrow(cut, ROWS)


def _in_buckets(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows whose bucket has more than one (sizes: core, k)."""
    several = stash(sizes.where("k > 1"), "buckets")
    hot = stash(several.where(F.col("k") > HOT).select("core"), "hot-buckets")
    if not 0 < hot.count() <= BROADCAST_IDS:
        return rows.join(several.select("core"), "core", "left_semi")
    large = F.broadcast(hot)
    return rows.join(large, "core", "left_semi").union(rows.join(large, "core", "left_anti").join(several.select("core"), "core", "left_semi"))


def _sorted_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of members: the ranges whose windows all repeat, and those that stay open (one for each extent of a bucket)."""
    every = stash(rows, "all-members")
    rows = stash(_in_buckets(every, every.groupBy("core").agg(F.count("*").alias("k"))), "members")
    discard(every)
    extents = rows.groupBy("core", "extent").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "text_hash", "offset", "start", "n")).alias("one"))
    extents = stash(extents, "extents")
    done = rows.join(extents.where("k > 1").select("core", "extent"), ["core", "extent"]).select("doc_id", "text_hash", "start", "n")
    mixed = _in_buckets(extents, extents.groupBy("core").agg(F.count("*").alias("k")))
    return done, mixed.select("one.doc_id", "one.text_hash", "core", "one.offset", "one.start", "one.n")


def _of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents whose (doc_id, text_hash) is, or is not, among ids."""
    keys = ids.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash")
    return docs.join(keys, docs["doc_id"].eqNullSafe(F.col("id")) & (docs["text_hash"] == F.col("hash")), how)


def repeats(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """docs with text_hash; and (doc_id, text_hash, start, n): n window starts from byte `start` on that all repeat."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found, open_ = _sorted_out(members(docs, length))
    texts = None
    for size in CLASSES[1:]:
        open_ = stash(open_, "open")
        if open_.isEmpty():
            break
        if texts is None:
            ids = open_.select("doc_id", "text_hash").distinct()
            some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
            texts = stash(_of(docs, some, "left_semi").dropDuplicates(["doc_id", "text_hash"]), "open-texts")
        more, open_ = _sorted_out(refined(texts, open_, size, length))
        found = found.union(more)
    return docs, stash(found, "ranges")


def _spans(starts: list[int], counts: list[int], length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, n in sorted(zip(starts, counts, strict=True)):
        b = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]




def cut(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of every document."""
    docs, ranges = repeats(docs, length)
    by_doc = ranges.groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    ids = stash(ranges.select("doc_id", "text_hash").distinct(), "repeat-ids")
    none = F.array().cast("array<int>")
    lists = by_doc.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash")

    def joined(part: DataFrame, how: str) -> DataFrame:
        out = part.join(lists, part["doc_id"].eqNullSafe(F.col("id")) & (part["text_hash"] == F.col("hash")), how)
        return out.select("doc_id", "text", F.coalesce("starts", none).alias("starts"), F.coalesce("counts", none).alias("counts"))

    if ids.count() <= BROADCAST_IDS:  # then texts without repeats are not shuffled
        rest = _of(docs, F.broadcast(ids), "left_anti").select("doc_id", "text", none.alias("starts"), none.alias("counts"))
        rows = rest.union(joined(_of(docs, F.broadcast(ids), "left_semi"), "inner"))
    else:
        rows = joined(docs, "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                spans = _spans(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), length)
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else text
                out.append((len(text), len(text) - len(kept), len(spans), kept))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


