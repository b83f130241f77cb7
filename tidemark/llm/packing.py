"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Documents become pieces of at most `capacity` tokens.  Pieces of one length are interchangeable, so the range-sorted
sides of the match are classes: lengths with their counts, in falling order, and gaps with runs of sequences that
have them, in rising order.  A superstep takes the longest length left and sweeps to the successor, the smallest gap
that holds it; conflicts for a run of sequences are resolved by rank, first rank first; the gaps are updated, and the
step repeats until the class is placed.  Pieces without a gap open new sequences.  That is best-fit decreasing.  The
plan is a table of (length, ranks from, ranks to, first sequence, offset).  Its size depends on capacity, not on the
corpus: a superstep ends a run of equal gaps or a class, and only ending a class splits a run, at most capacity times.

Ranks come from the cluster: rows are counted by (length, salt), the counts become offsets, and rows are numbered
within (length, salt), so that a length which a third of all pieces has is dealt over all salts.

Edge cases: null and empty texts are one piece of one token (the end mark); repeated rows are packed each for itself;
a null doc_id is kept; pieces of equal length are ranked by (doc_id, piece, checksum), and rows that agree on these are
interchangeable; a text of any length is tokenised whole and cut into pieces; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import slices, stash
from tidemark.llm.wordtokens import WordBpe, word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SALTS = 64


def to_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece.  Only documents over `capacity` tokens are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: WordBpe = word_bpe(tokenizer)
        for batch, texts in slices(batches):
            doc_ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements (length, from rank, ranks, first sequence, offset) by falling length, and the number of sequences."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: (first sequence, how many)
    gaps: list[int] = []  # those with runs, rising
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                gap = gaps[i]
                first, many = runs[gap].pop()
                if not runs[gap]:
                    gaps.pop(i)
            # A gap that holds several pieces of this length takes them all before the next is touched, as it stays the smallest.
            deep = min(left, gap // length)
            taken = min(many, left // deep)
            out += [(length, rank + j * taken, taken, first, capacity - gap + j * length) for j in range(deep)]
            for rest, start, size in ((gap, first + taken, many - taken), (gap - deep * length, first, taken)):
                if rest and size:
                    if not runs[rest]:
                        bisect.insort(gaps, rest)
                    runs[rest].append((start, size))
            left, rank = left - deep * taken, rank + deep * taken
    return np.array(out, np.int64).reshape(-1, 5), opened


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces with sequence_id and offset; offsets within a sequence are gapless from 0."""
    pieces = stash(to_pieces(docs, tokenizer, capacity, end_id), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int").alias("salt")
    salted = pieces.select("*", salt)
    # At most capacity x SALTS rows, whatever the corpus.
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    placements, _ = plan(counts, capacity)
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    order = np.lexsort((placements[:, 1], placements[:, 0]))
    placements = placements[order]
    stride = 1 + max(counts.values(), default=0)
    starts = placements[:, 0] * stride + placements[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            p = placements[np.searchsorted(starts, length * stride + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p[:, 3] + rank - p[:, 1]), pa.array(p[:, 4])], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
