"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The local alignment (match 2, mismatch -1, gap -1) of a passage with a test item is scored as a share of the item's
perfect score.  Words are lower-cased and lose their punctuation.

Seeds are ordered pairs of words that stand next to each other or with one word between.  An alignment that reaches
`least` of an item of n words has at least least * n - 1 neighbouring matches with one edit or none between them, since every
other step between matches takes two edits, which cost a match.  Each of them is a seed that starts at another
word of the item.  So of the n - 1 words that start seeds, the least * n - 2 whose seeds are most frequent in the documents can
be left out, and a passage that is due still hits one of the rest: the rare seeds.  They join passages (twice the item's
length to either side of a hit) to items, and passages in which fewer than least * n - 1 words of the item start a
seed are dropped.  What is left is aligned, equal passages once; no pair that reaches `least` is lost.

Items are searched in blocks of at most BLOCK_WORDS words (a few arrays of 8 bytes each, a broadcast of proven size); each
block reads all documents twice, once to count seeds and once to find them, and every row meets every block.

Edge cases: null and empty texts match nothing; items of fewer than `min_words` words are too short to tell a copy from
chance and match nothing; repeated items match each for itself; rows that share a doc_id report the best score of
any, of equal scores the earliest; seeds of equal frequency are taken in the item's order; null doc_id or item_id are
kept as null; further columns are ignored; empty tables give an empty result; texts of any length are searched whole,
in linear time, and an item's length bounds the passages aligned with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GOLDEN, mix, slices, stash, words_of

BLOCK_WORDS = 2_000_000
_DROPPED = b".,;:!?\"'()"
PASSAGES = "doc_id long, item int, at long, words binary"
ALIGNED = "content string, item int, score double, start long, end long"
LEAKS = "doc_id long, item_id long, score double, start_word long, end_word long"


def normal_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return words_of([t.lower().translate(None, _DROPPED) for t in texts])


def align(stretch: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where in `stretch` it ends (exclusive)."""
    j = np.arange(len(stretch) + 1)
    row, best, end = np.zeros(len(stretch) + 1, np.int64), 0, 0
    for word in item:
        step = np.maximum(row - 1, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(stretch == word, 2, -1))
        row = np.maximum(np.maximum.accumulate(step + j) - j, 0)
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def _pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds that start at each word: with the next word, and with the one after it."""
    return tuple(mix(words[: max(0, len(words) - k)] * GOLDEN + words[k:]) for k in (1, 2))


def _items(benchmark: DataFrame, min_words: int) -> DataFrame:
    """item_id, words (hashes) and n of each item with at least `min_words` words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            hashes, counts, starts = normal_words(texts)
            words = [hashes[s : s + n].tobytes() for s, n in zip(starts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(counts.astype(np.int64))], ["item_id", "words", "n"])

    return benchmark.select("item_id", "text").mapInArrow(cut, "item_id long, words binary, n long").where(f"n >= {min_words}").withColumn("at", F.monotonically_increasing_id())


class Items:
    """The items of a block: their words, their seeds, and which of them are rare."""

    def __init__(self, words: list[np.ndarray], least: float):
        self.words, self.least = words, least
        self.seeds = np.unique(np.concatenate([np.concatenate(_pairs(w)) for w in words]))
        self.needed = [max(1, math.ceil(least * len(w)) - 1) for w in words]
        self.use(self.seeds)

    def use(self, seeds: np.ndarray) -> None:
        self.wanted = seeds
        self.filter = np.zeros(1 << 20, bool)  # by the upper bits, before the search
        self.filter[(seeds >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of wanted seeds among pairs, and their numbers among the wanted."""
        at = np.flatnonzero(self.filter[(pairs >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.wanted, pairs[at]), len(self.wanted) - 1)
        same = self.wanted[place] == pairs[at]
        return at[same], place[same]

    def choose(self, counts: np.ndarray) -> None:
        """Keep the seeds of each item's rarest words, given how often every seed is found."""
        seeds, items = [], []
        for k, (words, needed) in enumerate(zip(self.words, self.needed, strict=True)):
            one, two = _pairs(words)
            often = counts[np.searchsorted(self.seeds, one)].astype(float)
            often[: len(two)] += counts[np.searchsorted(self.seeds, two)]
            rare = np.argsort(often, kind="stable")[: len(one) - needed + 1]
            some = np.unique(np.concatenate([one[rare], two[rare[rare < len(two)]]]))
            seeds.append(some)
            items.append(np.full(len(some), k, np.int32))
        seeds, items = np.concatenate(seeds), np.concatenate(items)
        order = np.argsort(seeds, kind="stable")
        wanted, self.begin, self.many = np.unique(seeds[order], return_index=True, return_counts=True)
        self.of_seed = items[order]
        self.use(wanted)

    def enough(self, item: int, passage: np.ndarray) -> bool:
        """Whether as many words of the item start a seed in the passage as an alignment must have."""
        (one, two), there = _pairs(self.words[item]), np.concatenate(_pairs(passage))
        started = np.isin(one, there)
        started[: len(two)] |= np.isin(two, there)
        return int(started.sum()) >= self.needed[item]


def _inside(at: np.ndarray, reach: int, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places with a word `reach` further lie in one text, and the text of each place."""
    doc = np.searchsorted(starts + counts, at, side="right")
    return at + reach < starts[doc] + counts[doc], doc


def _counted(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each seed of the items is found in the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.seeds), np.int64)
        for _, texts in slices(batches):
            hashes, counts, starts = normal_words(texts)
            for reach, pairs in enumerate(_pairs(hashes), 1):
                at, seed = items.hits(pairs)
                total += np.bincount(seed[_inside(at, reach, starts, counts)[0]], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["seed", "n"])

    out = np.zeros(len(items.seeds), np.int64)
    for r in docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():  # twice BLOCK_WORDS rows at most
        out[r["seed"]] = r["n"]
    return out


def _found(docs: DataFrame, items: Items) -> DataFrame:
    """Passages around rare seeds that hold enough seeds of their item."""
    sizes = np.array([len(w) for w in items.words])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            hashes, counts, starts = normal_words(texts)
            parts = []
            for reach, pairs in enumerate(_pairs(hashes), 1):
                at, seed = items.hits(pairs)
                ok, doc = _inside(at, reach, starts, counts)
                at, seed, doc = at[ok], seed[ok], doc[ok]
                many = items.many[seed]
                which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.begin[seed], many)
                parts.append((np.repeat(doc, many), items.of_seed[which], np.repeat(at, many)))
            doc, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, item, doc))
            doc, item, at = doc[order], item[order], at[order]
            rows = []
            if len(at):
                size = sizes[item]
                low, high = np.maximum(starts[doc], at - 2 * size), np.minimum(starts[doc] + counts[doc], at + 2 * size + 3)
                new = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0) | (low[1:] > high[:-1])) + 1
                for i, j in zip(np.append(0, new).tolist(), np.append(new, len(at)).tolist(), strict=True):
                    passage = hashes[low[i] : high[j - 1]]
                    if items.enough(item[i], passage):
                        d = int(doc[i])
                        rows.append((batch.column(0)[d].as_py(), int(item[i]), int(low[i] - starts[d]), passage.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PASSAGES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(find, PASSAGES)


def _block(docs: DataFrame, part: DataFrame, least: float, least_words: int) -> DataFrame:
    rows = part.select("item_id", "words").collect()  # BLOCK_WORDS words at most, or one longer item
    items = Items([np.frombuffer(r["words"], np.uint64) for r in rows], least)
    items.choose(_counted(docs, items))
    passages = stash(_found(docs, items).withColumn("content", F.sha2("words", 256)), "passages")
    contents = passages.select("content", "item", "words").dropDuplicates(["content", "item"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, item, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = np.frombuffer(words, np.uint64), items.words[item]
                best, end = align(s, t)
                if best >= least * 2 * len(t) and best >= 2 * min(len(t), least_words):
                    back = align(s[:end][::-1], t[::-1])[1]
                    out.append((content, item, best / (2 * len(t)), end - back, end))
            columns = list(zip(*out, strict=True)) or [()] * len(_ALIGNED)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ALIGNED.types, strict=True)], schema=_ALIGNED)

    scores = contents.mapInArrow(aligned, ALIGNED)
    names = docs.sparkSession.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], "item int, item_id long")
    out = passages.select("content", "item", "doc_id", "at").join(scores, ["content", "item"]).join(F.broadcast(names), "item")
    return out.select("doc_id", "item_id", "score", (F.col("at") + F.col("start")).alias("start_word"), (F.col("at") + F.col("end")).alias("end_word"))


_ALIGNED = pa.schema([("content", pa.string()), ("item", pa.int32()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 4, least: float = 0.5, least_words: int = 0) -> DataFrame:
    """Pairs of document and item whose alignment reaches `least` of the item's perfect score, and that of `least_words` words (of all, if it has fewer), with the place of the best."""
    items = stash(_items(benchmark, min_words), "items")
    n_blocks = -(-(items.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS)
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("at"), F.lit(n_blocks)) == k)
        if n_blocks == 1 or not part.isEmpty():
            found = found.union(_block(docs, part, least, least_words))
    best = F.max(F.struct("score", -F.col("start_word"), "end_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.col2")).alias("start_word"), F.col("best.end_word").alias("end_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 8, **options) -> DataFrame:
    """docs without the documents that hold a copy of a test item.

    Leaks are found by text, so that documents without an id go as well; rows that share an id with one go with it.  A
    copy has at least `least_words` matching words, or the whole item: two common words in a row are no copy of a short one.
    """
    key = F.xxhash64("text")
    found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark, least_words=least_words, **options)
    keys = stash(found.select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    own = docs.where("doc_id is not null").select("doc_id", key.alias("key"))
    ids = stash(own.join(keys, own["key"] == keys["_leak"], "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "leaks")
    left = docs.join(keys, F.xxhash64(docs["text"]) == keys["_leak"], "left_anti")
    return left.join(ids, left["doc_id"] == ids["_id"], "left_anti").select(*docs.columns)
