"""Ranked lexical search by inverted treaps, simultaneous for all terms of an item.

Documents are tokenised once per block of items; what is kept is the length of a document and its counts of terms that
the block's items hold.  A task cuts its documents into shards of bounded size and builds for each term a treap: a
binary search tree by place in doc_id order that is a heap by impact, so that the root of a subtree is the largest
impact within its range of documents.  An item's treaps are walked together, range by range: the roots' impacts, summed
with the terms' weights, bound the score of every document of the range, and a range whose bound is below the tenth
score known goes with all its subtrees.  Other ranges are cut at the root that weighs most; that document is scored
whole, and each treap descends to its roots left and right of it.  Ranges of at most LEAF documents are scored from
their postings.  All items' ranges of one depth are taken together, as arrays.  Tasks keep their tenth scores from shard
to shard and pass on ten documents an item; the ten best of all tasks are the answer.

The score is the one that op11's contract fixes, in 64-bit integers; the weight of a term comes from counts over all
documents.

Edge cases: null and empty texts, and texts without a term, are no documents and no queries; a null doc_id is kept and
comes after all others of its score; repeated rows rank each for itself; rows of one item_id or one text answer each for
itself; fewer than ten documents with a score above 0 are returned as they are; an empty table on either side gives an
empty result; texts are read whole, whatever their length; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import discard, mix, slices, stash

#: Bytes of item texts that one pass over the documents answers.
BLOCK_BYTES = 16_000_000
#: Postings of one shard, and documents of it, at most (one document more or less).
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 65_536
#: Ranges of so few documents are scored without further descent.
LEAF = 4
#: Item terms that descend together.
TOGETHER = 4_000
NO_ID = 2**63 - 1

_WORD = b"abcdefghijklmnopqrstuvwxyz0123456789"
_TO_TERMS = bytes(c if c > 127 or c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TO_TERMS).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the numbers and counts of the terms in the vocabulary, for each document with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, get = max(1, len(vocabulary)), vocabulary.get
        for batch, texts in slices(batches):
            parts = [terms(t) for t in texts]
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            at = np.fromiter((get(w, -1) for p in parts for w in p), np.int64, int(n.sum()))
            keys, tf = np.unique((np.repeat(np.arange(len(n)), n) * size + at)[at >= 0], return_counts=True)
            cuts = np.searchsorted(keys, np.arange(len(n) + 1) * size)
            which, tf = (keys % size).astype("<i4"), tf.astype("<i4")
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(on)), pa.array(n[on]), *(pa.array([a[cuts[i] : cuts[i + 1]].tobytes() for i in on], pa.binary()) for a in (which, tf))], ["doc_id", "n", "t", "f"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, t binary, f binary")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: one row a term from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("t").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # the block's vocabulary
        out[r["term"]] = r["df"]
    return out


@dataclass
class Best:
    """The k best documents of each query so far."""

    n: int
    k: int
    query: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    null: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    least: np.ndarray = None

    def __post_init__(self) -> None:
        self.least = np.ones(self.n, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        on = score >= self.least[query]
        if not on.any():
            return
        q, s = np.append(self.query, query[on]), np.append(self.score, score[on])
        d, z = np.append(self.doc, doc[on]), np.append(self.null, null[on])
        order = np.lexsort((d, z, -s, q))
        q = q[order]
        first = np.searchsorted(q, q, side="left")
        top = np.arange(len(q)) - first < self.k
        order = order[top]
        self.query, self.score, self.doc, self.null = q[top], s[order], d[order], z[order]
        full = np.flatnonzero(np.bincount(self.query, minlength=self.n) == self.k)
        self.least[full] = self.score[np.searchsorted(self.query, full, side="right") - 1]


class Shard:
    """Treaps of the terms of some documents, which stand in doc_id order."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, norm: np.ndarray, place: np.ndarray, term: np.ndarray, tf: np.ndarray, size: int):
        order = np.lexsort((doc, null))
        self.doc, self.null, self.n = doc[order], null[order], len(doc)
        moved = np.empty(self.n, np.int64)
        moved[order] = np.arange(self.n)
        key = term.astype(np.int64) * self.n + moved[place]
        by = np.argsort(key, kind="stable")
        self.key, self.at = key[by], moved[place][by]
        tf = tf[by].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[place][by])
        self.start = np.searchsorted(self.key, np.arange(size + 1) * self.n)
        self._grow()

    def _grow(self) -> None:
        """Left and right child of each posting and the root of each term; equal impacts fall by a hash, which keeps treaps shallow."""
        count = len(self.key)
        heap = np.empty(count, np.int64)
        heap[np.lexsort((mix(self.at.astype(np.uint64) + np.uint64(1)), self.impact))] = np.arange(count)
        left, right, root = [-1] * count, [-1] * count, [-1] * (len(self.start) - 1)
        rank, cuts = heap.tolist(), self.start.tolist()
        for t in range(len(root)):
            path: list[int] = []
            for i in range(cuts[t], cuts[t + 1]):
                below, r = -1, rank[i]
                while path and rank[path[-1]] < r:
                    below = path.pop()
                left[i] = below
                if path:
                    right[path[-1]] = i
                path.append(i)
            if path:
                root[t] = path[0]
        self.left, self.right, self.root = (np.array(x, np.int64) for x in (left, right, root))

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Descend from each node to the first one inside [low, high), or to -1."""
        node = node.copy()
        on = np.flatnonzero(node >= 0)
        while len(on):
            at = self.at[node[on]]
            on = on[(at < low[on]) | (at >= high[on])]
            now = node[on]
            node[on] = np.where(self.at[now] >= high[on], self.left[now], self.right[now])
            on = on[node[on] >= 0]
        return node

    def search(self, which: np.ndarray, query: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Walk the treaps of these queries (entries sorted by query).  Returns how many documents were scored."""
        scored = 0
        node = self.root[term]
        on = node >= 0
        row, term, weight, node = np.unique(query[on], return_inverse=True)[1] if on.any() else np.empty(0, np.int64), term[on], weight[on], node[on]
        q = np.unique(query[on])
        low, high = np.zeros(len(q), np.int64), np.full(len(q), self.n, np.int64)
        while len(q):
            begin = np.searchsorted(row, np.arange(len(q)))
            part = weight * self.impact[node]
            keep = np.add.reduceat(part, begin) >= best.least[which[q]]
            small = keep & (high - low <= LEAF)
            split = keep & ~small
            if small.any():
                scored += self._leaves(which, q, low, high, row, term, weight, small, best)
            if not split.any():
                break
            number = np.cumsum(split) - 1
            on = split[row]
            q, low, high = q[split], low[split], high[split]
            row, term, weight, node, part = number[row[on]], term[on], weight[on], node[on], part[on]
            begin = np.searchsorted(row, np.arange(len(q)))
            top = np.flatnonzero(part == np.maximum.reduceat(part, begin)[row])
            top = top[np.searchsorted(row[top], np.arange(len(q)))]
            cut = self.at[node[top]]
            scored += len(q)
            key = term * self.n + cut[row]
            hit = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            total = np.add.reduceat(np.where(self.key[hit] == key, weight * self.impact[hit], 0), begin)
            best.add(which[q], total, self.doc[cut], self.null[cut])
            left, right = self.within(node, low[row], cut[row]), self.within(node, cut[row] + 1, high[row])
            row, term, weight, node = np.append(2 * row, 2 * row + 1), np.append(term, term), np.append(weight, weight), np.append(left, right)
            on = np.flatnonzero(node >= 0)
            on = on[np.argsort(row[on], kind="stable")]
            live, row = np.unique(row[on], return_inverse=True)
            term, weight, node = term[on], weight[on], node[on]
            odd, up = live % 2 == 1, live // 2
            q, low, high = q[up], np.where(odd, cut[up] + 1, low[up]), np.where(odd, high[up], cut[up])
        return scored

    def _leaves(self, which: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, small: np.ndarray, best: Best) -> int:
        """Score every document of the small ranges from the postings within them."""
        number = np.cumsum(small) - 1
        on = small[row]
        row, term, weight = row[on], term[on], weight[on]
        a = np.searchsorted(self.key, term * self.n + low[row])
        b = np.searchsorted(self.key, term * self.n + high[row])
        many = b - a
        entry = np.repeat(np.arange(len(many)), many)
        posting = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + a[entry]
        total = np.zeros((int(small.sum()), LEAF), np.int64)
        np.add.at(total.reshape(-1), number[row[entry]] * LEAF + self.at[posting] - low[row[entry]], weight[entry] * self.impact[posting])
        i, j = np.nonzero(total)
        at = low[small][i] + j
        best.add(which[q[small][i]], total[i, j], self.doc[at], self.null[at])
        return len(i)


@dataclass
class Queries:
    """Items of a block: their terms by number, with weights times repeats, sorted by item."""

    names: list[str]
    query: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Items with about TOGETHER terms at a time: (items, number within the group, term, weight)."""
        ends = np.cumsum(np.bincount(self.query, minlength=len(self.names)))
        start = 0
        while start < len(self.names):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + TOGETHER, side="right")))
            a, b = np.searchsorted(self.query, (start, stop))
            yield np.arange(start, stop), self.query[a:b] - start, self.term[a:b], self.weight[a:b]
            start = stop


def _shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, size: int) -> Iterator[Shard]:
    doc, null, norm, place, term, tf, held = [], [], [], [], [], [], 0

    def made() -> Shard:
        return Shard(np.array(doc, np.int64), np.array(null, bool), np.array(norm, np.int64), np.repeat(np.arange(len(doc)), place), np.concatenate(term), np.concatenate(tf), size)

    for batch in batches:
        for i, n, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not t:
                continue
            doc.append(NO_ID if i is None else i)
            null.append(i is None)
            norm.append(25 + 75 * n * n_docs // n_terms)
            place.append(len(t) // 4)
            term.append(np.frombuffer(t, "<i4"))
            tf.append(np.frombuffer(f, "<i4"))
            held += place[-1]
            if held >= SHARD_POSTINGS or len(doc) >= SHARD_DOCS:
                yield made()
                doc, null, norm, place, term, tf, held = [], [], [], [], [], [], 0
    if doc:
        yield made()


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    words = {r["query"]: Counter(terms(r["text"].encode())) for r in rows}
    names = sorted(x for x, w in words.items() if w)
    vocabulary = {w: i for i, w in enumerate(sorted({w for n in names for w in words[n]}))}
    if not names:
        return None
    found = stash(counted(docs, vocabulary), "terms")
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        discard(found)
        return None
    df = document_frequencies(found, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    entries = [(q, vocabulary[w], c) for q, n in enumerate(names) for w, c in words[n].items()]
    query, term, repeats = (np.array(x, np.int64) for x in zip(*entries, strict=True))
    queries, size = Queries(names, query, term, weights[term] * repeats), len(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.names), k)
        for shard in _shards(batches, n_docs, n_terms, size):
            for group in queries.groups():
                shard.search(*group, best)
        ids = pa.array(best.doc, pa.int64(), mask=best.null)
        yield pa.RecordBatch.from_arrays([pa.array([queries.names[q] for q in best.query.tolist()], pa.string()), ids, pa.array(best.score)], ["query", "doc_id", "score"])

    return found.mapInArrow(search, "query string, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    named = items.select("item_id", F.sha2("text", 256).alias("query"), "text").where("text is not null")
    texts = stash(named.groupBy("query").agg(F.first("text").alias("text")), "queries")
    n_blocks = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    every = None
    for b in range(n_blocks):
        rows = texts.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).collect()  # about BLOCK_BYTES of texts
        part = _block(docs, rows, k)
        every = part if every is None else every.union(part) if part is not None else every
    if every is None:
        every = spark.createDataFrame([], "query string, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).alias("rank")
    best = stash(every.select("query", "doc_id", "score", place).where(F.col("rank") <= k), "ranked")
    return named.select("item_id", "query").join(best, "query").select("item_id", "rank", "doc_id", "score")
