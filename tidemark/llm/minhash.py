"""MinHash near-dedup with b-bit signatures.

A document's set is its distinct shingles of `shingle` lower-cased words.  Documents with equal sets collapse first.
Each distinct set keeps 80 minima: the low four bits of each, packed into five words, are its signature, and the full
minima of four at a time make 20 band keys.  A pair of Jaccard similarity 0.8 shares a band with probability
1 - (1 - 0.8^4)^20 = 0.99997.  Candidates come from band buckets; signatures estimate their similarity by counting
equal nibbles, corrected for the 1 / 16 that agree by chance; what stands more than five standard errors below the
threshold goes; all others are confirmed on the full sets, from the texts.

No bucket is expanded into pairs.  First each member meets the smallest id of its buckets, the best estimate only, and
confirmed links become components.  Then, in buckets that still hold more than one component, the members outside the
bucket's largest component are compared with the members of other components, a block of either side at a time, and only
links come out: sizes, then estimates, then intersections of 32-bit hashes.  Links inside a component change nothing, so
none that matters is lost.  Components come from repeated minimum over links, stored in shared storage at each round.

Edge cases: null, empty and blank texts have the empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; rows that share a doc_id are one node, and their sets link it together; rows without doc_id
are never linked, have a null component and are kept; of equally good partners the one of smallest id is met first;
further columns of the input are ignored; an empty table gives an empty result; long texts are read whole, and their
sets are as large as their different shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import BROADCAST_IDS, grams, mix, slices, stash, words_of

BANDS, ROWS, BITS = 20, 4, 4
MINIMA = BANDS * ROWS
#: Members of a bucket that meet the others of it in one task.
BLOCK = 512

_rng = np.random.default_rng(10)
_XOR = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: list[bytes], shingle: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each lower-cased text."""
    hashes, counts, starts = words_of([t.lower() for t in text])
    every, out = grams(hashes, shingle), []
    for n, s in zip(counts.tolist(), starts.tolist(), strict=True):
        if n >= shingle:
            out.append(np.unique(every[s : s + n - shingle + 1]))
        else:
            out.append(grams(hashes[s : s + n], n) if n else np.empty(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> tuple[list[int], list[int]]:
    """Packed low bits of the minima, and a key for each band."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, ((s[i : i + 4096][None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    low = mix(low)
    nibbles = (low & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low.reshape(BANDS, ROWS)[:, j])
    return np.bitwise_or.reduce(nibbles, axis=1).view(np.int64).tolist(), keys.view(np.int64).tolist()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the set (f1, f2), signature and bands (empty for the empty set)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = shingle_hashes(texts, shingle)
            f1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            f2 = [int(mix(s ^ _XOR[0]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            pairs = [_signature(s) if len(s) else ([], []) for s in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets]), pa.array(f1), pa.array(f2), pa.array([p[0] for p in pairs], longs), pa.array([p[1] for p in pairs], longs)],
                ["doc_id", "n_shingles", "f1", "f2", "signature", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, n_shingles long, f1 long, f2 long, signature array<long>, bands array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity of two signatures: the share of equal nibbles, corrected for those equal by chance."""
    words = [F.col(a)[i].bitwiseXOR(F.col(b)[i]) for i in range(MINIMA * BITS // 64)]
    odd = [w.bitwiseOR(F.shiftrightunsigned(w, 1)).bitwiseOR(F.shiftrightunsigned(w, 2)).bitwiseOR(F.shiftrightunsigned(w, 3)).bitwiseAND(F.lit(0x1111111111111111)) for w in words]
    differ = sum((F.bit_count(w) for w in odd[1:]), F.bit_count(odd[0]))
    return ((1 - differ / MINIMA) - 1 / 2**BITS) / (1 - 1 / 2**BITS)


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest id that each linked node can reach; roots themselves are left out.

    Each round every node tells its neighbours the smallest id it knows; the number of rounds grows with the logarithm
    of a component's diameter.
    """
    now = stash(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "links")
    while True:
        both = now.union(now.select(F.col("root"), F.col("node")))
        best = both.groupBy("node").agg(F.min("root").alias("root")).select("node", F.least("node", "root").alias("least"))
        told = both.join(best, "node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        now = stash(told.union(best.select("node", F.col("least").alias("root"))).where("node <> root").distinct(), "links")
        chained = now.join(now.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
        forked = now.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
        if chained.select("node").union(forked).isEmpty():
            return now


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs a, b whose full sets have 100 * intersection >= percent * union."""
    pairs = stash(pairs, "pairs")
    ids = stash(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = stash(docs.select("doc_id", "text").where("text is not null").join(some, "doc_id", "left_semi"), "pair-texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            first, second = ([t.encode() for t in batch.column(names.index(c)).to_pylist()] for c in ("ta", "tb"))
            keep = []
            for x, y in zip(first, second, strict=True):
                s, t = exact_shingles(x, shingle), exact_shingles(y, shingle)
                both = len(s & t)
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).filter(mask) for c in ("a", "b")], ["a", "b"])

    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return rows.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def _short_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id and the set of 32-bit shingle hashes of the named documents.  What equal hashes of
    different shingles add to an intersection is found when the full sets confirm; what they take away is given back."""
    ids = stash(ids, "set-ids")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            short = [(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in shingle_hashes(texts, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.list_(pa.int32()))], ["id", "short"])

    return docs.select("doc_id", "text").join(some, "doc_id", "left_semi").mapInArrow(cut, "id long, short array<int>")


def exact_shingles(text: bytes, shingle: int) -> set:
    words = text.lower().split()
    if not words:
        return set()
    n = min(shingle, len(words))
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys, each as one batch, from batches that are sorted by them."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        at = [0, *(1 + np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values]))).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(at[:-2], at[1:-1], strict=True))
        held = batch.slice(at[-2])
    if held is not None:
        yield held


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x[k] and y[k]: by products of 0-1 matrices where many pairs share the sets."""
    rows, columns = np.unique(x), np.unique(y)
    used = np.union1d(rows, columns)
    sizes = np.array([len(sets[r]) for r in used])
    _, codes, counts = np.unique(np.concatenate([sets[r] for r in used]), return_inverse=True, return_counts=True)
    n = len(counts)
    if len(rows) * len(columns) * n > len(x) * (100_000 + 200 * sizes.mean()):  # few pairs of long sets
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    owner, out = np.repeat(np.arange(len(used)), sizes), np.zeros((len(rows), len(columns)), np.float64)
    at_rows, at_columns = np.searchsorted(used, rows), np.searchsorted(used, columns)
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(0, n + 4096, 4096))
    for k in range(len(edges) - 1):
        some = order[edges[k] : edges[k + 1]]
        held = np.zeros((len(used), min(4096, n - 4096 * k)), np.float32)
        held[owner[some], codes[some] - 4096 * k] = 1
        out += held[at_rows] @ held[at_columns].T
    return out[np.searchsorted(rows, x), np.searchsorted(columns, y)].astype(np.int64)


def _met(group: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the possible links between the two sides of a block."""
    get = {name: group.column(k) for k, name in enumerate(group.schema.names)}
    ids, root, n = (get[c].to_numpy() for c in ("id", "root", "n_shingles"))
    few, side, at = (get[c].to_numpy(zero_copy_only=False) for c in ("few", "side", "at"))
    xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    # Two members outside the largest component meet in both orders; one is enough.
    meet = (root[xs][:, None] != root[ys]) & (~few[ys] | (ids[xs][:, None] < ids[ys]))
    meet &= np.minimum(n[xs][:, None], n[ys]) * 100 >= np.maximum(n[xs][:, None], n[ys]) * percent
    x, y = np.nonzero(meet)
    x, y = xs[x], ys[y]
    if len(x):
        words = _matrix(get["signature"]).view(np.uint64)
        odd = words[x] ^ words[y]
        odd |= odd >> np.uint64(1)
        odd |= odd >> np.uint64(2)
        same = 1 - np.bitwise_count(odd & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64) / MINIMA
        likely = (same - 1 / 2**BITS) / (1 - 1 / 2**BITS) >= percent / 100 - 0.25
        x, y = x[likely], y[likely]
    if len(x) and at[0]:  # those that share a band before this one meet there
        bands = _matrix(get["bands"])[:, : at[0]]
        later = ~(bands[x] == bands[y]).any(axis=1)
        x, y = x[later], y[later]
    if len(x):
        sets = [np.unique(v.values.to_numpy()) for v in get["short"]]
        lost = n - np.array([len(s) for s in sets])  # different shingles of one hash
        both = _common(sets, x, y) + np.minimum(lost[x], lost[y])
        link = 100 * both >= percent * (n[x] + n[y] - both)
        x, y = x[link], y[link]
    return ids[x], ids[y]


def cross_links(mixed: DataFrame, percent: int) -> DataFrame:
    """Possible links a, b between members of a bucket that are of different components.

    The members outside a bucket's largest component, in few_blocks blocks, meet all members, in `blocks` blocks; a
    block of one side and a block of the other are met at a time, so that no task holds more than two of them.
    """
    names = ["band", "at", "id", "root", "n_shingles", "signature", "bands", "short"]
    rows = mixed.select(*names, (F.col("root") != F.col("most")).alias("few"), "few_blocks", "blocks")

    def side(part: DataFrame, number: int, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        i, j = (place, every) if number == 0 else (every, place)
        return part.select(*names, "few", F.lit(number).alias("side"), i.alias("i"), j.alias("j"))

    both = side(rows.where("few"), 0, "few_blocks", "blocks").union(side(rows, 1, "blocks", "few_blocks"))
    # Work grows with the square of a block and not with its bytes: small partitions must not be put together.
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["band", "i", "j"]):
            x, y = _met(group, percent)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return both.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id)."""
    signed = stash(signatures(docs, shingle), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    sets = usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    sets = stash(sets, "sets")
    buckets = sets.select("id", F.posexplode("bands").alias("at", "band"))
    # Only buckets with two sets or more matter; most have one.
    shared = buckets.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    members = stash(buckets.join(shared.select("band", "low"), "band"), "buckets")
    about = sets.select("id", "signature", "n_shingles")
    possible = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate("sa", "sb") >= percent / 100 - 0.25)

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs a, b with the estimate; those that cannot reach the threshold are left out."""
        a, b = (about.select(F.col("id").alias(s), F.col("signature").alias(f"s{s}"), F.col("n_shingles").alias(f"n{s}")) for s in ("a", "b"))
        return pairs.join(a, "a").join(b, "b").where(possible).select("a", "b", estimate("sa", "sb").alias("estimate"))

    stars = plausible(members.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b")
    links = _confirmed(best, docs, shingle, percent)
    # A doc_id with several sets links them.
    of_doc = usable.join(sets.select("f1", "f2", "n_shingles", "id"), ["f1", "f2", "n_shingles"]).select("doc_id", "id")
    several = of_doc.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("doc_id")
    links = stash(links.union(of_doc.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))), "first-links")
    roots = components(links)

    placed = members.select("band", "at", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "at", "id", F.coalesce("root", "id").alias("root"))
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("n")).where("roots > 1")
    blocks = [F.ceil(n / BLOCK).cast("int").alias(name) for n, name in ((F.col("n") - F.col("most.n"), "few_blocks"), (F.col("n"), "blocks"))]
    mixed = placed.join(mixed.select("band", F.col("most.root").alias("most"), *blocks), "band").join(sets.select("id", "signature", "bands", "n_shingles"), "id")
    mixed = stash(mixed, "mixed-buckets")
    mixed = stash(mixed.join(_short_sets(docs, mixed.select(F.col("id").alias("doc_id")).distinct(), shingle), "id"), "mixed-sets")
    cross = cross_links(mixed, percent).distinct()
    more = _confirmed(cross, docs, shingle, percent)
    roots = components(links.union(more))

    equal = sets.select("f1", "f2", "n_shingles", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", "n_shingles", F.coalesce("root", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(equal, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller id."""
    gone = near_duplicates(docs, shingle, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(stash(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)
