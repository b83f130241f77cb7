"""Near-duplicate passages by compact windows.

A passage has at least MIN_WORDS words.  For candidates a text is its sequence of tokens, runs of TOKEN words.  Under
each of FUNCTIONS hash functions, all subsequences of MIN_TOKENS tokens whose minimum is the token at c form one
compact window: they start in [l, c] and end in [c, r], where l and r are the reach of c in the Cartesian tree of the
hashes (up to the nearest smaller ones, and MIN_TOKENS - 1 at most, as no such subsequence reaches further).  Exact
repeats agree in every minimum; a passage of 50 words with one word changed has a similarity of 0.76 in such tokens, and
agrees with the original in one of three minima with probability 0.987, longer ones more often.  A longer passage of
similarity 0.8 holds subsequences of that length and similarity, so what is local to a minimum decides.

Windows whose minimum only one text has are dropped by a count before anything is joined.  Then:

1. Exact repeats.  Windows of the first function name runs of MIN_TOKENS tokens by their content, at every GRID-th offset
   of the minimum and at the last.  Runs that two texts have make passages; overlapping ones of a text are one stretch,
   and stretches that share a run are of one class.
2. An interval join places every minimum in the stretch that holds it.  A key is done once one class holds all its minima.
3. The minima of all other keys are put together by key and content of their window: what goes on alike is one passage at
   once.  One minimum of each content gets its context, the shingles of its window.
4. Under each key all contexts of different classes meet, in blocks of SMALL, by products of 0-1 matrices for frequent
   shingles and by counting for rare ones.  Pairs with enough shingles in common are verified: around the minimum, the
   stretch of at least MIN_WORDS words of either text that gains most (a shingle that the other has is a gain, any other
   a loss) must have a Jaccard similarity of 0.8 on five-word shingles.  A pair is left out only if links verified before
   it, whose stretches have TOGETHER shingles around the minimum in common, make it one class already.  The likeliest
   pairs of each class come first, and a link that neither joins anything nor makes a stretch longer is not written, so
   that links do not grow with the square of a group.  Shingles are compared by 32-bit hashes.
5. Ends of exact stretches are moved outward word by word as long as another text goes on in the same way.

Equal texts are one text until the end, where every document of a text gets its passages, and copies of a whole text
of 50 words or more are passages of their own.

Edge cases: null, empty and short texts have no passages; a passage that repeats only inside one text is not reported;
rows that repeat doc_id and text count once; null doc_ids come last as representatives; of equal minima the first in a
text counts; further columns are ignored; an empty
table gives an empty result; long texts are read whole, in time linear in their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import BROADCAST_IDS, GOLDEN, discard, grams, mix, slices, stash
from tidemark.llm.minhash import components

MIN_WORDS = 50
SHINGLE, TOKEN = 5, 6
MIN_SHINGLES, MIN_TOKENS = MIN_WORDS - SHINGLE + 1, MIN_WORDS - TOKEN + 1
FUNCTIONS = 3
GRID = 11
#: Two passages of a text that have this many shingles in common are one stretch.
TOGETHER = MIN_SHINGLES // 2
#: Contexts of a key up to this many meet in one block; more are met block against block.  Either way is exact.
SMALL = 512
#: Shingles that more contexts of a block have are counted by products of matrices.
RARE = 16
#: Tokens of a text that are handled at a time.
PART = 1 << 20
_XOR = np.random.default_rng(7).integers(0, 2**63, FUNCTIONS, dtype=np.uint64)
_SALT = np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * GOLDEN
_PLACE = np.uint64(0xFFFFFF)
_NEAR = MIN_TOKENS - 1


#: White space, and a random odd number for each byte, the same for A-Z and a-z.
_GAP = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BYTE = (np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_BASE = 0xD6E8FEB86659FD93
#: Bytes that are hashed at a time, and the greatest length of words that are hashed as polynomials.
_BYTES, _LONG = 1 << 21, 256


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(_BYTES, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 2**64)))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What words_of gives for texts in lower case, by other hashes: polynomials of the bytes, without an object for each word."""
    whole = b"\n".join([*texts, b""])
    data = np.frombuffer(whole, np.uint8)
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers()
    hashes = np.zeros(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        a = int(begin[first])
        last = max(first + 1, int(np.searchsorted(end, a + _BYTES, side="right")))
        some = slice(first, last)
        if last - first > 1 or end[first] - a <= _LONG:
            # Neither gaps nor what lies before a word count: the difference of two sums holds the word alone.
            part = data[a : int(end[last - 1])]
            sums = np.append(np.uint64(0), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64))
            hashes[some] = (sums[end[some] - a] - sums[begin[some] - a]) * down[begin[some] - a]
        first = last
    long = np.flatnonzero(end - begin > _LONG)
    if len(long):
        named = np.empty(len(long), object)
        named[:] = [whole[a:b].lower() for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
        hashes[long] = pd.util.hash_array(named, categorize=False)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.searchsorted(begin, np.append(0, ends[:-1])) if texts else np.empty(0, np.int64)
    return mix(hashes), np.diff(np.append(starts, len(begin))), starts


def compact(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of all compact windows of `width` keys, with reach cut to width - 1.  Keys end in their places; key 0 parts texts."""
    n = len(keys)
    if n < width:
        return (np.empty(0, np.int64),) * 3
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(-1, width)
    ahead, behind = np.minimum.accumulate(table, axis=1).ravel(), np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    # A minimum holds for neighbouring windows, and the places of minima ascend.
    least = least[np.append(True, least[1:] != least[:-1])]
    c = (least[least > 0] & _PLACE).astype(np.int64)
    edge = np.concatenate([np.zeros(width - 1, np.uint64), keys, np.zeros(width - 1, np.uint64)])
    steps = np.arange(1, width)
    left, right = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
    for some in np.array_split(np.arange(len(c)), 1 + len(c) // 65536):
        here, key = c[some] + width - 1, keys[c[some]][:, None]
        for side, out in ((here[:, None] - steps, left), (here[:, None] + steps, right)):
            smaller = edge[side] < key
            out[some] = np.where(smaller.any(axis=1), smaller.argmax(axis=1), width - 1)
    return c, c - left, c + right


WINDOWS = "text_hash long, key long, place long, same long"
#: A place packs, from the low end: 6 bits each of reach to the right and left, 3 bits of function, and the token's number.
_LEFT, _FN, _TOKEN = 6, 12, 15


def _ends(starts: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Places of runs of `size` words that cross the end of a text, among n runs."""
    out = []
    for k in range(size - 1):
        ends = starts + counts - 1 - k
        out.append(ends[(ends >= 0) & (ends < n) & (ends >= starts)])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def windows(docs: DataFrame) -> DataFrame:
    """Compact windows (docs: text_hash, text): key of function and minimum, their place, and a name of their content."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=1_500_000):
            hashes, counts, starts = _words(texts)
            every = grams(hashes, TOKEN)
            if len(every) < MIN_TOKENS:
                continue
            inside = np.ones(len(every), bool)
            inside[_ends(starts, counts, len(every), TOKEN)] = False
            of_text = batch.column(0).to_numpy()
            for begin in range(0, len(every), PART):
                a, b = max(0, begin - 2 * MIN_TOKENS), min(len(every), begin + PART + 2 * MIN_TOKENS)
                some, place = every[a:b], np.arange(b - a, dtype=np.uint64)
                # Sums of the tokens, bare and by place: they name a sequence of tokens.
                token = mix(some ^ GOLDEN)
                bare, placed = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (token, token * place))
                for fn in range(FUNCTIONS):
                    minimum = mix(some ^ _XOR[fn])
                    keys = np.where(inside[a:b], (minimum | (_PLACE + np.uint64(1))) & ~_PLACE | place, np.uint64(0))
                    c, left, right = compact(keys, MIN_TOKENS)
                    own = (c + a >= begin) & (c + a < begin + PART)
                    c, left, right = c[own], left[own], right[own]
                    which = np.searchsorted(starts, c + a, side="right") - 1
                    packed = (c + a - starts[which]) << _TOKEN | fn << _FN | (c - left) << _LEFT | (right - c)
                    total = bare[right + 1] - bare[left]
                    same = mix(mix(total) + placed[right + 1] - placed[left] - left.astype(np.uint64) * total + (c - left).astype(np.uint64) * GOLDEN)
                    yield pa.RecordBatch.from_arrays([pa.array(of_text[which]), pa.array((minimum[c] ^ _SALT[fn]).view(np.int64)), pa.array(packed), pa.array(same.view(np.int64))], ["text_hash", "key", "place", "same"])

    return docs.mapInArrow(cut, WINDOWS)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key at least two different texts have; counted by 32-bit hashes first, which only lets more through."""
    short = rows.select(F.hash("key").alias("k"), F.hash("text_hash").alias("t"))
    keys = short.groupBy("k").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("k")
    return rows.join(keys, F.hash("key") == F.col("k")).drop("k")


def _lists(batch: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list column, and the row of each."""
    lists = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(batch.num_rows), sizes)


def _with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """text and the rows of each text as lists.  docs has each text once, and rows differ."""
    names = [c for c in rows.columns if c != "text_hash"]
    by_text = rows.groupBy("text_hash").agg(F.collect_list(F.struct(*names)).alias("rows"))
    return docs.join(by_text, "text_hash").select("text_hash", "text", *[F.col(f"rows.{c}").alias(c) for c in names])


RUNS = "text_hash long, run long, start int"


def exact_runs(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Runs of MIN_TOKENS tokens around the minima of the first function: content and first token."""
    rows = _with_texts(found.where(F.shiftright("place", _FN).bitwiseAND(F.lit(7)) == 0).select("text_hash", "place"), docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=1_500_000):
            hashes, _, starts = _words(texts)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams(hashes, TOKEN) ^ GOLDEN), dtype=np.uint64)])
            places, row = _lists(batch, "place")
            places = places.to_numpy()
            c, left, right = places >> _TOKEN, places >> _LEFT & 63, places & 63
            last = np.maximum(0, _NEAR - right)
            grid = np.arange(0, MIN_TOKENS, GRID)
            offset = np.concatenate([np.broadcast_to(grid, (len(c), len(grid))), last[:, None]], axis=1)
            ok = (offset <= left[:, None]) & (offset >= last[:, None])
            ok[:, -1] &= (last % GRID != 0) & (last <= left)
            at = np.flatnonzero(ok.ravel())
            which = at // offset.shape[1]
            start = c[which] - offset.ravel()[at]
            base = starts[row[which]] + start
            run = mix(sums[base + MIN_TOKENS] - sums[base])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[which])), pa.array(run.view(np.int64)), pa.array(start.astype(np.int32))], ["text_hash", "run", "start"])

    return rows.mapInArrow(cut, RUNS)


def _classes(sides: DataFrame) -> DataFrame:
    """Stretches (text_hash, start, end, class, similarity) of sides (link, text_hash, start, end, similarity).

    Sides of a text that have TOGETHER shingles in common are one stretch; stretches that a link joins are of one class.
    """
    w = Window.partitionBy("text_hash").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | (F.least(before, "end") - F.col("start") + 1 < TOGETHER)
    placed = sides.withColumn("new", new).withColumn("first", F.max(F.when(F.col("new"), F.struct("start", "end"))).over(w))
    placed = stash(placed.select("link", "text_hash", "start", "end", "similarity", F.xxhash64("text_hash", "first").alias("node")), "passage-ends")
    nodes = placed.select("link", "node").distinct()
    least = nodes.groupBy("link").agg(F.min("node").alias("least"))
    roots = components(nodes.join(least, "link").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    whole = placed.groupBy("text_hash", "node").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("similarity").alias("similarity"))
    out = stash(whole.join(roots, "node", "left").select("text_hash", "start", "end", F.coalesce("root", "node").alias("class"), "similarity"), "stretches")
    discard(placed)
    return out


def _held(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """rows (key, text_hash, place, same) with the class of the stretch that holds their token, or one of their own: an interval join by sorting."""
    none, at = F.lit(None).cast("long"), F.shiftright("place", _TOKEN).cast("int").alias("at")
    both = rows.select("text_hash", at, F.lit(1).alias("kind"), "key", "place", "same", F.lit(None).cast("struct<end:int,class:long>").alias("one")).union(
        stretches.select("text_hash", F.col("start").alias("at"), F.lit(0), none, none, none, F.struct("end", "class"))
    )
    w = Window.partitionBy("text_hash").orderBy("at", "kind")
    both = both.withColumn("one", F.last("one", ignorenulls=True).over(w)).where("kind = 1")
    own = F.xxhash64("text_hash", "at", F.lit("open"))
    return both.select("key", "text_hash", "place", "same", F.when(F.col("one.end") >= F.col("at"), F.col("one.class")).otherwise(own).alias("class"))


#: Shingles of the widest window.
_WIDE = 2 * MIN_TOKENS - 1 + TOKEN - SHINGLE
CARRIED = "key long, same long, high long, high_place long, class long, blocks int"
CONTEXTS = f"text_hash long, place long, at int, least int, context array<int>, {CARRIED}"


def contexts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (text_hash, place, CARRIED) with the shingles of their window, the place `at` of its minimum among them, and the
    least number of different shingles that a passage in it can have."""
    wide = _with_texts(rows, docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=1_500_000):
            hashes, _, starts = _words(texts)
            every = (grams(hashes, SHINGLE) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            different = _distinct(every)
            (places, row), carried = _lists(batch, "place"), [_lists(batch, x.split()[0])[0] for x in CARRIED.split(", ")]
            place = places.to_numpy()
            c, left, right = place >> _TOKEN, place >> _LEFT & 63, place & 63
            for some in np.array_split(np.arange(len(c)), 1 + len(c) // 20_000):
                r = row[some]
                a, b = c[some] - left[some], c[some] + right[some] + TOKEN - SHINGLE
                sizes = b - a + 1
                ends = np.cumsum(sizes)
                flat = every[np.repeat(starts[r] + a - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
                last = starts[r] + b - MIN_SHINGLES + 1
                least = different[np.minimum((starts[r] + a)[:, None] + np.arange(_WIDE - MIN_SHINGLES + 1), last[:, None])].min(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(r)), places.take(pa.array(some)), pa.array((c[some] - a).astype(np.int32)), pa.array(least.astype(np.int32)), lists, *(x.take(pa.array(some)) for x in carried)],
                    [x.split()[0] for x in CONTEXTS.split(", ")],
                )

    return wide.mapInArrow(cut, CONTEXTS)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Number of different values in each MIN_SHINGLES neighbouring ones, or in all if there are fewer."""
    n = max(1, len(x) - MIN_SHINGLES + 1)
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    before, after = np.full(len(x), -1), np.full(len(x), len(x))
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    start = np.arange(1, n)
    step = (before[start + MIN_SHINGLES - 1] < start).astype(np.int64) - (after[start - 1] >= start + MIN_SHINGLES - 1)
    return np.cumsum(np.append((before[:MIN_SHINGLES] < 0).sum(), step))


def _least_distinct(x: np.ndarray) -> int:
    """Least number of different values in MIN_SHINGLES neighbouring ones."""
    return int(_distinct(x).min())


#: Losses of a shingle that the other text lacks.  A similarity of 0.8 is eight of nine shingles, so at 8 no stretch that is due has a negative sum.
LOSSES = (2, 4, 8)


def _extents(known: np.ndarray, at: np.ndarray, size: np.ndarray, loss: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: (a, b, gain) of the stretch around `at`, of MIN_SHINGLES at least, that gains most: 1 for a known shingle, -loss for any other."""
    m, wide = known.shape
    place = np.arange(wide + 1)
    step = np.where(place[:wide] < size[:, None], np.where(known, 1, -loss), -1000)
    total = np.concatenate([np.zeros((m, 1), np.int64), np.cumsum(step, axis=1)], axis=1)
    best = np.maximum.accumulate(total[:, :0:-1], axis=1)[:, ::-1]  # greatest sum up to any end from each place on
    starts = place[:wide]
    ends = np.minimum(np.maximum(at[:, None], starts + MIN_SHINGLES - 1), wide - 1)
    gain = np.where(starts <= np.minimum(at, size - MIN_SHINGLES)[:, None], np.take_along_axis(best, ends, axis=1) - total[:, :wide], -(10**6))
    a = wide - 1 - gain[:, ::-1].argmax(axis=1)  # the narrowest of equal ones
    rows = np.arange(m)
    b = np.where(place > ends[rows, a][:, None], total, -(10**6)).argmax(axis=1) - 1
    return a, b, gain[rows, a]


def aligned(x: np.ndarray, y: np.ndarray, x_size: np.ndarray, y_size: np.ndarray, at: np.ndarray, other: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified passages of rows of contexts (padded to one width) around the places `at` of x and `other` of y.

    (start, end, start, end) of each row, ends inclusive, and the similarity, 0 where there is none of at least `least`.
    """
    m, wide = x.shape
    place = np.arange(wide)
    pad = 2**40 + place
    both = np.concatenate([np.where(place < x_size[:, None], x, pad), np.where(place < y_size[:, None], y, 2 * pad)], axis=1)
    bits = int(2 * wide).bit_length()
    packed = np.sort(both << bits | np.arange(2 * wide), axis=1)
    order, ranked = packed & (1 << bits) - 1, packed >> bits
    new = np.zeros(both.shape, np.int64)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    codes = np.empty(both.shape, np.int64)
    np.put_along_axis(codes, order, np.cumsum(new, axis=1), axis=1)
    places, similarity = np.zeros((m, 4), np.int64), np.zeros(m)

    def members(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which codes stand at places a to b of each row."""
        out = np.zeros((len(code), 2 * wide), bool)
        r, k = np.nonzero((place >= a[:, None]) & (place <= b[:, None]))
        out[r, code[r, k]] = True
        return out

    def known(code: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.take_along_axis(some, code, axis=1)

    left = np.flatnonzero((x_size >= MIN_SHINGLES) & (y_size >= MIN_SHINGLES))
    cx, cy = codes[left, :wide], codes[left, wide:]
    zero = np.zeros(len(left), np.int64)
    gains = _extents(known(cx, members(cy, zero, y_size[left] - 1)), at[left], x_size[left], LOSSES[-1])[2] + _extents(known(cy, members(cx, zero, x_size[left] - 1)), other[left], y_size[left], LOSSES[-1])[2]
    left = left[gains >= 0]
    for loss in LOSSES:
        if not len(left):
            break
        cx, cy, i, j, nx, ny = codes[left, :wide], codes[left, wide:], at[left], other[left], x_size[left], y_size[left]
        a, b, _ = _extents(known(cx, members(cy, np.zeros_like(ny), ny - 1)), i, nx, loss)
        c, d, _ = _extents(known(cy, members(cx, a, b)), j, ny, loss)
        v = members(cy, c, d)
        a, b, _ = _extents(known(cx, v), i, nx, loss)
        u = members(cx, a, b)
        share = (u & v).sum(axis=1) / (u | v).sum(axis=1)
        done = share >= least
        places[left[done]] = np.stack([a, b, c, d], axis=1)[done]
        similarity[left[done]] = share[done]
        left = left[~done]
    return places, similarity


SIDES = "link long, text_hash long, start int, end int, similarity double"
LINKS = f"{SIDES}, key long, same long, from int, to int, core boolean"
_INTS = ["key", "same", "text_hash", "place", "high", "high_place", "class", "at", "least"]


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places x < y of all entries that have one code; codes ascend."""
    ends = np.flatnonzero(np.append(codes[1:] != codes[:-1], True))
    after = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(codes))
    y = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after) + np.repeat(np.arange(1, len(codes) + 1), after)
    return np.repeat(np.arange(len(codes)), after), y


def _in_common(owner: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, count of all pairs x < y of n owners that have codes in common; codes ascend, and the owners of each."""
    codes = np.cumsum(np.append(False, codes[1:] != codes[:-1]))
    often = np.bincount(codes)[codes] > RARE
    x, y = _pairs(codes[~often]) if not often.all() else (np.empty(0, np.int64),) * 2
    total = np.bincount(owner[~often][x] * n + owner[~often][y], minlength=n * n).astype(np.float32).reshape(n, n)
    if often.any():
        owner, codes = owner[often], np.cumsum(np.append(False, np.diff(codes[often]) > 0))
        for first in range(0, int(codes[-1]) + 1, 4096):
            a, b = np.searchsorted(codes, (first, first + 4096))
            held = np.zeros((n, int(codes[b - 1]) - first + 1), np.float32)
            held[owner[a:b], codes[a:b] - first] = 1
            total += held @ held.T
    x, y = np.nonzero(np.triu(total, 1))
    return x, y, total[x, y].astype(np.int64)


def _entries(run: np.ndarray, owner: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and code of every different shingle of each row, by run, shingle and owner; codes are numbers of run and shingle."""
    first = np.searchsorted(run, run)
    bits = int(np.max(np.arange(len(run)) - first)).bit_length()
    shingles = shingles.view(np.uint32)
    if 32 + bits + int(run[-1]).bit_length() > 64:
        order = np.lexsort((owner, shingles, run[owner]))
        owner, shingles = owner[order], shingles[order]
        differ = (shingles[1:] != shingles[:-1]) | (run[owner[1:]] != run[owner[:-1]])
        new = np.append(True, differ | (owner[1:] != owner[:-1]))
        return owner[new], np.cumsum(np.append(False, differ))[new]
    high = (run.astype(np.uint64) << np.uint64(32 + bits)) | (np.arange(len(run)) - first).astype(np.uint64)
    packed = np.sort(high[owner] | shingles.astype(np.uint64) << np.uint64(bits))
    packed = packed[np.append(True, packed[1:] != packed[:-1])]
    code = packed >> np.uint64(bits)
    start = np.searchsorted(run, np.arange(int(run[-1]) + 1))
    owner = start[(code >> np.uint64(32)).astype(np.int64)] + (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    return owner, np.cumsum(np.append(False, code[1:] != code[:-1]))


def _candidates(run: np.ndarray, owner: np.ndarray, shingles: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, count of the pairs of rows of a run that have at least enough[x] and enough[y] shingles in common.  run ascends."""
    none = (np.empty(0, np.int64),) * 3
    if not len(shingles):
        return none
    owner, codes = _entries(run, owner, shingles)
    while True:  # what only one row has, and rows that cannot have enough without it
        often = np.bincount(codes)[codes] > 1
        often &= (np.bincount(owner[often], minlength=len(run)) >= enough)[owner]
        if often.all():
            break
        codes, owner = codes[often], owner[often]
    if not len(codes):
        return none
    sizes = np.bincount(run)
    first = np.cumsum(sizes) - sizes
    out, small = [], sizes[run[owner]] <= 2 * RARE
    if small.any():
        some, (x, y) = owner[small], _pairs(codes[small])
        x, y = some[x], some[y]
        room = np.where(sizes <= 2 * RARE, sizes * sizes, 0)
        base = np.cumsum(room) - room
        k = run[x]
        count = np.bincount(base[k] + (x - first[k]) * sizes[k] + y - first[k], minlength=room.sum())
        at = np.flatnonzero(count)
        k = np.searchsorted(base + room, at, side="right")
        rest = at - base[k]
        out.append((first[k] + rest // sizes[k], first[k] + rest % sizes[k], count[at]))
    large, many = owner[~small], codes[~small]
    ends = np.flatnonzero(np.append(np.diff(run[large]) > 0, len(large) > 0)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
        k = run[large[a]]
        x, y, count = _in_common(large[a:b] - first[k], many[a:b], int(sizes[k]))
        out.append((x + first[k], y + first[k], count))
    x, y, count = (np.concatenate(z) for z in zip(*out, strict=True))
    keep = count >= np.maximum(enough[x], enough[y])
    return x[keep], y[keep], count[keep]


def _joined(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """labels, after those of x[k] and y[k] are made one."""
    root = np.arange(labels.max() + 1)

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in zip(labels[x].tolist(), labels[y].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    while (root != root[root]).any():
        root = root[root]
    return root[labels]


class _Kept:
    """Which of the verified links say anything new, so that their number does not grow with the square of a group.

    A passage around a minimum has the TOGETHER shingles that end there, or those that begin there.  Those that have the
    same ones are one stretch.  So a link is needless if what it links is linked already, either side lies inside the stretches
    so far, and it is the best of no content that stands for further texts.
    """

    def __init__(self, at: np.ndarray, shared: np.ndarray) -> None:
        self.at, self.shared = at.tolist(), shared.tolist()
        n = 2 * len(at)
        self.root, self.low, self.high = list(range(n)), [_WIDE] * n, [-1] * n
        self.best = [(False, 0.0)] * len(at)

    def _find(self, a: int) -> int:
        root = self.root
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    def these(self, u: np.ndarray, v: np.ndarray, places: np.ndarray, whole: np.ndarray, similarity: np.ndarray) -> np.ndarray:
        out, at, low, high = np.zeros(len(u), bool), self.at, self.low, self.high
        for k, (x, y, (a, b, c, d), *good) in enumerate(zip(u.tolist(), v.tolist(), places.tolist(), whole.tolist(), similarity.tolist(), strict=True)):
            good, new, nodes = tuple(good), False, []
            for w, start, end in ((x, a, b), (y, c, d)):
                for node, holds in ((2 * w, start <= at[w] - TOGETHER + 1), (2 * w + 1, end >= at[w] + TOGETHER - 1)):
                    if holds:
                        nodes.append(self._find(node))
                        if start < low[node] or end > high[node]:
                            new, low[node], high[node] = True, min(low[node], start), max(high[node], end)
                if self.shared[w] and good > self.best[w]:
                    new, self.best[w] = True, good
            least = min(nodes)
            if new or max(nodes) != least:
                out[k] = True
                for node in nodes:
                    self.root[node] = least
        return out


def _met(rows: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    """Sides of the links between contexts of the same key and blocks; rows are sorted by them, none is cut."""
    get = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
    key, same, text, place, high, high_place, klass, at, fewest = (get[n].to_numpy().astype(np.int64) for n in _INTS)
    i, j, side = (get[n].to_numpy() for n in ("i", "j", "side"))
    run = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    shingles, owner = _lists(rows, "context")
    x, y, count = _candidates(run, owner, shingles.to_numpy(), np.ceil(least * fewest - 1e-9).astype(np.int64))
    one_text = (text[x] == high[x]) & (text[y] == high[y]) & (text[x] == text[y])
    meet = ~one_text & ((i[x] == j[x]) | (side[x] != side[y]))
    x, y, count = x[meet], y[meet], count[meet]
    order = np.argsort(-count, kind="stable")
    x, y = x[order], y[order]
    labels = np.unique(np.stack([run, klass]), axis=1, return_inverse=True)[1].ravel()
    size = np.bincount(owner, minlength=len(run))
    ends = np.cumsum(size)
    core = np.clip(at - TOGETHER // 2, 0, size - TOGETHER)
    values, many = shingles.to_numpy(), 1
    kept = _Kept(at, text != high)

    def padded(some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), _WIDE), np.int64)
        r = np.repeat(np.arange(len(some)), size[some])
        k = np.arange(len(r)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        out[r, k] = values[np.repeat(ends[some] - size[some], size[some]) + k]
        return out

    while True:
        left = labels[x] != labels[y]
        x, y = x[left], y[left]
        if not len(x):
            return
        # The likeliest pairs of any class first, ever more of them, as one link makes the rest between two classes needless.
        both = np.concatenate([labels[x], labels[y]])
        order = np.argsort(both * len(x) + np.tile(np.arange(len(x)), 2))
        new = np.append(True, np.diff(both[order]) > 0)
        rank = np.empty(len(both), np.int64)
        rank[order] = np.arange(len(both)) - np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))
        now = np.flatnonzero(rank.reshape(2, -1).min(axis=0) < many)
        many *= 2
        for begin in range(0, len(now), 4096):
            u, v = x[now[begin : begin + 4096]], y[now[begin : begin + 4096]]
            apart = labels[u] != labels[v]
            u, v = u[apart], v[apart]
            places, similarity = aligned(padded(u), padded(v), size[u], size[v], at[u], at[v], least)
            ok = similarity > 0
            u, v, places, similarity = u[ok], v[ok], places[ok], similarity[ok]
            whole = np.ones(len(u), bool)
            for k, w in ((0, u), (2, v)):
                whole &= (places[:, k] <= core[w]) & (places[:, k + 1] >= core[w] + TOGETHER - 1)
            if whole.any():
                labels = _joined(labels, u[whole], v[whole])
            say = kept.these(u, v, places, whole, similarity)
            u, v, places, similarity, whole = u[say], v[say], places[say], similarity[say], whole[say]
            link = mix(mix(same[u].view(np.uint64)) + same[v].view(np.uint64) * GOLDEN + key[u].view(np.uint64)).view(np.int64)
            for k, w in ((0, u), (2, v)):
                start, end = places[:, k] - at[w], places[:, k + 1] - at[w]
                for of, c, which in ((text[w], place[w] >> _TOKEN, slice(None)), (high[w], high_place[w] >> _TOKEN, high[w] != text[w])):
                    ints = [pa.array(n[which].astype(np.int32)) for n in (c + start, c + end)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(link[which]), pa.array(of[which]), *ints, pa.array(similarity[which]), pa.array(key[w][which]), pa.array(same[w][which]), pa.array(start[which].astype(np.int32)), pa.array(end[which].astype(np.int32)), pa.array(whole[which])], [n.split()[0] for n in LINKS.split(", ")]
                    )
        tested = np.zeros(len(x), bool)
        tested[now] = True
        x, y = x[~tested], y[~tested]


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by `names`, cut anew so that rows that agree in them stay together."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [[b.column(b.schema.get_field_index(n)).to_numpy() for n in names] for b in held[-2:]]
        differ = np.logical_or.reduce([v != v[-1] for v in last[-1]])
        cut = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
        if not cut and len(held) > 1 and any(v[-1] != w[-1] for v, w in zip(*last, strict=True)):
            yield pa.concat_batches(held[:-1])
            held = held[-1:]
        elif cut:
            yield pa.concat_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def near_links(rows: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Sides of the verified links between rows (key, text_hash, place, same, class) of one key: SIDES.

    A key is done if one class or one text has all its rows.  Rows of one content are met as one.  Every link has the first and the last text of either content, and a content's
    best link has all its rows.
    """
    one = rows.groupBy("key", "same").agg(
        F.min("text_hash").alias("text_hash"), F.min_by("place", "text_hash").alias("place"), F.max("text_hash").alias("high"), F.max_by("place", "text_hash").alias("high_place"), F.min("class").alias("class"), F.max("class").alias("last")
    )
    one = stash(one, "contents")
    keys = one.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b"), F.min("text_hash").alias("c"), F.max("high").alias("d")).where("n > 1 and a <> b and c <> d")
    some = one.join(keys.select("key", F.ceil(F.col("n") / SMALL).cast("int").alias("blocks")), "key").drop("last")
    around = contexts(some, docs)
    own = F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int")
    around = around.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    around = around.select(*_INTS, "context", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).cast("int").alias("side"))
    # Work grows with the square of a block and not with its bytes: small partitions must not be put together.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = around.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_runs(batches, ["key", "i", "j"]):
            yield from _met(whole, least)

    found = stash(around.mapInArrow(meet, LINKS), "near-links")
    best = found.groupBy("key", "same").agg(F.max_by(F.struct("link", "from", "to", "similarity"), F.struct("core", "similarity", "link")).alias("best"))
    # Rows of one content and several classes are one passage: their whole windows.
    mixed = one.where("class <> last and text_hash <> high").select("key", "same", F.lit(True).alias("mixed"))
    said = best.withColumn("mixed", F.lit(False)).unionByName(mixed, allowMissingColumns=True)
    said = said.groupBy("key", "same").agg(F.max("best").alias("best"), F.max("mixed").alias("mixed"))
    at = F.shiftright("place", _TOKEN)
    reach = F.shiftright("place", _LEFT).bitwiseAND(F.lit(63)), F.col("place").bitwiseAND(F.lit(63)) + TOKEN - SHINGLE
    side = lambda link, start, end, similarity: F.struct(link.alias("link"), "text_hash", start.cast("int").alias("start"), end.cast("int").alias("end"), similarity.alias("similarity"))
    equal = F.when(F.col("mixed"), side(F.xxhash64("key", "same"), at - reach[0], at + reach[1], F.lit(1.0)))
    member = F.when(F.col("best").isNotNull(), side(F.col("best.link"), at + F.col("best.from"), at + F.col("best.to"), F.col("best.similarity")))
    members = rows.join(said, ["key", "same"]).select(F.inline(F.array_compact(F.array(member, equal))))
    out = stash(found.select(*members.columns).union(members).distinct(), "near-sides")
    discard(found)
    discard(one)
    return out


EDGES = "text_hash long, at int, side int, contents array<long>"


def moved_ends(stretches: DataFrame, exact: DataFrame, docs: DataFrame) -> DataFrame:
    """stretches whose ends are moved outward, less than GRID words, as long as another text goes on in the same way.

    exact: runs (link, text_hash, start, end).  Every text that has a run which is the end of a stretch anywhere says how it goes on.
    """
    outer = [exact.join(stretches.select("text_hash", c), ["text_hash", c]).select("link", F.lit(side).alias("side")) for side, c in enumerate(("start", "end"))]
    places = exact.join(outer[0].union(outer[1]).distinct(), "link").select("text_hash", "start", "side")
    rows = _with_texts(places, docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=1_500_000):
            hashes, counts, starts = _words(texts)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams(hashes, SHINGLE) ^ GOLDEN), dtype=np.uint64)])
            (first, row), (side, _) = _lists(batch, "start"), _lists(batch, "side")
            first, side = first.to_numpy().astype(np.int64), side.to_numpy()
            room = np.minimum(GRID - 1, np.where(side == 0, first, counts[row] - SHINGLE + 1 - MIN_SHINGLES - first))
            ends = np.cumsum(room)
            steps = np.arange(1, ends[-1] + 1 if len(ends) else 1) - np.repeat(ends - room, room)
            # Passages of the least length, moved outward.
            base = np.repeat(starts[row] + first, room) + np.where(np.repeat(side, room) == 0, -steps, steps)
            content = mix(sums[base + MIN_SHINGLES] - sums[base])
            contents = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(content.view(np.int64)))
            at = np.where(side == 0, first, first + MIN_SHINGLES - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(side), contents], [x.split()[0] for x in EDGES.split(", ")])

    edges = stash(rows.mapInArrow(cut, EDGES), "edges")
    # What goes on alike is counted as one; only ends of stretches need to know how far.
    alike = edges.groupBy("contents").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
    goes_on = alike.select(F.explode("contents").alias("content"), "low", "high").groupBy("content").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("content")
    own = stretches.select("text_hash", F.col("start").alias("at"), F.lit(0).alias("side")).union(stretches.select("text_hash", "end", F.lit(1))).distinct()
    moved = edges.join(own, ["text_hash", "at", "side"]).select("text_hash", "at", "side", F.posexplode("contents").alias("pos", "content"))
    moved = stash(moved.join(goes_on, "content").groupBy("text_hash", "at", "side").agg((F.max("pos") + 1).alias("steps")), "moved-ends")
    discard(edges)
    back = moved.where("side = 0").select("text_hash", F.col("at").alias("start"), F.col("steps").alias("back"))
    on = moved.where("side = 1").select("text_hash", F.col("at").alias("end"), F.col("steps").alias("on"))
    out = stretches.join(back, ["text_hash", "start"], "left").join(on, ["text_hash", "end"], "left")
    zero = F.lit(0)
    return out.select("text_hash", (F.col("start") - F.coalesce("back", zero)).alias("start"), (F.col("end") + F.coalesce("on", zero)).alias("end"), "class", "similarity")


def _once(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text_hash, text of every different text (docs: doc_id, text_hash, text; ids: without text)."""
    copied = ids.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("text_hash").alias("of"), "first")
    copied = stash(copied, "copies")
    some = F.broadcast(copied) if copied.count() <= BROADCAST_IDS else copied
    texts = stash(docs.join(some, F.col("text_hash") == F.col("of"), "left").where("of is null or doc_id <=> first").select("text_hash", "text"), "texts")
    discard(copied)
    if texts.groupBy("text_hash").count().where("count > 1").isEmpty():
        return texts
    once = stash(texts.dropDuplicates(["text_hash"]), "texts")  # rows that repeat doc_id and text
    discard(texts)
    return once


def sides(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """doc_id and text_hash; every text once; exact runs; and the ends of all links between texts.  Both: link, text_hash, start, end (in shingles, inclusive), similarity."""
    docs = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    ids = stash(docs.select("doc_id", "text_hash"), "ids")
    bare = _once(docs, ids)
    every = stash(windows(bare), "all-windows")
    found = stash(_shared(every), "windows")
    discard(every)

    runs = stash(exact_runs(found, bare), "all-runs")
    twice = runs.groupBy("run").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low <> high").select("run")
    exact = stash(runs.join(twice, "run").select(F.col("run").alias("link"), "text_hash", "start", (F.col("start") + MIN_SHINGLES - 1).alias("end"), F.lit(1.0).alias("similarity")), "runs")
    discard(runs)

    stretches = _classes(exact)
    held = stash(_held(found, stretches), "held")
    discard(found)
    near = near_links(held, bare, least)
    discard(held)
    names = ["link", "text_hash", "start", "end", "similarity"]
    return ids, bare, exact, stretches.select(F.col("class").alias("link"), "text_hash", "start", "end", "similarity").union(near.select(*names))


def passages(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), class_id, similarity of every passage that another text has, too.

    Passages of one class_id are linked, directly or over others; class_id is the smallest doc_id among
    them, and similarity the least of the links by which a passage came in.
    """
    ids, texts, exact, ends = sides(docs, least)
    stretches = stash(moved_ends(_classes(ends), exact, texts), "moved")
    members = ids.distinct()
    sized = members.groupBy("text_hash").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    first = stretches.select("class", "text_hash").join(sized, "text_hash").groupBy("class").agg(F.min("class_id").alias("class_id"))
    words = members.join(stretches, "text_hash").join(first, "class").select("doc_id", F.col("start").cast("long").alias("start_word"), (F.col("end") + SHINGLE).cast("long").alias("end_word"), "class_id", "similarity")

    copied = stash(sized.where("n > 1").select("text_hash", "class_id"), "copied")
    some = F.broadcast(copied) if copied.count() <= BROADCAST_IDS else copied

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t.split()) for t in texts], pa.int64())], ["text_hash", "class_id", "n"])

    counted = texts.join(some, "text_hash").select("text_hash", "class_id", "text").mapInArrow(count, "text_hash long, class_id long, n long").where(F.col("n") >= MIN_WORDS)
    whole = stash(counted, "whole-texts")
    discard(texts)
    return words.union(members.join(whole, "text_hash").select("doc_id", F.lit(0).cast("long"), "n", "class_id", F.lit(1.0)))
