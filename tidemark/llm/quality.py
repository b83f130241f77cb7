"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A document is described by about twenty statistics of its whole text.  Random Fourier features approximate a
Gaussian kernel over them.  Each partition sums its share of the normal equations, the driver adds the few
(features + 1)-square matrices and solves for the ridge weights, and an isotonic fit on rows that the ridge
has not seen turns raw scores into probabilities.

Edge cases: a null or empty text has all statistics zero and is scored like any other; documents without a
label are scored; duplicate labels of one document count once (the highest); with no usable label, or labels
of one kind only, every score is the share of positive labels (0.5 without labels); repeated rows are scored each
for itself, and equal texts have equal scores; texts are read whole, in time linear in their length; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grams, slices, stash

#: Byte classes, fixed values: 1 symbol, 2 upper, 3 lower, 4 digit, 5 punctuation, 6 white space, 7 non-ASCII, 8 exclamation.
_CLASS = np.zeros(256, np.uint8)
for _c in b"#*$%&|<>":
    _CLASS[_c] = 1
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 7
for _c in b".,;:?-'\"()":
    _CLASS[_c] = 5
_CLASS[[32, *range(9, 14)]] = 6
_CLASS[33] = 8

N_STATS = 20


def statistics(text: bytes) -> np.ndarray:
    """The statistics of one whole text.  Cost is linear in its length."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    n = len(text)
    share = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9) / n
    words = text.split()
    n_words = max(1, len(words))
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint64, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    out[:9] = share
    out[9], out[10] = np.log1p(len(words)), np.log1p(n_lines)
    out[11], out[12] = lengths.mean(), lengths.std()
    out[13] = len(index) / n_words ** 0.75
    out[14] = float((ids[1:] == ids[:-1]).sum()) / n_words
    out[15] = 1 - len(set(lines)) / n_lines
    five = grams(ids + np.uint64(1), 5)
    out[16] = 1 - len(np.unique(five)) / len(five) if len(five) else 0
    out[17] = float(np.bincount(ids.astype(np.int64)).max()) / n_words if len(ids) else 0
    out[18] = np.log1p(n / n_lines)
    out[19] = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / n_lines
    return out


@dataclass(frozen=True)
class Model:
    """All that scoring needs; a few hundred kB at any corpus size."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((stats - self.mean) / self.scale, -8, 8) @ self.frequencies + self.phases)
        return np.hstack([z * np.sqrt(2 / len(self.phases)), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to y, in the order of x, with weights w."""
    blocks: list[list[float]] = []
    for v, k in zip(y[np.argsort(x, kind="stable")], w[np.argsort(x, kind="stable")], strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        stats = [statistics(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["stats", "label", "part"])


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 30_000, n_features: int = 256, ridge: float = 1e-3, width: float = 1.0, seed: int = 7, calibration_bins: int = 500) -> Model:
    """Fit on at most about `max_fit_rows` labelled rows, chosen by a hash of doc_id, none of them held out.

    Held out are rows whose crc32 of doc_id as text is divisible by 5.  A quarter of the rest calibrates.
    """
    usable = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    n = usable.count()
    share = min(1.0, max_fit_rows / max(1, n))
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "label", part.cast("int").alias("part"))
    # The sample has a bound (max_fit_rows small rows), so that it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", "part")
    seen = stash(rows.mapInArrow(_stats_of, "stats array<double>, label double, part int"), "quality-sample")
    moments = seen.select(*[F.col("stats")[i].alias(f"s{i}") for i in range(N_STATS)]).agg(
        *[F.avg(f"s{i}").alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(f"s{i}").alias(f"d{i}") for i in range(N_STATS)]
    ).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(N_STATS)])
    scale = np.maximum(np.array([moments[f"d{i}"] or 0.0 for i in range(N_STATS)]), 1e-6)
    rng = np.random.default_rng(seed)
    blank = Model(mean, scale, rng.normal(0, 1 / (width * np.sqrt(N_STATS)), (N_STATS, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.zeros(1), np.zeros(1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
        for b in batches:
            z = blank.features(np.array(b.column(0).to_pylist()).reshape(-1, N_STATS))
            y = np.array(b.column(1).to_pylist(), float)
            gram += z.T @ z
            right += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], ["gram", "right"])

    # Few partitions by the bound on the sample, so few matrices of half a MB reach the driver.
    sums = seen.where("part > 0").select("stats", "label").coalesce(4).mapInArrow(partial, "gram binary, `right` binary").collect()
    gram = sum((np.frombuffer(r["gram"]).reshape(n_features + 1, -1) for r in sums), np.zeros((n_features + 1, n_features + 1)))
    right = sum((np.frombuffer(r["right"]) for r in sums), np.zeros(n_features + 1))
    penalty = np.full(n_features + 1, ridge * max(1.0, gram[-1, -1]) / n_features)
    penalty[-1] = 1e-9
    model = Model(mean, scale, blank.frequencies, blank.phases, np.linalg.solve(gram + np.diag(penalty), right), np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.raw(np.array(b.column(0).to_pylist()).reshape(-1, N_STATS))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(raw, -1, 2) * calibration_bins).astype(np.int64)), b.column(1)], ["bin", "label"])

    # Bins are of fixed width on [-1, 2]: three times calibration_bins rows at most, at any size.
    bins = seen.where("part = 0").select("stats", "label").mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()
    if not bins:
        share_good = float(right[-1] / gram[-1, -1]) if gram[-1, -1] else 0.5
        return Model(mean, scale, model.frequencies, model.phases, model.weights, np.zeros(1), np.array([share_good]))
    x, y, w = (np.array([r[k] for r in bins], float) for k in ("bin", "y", "w"))
    return Model(mean, scale, model.frequencies, model.phases, model.weights, x / calibration_bins, isotonic(x, y, w))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of docs, with score and predicted.  One pass; nothing is shuffled."""
    taken = {c.lower() for c in docs.columns}
    key = next(c for c in ("_text", "_text_", "_text__") if c not in taken)
    schema = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    names = schema.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, key):
            s = model.score(np.array([statistics(t) for t in texts]))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema)
    return schema.withColumn(key, F.col("text")).mapInArrow(scored, f"{out}, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Column: this row is never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
