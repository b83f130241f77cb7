"""Discrete Fourier transforms of keyed series of any length, in n log n, and phase-scrambled surrogates.

A length n = a * b is transformed along one axis of the a x b arrangement, twiddled, and transformed along the other:
each step is one shuffle of the n rows by (key, place on the other axis), and numpy sees one factor at a time, `limit`
values at most.  A length up to `limit` takes one step, up to its square mostly two.  A length with a prime factor above
`limit` becomes a circular convolution with a chirp, of the next power of two, by three transforms of that length.

Edge cases: missing orders and null values count as zero; a key of one row is its own transform; an empty series gives
an empty result; a null key is a key like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one transform within a task takes at most.
LIMIT = 16_384


@lru_cache(maxsize=100_000)
def next_factor(length: int, limit: int) -> int:
    """The factor to transform along first: a short length itself, else the divisor next above the root, else the greatest up to limit; 0 if there is none."""
    if length <= limit:
        return length
    divisors = [d for d in range(2, limit + 1) if length % d == 0]
    above = [d for d in divisors if d * d >= length]
    return above[0] if above else divisors[-1] if divisors else 0


def steps_of(length: int, limit: int) -> int:
    """Shuffles that a length takes, or 0 where one of its factors is out of reach."""
    steps = 0
    while length > 1:
        a = next_factor(length, limit)
        if not a:
            return 0
        length, steps = length // a, steps + 1
    return max(1, steps)


def _transformed(table: pa.Table, keys: list[str], starts: np.ndarray, limit: int) -> pa.RecordBatch:
    """Transforms of whole groups.  Rows of a group share (keys, prefix, t2) and hold t1, re and im."""
    column = {c: table[c].to_numpy() for c in table.column_names if c not in keys}
    sizes = np.diff(np.append(starts, len(table)))
    group = np.repeat(np.arange(len(starts)), sizes)
    head = {c: v[starts] for c, v in column.items()}
    parts = []
    for a in np.unique(head["factor"]).tolist():
        own = np.flatnonzero(head["factor"] == a)
        at = np.full(len(starts), -1)
        at[own] = np.arange(len(own))
        rows = at[group] >= 0
        x = np.zeros((len(own), a), complex)
        x[at[group[rows]], column["t1"][rows]] = column["re"][rows] + 1j * column["im"][rows]
        length, t2, k = head["length"][own][:, None], head["t2"][own][:, None], np.arange(a)
        y = np.fft.fft(x, axis=1) * np.exp(-2j * math.pi * ((t2 * k) % length) / length)
        prefix = head["prefix"][own][:, None] + head["stride"][own][:, None] * k
        parts.append((np.repeat(own, a), prefix.ravel(), np.repeat(head["stride"][own] * a, a), np.repeat(head["length"][own] // a, a), np.repeat(head["t2"][own], a), y.ravel()))
    own, prefix, stride, length, j, y = (np.concatenate(p) for p in zip(*parts, strict=True))
    short, back = np.unique(length, return_inverse=True)
    factor = np.array([next_factor(int(v), limit) for v in short], np.int64)[back]
    key_rows = pa.array(starts[own])
    columns = {c: table[c].take(key_rows).combine_chunks() for c in keys} | {"n": pa.array(head["n"][own])}
    for c, v in (("prefix", prefix), ("stride", stride), ("length", length), ("factor", factor), ("j", j), ("re", np.ascontiguousarray(y.real)), ("im", np.ascontiguousarray(y.imag))):
        columns[c] = pa.array(v)
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], list(columns))


def _step(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """One shuffle: rows meet those of their group, which are transformed along t1."""
    b = F.expr("length div factor")
    sent = rows.select(*keys, "n", "prefix", "stride", "length", "factor", F.expr("j div (length div factor)").alias("t1"), (F.col("j") % b).alias("t2"), "re", "im")
    dealt = sent.repartition(*keys, "prefix", "t2").sortWithinPartitions(*keys, "prefix", "t2")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # rows of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*kept, batch]).combine_chunks()
            new = np.zeros(len(table), bool)
            new[0] = True
            for c in (*keys, "prefix", "t2"):
                v = pc.fill_null(table[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield _transformed(table.slice(0, starts[-1]), keys, starts[:-1], limit)
            kept = table.slice(starts[-1]).to_batches()
        if kept:
            yield _transformed(pa.Table.from_batches(kept), keys, np.zeros(1, np.int64), limit)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return dealt.mapInArrow(transform, f"{kinds}, n long, prefix long, stride long, length long, factor long, j long, re double, im double")


def _factored(rows: DataFrame, keys: list[str], length: str, steps: int, limit: int) -> DataFrame:
    """keys, n, bin, re and im of the transforms of rows (keys, n, j, re, im) of the given lengths."""
    factor = F.pandas_udf(lambda s: s.map(lambda v: next_factor(int(v), limit)).astype("int64"), "long")
    state = rows.select(*keys, "n", F.lit(0).cast("long").alias("prefix"), F.lit(1).cast("long").alias("stride"), F.col(length).alias("length"), factor(F.col(length)).alias("factor"), "j", "re", "im")
    done = None
    for step in range(steps):
        state = _step(state, keys, limit)
        if step < steps - 1:  # keys whose lengths take fewer steps
            ready = state.where("length = 1")
            done = ready if done is None else done.union(ready)
            state = state.where("length > 1")
    return (state if done is None else done.union(state)).select(*keys, "n", F.col("prefix").alias("bin"), "re", "im")


def _chirped(rows: DataFrame, by: str, limit: int, steps: int) -> DataFrame:
    """Transforms of lengths out of reach of factors, as convolutions with a chirp."""
    m = F.expr("shiftleft(1L, length(bin(2 * n - 2)))")
    turn = lambda t: math.pi * ((t * t) % (2 * F.col("n"))) / F.col("n")
    t = F.col("j")
    wide = rows.withColumn("m", m).withColumns({"c": F.cos(turn(t)), "s": F.sin(turn(t))})
    signal = wide.select(by, F.lit(0).alias("side"), "n", "m", "j", (F.col("re") * F.col("c") + F.col("im") * F.col("s")).alias("re"), (F.col("im") * F.col("c") - F.col("re") * F.col("s")).alias("im"))
    places = F.explode(F.when(t > 0, F.array(t, F.col("m") - t)).otherwise(F.array(t))).alias("j")
    chirp = wide.select(by, F.lit(1).alias("side"), "n", "m", places, F.col("c").alias("re"), F.col("s").alias("im"))
    both = _factored(signal.union(chirp), [by, "side"], "m", steps, limit)
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    met = both.groupBy(by, "n", "bin").agg(pick(0, "re").alias("a"), pick(0, "im").alias("b"), pick(1, "re").alias("c"), pick(1, "im").alias("d"))
    product = met.select(by, "n", m.alias("m"), F.col("bin").alias("j"), (F.col("a") * F.col("c") - F.col("b") * F.col("d")).alias("re"), (-(F.col("a") * F.col("d") + F.col("b") * F.col("c"))).alias("im"))
    back = _factored(product, [by], "m", steps, limit).where("bin < n").withColumn("m", m)
    re, im, k = F.col("re") / F.col("m"), -F.col("im") / F.col("m"), F.col("bin")
    return back.select(by, "n", "bin", (re * F.cos(turn(k)) + im * F.sin(turn(k))).alias("re"), (im * F.cos(turn(k)) - re * F.sin(turn(k))).alias("im"))


def transform(rows: DataFrame, by: str, limit: int = LIMIT) -> DataFrame:
    """by, n, bin, re, im: the transforms of rows (by, n, j, re, im), where n is the length of the key's series."""
    counted = F.pandas_udf(lambda s: pd.Series([steps_of(int(v), limit) for v in s], dtype="int32"), "int")
    longer = F.pandas_udf(lambda s: pd.Series([steps_of(1 << (2 * int(v) - 2).bit_length(), limit) for v in s], dtype="int32"), "int")
    marked = rows.select("n").distinct().select(counted("n").alias("steps"), longer("n").alias("chirp"))
    most = marked.agg(F.max("steps").alias("steps"), F.max(F.when(F.col("steps") == 0, F.col("chirp"))).alias("chirp")).first()  # one row
    plain = rows if most["chirp"] is None else rows.where(counted("n") > 0)
    out = _factored(plain, [by], "n", max(1, most["steps"] or 0), limit)
    return out if most["chirp"] is None else out.union(_chirped(rows.where(counted("n") == 0), by, limit, most["chirp"]))


def fft(series: DataFrame, by: str, order: str, value: str, limit: int = LIMIT) -> DataFrame:
    """by, n, bin, re, im of each real series (order counts from 0)."""
    rows = series.select(by, F.col(order).cast("long").alias("j"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    sizes = series.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"))
    rows = rows.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).select(by, "n", "j", "re", "im")
    return transform(rows, by, limit)


def inverse(spectrum: DataFrame, by: str, order: str, value: str, limit: int = LIMIT) -> DataFrame:
    """The real series (by, order, value) of whole spectra (by, n, bin, re, im)."""
    rows = spectrum.select(by, "n", F.col("bin").alias("j"), "re", (-F.col("im")).alias("im"))
    return transform(rows, by, limit).select(by, F.col("bin").alias(order), (F.col("re") / F.col("n")).alias(value))


def surrogate(series: DataFrame, by: str, order: str, value: str, turn: Callable[[Column, Column], Column] | None = None, seed: int = 42, limit: int = LIMIT) -> DataFrame:
    """by, order and `value`_surrogate: the same power spectrum with scrambled phases.

    `turn` gives the turn in [0, 1) of a key's bin; by default it is a hash of both and the seed.  Bins that mirror each
    other turn in opposite senses, and the mean and the middle bin of an even length stay, so that the series is real.
    """
    if turn is None:
        turn = lambda key, k: F.pmod(F.xxhash64(key, k, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    k, n = F.col("bin"), F.col("n")
    low = F.least(k, n - k)
    sense = F.when((k == 0) | (2 * k == n), 0.0).when(k < n - k, 1.0).otherwise(-1.0)
    angle = sense * 2 * math.pi * turn(F.col(by), low)
    turned = fft(series, by, order, value, limit).select(by, "n", "bin", (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("im") * F.cos(angle) + F.col("re") * F.sin(angle)).alias("im"))
    return inverse(turned, by, order, f"{value}_surrogate", limit)
