"""Windowed measures over keyed, ordered series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.scalar import safe_corr
from tidemark.operators import fourier


def trailing(by: Sequence[str] | str, order: Sequence[str] | str, rows: int) -> WindowSpec:
    by, order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)


def running(by: Sequence[str] | str, order: Sequence[str] | str) -> WindowSpec:
    by, order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def rolling_zscore(value: Column, w: WindowSpec) -> Column:
    """z-score of the last value in a trailing window, population deviation; 0 where that is below 1e-12."""
    deviation = F.stddev_pop(value).over(w)
    return F.when(deviation < 1e-12, 0.0).otherwise((value - F.avg(value).over(w)) / F.greatest(deviation, F.lit(1e-12)))


def short_long_ratio(value: Column, short: WindowSpec, long: WindowSpec) -> Column:
    """Mean absolute value over a short window by that over a long one."""
    return F.avg(F.abs(value)).over(short) / F.greatest(F.avg(F.abs(value)).over(long), F.lit(1e-12))


def pair_correlations(df: DataFrame, channels: Sequence[str], by: Sequence[str], order: str, width: int, lag: int = 0) -> DataFrame:
    """Trailing correlation of every channel pair, one row a pair; only full windows, and no constant ones.

    All pairs share one sort of the series.  With a lag the second channel of a pair is that many rows older.
    """
    w = trailing(by, order, width)
    back = Window.partitionBy(*by).orderBy(order)
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    second = {b: F.lag(b, lag).over(back) if lag else F.col(b) for _, b in pairs}
    lagged = df.withColumns({f"_{b}": c for b, c in second.items()})
    full = lagged.withColumn("_n", F.count(F.col(f"_{channels[1]}")).over(w))
    full = full.withColumns({f"_r{i}": safe_corr(F.col(a), F.col(f"_{b}"), w) for i, (a, b) in enumerate(pairs)}).where(F.col("_n") == width)
    rows = F.stack(F.lit(len(pairs)), *[x for i, (a, b) in enumerate(pairs) for x in (F.lit(a), F.lit(b), F.col(f"_r{i}"))]).alias("channel_a", "channel_b", "pearson_r")
    return full.select(*by, order, rows).where("pearson_r is not null and not isnan(pearson_r)")


def rolled_null_correlation(df: DataFrame, value: str, by: str, order: str, width: int) -> DataFrame:
    """Trailing correlation of a series with itself rotated by half the window: what chance alone gives."""
    numbered = df.select(by, order, value).withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    sized = numbered.join(numbered.groupBy(by).agg(F.count("*").alias("n")), by)
    rotated = sized.select(by, F.pmod(F.col("i") + max(1, width // 2), F.col("n")).alias("i"), F.col(value).alias("rolled"))
    w = trailing(by, "i", width)
    both = sized.join(rotated, [by, "i"]).withColumn("r", safe_corr(F.col(value), F.col("rolled"), w)).withColumn("k", F.count("*").over(w))
    return both.where(F.col("k") == width).where("r is not null and not isnan(r)").select(by, order, "r")


def surrogate_null_correlation(df: DataFrame, value: str, by: str, order: str, width: int, turn: Callable[[Column, Column], Column] | None = None, seed: int = 42) -> DataFrame:
    """Trailing correlation of a series (order counts from 0) with its phase-scrambled surrogate."""
    scrambled = fourier.surrogate(df, by, order, value, turn, seed)
    w = trailing(by, order, width)
    both = df.select(by, order, value).join(scrambled, [by, order]).withColumn("r", safe_corr(F.col(value), F.col(f"{value}_surrogate"), w)).withColumn("k", F.count("*").over(w))
    return both.where(F.col("k") == width).where("r is not null and not isnan(r)").select(by, order, "r")


def null_threshold(null: DataFrame, by: str, quantile: float = 0.95, low: float = 0.05, high: float = 0.99) -> DataFrame:
    """Exact interpolated quantile of |r|, kept within [low, high]."""
    return null.groupBy(by).agg(F.least(F.greatest(F.percentile(F.abs("r"), quantile), F.lit(low)), F.lit(high)).alias("threshold"))


def walk(steps: DataFrame, by: Sequence[str], order: str, start: str, step: str, size: int) -> DataFrame:
    """Positions of a random walk on a ring: start plus the running sum of steps, modulo size."""
    return steps.withColumn("position", F.pmod(F.col(start) + F.sum(step).over(running(by, order)), F.lit(size)))


def gaps(df: DataFrame, by: str, sequence: str) -> DataFrame:
    """Missing ranges of a sequence: by, first_missing, last_missing."""
    before = F.lag(sequence).over(Window.partitionBy(by).orderBy(sequence))
    return df.select(by, sequence).distinct().withColumn("before", before).where(F.col(sequence) - F.col("before") > 1).select(by, (F.col("before") + 1).alias("first_missing"), (F.col(sequence) - 1).alias("last_missing"))


def last_difference(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The last value of each series and its difference from the one before."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return df.select(by, order, value, step.alias("difference")).groupBy(by).agg(F.max_by(value, order).alias("last"), F.max_by("difference", order).alias("difference"))


def next_scheduled(schedule: DataFrame, done: DataFrame, by: str, index: str) -> DataFrame:
    """The first entry of each schedule (by, index) that is not done: what a queue would give next."""
    return schedule.join(done.select(by, index), [by, index], "left_anti").groupBy(by).agg(F.min(index).alias(index))


def valid_prefix(df: DataFrame, by: str, order: str, valid: Column) -> DataFrame:
    """Rows before the first invalid one of each key."""
    return df.withColumn("_ok", F.bool_and(valid).over(running(by, order))).where("_ok").drop("_ok")


def backward_time(df: DataFrame, by: str, order: str, time: str) -> DataFrame:
    """Rows whose time is before a time already seen."""
    before = F.max(time).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).where(F.col(time) < F.col("_before")).drop("_before")


def sample_times(df: DataFrame, anchor_us: str, last_sequence: str, sequence: str, period_us: str) -> Column:
    """Device time of a sample in a batch, from the batch's anchor, its last sequence number and the nominal period."""
    return F.col(anchor_us) - (F.col(last_sequence) - F.col(sequence)) * F.col(period_us)


def local_maxima(df: DataFrame, by: str, order: str, value: str, floor: float = 0.05) -> DataFrame:
    """Rows larger than both neighbours and than `floor` of their key's largest."""
    w = Window.partitionBy(by).orderBy(order)
    top = Window.partitionBy(by)
    marked = df.withColumns({"_b": F.lag(value).over(w), "_a": F.lead(value).over(w), "_m": F.max(value).over(top)})
    return marked.where((F.col(value) > F.col("_b")) & (F.col(value) > F.col("_a")) & (F.col(value) > floor * F.col("_m"))).drop("_a", "_b", "_m")


def time_shifted(df: DataFrame, by: str, order: str, value: str, shift: int) -> DataFrame:
    """The series rotated by `shift` rows: a time-shifted baseline."""
    numbered = df.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    sized = numbered.join(numbered.groupBy(by).agg(F.count("*").alias("n")), by)
    moved = sized.select(by, F.pmod(F.col("i") + shift, F.col("n")).alias("i"), F.col(value).alias(f"{value}_shifted"))
    return sized.join(moved, [by, "i"]).drop("i", "n")
