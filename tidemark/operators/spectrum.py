"""Spectra of keyed series, and matching of their peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import fourier
from tidemark.operators.windows import local_maxima


def dft(series: DataFrame, by: str, order: str, value: str, bins: int | None = None) -> DataFrame:
    """Magnitude of the first n / 2 bins of each series of n (order counts from 0), or of `bins` of them at most."""
    low = F.floor(F.col("n") / 2) if bins is None else F.least(F.floor(F.col("n") / 2), F.lit(bins))
    found = fourier.fft(series, by, order, value).where(F.col("bin") < low)
    return found.select(by, F.col("bin").cast("int").alias("bin"), (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.col("n")).alias("magnitude"))


def peaks(spectrum: DataFrame, by: str, floor: float = 0.05) -> DataFrame:
    return local_maxima(spectrum, by, "bin", "magnitude", floor)


def harmonics(found: DataFrame, fundamentals: DataFrame, by: str, frequency: str, width: float = 2.0) -> DataFrame:
    """Peaks near 2, 3 or 4 times, or a half or third of, the key's fundamental: by, frequency, kind, order."""
    multiples = [("harmonic", k, float(k)) for k in (2, 3, 4)] + [("subharmonic", k, 1.0 / k) for k in (2, 3)]
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("order"), F.lit(c).alias("times")) for a, b, c in multiples]))
    wanted = fundamentals.select(by, "fundamental", kinds.alias("m")).select(by, "m.kind", "m.order", (F.col("fundamental") * F.col("m.times")).alias("target"))
    return found.join(wanted, by).where(F.abs(F.col(frequency) - F.col("target")) < width).select(by, frequency, "kind", "order").distinct()


def intermodulation(lines: DataFrame, found: DataFrame, by: str, frequency: str, width: float = 2.0) -> DataFrame:
    """Products |f1 - f2|, f1 + f2 and |2 f1 - f2| of a key's drive lines (i, f) that lie near a peak."""
    a, b = lines.select(by, F.col("i").alias("i"), F.col("f").alias("f1")), lines.select(by, F.col("i").alias("j"), F.col("f").alias("f2"))
    both = a.join(b, by).where("i < j")
    products = both.select(by, F.explode(F.array(F.abs(F.col("f1") - F.col("f2")), F.col("f1") + F.col("f2"), F.abs(2 * F.col("f1") - F.col("f2")))).alias("product"))
    peak = found.select(F.col(by).alias("_by"), F.col(frequency).alias("_p"))
    return products.join(peak, (F.col(by) == F.col("_by")) & (F.abs(F.col("product") - F.col("_p")) < width), "left_semi").distinct()


def mode_splits(lines: DataFrame, found: DataFrame, by: str, frequency: str) -> DataFrame:
    """Keys with a peak more than 0.5 and less than 8 away from a drive line."""
    gap = F.abs(F.col(frequency) - F.col("f"))
    return lines.join(found, by).where((gap > 0.5) & (gap < 8.0)).select(by).distinct()


def order_parameter(phases: DataFrame, by: str, phase: str) -> DataFrame:
    """Length of the mean phase vector, and whether it locks (over 0.70)."""
    g = phases.groupBy(by).agg(F.avg(F.cos(phase)).alias("c"), F.avg(F.sin(phase)).alias("s"))
    return g.select(by, F.sqrt(F.col("c") ** 2 + F.col("s") ** 2).alias("coherence")).withColumn("locked", F.col("coherence") > 0.70)
