"""Column functions that Spark lacks or that need guards under ANSI rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.checksum import crc32c_of


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_corr(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson r over a group or a window; null where either side is constant."""

    def at(c: Column) -> Column:
        return c.over(over) if over is not None else c

    return F.try_divide(at(F.covar_pop(x, y)), at(F.stddev_pop(x)) * at(F.stddev_pop(y)))


def number(c: Column) -> Column:
    """Text as double, or null: decimal and exponent notation only, no suffixes, no NaN."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def canonical_json(row: Column) -> Column:
    """Compact JSON; give a struct with its fields in alphabetical order."""
    return F.to_json(row)


def sorted_map(m: Column) -> Column:
    """A map with its keys in order, so that its JSON is canonical."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def _crc32c_of(data: pd.Series) -> pd.Series:
    """CRC-32C of strings (as UTF-8) or bytes: eight upper-case hex digits; null stays null."""
    raw = [None if v is None else (v.encode() if isinstance(v, str) else bytes(v)) for v in data]
    sums = crc32c_of([r or b"" for r in raw])
    return pd.Series([None if r is None else f"{int(c):08X}" for r, c in zip(raw, sums, strict=True)], dtype=object)


def crc32c(data: Column | str) -> Column:
    """CRC-32C of a string (as UTF-8) or binary column."""
    return F.pandas_udf(_crc32c_of, "string")(data)


def register(spark: SparkSession) -> None:
    """Make crc32c callable from SQL."""
    spark.udf.register("crc32c", F.pandas_udf(_crc32c_of, "string"))


#: Two-sided Student t critical values at 0.05 by degrees of freedom (fixed values).
T_CRITICAL = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 25: 2.060, 30: 2.042}


def t_critical(df: Column) -> Column:
    """Nearest tabulated value up to 30 degrees of freedom (ties to the smaller), a series in 1/df beyond, 12.706 below 1."""
    nearest = F.lit(12.706)
    for known in sorted(T_CRITICAL):
        smaller = max((k for k in T_CRITICAL if k < known), default=0)
        nearest = F.when(df * 2 > known + smaller, F.lit(T_CRITICAL[known])).otherwise(nearest) if smaller else nearest
    far = F.round(F.lit(1.95996) + 2.378 / F.greatest(df, F.lit(1)) + 2.82 / F.greatest(df * df, F.lit(1)), 3)
    return F.when(df > 30, far).otherwise(nearest)


def lcg(seed: Column) -> Column:
    """One step of a linear congruential generator modulo 2^31; use the high bits."""
    return F.pmod(F.pmod(seed.cast("long"), F.lit(2**31)) * F.lit(1103515245) + F.lit(12345), F.lit(2**31))
