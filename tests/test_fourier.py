"""Transforms against numpy at many lengths and limits; surrogates keep their spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fourier, spectrum

LENGTHS = {"a": 1, "b": 2, "c": 12, "d": 60, "e": 97, "f": 128, "g": 194, "h": 210, None: 30}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(8)
    x = {k: rng.normal(size=n) for k, n in LENGTHS.items()}
    rows = [(k, t, float(v)) for k, s in x.items() for t, v in enumerate(s)]
    return x, spark.createDataFrame(rows, "k string, t int, v double").withColumn("n", F.lit(-1)).withColumn("re", F.lit(9.0)).repartition(5)


def _by_key(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append((r[1], r[value]))
    return {k: np.array([v for _, v in sorted(rows)]) for k, rows in out.items()}


@pytest.mark.parametrize("limit", [4096, 16])
def test_any_length_equals_numpy(spark, series, limit):
    x, df = series
    got = fourier.fft(df, "k", "t", "v", limit).select("k", "bin", "re", "im")
    re, im = _by_key(got, "re"), _by_key(got, "im")
    for k, s in x.items():
        assert np.allclose(re[k] + 1j * im[k], np.fft.fft(s), atol=1e-9), k


def test_factors():
    assert fourier.next_factor(4096, 64) == 64 and fourier.steps_of(4096, 64) == 2
    assert fourier.steps_of(97 * 2, 16) == 0 and fourier.steps_of(97, 100) == 1 and fourier.steps_of(2**30, 1024) == 3


def test_missing_orders_and_nulls_are_zero(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 2, 5.0), ("s", 1, None)], "k string, t int, v double")
    got = _by_key(fourier.fft(df, "k", "t", "v").select("k", "bin", "re", "im"), "re")["s"]
    assert np.allclose(got, np.fft.fft([1.0, 0.0, 5.0]).real)
    assert fourier.fft(df.where("t > 5"), "k", "t", "v").count() == 0


def test_surrogates(spark, series, limit=64):
    x, df = series
    one = _by_key(fourier.surrogate(df, "k", "t", "v", seed=1, limit=limit), "v_surrogate")
    other = _by_key(fourier.surrogate(df.repartition(2), "k", "t", "v", seed=2, limit=4096), "v_surrogate")
    again = _by_key(fourier.surrogate(df.repartition(2), "k", "t", "v", seed=1, limit=4096), "v_surrogate")
    for k, s in x.items():
        assert np.allclose(np.abs(np.fft.fft(one[k])), np.abs(np.fft.fft(s)), atol=1e-9)
        assert np.allclose(one[k], again[k], atol=1e-12)
        if len(s) > 4:
            assert abs(np.corrcoef(one[k], s)[0, 1]) < 0.9 and not np.allclose(one[k], other[k])


def test_dft_rows_are_linear_in_the_length(spark):
    """No stage makes more than a few rows for each sample."""
    n = 3000
    df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.sin(F.col("id") * 0.3).alias("v"))
    out = spectrum.dft(df, "k", "t", "v")
    assert out.count() == n // 2 and "Generate" not in out._jdf.queryExecution().executedPlan().toString()
