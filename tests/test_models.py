"""Regression with inflation factors and Gaussian processes, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factorial, gaussian, regression


def plain_ols(x, y):
    a = np.column_stack([np.ones(len(y)), x])
    inverse = np.linalg.inv(a.T @ a)
    beta = inverse @ a.T @ y
    s2 = ((y - a @ beta) ** 2).sum() / (len(y) - a.shape[1])
    vif = [1 / (1 - (1 - ((x[:, k] - np.column_stack([np.ones(len(y)), np.delete(x, k, 1)]) @ np.linalg.lstsq(np.column_stack([np.ones(len(y)), np.delete(x, k, 1)]), x[:, k], rcond=None)[0]) ** 2).sum() / ((x[:, k] - x[:, k].mean()) ** 2).sum())) for k in range(x.shape[1])]
    return beta, np.sqrt(s2 * np.diag(inverse)), vif


def test_six_predictors_against_numpy(spark):
    rng = np.random.default_rng(6)
    names = [f"x{i}" for i in range(6)]
    parts, want = [], {}
    for key, n in (("a", 200), ("b", 40), (None, 30)):
        x = rng.normal(size=(n, 6)) + 100
        x[:, 5] = x[:, 0] + 0.2 * x[:, 5]
        y = x @ rng.normal(size=6) + rng.normal(size=n) + 5
        want[key] = plain_ols(x, y)
        parts.append(pd.DataFrame(x, columns=names).assign(y=y, k=key))
    df = spark.createDataFrame(pd.concat(parts), "x0 double, x1 double, x2 double, x3 double, x4 double, x5 double, y double, k string")
    extra = df.limit(3).withColumn("x2", F.lit(None).cast("double")).union(df.limit(2).withColumn("y", F.lit(float("nan"))))
    got = regression.linear_model(df.union(extra).repartition(4), ["k"], "y", names).toPandas()
    for key, (beta, error, vif) in want.items():
        mine = got[got["k"].isna()] if key is None else got[got["k"] == key]
        mine = mine.set_index("term").loc[["intercept", *names]]
        assert np.allclose(mine["coefficient"], beta, rtol=1e-6) and np.allclose(mine["std_error"], error, rtol=1e-6)
        assert np.allclose(mine["vif"].iloc[1:], vif, rtol=1e-6)


def test_collinear_and_constant_predictors(spark):
    rows = [(float(i), 2.0 * i, 7.0, float((i * i) % 5), 3.0 * i + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, twice double, flat double, b double, y double")
    got = regression.linear_model(df, [], "y", ["a", "twice", "flat", "b"]).toPandas().set_index("term")
    assert got.loc["a", "coefficient"] == pytest.approx(3) and got.loc[["twice", "flat"], "vif"].isna().all()
    assert got.loc["intercept", "coefficient"] == pytest.approx(1) and got.loc["a", "df"] == 17
    assert regression.linear_model(df.where("a < 0"), [], "y", ["a"]).count() == 0
    assert regression.linear_model(df.where("a < 1"), [], "y", ["a"]).toPandas()["std_error"].isna().all()


def exact(x, y, c, noise=0.05):
    scales = np.array(factorial.LENGTH_SCALES)
    kernel = lambda a, b: np.exp(-0.5 * ((((a[:, None] - b[None]) / scales) ** 2).sum(2)))
    k, s = kernel(x, x) + noise * np.eye(len(x)), kernel(x, c)
    solved = np.linalg.solve(k, np.column_stack([y, s]))
    return s.T @ solved[:, 0], np.sqrt(np.maximum(1e-4, 1 - (s * solved[:, 1:]).sum(axis=0)))


def history(rng, n):
    x = np.zeros((n, 16))
    x[:, 0], x[:, 1] = np.log10(rng.integers(40, 1000, n)), rng.integers(0, 20, n) / 4
    for at, size in ((2, 4), (6, 5), (11, 5)):
        x[np.arange(n), at + rng.integers(0, size, n)] = 1
    return x, np.sin(3 * x[:, 0]) + 0.3 * x[:, 2] + 0.1 * rng.normal(size=n)


def _posterior(spark, groups, cand, **options):
    rows = [(k, v.tolist(), float(r)) for k, (x, y) in groups.items() for v, r in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "opt string, features array<double>, response double").repartition(3)
    got = factorial.gaussian_process(df, cand, "opt", **options).toPandas()
    return {k: (got[got["opt"].isna()] if k is None else got[got["opt"] == k]).sort_values("candidate_id") for k in groups}


def test_gaussian_process_is_exact_on_short_histories(spark):
    rng = np.random.default_rng(0)
    c, _ = history(rng, 7)
    cand = pd.DataFrame({"candidate_id": range(7), "features": c.tolist()})
    groups = {"a": history(rng, 40), "b": history(rng, 3), None: history(rng, 20)}
    groups["repeats"] = tuple(np.concatenate([v, v[:4], v[:2]]) for v in history(rng, 10))
    for k, got in _posterior(spark, groups, cand).items():
        mu, sigma = exact(*groups[k], c)
        assert np.allclose(got["mu"], mu, atol=1e-6) and np.allclose(got["sigma"], sigma, atol=1e-6), k


def test_gaussian_process_over_many_parts(spark, monkeypatch):
    """Parts and merges change nothing; with fewer inducing points than rows the error stays small."""
    rng = np.random.default_rng(1)
    x, y = history(rng, 220)
    c, _ = history(rng, 30)
    cand = pd.DataFrame({"candidate_id": range(30), "features": c.tolist()})
    mu, sigma = exact(x, y, c)
    monkeypatch.setattr(gaussian, "ROWS", 30)
    monkeypatch.setattr(gaussian, "FAN", 3)
    got = _posterior(spark, {"a": (x, y)}, cand, most=300)["a"]
    assert np.allclose(got["mu"], mu, atol=1e-5) and np.allclose(got["sigma"], sigma, atol=1e-5)
    near = _posterior(spark, {"a": (x, y)}, cand, most=120)["a"]
    assert np.sqrt(((near["mu"] - mu) ** 2).mean()) < 0.12 and np.sqrt(((near["sigma"] - sigma) ** 2).mean()) < 0.3
