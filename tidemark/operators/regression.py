"""Least squares on any number of predictors, with variance inflation, from mergeable moments.

A group's rows become means, centred products and a count in one pass (map-side combined and stable); the small matrix
of each group is then solved by the sweep operator, which turns the predictors' block into its inverse, so that
coefficients, residual variance and inflation factors come from the same matrix.

Edge cases: rows with a null in the response or a predictor are left out; a predictor that is constant or a combination
of those before it is not swept: its coefficient, error and inflation factor are null, and all others are as without
it; with too few rows for a residual variance errors are null; a null key is a group like any other; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pivot below this share of its predictor's own variance is taken as zero.
TOLERANCE = 1e-10


def swept(matrix: np.ndarray, pivots: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The matrix after sweeping its first `pivots` rows, and which of them were swept."""
    a, done = matrix.astype(float).copy(), np.zeros(pivots, bool)
    for k in range(pivots):
        d = a[k, k]
        if not d > tolerance * max(matrix[k, k], 0.0):
            continue
        row, column = a[k] / d, a[:, k].copy()
        a -= np.outer(column, row)
        a[k], a[:, k] = row, -column / d
        a[k, k] = 1 / d
        done[k] = True
    return a, done


FIT = "term string, coefficient double, std_error double, t double, vif double, n long, df long, r_squared double, residual_variance double"


def linear_model(df: DataFrame, by: Sequence[str], y: str, predictors: Sequence[str]) -> DataFrame:
    """One row for the intercept and one for each predictor of each group, with the group's fit repeated on each."""
    names, by = [*predictors, y], list(by)
    p = len(predictors)
    whole = df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in names)).select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    means = F.array(*[F.avg(f"_v{i}") for i in range(p + 1)]).alias("means")
    products = F.array(*[F.covar_pop(f"_v{i}", f"_v{j}") * F.count("*") for i, j in pairs]).alias("products")
    moments = whole.groupBy(*by).agg(F.count("*").alias("n"), means, products).where("n > 0")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.array(pairs)
        for batch in batches:
            out, rows = [], []
            for g in range(batch.num_rows):
                n, mean, flat = (batch.column(len(by) + k)[g].as_py() for k in range(3))
                m = np.zeros((p + 1, p + 1))
                m[upper[:, 0], upper[:, 1]] = m[upper[:, 1], upper[:, 0]] = flat
                a, done = swept(m, p)
                df_, total = n - 1 - int(done.sum()), m[p, p]
                sse = max(a[p, p], 0.0)
                variance = sse / df_ if df_ > 0 else None
                fit = (n, df_, 1 - sse / total if total > 0 else None, variance)
                beta = np.where(done, a[:p, p], 0.0)
                x = np.array(mean[:p])
                inverse = a[:p, :p] * np.outer(done, done)

                def row(term: str, value: float, spread: float, vif: float | None, variance: float | None = variance, fit: tuple = fit) -> tuple:
                    error = None if variance is None else float(np.sqrt(max(variance * spread, 0.0)))
                    return (term, float(value), error, float(value) / error if error else None, vif, *fit)

                out.append(row("intercept", mean[p] - beta @ x, 1 / n + x @ inverse @ x, None))
                for k, name in enumerate(predictors):
                    out.append(row(name, beta[k], inverse[k, k], float(inverse[k, k] * m[k, k])) if done[k] else (name, None, None, None, None, *fit))
                rows += [g] * (p + 1)
            keys = [batch.column(i).take(pa.array(rows, pa.int32())) for i in range(len(by))]
            kinds = [pa.string(), *[pa.float64()] * 4, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*by, *[f.split()[0] for f in FIT.split(", ")]])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return moments.mapInArrow(solve, kinds + FIT)
