"""Centroid clustering against its SQL and a plain version."""

import hashlib
import math

import numpy as np

from tidemark.llm import centroids


def plain(rows, k, rounds, dims=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    chosen = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    c = [x for *_, x in chosen]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        c = [[sum(col) // len(col) for col in zip(*own, strict=True)] if (own := [x for (_, x), a in zip(kept, at, strict=True) if a == j]) else c[j] for j in range(len(c))]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, sum(e for _, a, e in out if a == j), sum(e for *_, e in out), name[j]) for i, j, d in out), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clusters_match_plain(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(0, 0.2, (6, 64))
    rows = [(i, (base[i % 6] + rng.normal(0, 0.1, 64)).tolist()) for i in range(150)]
    rows += [(150, rows[3][1]), (150, rows[3][1]), (None, rows[4][1]), (None, None), (151, None), (152, [0.1] * 63), (153, [0.1] * 65), (154, [None] + [0.5] * 63), (155, [float("nan")] * 64), (156, [float("inf")] + [0.0] * 63), (157, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as cluster", "3 as distance").repartition(5)
    assert rows_of(centroids.clusters(df, k=12, rounds=5)) == plain(rows, 12, 5)


def test_few_empty_and_huge(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(centroids.clusters(df, k=40))
    assert [r[0] for r in got] == [1, 2, 3] and [r[2] for r in got] == [0, 0, 0]
    one = rows_of(centroids.clusters(df, k=1))
    assert one[0][2] == 64 * (centroids.LIMIT) ** 2 and {r[4] for r in one} == {sum(r[2] for r in one)}
    assert centroids.clusters(df.where("vec_id < 0")).collect() == []


def test_search_is_exact():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (40, 64))
    c[7] = c[3]
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    at, d = centroids.nearest(x, c)
    assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


def test_clusters_match_sql(spark, sf):
    from tests.compare import duck, same
    from tidemark.llm import queries

    same(queries.op12_centroids(spark, sf), duck(sf), queries.oracle_sql()["op12_centroids"])
