"""Ranked search against a plain ranking of all documents, and against its SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, df = sum(sum(b.values()) for _, b in bags), Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        want = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * len(bags) // total
            s = sum(c * math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w, c in want.items() if w in b)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms_as_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aZ09 _-.\x00\x7f\n\x85\xa0éÉ中 [`{/:@") for _ in range(rng.randint(0, 40)))
        assert [w.decode() for w in ranked.terms(t.encode())] == TERM.findall(t.translate(LOWER))


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_matches_plain(spark, seed, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_DOCS", 60)
    monkeypatch.setattr(ranked, "TOGETHER", 30)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "中", "Ab"]
    text = lambda a, b: " ".join(words[min(int(rng.expovariate(0.12)), 42)] for _ in range(rng.randint(a, b)))
    docs = [(i, text(0, 60)) for i in range(400)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, " ?! "), (902, "w1 " * 30_000)]
    docs += [(1000 + i, "w5 w6 w7") for i in range(50)]  # ties
    items = [(i, text(1, 30)) for i in range(12)] + [(3, "w1"), (50, "unknown"), (51, None), (52, ""), (None, "w5 w6 w6"), (53, "w5 w6 w6")]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as score", "3 as query", "4 as item_id").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as doc_id", "3 as query")
    assert rows_of(ranked.ranked(a, b)) == plain(docs, items)


def test_blocks_of_items(spark, monkeypatch, odd):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 20)
    docs = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    items = [(i, t) for i, t in enumerate(["one", "same words", "a text", "éß 中文", "line of a long text", "of of of", "here"])]
    assert rows_of(ranked.ranked(odd, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked.ranked(empty, items).collect() == []
    assert ranked.ranked(odd, items.where("item_id > 1")).collect() == []
    assert ranked.ranked(odd, spark.createDataFrame([(1, " ! ")], "item_id long, text string")).collect() == []


def test_most_documents_are_pruned():
    rng = np.random.default_rng(5)
    tf = rng.integers(1, 9, (4000, 12)) * (rng.random((4000, 12)) < 0.2)
    tf[34::400] = 8  # ten documents that hold every term
    place, term = np.nonzero(tf)
    shard = ranked.Shard(np.arange(4000), np.zeros(4000, bool), np.full(4000, 100), place, term.astype(np.int32), tf[place, term], 12)
    best = ranked.Best(1, 10)
    scored = shard.search(np.array([0]), np.zeros(12, np.int64), np.arange(12), np.full(12, 1000), best)
    assert best.doc.tolist() == list(range(34, 4000, 400)) and scored < 1000


def test_ranking_matches_sql(spark, sf):
    from tests.compare import duck, same
    from tidemark.llm import queries

    same(queries.op11_ranked(spark, sf), duck(sf), queries.oracle_sql()["op11_ranked"])
