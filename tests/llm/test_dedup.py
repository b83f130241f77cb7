"""Line, near, substring and passage dedup, and decontamination, against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import duck, same
from tests.llm.conftest import ODD
from tidemark.llm import compact_windows, decontaminate, line_dedup, minhash, queries, suffix_dedup


def test_lines_equal_sql(spark, sf):
    same(queries.op2_line_dedup(spark, sf), duck(sf), queries.OP2)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_lines_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("ab "), rng.integers(14, 36))).strip() or "x" for _ in range(25)]
    lines = []
    for b in base:
        for _ in range(4):
            s = list(b)
            for _ in range(rng.integers(0, 3)):
                i = int(rng.integers(0, len(s) + 1))
                kind = rng.integers(3)
                if kind == 0:
                    s.insert(i, "c")
                elif i < len(s):
                    s[i : i + 1] = [] if kind == 1 else ["d"]
            lines.append("".join(s))
    lines += ["a" * 20, "a" * 21, "a" * 22, "a" * 24, "aXaaaaaaaaaaaaaaaaaaa", "short", "shorts", "short"]
    rng.shuffle(lines)
    got = line_dedup.line_decisions(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string"))
    gone = {r.doc_id for r in got.collect()}
    long_ = lambda s: len(s) >= 16
    want = {i for i, t in enumerate(lines) if t.strip() and any(t == u or (long_(t) and long_(u) and _distance(t, u) <= 1) for u in lines[:i])}
    assert gone == want


def test_lines_odd_rows(odd, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    got = line_dedup.dedup_lines(odd).collect()
    # Texts without a line stay; 8 keeps its first line of each near group.
    assert Counter(r.doc_id for r in got) >= Counter([1, 2, 3, 4, None, None])
    assert all(len((r.text or "").split("\n")) < 3000 for r in got) and set(got[0].asDict()) == set(odd.columns)


def _components(sets, percent):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_against_all_pairs(spark, sf, texts, shingle):
    got = minhash.near_duplicates(queries.table(spark, sf, "documents"), shingle, 80).collect()
    sets = {d: minhash.exact_shingles(t.encode(), shingle) for d, t in texts.items()}
    want = _components(sets, 80)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, len(sets[d]), want[d], want[d] == d) for d in texts}


def test_links_between_components_are_found(spark):
    """A family around a centre that is not the smallest id: links that no star shows."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(60):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            words[k] = f"x{i}_{k}"
        rows[i] = " ".join(words)
    got = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), 2, 80)
    want = _components({d: minhash.exact_shingles(t.encode(), 2) for d, t in rows.items()}, 80)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_near_duplicates_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd, 2).collect()
    assert len(got) == len(ODD)
    by = Counter((r.doc_id, r.component_id, r.kept) for r in got)
    assert by[(5, 5, True)] == 2 and by[(None, None, True)] == 2 and by[(1, 1, True)] == 1
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one(odd).count() == len(ODD)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        found = []
        for _ in range(40):
            common = rng.integers(1, 2**62, int(800 * share / (1 + share)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(1, 2**62, 400 - len(common), dtype=np.uint64)])) for _ in range(2))
            x, y = (np.array(minhash._signature(s)[0], np.int64).view(np.uint8) for s in (a, b))
            nibbles = lambda v: np.concatenate([v & 15, v >> 4])
            equal = (nibbles(x) == nibbles(y)).mean()
            found.append((equal - 1 / 16) / (15 / 16) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(found)) < 0.03


def _cut(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), len(t) - len(kept), sum(1 for r in bytes(gone).split(b"\0") if r), kept))
    return out


def test_substrings_against_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op5_suffix_dedup(spark, sf).collect()}
    ids = list(texts)
    for d, (n, removed, spans, kept) in zip(ids, _cut([texts[d].encode() for d in ids], 400), strict=True):
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_substrings_of_awkward_texts(spark):
    rng = np.random.default_rng(2)
    block = "".join(rng.choice(list("abcdefgh "), 900))
    made = [block, block[100:700], "z" * 30 + block[:450] + "y" * 500, block[:430] + "Q" + block[431:], "ab" * 700, "ab" * 300 + "c" + "ab" * 260, "é" * 450, "x" + "é" * 230, "", block[::-1] + block[200:640] + block[200:640], block, None]
    got = suffix_dedup.cut(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()}
    assert [rows[i] for i in range(len(made))] == _cut([(t or "").encode() for t in made], 400)


def test_substrings_odd_rows(odd, empty):
    got = suffix_dedup.cut(odd).collect()
    want = _cut([(t or "").encode() for _, t, _, _ in ODD if t is None or len(t) < 50_000], 400)
    assert len(got) == len(ODD) and Counter((r.n_bytes, r.n_removed) for r in got if r.n_bytes < 50_000) == Counter(w[:2] for w in want)
    assert suffix_dedup.cut(empty).count() == 0


def test_substrings_in_hot_buckets(spark, monkeypatch):
    """Buckets that are picked out by broadcast give the same result."""
    rng = np.random.default_rng(21)
    passage = "".join(rng.choice(list("abcdefgh "), 900))
    made = ["".join(rng.choice(list("abcdefgh "), 300)) + passage + "".join(rng.choice(list("abcdefgh "), 300)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.cut(df).collect()}
    assert [tuple(rows[i]) for i in range(25)] == [tuple(x) for x in _cut([t.encode() for t in made], 400)]


def test_short_lines_when_asked_for(spark):
    rng = np.random.default_rng(22)
    lines = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(2, 20, 120)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").selectExpr("*", "1 AS _cut_lines", "2 AS line", "3 AS place")

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for least in (16, 9, 3):
        want = {i for i, b in enumerate(lines) if any(a == b or (min(len(a), len(b)) >= least and near(a, b)) for a in lines[:i])}
        kept = line_dedup.dedup_lines(df, least)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(120)) - want


def test_buckets_dealt_over_blocks(spark, monkeypatch):
    """Many documents of one bucket that are no links, with some links among them, in blocks of a few."""
    rng = np.random.default_rng(23)
    base = [f"w{x}" for x in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(60, 6 if i % 3 else 2, replace=False):
            words[k] = f"u{i}_{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 2, 80).collect()}
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 2, 80).collect()} == one
    sets = [minhash.exact_shingles(t.encode(), 2) for _, t in rows]
    root = list(range(120))
    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert one == set(enumerate(root))


@pytest.mark.parametrize(("n", "span"), [(40, 300), (3, 10**9), (30, 20_000)])
def test_common_sizes_against_sets(n, span):
    """Dense products and pair by pair, with sets of very different sizes, an empty one included."""
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, span, k).astype(np.int32)) for k in [0, *rng.integers(1, 6000, n)]]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(1, n + 1), indexing="ij"))
    some = rng.random(len(x)) < 0.7
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(x[some], y[some], strict=True)]
    assert minhash._common(sets, x[some], y[some]).tolist() == want


def test_runs_of_equal_keys_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([], [1, 1, 2], [2, 2], [2, 3], [4])]
    assert [r.column(0).to_pylist() for r in minhash._runs(iter(batches), ["k"])] == [[1, 1], [2] * 4, [3], [4]]
    assert list(minhash._runs(iter([]), ["k"])) == []


def test_compact_windows_against_definition():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, width = int(rng.integers(1, 300)), int(rng.integers(2, 30))
        keys = np.where(rng.random(n) < 0.02, 0, rng.integers(1, 2**40, n) << 24 | np.arange(n)).astype(np.uint64)
        want = []
        for i in np.flatnonzero(keys).tolist():
            a = b = i
            while a > 0 and keys[a - 1] > keys[i]:
                a -= 1
            while b < n - 1 and keys[b + 1] > keys[i]:
                b += 1
            if b - a + 1 >= width:
                want.append((i, max(a, i - width + 1), min(b, i + width - 1)))
        c, left, right = compact_windows.compact(keys, width)
        assert list(zip(c.tolist(), left.tolist(), right.tolist(), strict=True)) == want


def test_passages_cover_all_exact_repeats(spark, sf, texts):
    covered = defaultdict(list)
    for r in queries.op7_compact_windows(spark, sf).collect():
        covered[r.doc_id].append((r.start_word, r.end_word))
        assert r.end_word - r.start_word >= compact_windows.MIN_WORDS and r.similarity >= 0.8
    places = defaultdict(set)
    words = {d: t.lower().split() for d, t in texts.items()}
    for d, w in words.items():
        for i in range(len(w) - 49):
            places[tuple(w[i : i + 50])].add(texts[d])
    for d, w in words.items():
        for i in range(len(w) - 49):
            if len(places[tuple(w[i : i + 50])]) > 1:
                assert any(a <= i and i + 50 <= b for a, b in covered[d]), (d, i)


def test_passages_in_common_and_lines_are_told_apart(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    line, rows = words(14), []
    for _ in range(30):
        passage = words(80)
        near = [*passage[:40], "changed", *passage[41:]]
        rows += [words(60) + p + words(60) for p in (passage, passage, near)]
    rows += [words(70) + line + words(70) for _ in range(30)]
    got = compact_windows.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()
    found = {r.doc_id: r.class_id for r in got}
    assert all(found[d] == d - d % 3 for d in range(90) if d % 3 < 2), "exact repeats are all found"
    assert sum(found.get(d) == d - 2 for d in range(2, 90, 3)) >= 24, "near ones mostly"
    assert max(found) < 90, "a common line is no passage"


def test_short_passages_with_a_changed_word_are_found(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for k in range(200):
        passage, at = words(50), k % 50
        rows += [words(70) + p + words(70) for p in (passage, [*passage[:at], "changed", *passage[at + 1 :]])]
    got = compact_windows.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.class_id == r.doc_id - 1}
    print("recall", len(found) / 200)
    assert len(found) >= 194
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= compact_windows.MIN_WORDS for r in got)


def test_passages_of_two_confirmed_pairs_are_linked(spark):
    rng = np.random.default_rng(9)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for k in range(100):
        passage = words(50)
        edited = [*passage[: k % 50], "changed", *passage[k % 50 + 1 :]]
        rows += [words(70) + p + words(70) for p in (passage, passage, edited, edited)]
    got = compact_windows.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()
    found = {(r.doc_id, r.class_id) for r in got}
    assert all(c // 4 == d // 4 for d, c in found)
    whole = sum(all((4 * k + j, 4 * k) in found for j in range(4)) for k in range(100))
    print("whole", whole)
    assert whole >= 97


def test_passages_that_only_a_linked_one_links(spark, monkeypatch):
    """B is like A, and A like P, which two texts have; B is not like P, with which every shared minimum is compared first."""
    rng = np.random.default_rng(13)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for _ in range(60):
        p = words(60)
        a = [*p[:20], "changed", *p[21:]]
        b = [*a[:40], "again", *a[41:]]
        rows += [words(70) + x + words(70) for x in (p, p, a, b)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = [{(r.doc_id, r.class_id) for r in compact_windows.passages(docs).collect()}]
    monkeypatch.setattr(compact_windows, "SMALL", 1)
    got.append({(r.doc_id, r.class_id) for r in compact_windows.passages(docs).collect()})
    assert got[0] == got[1], "blocks change nothing"
    assert all(c // 4 == d // 4 for d, c in got[0])
    whole = sum(all((4 * k + j, 4 * k) in got[0] for j in range(4)) for k in range(60))
    print("whole", whole)
    assert whole >= 58


def test_passages_beside_a_common_line(spark, monkeypatch):
    """A line that all texts hold does not hide that some go on alike, whichever way failed minima are compared."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    line = words(32)
    rows = []
    for k in range(40):
        more = words(30)
        changed = [*more[: k % 12 + 3], "changed", *more[k % 12 + 4 :]]
        rows += [words(60) + line + m + words(60) for m in (more, changed)]
    rows += [words(60) + line + words(60) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = [{(r.doc_id, r.class_id) for r in compact_windows.passages(docs).collect()}]
    monkeypatch.setattr(compact_windows, "SMALL", 3)
    got.append({(r.doc_id, r.class_id) for r in compact_windows.passages(docs).collect()})
    assert got[0] == got[1], "splitting a key changes nothing"
    assert all(d < 80 and c == d - d % 2 for d, c in got[0])
    print("found", len(got[0]))
    assert len(got[0]) >= 78


def test_links_of_near_copies_do_not_grow_with_their_square(spark, monkeypatch):
    """All near copies of a passage are one class, of links as many as its minima need and not one for each pair."""
    rng = np.random.default_rng(17)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    passage, made, stash = words(60), [], compact_windows.stash

    def counted(df, name):
        out = stash(df, name)
        if name == "near-links":
            made.append(out.count())
        return out

    monkeypatch.setattr(compact_windows, "stash", counted)
    for n in (30, 90):
        rows = [words(70) + [*passage[:k], "changed", *passage[k + 1 :]] + words(70) for k in rng.integers(0, 60, n).tolist()]
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
        found = {r.doc_id for r in compact_windows.passages(docs).collect() if r.class_id == 0}
        assert len(found) >= 0.95 * n
    print("links", made)
    assert made[1] <= 4.5 * made[0]


def test_words_are_those_of_bytes(monkeypatch):
    """The same words as by splitting, in either case and over parts, and hashes that are equal for equal words alone."""
    rng = np.random.default_rng(18)
    signs = list(b"aAbB \t\n\r\x0b\x0c\x1c\x85\xc3\xa9")
    compact_windows._powers.cache_clear()
    monkeypatch.setattr(compact_windows, "_BYTES", 64)
    monkeypatch.setattr(compact_windows, "_LONG", 32)
    for _ in range(100):
        texts = [bytes(rng.choice(signs, n).tolist()) for n in rng.choice([0, 1, 3, 40, 300], 4)] + [b"Q" * int(n) for n in rng.choice([31, 32, 33, 63, 64, 65, 200], 2)]
        parts = [t.lower().split() for t in texts]
        hashes, counts, starts = compact_windows._words(texts)
        assert counts.tolist() == [len(p) for p in parts]
        assert all(starts[i] == sum(map(len, parts[:i])) for i in range(len(texts)))
        names = dict(zip(hashes.tolist(), (w for p in parts for w in p), strict=True))
        assert len(set(names.values())) == len(names) == len({w for p in parts for w in p})
        assert all(names[h] == w for h, w in zip(hashes.tolist(), (w for p in parts for w in p), strict=True))
    compact_windows._powers.cache_clear()
    assert len(compact_windows._words([])[0]) == 0


def test_least_distinct():
    rng = np.random.default_rng(12)
    for _ in range(200):
        x = rng.integers(0, rng.integers(1, 200), rng.integers(1, 95)).astype(np.int32)
        n = compact_windows.MIN_SHINGLES
        want = min(len(set(x[i : i + n].tolist())) for i in range(max(1, len(x) - n + 1)))
        assert compact_windows._least_distinct(x) == want


def test_passages_odd_rows(odd, empty):
    assert compact_windows.passages(odd).where("doc_id in (1, 2, 3, 4, 6)").count() == 0
    assert compact_windows.passages(empty).count() == 0


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = np.random.default_rng(7)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 5000, n)]
    items = [words(40) for _ in range(12)]
    edited = list(items[1])
    for k in (5, 13, 22, 31):
        edited[k] = "other"
    docs = [words(200) + items[0] + words(50), words(90) + edited + words(90), [*words(30), *items[2][:18], *words(60)], words(300), [w.upper() + "," for w in items[3]]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, "too short item"), (98, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (4, 3)}
    assert (got[0, 0].start_word, got[0, 0].end_word, got[0, 0].score) == (200, 240, 1.0) and got[1, 1].start_word == 90
    assert {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()} == {2, 3}


def test_leaks_without_an_id_go_and_short_items_take_nothing_else(spark):
    item, short = "one two three four five six seven eight nine ten eleven twelve", "where is the dog"
    docs = [(None, f"before {item} after"), (None, "a clean text of several words that stays"), (1, "this is the house and that is the garden"), (2, "tell me where is the dog now"), (3, f"x {item}"), (3, "another text with the id of a leak"), (4, None), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _leak", "2 as _id", "3 as n")
    bench = spark.createDataFrame([(1, item), (2, short), (None, None)], "item_id long, text string")
    got = decontaminate.without_leaks(df, bench).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted([("None", docs[1][1]), ("1", docs[2][1]), ("4", ""), ("None", "")])
    assert got[0].asDict().keys() == {"doc_id", "text", "_leak", "_id", "n"}



def test_edited_leaks_beside_an_exact_one(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 5000, n)]
    item = words(40)
    edited = ["other" if k % 6 == 5 else w for k, w in enumerate(item)]
    docs = [words(150) + item + words(150)] + [words(150) + edited + words(150) for _ in range(5)] + [words(150) + item[:4] + words(150) for _ in range(20)]
    docs += [" ".join(docs[1]).split()] * 30  # copies of one text
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {*range(6), *range(26, 56)}
    # The last word of the item that is kept stands at 39: seven blocks, six changed words.
    assert all(got[d].score == pytest.approx((2 * 34 - 6) / 80) and (got[d].start_word, got[d].end_word) == (150, 190) for d in [*range(1, 6), *range(26, 56)])


def test_no_leak_is_lost_to_regular_edits(spark):
    """Edits after every third, fourth or fifth word, of each kind, against aligning every pair at the operator's own level."""
    rng = np.random.default_rng(13)
    common = [f"c{x}" for x in range(40)]
    words = lambda n: [common[int(40 * rng.random() ** 2)] if rng.random() < 0.5 else f"t{x}" for x in rng.integers(0, 3000, n)]
    items = [words(int(n)) for n in rng.integers(4, 60, 25)]
    docs = []
    for item in items:
        for every in (2, 3, 4, 5):
            for kind in range(3):
                edited = []
                for k, w in enumerate(item):
                    edit = k % every == every - 1
                    edited += [["other"], [], [w, "more"]][kind] if edit else [w]
                docs.append(words(int(rng.integers(0, 80))) + edited + words(int(rng.integers(0, 80))))
    docs += [words(100) for _ in range(40)] + [common * 3]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench).collect()}
    hashed = lambda rows: [decontaminate.normal_words([" ".join(w).encode()])[0] for w in rows]
    want = {}
    for d, s in enumerate(hashed(docs)):
        for i, t in enumerate(hashed(items)):
            score = decontaminate.align(s, t)[0] / (2 * len(t))
            if score >= 0.5:
                want[d, i] = score
    assert len(want) > 150 and got == pytest.approx(want)


def _align(s, t):
    best = 0
    h = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
    for i in range(1, len(s) + 1):
        for j in range(1, len(t) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if s[i - 1] == t[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_the_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s, t = rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 15)).astype(np.uint64)
        assert decontaminate.align(s, t)[0] == _align(s.tolist(), t.tolist())


def test_leaks_against_aligning_every_pair(spark, sf, texts):
    bench = dict(queries.table(spark, sf, "benchmark").rdd.map(tuple).collect())
    got = {(r.doc_id, r.item_id): r.score for r in queries.op8_decontamination(spark, sf).collect()}
    norm = lambda t: decontaminate.normal_words([t.encode()])[0]
    docs, items = {d: norm(t) for d, t in texts.items()}, {i: norm(t) for i, t in bench.items()}
    want = {}
    for d, s in docs.items():
        for i, t in items.items():
            if np.isin(t, s).sum() >= 0.5 * len(t) and len(t) >= 4:  # each match needs a word of the item
                score = decontaminate.align(s, t)[0] / (2 * len(t))
                if score >= 0.5:
                    want[d, i] = score
    assert got == pytest.approx(want)


def test_leaks_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same words here same words here same words"), (None, "a text without a number is still a text of ten words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench).collect()}
    assert got == {(5, 1), (None, None)}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench.where("1 = 0")).count() == 0
