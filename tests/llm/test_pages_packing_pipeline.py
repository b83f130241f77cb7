"""HTML extraction, packing, and the pipeline stage by stage."""

import html
import re
import zlib
from collections import defaultdict

import numpy as np

from tests.llm.conftest import ODD
from tidemark.llm import html_extract, minhash, packing, queries
from tidemark.llm.wordtokens import word_bpe


def test_pages_of_known_make(spark, sf):
    """These pages have one article of h1 and p blocks, so plain expressions can cut it out."""
    pages = {r.page_id: r.html for r in queries.table(spark, sf, "pages").collect()}
    for r in queries.op6_html(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_labelled_pages_held_out():
    pages = [html_extract.parse(s) for s in html_extract.labelled_pages(480, seed=11)]
    model = html_extract.learn([html_extract._row(p, [v.label or 0 for v in p.nodes]) for p in pages[:240]])
    right = total = 0
    for p in pages[240:]:
        m = model.marginals(p)
        for node, _ in p.segments:
            right += (m[node] > 0.5) == bool(p.nodes[node].label)
            total += 1
    assert right / total > 0.97


def test_marginals_against_enumeration():
    page = html_extract.parse("<div><p>some text here.</p><ul><li><a href=x>menu</a></li></ul></div><p>more</p>")
    rng = np.random.default_rng(0)
    model = html_extract.TreeModel(rng.normal(size=html_extract.N_OWN), rng.normal(size=html_extract.N_PAIR))
    f, g = html_extract.described(page)
    own, agree, n = f @ model.own, g @ model.pair, len(page.nodes)
    weight = np.zeros(n)
    whole = 0.0
    for mask in range(2**n):
        y = [(mask >> i) & 1 for i in range(n)]
        e = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(agree[i] * (1 if y[i] == y[page.nodes[i].parent] else -1) for i in range(1, n)))
        whole += e
        weight += e * np.array(y)
    assert np.allclose(model.marginals(page), weight / whole)


def test_pages_of_many_makes(spark, sf):
    """Short and long articles in wrappers of every kind, with link lists inside, between menus and footers."""
    model = html_extract.fit(queries.table(spark, sf, "pages"))
    nav = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav>'
    foot = "<footer><p>&copy; 2024 Some Company. All rights reserved.</p></footer>"
    side = '<div class="sidebar"><h3>More</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Other thing</a></li></ul></div>'
    comments = '<section class="comments"><h2>Comments</h2><div class="comment"><p>I read this twice and liked it.</p></div></section>'
    short = ["<p>The river rose in the night and the bridge was closed.</p>", "<p>It opened again on Monday, the town said.</p>"]
    long_ = ["<h1>The bridge</h1>", *(f"<p>{'The river rose in the night, and nobody crossed the bridge number %d. ' % i * 4}</p>" for i in range(6))]
    listed = [*short, '<ul><li><a href="/map">A map of the town</a></li><li><a href="/old">The old bridge</a></li></ul>', "<p>More is known since the morning, when the gates were opened.</p>"]
    wraps = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="wrap">', "</div>"), ("<div>", "</div>"), ('<div class="share-story">', "</div>"), ('<div id="post">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section id="middle">', "</section>"), ('<div class="container"><div class="row">', "</div></div>"), ("<main><article>", "</article></main>")]
    plain = lambda block: [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li)>", block)]
    wrong = []
    for name, blocks in (("short", short), ("long", long_), ("listed", listed)):
        want = "\n".join(x for b in blocks for x in plain(b) if x)
        for a, b in wraps:
            for before, after in ((nav, foot), (nav + side, comments + foot), ("", "")):
                page = f"<html><head><title>t</title></head><body>{before}{a}{''.join(blocks)}{b}{after}</body></html>"
                if model.text(page) != want:
                    wrong.append((name, a, before[:20], model.text(page)[:80]))
    print(len(wrong), "of 90 pages", wrong[:6])
    assert len(wrong) <= 2
    assert model.text(f"<body>{nav}{side}{foot}</body>") == ""


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        page = html_extract.parse("<div>" * n + "<p>text</p>" + "</div>" * n + "</x>" * n)
        took.append(time.perf_counter() - began)
        assert [t for _, t in page.segments] == ["text"] and len(page.nodes) == n + 2
    assert took[1] < 12 * took[0]


def test_parser():
    def segments(source):
        return [t for _, t in html_extract.parse(source).segments]

    assert segments("<p>a<b>b</b> &amp;&nbsp;c<br>d<p>e") == ["ab & c d", "e"]
    assert segments("a < b <!-- <p>no</p> --> c<script>var x='</p>';</script><style>p{}</style>") == ["a < b c"]
    assert segments("<ul><li>x<li>y</ul>z") == ["x", "y", "z"]
    assert segments('<div title="a>b">t</div>') == ["t"]
    assert segments("") == [] and segments("<") == ["<"] and segments("<p title='open>x") == ["x"]


def test_pages_odd_rows(spark):
    model = html_extract.learn([html_extract._row(p, [v.label or 0 for v in p.nodes]) for p in map(html_extract.parse, html_extract.labelled_pages(60))])
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article>" + "<p>Some words of text, again.</p>" * 20_000 + "</article>"), (3, "u", "plain"), (None, "u", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(df, model).collect()
    assert len(got) == 5 and sum(r.text == "" for r in got) >= 2 and max(r.text.count("\n") for r in got) == 19_999
    assert html_extract.extract(df.where("1 = 0"), html_extract.fit(df.where("1 = 0"))).count() == 0


def _check_packing(rows, lengths, capacity):
    """rows: (key, piece, start, length, sequence, offset).  Everything placed once, sequences gapless and in bounds."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for key, piece, start, length, sequence, offset in rows:
        by_key[key].append((piece, start, length))
        by_sequence[sequence].append((offset, length))
    for key, n in lengths.items():
        parts = sorted(by_key[key])
        assert [p for p, _, _ in parts] == list(range(-(-n // capacity))) and sum(x for _, _, x in parts) == n
        assert all(start == piece * capacity for piece, start, _ in parts)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark, sf, texts):
    rows = queries.op9_best_fit_packing(spark, sf).collect()
    encode = word_bpe(queries.tokenizer("word_bpe_49k.json")).tokenizer
    ids = {d: [*encode.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    n = _check_packing([(r.doc_id, r.piece, r.start, r.length, r.sequence_id, r.offset) for r in rows], {d: len(i) for d, i in ids.items()}, 4096)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert n <= _best_fit([min(4096, len(i) - s) for i in ids.values() for s in range(0, len(i), 4096)], 4096)


def _best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plan_equals_sequential_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(1, 60, rng.integers(1, 300)).tolist()
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        placements, opened = packing.plan(counts, 64)
        assert opened == _best_fit(lengths, 64)
        used = defaultdict(list)
        for length, rank, many, first, offset in placements.tolist():
            for k in range(many):
                used[first + k].append((offset, length))
        assert sum(map(len, used.values())) == len(lengths)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64


def test_packing_odd_rows(spark, odd, empty):
    got = packing.pack(odd, queries.tokenizer("word_bpe_49k.json"), 64).collect()
    assert {(r.doc_id, r.piece) for r in got} >= {(1, 0), (2, 0), (None, 0)} and sum(r.doc_id == 5 and r.piece == 0 for r in got) == 2
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[0] != a[0] or b[1] == a[1] + a[2] for a, b in zip(places, places[1:], strict=False)) and max(o + n for _, o, n in places) <= 64
    assert packing.pack(empty, queries.tokenizer("word_bpe_49k.json")).count() == 0


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = queries.table(spark, sf, "documents")
    columns = docs.columns
    sizes, seen = [docs.count()], {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, docs)
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and sizes[-1] <= sizes[-2]
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in seen["quality classifier"][1].collect()}
    assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.9
    before, after = seen["MinHash near-dedup"]
    sets = {r.doc_id: minhash.exact_shingles(r.text.encode(), 5) for r in before.collect()}
    left = {r.doc_id for r in after.collect()}
    for a in left:
        for b in left:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                assert 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    assert sizes[-1] > 0
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == sizes[-1]


def test_odd_documents_through_the_pipeline(spark, odd, sf):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", odd["n_chars"].cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame((out := stage(spark, docs, sf)).collect(), out.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    lengths = docs.groupBy("sequence_id").sum("length").collect()
    assert "sequence_id" in docs.columns and all(r[1] <= 4096 for r in lengths) and docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_short_and_bare_articles(spark):
    """A single short paragraph, bare sentences with line breaks, an empty table, and pages of clutter alone."""
    nav = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
    foot = "<footer><p>&copy; 2024 Some Company. All rights reserved.</p></footer>"
    bodies = ['<div class="wrap"><p>Short note of one line.</p></div>', '<div id="c"><h1>Title of it</h1>First sentence here.<br><br>Second sentence there.</div>', "<p>Only.</p>", "<div>Bare text alone</div>", ""]
    want = ["Short note of one line.", "Title of it\nFirst sentence here. Second sentence there.", "Only.", "Bare text alone", ""]
    pages = spark.createDataFrame([(i, "u", f"<html><body>{nav}{b}{foot}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    model = html_extract.fit(pages)
    assert [r["text"] for r in html_extract.extract(pages, model).orderBy("page_id").collect()] == want
    none = pages.where("page_id > 100")
    assert html_extract.extract(none, html_extract.fit(none)).collect() == []
