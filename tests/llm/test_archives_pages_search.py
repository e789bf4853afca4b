"""WARC archives, main text of pages, top-k search, the pipeline."""
import base64
import hashlib
import random

import numpy as np
import pytest

from domainlab.llm import balltree, files, htmldom, htmlpages, htmltree, warc
from domainlab.session import scratch_path, ship_package


def test_warc_round_trip(spark):
    ship_package(spark)
    big = "".join(random.Random(1).choices("abcdef <>", k=300_000))
    rows = [(1, "http://a/", "<p>x</p>", "q"), (2, None, "<p>x</p>", "q"), (3, "http://c/ d", None, "q"), (4, "u", "", "q"),
            (5, "u", big, "q"), (6, "u", big, None), (None, "u", "<p>x</p>", "q"), (7, "u", "é" * 10, "q"), (7, "u", "é" * 10, "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string").repartition(3)
    folder = scratch_path(spark, "warc-test")
    written = warc.write(df, folder)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(written).collect()}
    assert got == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None),
                   (6, "revisit", 5), (None, "revisit", 1), (7, "response", None)}
    full = [r for r in warc.read(written, payload=True).collect()]
    assert len(full) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in full:
        body = html[r["page_id"]]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == body
    for r in written.collect():
        with files.open_file(r["path"]) as f:
            assert f.read(4) == (0x184D2A5D).to_bytes(4, "little")
    assert warc.round_trip(df.limit(0)).collect() == []
    least = warc.read(warc.write(df, scratch_path(spark, "warc-test"), least=100)).collect()
    assert {r["page_id"] for r in least if r["record_type"] == "revisit"} == {6}


def test_parser():
    def blocks(p):
        return [n.text for n in htmldom.parse(p) if n.text is not None]

    assert blocks("<p>a <b>b</b>\n c<br>d<p>e&amp;f</p><ul><li>x<li>y</ul>tail") == ["a b c d", "e&f", "x", "y", "tail"]
    assert blocks("<p>x<!-- <p>no</p> -->y<script>var t='</p>'</script>z</p>") == ["xyz"]
    assert blocks("<div>open <p>cut off &am") == ["open", "cut off &am"]
    assert blocks(None) == blocks("") == []
    assert len(htmldom.parse("<div>" * 3000 + "x")) == 3002


def test_formulas_and_fallback_text_reach_the_model():
    def blocks(p):
        return [n.text for n in htmldom.parse(p) if n.text is not None]

    assert blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    for tag in ("noscript", "iframe", "object", "audio", "video", "canvas"):
        assert blocks(f"<p>a <{tag}>b <i>c</i></{tag}> d</p>") == ["a b c d"]
        assert tag not in htmldom.SILENT
    page = ("<body><nav><a href=/>Home</a></nav><article><h1>A title of some length</h1><p>The first sentence is here. "
            "It follows that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, and that is all there is to it.</p>"
            "<p>A second paragraph, with more words in it, ends the article. Nothing else is said.</p></article></body>")
    assert "It follows that x=2 holds" in htmltree.trained().texts([page])[0]
    long = htmldom.parse("<footer>" + "All rights reserved by us. " * 10 + "© 2020</footer>")
    assert htmltree.FEATURES.index("copyright") in htmltree.features(long)[-1]


def test_stray_quotes_in_tags():
    def blocks(p):
        return [n.text for n in htmldom.parse(p) if n.text is not None]

    assert blocks("<p title=Bob's>One paragraph, it's here.</p>") == ["One paragraph, it's here."]
    assert blocks('<a href="x"">Read "this" now</a>') == ['Read "this" now']
    assert blocks("<p \"a>b's</p><p =\">c\"</p>") == ["b's", 'c"']
    assert blocks("<p title = 'a>b' data-x=\"c>'d\">x</p>") == ["x"]
    assert blocks("<p>x<a href='cut off") == ["x"]


ARTICLE = ("<article><h1>The village in the hills</h1><p>This is the first full paragraph of the article, with some words.</p>%s"
           "<p>And here is the second paragraph, which ends the story.</p></article>")
FIRST, LAST = ("The village in the hills\nThis is the first full paragraph of the article, with some words.",
               "And here is the second paragraph, which ends the story.")
SITE = ('<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>%s'
        "<footer>&copy; me</footer></body></html>")
ONE_LINK = '<p><a href="/x">Read the whole story of the village on our other site, with pictures.</a></p>'
SOURCES = '<ul><li><a href="/1">First source of the story</a></li><li><a href="/2">Second source, longer</a></li></ul>'
READ = "Read the whole story of the village on our other site, with pictures."


@pytest.mark.parametrize("page,inside", [
    (SITE % (ARTICLE % ONE_LINK), READ), (ARTICLE % ONE_LINK, READ),
    (SITE % (ARTICLE % SOURCES), "First source of the story\nSecond source, longer"),
    (ARTICLE % SOURCES, "First source of the story\nSecond source, longer"),
    (SITE % (ARTICLE % '<h2><a href="/k">A linked heading</a></h2>'), "A linked heading"),
    (SITE % ('<div class="content">' + ARTICLE % ONE_LINK + '</div><aside><ul><li><a href="/q">Other</a></li></ul></aside>'), READ),
    ("<script>var a;</script type='x'>" + ARTICLE % "", None), ("<!-->" + ARTICLE % "", None), ("<!--->" + ARTICLE % "", None),
    ("<!-- x --!>" + ARTICLE % "", None), (ARTICLE % "<template><p>one</p><template>in</template><p>leak</p></template>", None)])
def test_pages_written_by_hand(page, inside):
    """Mark-up that must not swallow the article, and article blocks that are links."""
    assert htmltree.trained().texts([page]) == ["\n".join([FIRST, *([inside] if inside else []), LAST])]


def test_short_and_bare_pages():
    m = htmltree.trained()
    assert m.texts([SITE % f"<article>{ONE_LINK}<p>Short note on it.</p></article>"]) == [READ + "\nShort note on it."]
    bare = "This is a page of bare text without any tag at all, of some words."
    assert m.texts([bare]) == [bare]


def test_stray_end_tags_take_no_search():
    import time
    t = time.process_time()
    htmldom.parse("<b>" * 100_000 + "</i>" * 100_000 + "x")
    htmldom.parse("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "<div></div>" * 20_000)
    assert time.process_time() - t < 5


def test_very_long_page():
    text = "word, " * 200_000 + "end."
    assert htmltree.trained().texts([SITE % f"<article><h1>Title of it</h1><p>{text}</p></article>"]) == ["Title of it\n" + text]


def test_marginals_are_exact():
    nodes = htmldom.parse("<body><nav><a>m</a></nav><article><h1>t</h1><p>one. two.</p></article></body>")
    f = htmltree.Forest([nodes])
    r = np.random.RandomState(0)
    w, pair = r.randn(htmltree.N_FEATURES), r.randn(2, 2, 2)
    own = np.bincount(f.row, weights=w[f.feature], minlength=f.n)
    z, p1 = 0.0, np.zeros(f.n)
    for i in range(1 << f.n):
        y = [i >> k & 1 for k in range(f.n)]
        e = np.exp(sum(own[k] * y[k] for k in range(f.n))
                   + sum(pair[f.kind[k], y[f.parent[k]], y[k]] for k in range(f.n) if f.parent[k] >= 0))
        z += e
        p1 += e * np.array(y)
    p, joint = f.marginals(w, pair)
    assert np.allclose(p, p1 / z)
    assert np.allclose(joint.sum(axis=(1, 2)), 1) and np.allclose(joint[:, :, 1].sum(axis=1), p[f.child])


def test_held_out_pages():
    model, wrong, n = htmltree.trained(), 0, 0
    for k in range(200):
        page, mark = htmlpages.page(50_000_000 + k)
        nodes = htmldom.parse(page)
        want = [x.text for x, y in zip(nodes, htmlpages.labels(nodes, mark)) if y and x.text]
        got = model.texts([page.replace(mark, "")])[0].split("\n")
        wrong += len(set(want) ^ {g for g in got if g})
        n += len(set(want))
    assert wrong < 0.06 * n


def test_extract(spark):
    ship_package(spark)
    page = ('<html><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy this.</div><article><h1>Title &amp; more</h1>'
            "<p>First  line\nhere.</p><p><b>Second line, of words.<br></article><section id='comments'><p>I like it. Good.</p></section>"
            "<form><p>Write to us.</p></form><footer>&copy; me</footer>")
    rows = [(1, "u", page, 3), (2, None, None, 3), (3, "u", "", 3), (3, "u", "", 3), (None, "u", page * 1, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in htmltree.extract(df, htmltree.trained()).collect()}
    text = "Title & more\nFirst line here.\nSecond line, of words."
    assert got == {(1, "u"): (text, len(text)), (None, "u"): (text, len(text)), (2, None): ("", 0), (3, "u"): ("", 0)}
    assert htmltree.extract(df.limit(0), htmltree.trained()).collect() == []


@pytest.mark.parametrize("shard_rows,block_rows", [(50, 4), (1000, 1000)])
def test_top_k(spark, shard_rows, block_rows):
    ship_package(spark)
    r = np.random.RandomState(3)
    rows = [(i, r.randn(8).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(1, 100)] + [(501 + i, rows[0][1], 0) for i in range(20)]
    rows += [(5, rows[5][1], 0)] + [(301, rows[0][1], 0)] * 3
    rows += [(900, None, 0), (901, [1.0] * 7 + [None], 0), (902, [float("nan")] * 8, 0), (903, [float("inf")] * 8, 0),
             (None, [9.0] * 8, 0), (1000, [2.0, 3.0], 0), (1001, [-1.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = balltree.top_k(df, df.where("vec_id % 100 = 0"), shard_rows=shard_rows, block_rows=block_rows)
    v = [(i, np.floor(1024 * np.array(e)).astype(int)) for i, e, _ in rows
         if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    want = []
    for q, e in v:
        if q % 100 == 0:
            best = sorted(((-int(e @ x), i) for i, x in v if i != q and len(x) == len(e)))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    # repeated rows are candidates each, as in the query's SQL
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted(want)
    assert balltree.top_k(df.limit(0), df.limit(0)).collect() == []


def test_shared_scores_spare_leaves():
    """Eight shards in waves of 1, 1, 2 and 4: the fewer leaves a shard costs, the later it comes."""
    r = np.random.RandomState(4)
    x, ids = np.floor(1024 * r.randn(8 * 2048, 6)), np.arange(8 * 2048)
    trees = [balltree.BallTree.from_bytes(balltree.BallTree(x[s::8]).to_bytes(ids[s::8])) for s in range(8)]
    per_shard = np.zeros(4)
    for q in range(0, 400, 20):
        best = []
        for w, wave in enumerate([[0], [1], [2, 3], [4, 5, 6, 7]]):
            floor = best[9][0] if len(best) >= 10 else None
            for s in wave:
                tree, own = trees[s]
                tree.visited = 0
                best += tree.search(x[q], own, q, 10, floor)
                per_shard[w] += tree.visited / len(wave)
            best = sorted(best, key=lambda t: (-t[0], t[1]))[:10]
        score = x @ x[q]
        score[q] = -np.inf
        assert [i for _, i in best] == sorted(range(len(x)), key=lambda i: (-score[i], i))[:10]
    assert per_shard[0] > per_shard[1] > per_shard[2] > per_shard[3], per_shard


def test_pipeline(spark):
    import corpus_pipeline as C
    from domainlab.llm import dartminhash, linecrf, mixing

    sf = "/root/testdata/sf0.001"
    out = C.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = linecrf.drop_low_quality(docs, linecrf.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    first = {r["class_id"] for r in dartminhash.classes(kept).collect()}
    copies = {r["doc_id"]: r["mix"]["copies"] for r in mixing.mix(kept.where(kept.doc_id.isin(list(first)))).collect()}
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(got) == sorted(d for d, n in copies.items() for _ in range(n))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded"] == texts[r["doc_id"]] for r in out.collect())
