"""Language labels, page texts and neighbours against brute force and fixed cases."""

import html
import time
import re

import numpy as np
import pytest

from metaquarry.llm import html_text, lang_crf, permutation_index
from tests.llm import edge

SF = "/root/testdata/sf0.01"
F = edge.F


def test_chunked_posteriors_are_exact():
    rng = np.random.default_rng(0)
    for n in (1, 4):
        sizes = np.array([1, 0, 32, 33, 100, 34, 31])
        e, moves = rng.normal(size=(sizes.sum(), n)) * 3, rng.normal(size=(n, n))
        got, at = lang_crf.posteriors(e, sizes, moves), 0
        for s in sizes:
            if s:
                want, _ = lang_crf._forward_backward(e[None, at : at + s], moves)
                assert np.allclose(want[0], got[at : at + s])
            at += s


def test_held_out_accuracy(spark):
    import zlib

    rows = lang_crf.op9(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 150
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in unseen]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_awkward_rows(spark):
    docs = edge.documents(spark)
    model = lang_crf.fit(docs.filter("doc_id is not null"), "doc_id", "text", "lang")
    out = lang_crf.identify(docs, "text", model).select("doc_id", "text", "found.*").collect()
    assert len(out) == len(edge.ROWS)
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    none = lang_crf.fit(docs.limit(0), "doc_id", "text", "lang")
    assert none.languages == []
    assert {r["lang_pred"] for r in lang_crf.identify(docs, "text", none).select("found.*").collect()} == {"und"}
    assert lang_crf.identify(docs.limit(0), "text", model).count() == 0


def test_words_of_mixed_text_are_labelled():
    texts = ["the house and the garden with that", "le jardin et la maison avec une", "der garten und das haus mit"] * 30
    model = lang_crf.train(texts, ["en", "fr", "de"] * 30)
    marginals, _ = lang_crf.Labeller(model).words(["the garden and that le jardin avec une maison"])
    assert [model.languages[k] for k in marginals.argmax(1)] == ["en"] * 4 + ["fr"] * 5


PAGE = """<body class=x><div class="has-sidebar"><header><h1>Site</h1></header><nav>m</nav>
<div id="cookieNotice">We use</div><article class=post><header><h1>T &amp; x</h1><p>by me</p></header>
<p>One <a href="x">li&nbsp;nk</a> t<br>wo<ul><li>a<li>b</ul><aside>no</aside><div class="ad">buy</div>
<form><input></form><section id=comments><article class="comment">hi</article></section><p>end &lt;p&gt;
<script>if (a < b) "</p>"</script></article><div class=sidebar>s</div></div><footer>f</footer>"""


@pytest.mark.parametrize(
    "page,want",
    [
        (PAGE, "T & x\n\nOne li nk t wo\n\na\n\nb\n\nend <p>"),
        ("", ""),
        ("plain &amp; <b>bold</b>", "plain & bold"),
        ("<main><div class=menu>m</div><p>a</p>b<div>c</div></main><p>x</p>", "a\n\nb\n\nc"),
        ("<div><p>a<p>b</div><div role=navigation>n</div><div hidden>h</div>", "a\n\nb"),
        ("<title>t</title><p>a &#x41;&#66; <i>c</i>d", "a AB cd"),
        ("<article><p>one</article><article><p>two</article>", "one\n\ntwo"),
        ('<p title="a>b">x</p><!-- <p>no</p> --><style>p{}</style><p>y', "x\n\ny"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>d\n e</pre></article>", "a\n\nb\n\nc\n\nd e"),
        ("<b>" * 3000 + "deep", "deep"),
    ],
)
def test_page_structure(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=it's>One</p><p title=it's>Two</p>", "One\n\nTwo"),
        ("<p title='a>b'>One</p><p title=\"it's > 'x'\">Two</p>", "One\n\nTwo"),
        ("<p title=\"One</p><p>Two</p>", "Two"),
        ("<article><p class='tags'>A</p><h2 id='search-engines'>B</h2><p class=social>C</p><p class='teaser'>D</p></article>", "A\n\nB\n\nC\n\nD"),
        ("<div><div class='social'>gone</div><p>stays</p></div>", "stays"),
        ("<p>a < b and <3 hearts </ p> x</p><p>c", "a < b and <3 hearts </ p> x\n\nc"),
        ("<p>one</i></b> two</p><p>three <b>bold<p>four</b></p>", "one two\n\nthree bold\n\nfour"),
        ("<p>x<!-- <p>no</p> --><![CDATA[ y ]]></p>", "x y"),
        ("<p>x<a href=/b/>y</a></p>", "xy"),
        ("<!DOCTYPE html><p>x</p><!-- open", "x"),
    ],
)
def test_stray_quotes_and_names(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 100_000,
        "<b>" * 100_000 + "</i>" * 100_000 + "text",
        "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
        '<a x=">"' * 100_000,
        "<p title='" * 100_000,
        "<div>" * 100_000 + "</span>" * 50_000,
        "<" * 200_000,
        "<![CDATA[" * 50_000,
        "&" * 200_000,
        "<li>" * 100_000,
        "</p>" * 100_000,
    ],
)
def test_no_page_takes_long(page):
    start = time.time()
    html_text.page_hashes(page)
    assert time.time() - start < 5


def test_site_template_goes(spark):
    rows = [
        (i, f"http://h.org/{i}", f"<article><h1>T{i}</h1><p>text {i}</p><div>Read our <b>other</b> news</div></article>")
        for i in range(20)
    ]
    rows += [(100 + i, f"http://g.org/{i}", "<article><p>the same story</p></article>") for i in range(5)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://h.org/0", rows[0][2]), (None, "http://h.org/z", "<p>z")]
    rows += [(200, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in edge.CLASHES if c != "text"}
    )
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages, "page_id", "url", "html").collect()}
    assert got[3] == "T3\n\ntext 3" and got[202] == "T0\n\ntext 0"
    assert got[100] == "the same story"  # too few pages to be a template
    assert got[200] == got[201] == "" and got[None] == "z"
    out = html_text.extract_text(pages, "page_id", "url", "html")
    assert out.count() == len(rows)
    assert html_text.extract_text(pages.limit(0), "page_id", "url", "html").count() == 0


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.op10(spark, "/root/testdata/sf0.001").collect()}
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [
            re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", "\n")))).strip()
            for x in re.split(r"</?(?:p|h1)>", inner)
        ]
        assert got[p["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def brute_nearest(rows, k, every):
    """Query to its k nearest by inner product, ties to the smaller id; every row is one."""
    good = [
        (i, np.array(v, np.float64))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for own, (q, vector) in enumerate(good):
        if q % every == 0:
            near = [(-float((vector * v).sum()), i) for at, (i, v) in enumerate(good) if at != own and len(v) == len(vector)]
            out.setdefault(q, []).extend((rank, i, -s) for rank, (s, i) in enumerate(sorted(near)[:k]))
    return {q: [(i, s) for _, i, s in sorted(found)] for q, found in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"], r["vec_id"], r["score"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_neighbours_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [
        (200, None), (220, [0.0] * 5), (240, [1.0, None, 1.0, 1.0, 1.0]), (260, [float("nan")] * 5), (280, []),
        (300, [float("inf")] + [1.0] * 4), (320, [100.0] * 5), (340, [1.0, 2.0]), (360, [2.0, 1.0]), (None, [1.0] * 5),
    ]
    rows += [rows[0], rows[20], (40, rows[7][1]), (1, rows[8][1])]  # repeated ids, with other vectors too
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(1) for c in edge.CLASHES}
    )
    out = permutation_index.nearest(df, "vec_id", "embedding", lambda i: i % 20 == 0)
    got, want = found(out), brute_nearest(rows, 20, 20)
    assert got.keys() == want.keys()
    for q in want:  # slices this small are reranked in whole
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    assert permutation_index.nearest(df.limit(0), "vec_id", "embedding", lambda i: i % 20 == 0).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = found(permutation_index.op4(spark, sf))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 20, 20)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert len(got) == len(want) and np.mean(hits) >= 0.9


def test_several_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SLICE_ROWS", 40)
    monkeypatch.setattr(permutation_index, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(permutation_index.nearest(df, "vec_id", "embedding", lambda i: i % 20 == 0))
    want = brute_nearest(rows, 20, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
