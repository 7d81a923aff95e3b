"""Main text of pages, and the quality model's held-out accuracy."""

import random

import pytest

from revledger.llm import html_extract as hx
from revledger.llm import quality_model as qm
from revledger.session import read_table
from tests.conftest import SMALL
from tests.llm.conftest import documents, prose

PAGES = "page_id long, url string, html string, key string, host string, n long, lines string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], PAGES)


FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><header><h1>Head &amp; tail</h1></header><p>One<br>two &lt;3
  <b>bold</b>text<p>Next &copy; &#233; <script>var x="</p>";</script>end</p><ul><li>item</li></ul>
<form><p>Name</p></form><aside>See also</aside><div id="comments"><p>First!</p></div></article>
<div role="complementary">side</div><footer>Foot</footer></body></html>"""


def test_article_only():
    assert [t for t, _ in hx.blocks(FULL)] == ["Head & tail", "One two <3 boldtext", "Next © é end", "item"]


@pytest.mark.parametrize("html,want", [
    (None, []), ("", []), ("plain words", ["plain words"]), ("<p>a<p>b</div></p>c", ["a", "b", "c"]),
    ("<nav><p>x", []), ("<div><nav>x</div><p>y", ["y"]), ("<p hidden>x</p><p>y", ["y"]),
    ("<p>a&nbsp;&nbsp;b\t\nc</p>", ["a b c"]), ("<p>1 < 2 &amp; 3</p>", ["1 < 2 & 3"]),
    ("<!-- c --><p>x<!-- y -->z</p><![CDATA[q]]>", ["xz"])])
def test_blocks(html, want):
    assert [t for t, _ in hx.blocks(html)] == want


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_longest():
    r = random.Random(3)
    for _ in range(400):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        x, y = hx.common_lines(a, b)
        assert len(x) == len(y) == lcs(a, b)
        assert [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)]


@pytest.mark.parametrize("bits", [1 << 29, 40])
def test_alignment_of_halves_is_longest(bits, monkeypatch):
    monkeypatch.setattr(hx, "_ROW_BITS", bits)
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.randrange(r.choice([2, 9])) for _ in range(r.randrange(30))] for _ in range(2))
        x, y = hx.common_lines(a, b)
        assert len(x) == len(y) == lcs(a, b)
        assert [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)]


def test_many_equal_lines_are_quick():
    import time

    start = time.time()
    x, y = hx.common_lines([1] + [7] * 50_000 + [2], [3] + [7] * 40_000 + [4])
    assert len(x) == len(y) == 40_000
    x, _ = hx.common_lines([5] + [7, 8] * 10_000, [6] + [8, 7] * 10_000)
    assert len(x) == 19_999
    assert time.time() - start < 20


@pytest.mark.parametrize("html,want", [
    ("<article><section id='related-work'><p>a</p></section><section id='search-algorithms'>b</section>"
     "<p class='ad-hoc'>c</p><h2 id='legal-search'>d</h2><h3 id='comments'>e</h3></article>", ["a", "b", "c", "d", "e"]),
    ("<article><ul><li class='share'>x<li>y<li>z</ul><p>p</p></article>", ["y", "z", "p"]),
    ("<article><dl><dt class='ad'>x<dd>y</dl><table><tr><td class='ad'>x<td>y<tr class='ad'><td>x<tr><td>z</table>"
     "<p class='ad'><b>x<p>q</article>", ["y", "y", "z", "q"]),
    ("<ul><li>a<ul><li class='ad'>x</ul><li>b</ul>", ["a", "b"]),
    ("<article>small</article><main><p>the main text</p><article>inner</article></main><article>t</article>",
     ["the main text", "inner"]),
    (f"<article>teaser</article><div><p>{'long words ' * 30}</p></div>", ["teaser", ("long words " * 30).strip()]),
    ("<div class='site-footer'>x</div><div class='cookie-notice'>x</div><div id='left-sidebar'>x</div>"
     "<div class='ad-slot-1'>x</div><div class='ad_banner top'>x</div><p>y</p>", ["y"]),
    ("<article><div class='comments'>x</div><div id='comments'>x</div><p>y</p></article>", ["y"])])
def test_only_whole_names_and_siblings(html, want):
    assert [t for t, _ in hx.blocks(html)] == want


MENU = "".join(f"<div>Menu entry number {i} of ours</div>" for i in range(6))


def test_heavy_frames_go(spark):
    """More frame than text, and neighbours that are copies of each other."""
    own = [f"own words of page {i} are {prose(i, 4)}" for i in range(30)]
    rows = [(i, f"http://h.org/{i:03}", f"{MENU}<div>{own[i]}</div>") for i in range(30)]
    news = [" ".join(prose(700 + i, 60).split()) for i in range(3)]
    for n in range(3):
        rows += [(100 + 10 * n + i, f"http://n.org/{n}/{i}", f"{MENU}<p>{news[n]}</p>") for i in range(4)]
    near = f"<p>{news[0]}</p><p>{news[1]}</p>"
    rows += [(200 + i, f"http://c.org/{i}", f"{near}<p>edit {i}</p>") for i in range(3)]
    out = {r["page_id"]: r["text"] for r in hx.extract(pages(spark, rows)).collect()}
    assert [out[i] for i in range(30)] == [" ".join(t.split()) for t in own]
    assert all(out[100 + 10 * n + i] == news[n] for n in range(3) for i in range(4))
    assert all(out[200 + i] == f"{news[0]}\n\n{news[1]}\n\nedit {i}" for i in range(3))


def frame(i):
    return (f"<div><p>Welcome to our site</p><p>Call us today</p><p>{prose(i, 40)}</p><p>{prose(i + 500, 30)}</p>"
            "<p>All rights kept by us</p></div>")


def test_differencing_deletes_what_neighbours_share(spark):
    rows = [(i, f"http://h.org/a/{i:04}", frame(i)) for i in range(150)]
    rows += [(900, "http://other.org/x", frame(3)), (901, "http://h.org/zz", "<p>Only page of its kind</p>")]
    rows += [(902, "http://twin.org/a", frame(7)), (903, "http://twin.org/b", frame(7))]
    out = {r["page_id"]: r for r in hx.extract(pages(spark, rows)).collect()}
    for i in range(150):
        want = [" ".join(prose(i, 40).split()), " ".join(prose(i + 500, 30).split())]
        assert out[i]["text"] == "\n\n".join(want) and out[i]["n_chars"] == len(out[i]["text"])
    assert out[900]["text"].startswith("Welcome")      # no neighbour on its host
    assert out[901]["text"] == "Only page of its kind"
    assert out[902]["text"] == out[903]["text"] and out[902]["text"].startswith("Welcome")  # copies


def test_declared_main_text_is_kept(spark):
    rows = [(i, f"http://h.org/{i}", f"<p>Menu words</p><article><p>Same start</p><p>{prose(i, 30)}</p></article>")
            for i in range(5)]
    assert all(r["text"].startswith("Same start\n\n") for r in hx.extract(pages(spark, rows)).collect())


def test_html_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, None, "<p>x"), (3, "no scheme", "<p>y"), (3, "no scheme", "<p>y"),
            (4, "http://u:p@H.org:80/A?b#c", "<p>" + "long " * 200_000 + "</p>"), (5, "http://h.org/a", "<" * 1000)]
    out = hx.extract(pages(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[1]["text"] == "" and by[2]["text"] == "" and by[3]["text"] == "y" and by[4]["n_chars"] == 999_999
    assert hx.extract(pages(spark, [])).collect() == []
    assert hx.url_parts("http://u:p@H.org:80/A/?b#c") == ("h.org", "a")


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, text string")


def noisy(seed):
    return " ".join(w + random.Random(f"{seed}{i}").choice(["###", "$$$", "&&&"])
                    for i, w in enumerate(prose(seed, 60).split()))


def auc(pairs):
    good, bad = ([s for s, y in pairs if y == q] for q in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    rows = [(i, noisy(i) if i % 4 == 0 else prose(i, 60), "s") for i in range(600)]
    docs = documents(spark, rows)
    model = qm.fit(docs, labels(spark, [(i, int(i % 4 != 0), 0) for i in range(600)]))
    out = qm.score(docs, model).withColumn("h", qm.held_out()).collect()
    held = [(r["score"], int(r["doc_id"] % 4 != 0)) for r in out if r["h"]]
    assert 60 < len(held) < 180 and auc(held) > 0.95
    assert sum((s >= qm.THRESHOLD) == bool(y) for s, y in held) / len(held) > 0.9


def test_held_out_labels_are_never_used(spark):
    rows = [(i, noisy(i) if i % 4 == 0 else prose(i, 60), "s") for i in range(300)]
    docs = documents(spark, rows)
    marked = docs.select("doc_id").withColumn("h", qm.held_out()).collect()
    held = {r["doc_id"] for r in marked if r["h"]}
    right = [(i, int(i % 4 != 0), 0) for i in range(300)]
    wrong = [(i, 1 - q if i in held else q, t) for i, q, t in right]
    assert qm.fit(docs, labels(spark, right)) == qm.fit(docs, labels(spark, wrong))


def test_accuracy_on_the_given_labels(spark):
    docs, lab = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(
        spark, "/root/testdata/sf0.01", "labels")
    out = qm.score(docs, qm.fit(docs, lab)).withColumn("held", qm.held_out())
    pairs = out.join(lab, "doc_id").filter("held").select("score", "quality").collect()
    assert auc([tuple(p) for p in pairs]) > 0.85


@pytest.mark.parametrize("quality", [[], [1, 1, 1], [0, 0], [None, 1]])
def test_labels_of_one_kind(spark, quality):
    docs = documents(spark, [(i, prose(i, 20), "s") for i in range(5)])
    out = qm.score(docs, qm.fit(docs, labels(spark, [(i, q, 0) for i, q in enumerate(quality)]))).collect()
    assert len({r["score"] for r in out}) == 1 and 0 < out[0]["score"] < 1


def test_quality_odd_rows(spark, odd_rows):
    docs = documents(spark, odd_rows)
    model = qm.fit(docs, labels(spark, [(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (8, 0, 0), (8, 1, 1)]))
    out = qm.score(docs, model).collect()
    assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert qm.score(documents(spark, []), qm.fit(documents(spark, []), labels(spark, []))).collect() == []
    assert SMALL


def test_scores_do_not_depend_on_the_sample_size(spark):
    rows = [(i, prose(i, 60) + (" " + prose(i % 7, 8) if i % 6 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 6 > 0)) for i, _ in rows], "doc_id long, quality int")
    means = []
    for size in (40, 10_000):
        model = qm.fit(docs, known, sample_docs=size)
        means.append(sum(r["score"] for r in qm.score(docs, model).collect()) / len(rows))
    assert abs(means[0] - 5 / 6) < 0.1 and abs(means[1] - 5 / 6) < 0.1


def test_frames_go_behind_any_number_of_copies(spark):
    """Long rows of near copies on either side; a page with only copies in
    reach is led to the page behind them."""
    news = [" ".join(prose(800 + i, 90).split()) for i in range(3)]
    rows = [(1000 * n + i, f"http://n.org/{n}/{i:03}", f"{MENU}<p>{news[n]}</p><p>edit {n} {i}</p>")
            for n in range(3) for i in range((40, 1, 25)[n])]
    out = {r["page_id"]: r["text"] for r in hx.extract(pages(spark, rows)).collect()}
    assert len(out) == 66
    assert all(t == f"{news[k // 1000]}\n\nedit {k // 1000} {k % 1000}" for k, t in out.items())


def test_frame_beside_declared_text_goes_from_neighbours(spark):
    """A neighbour that declares its main text shows the frame as any other."""
    own = [" ".join(prose(900 + i, 60).split()) for i in range(4)]
    rows = [(i, f"http://m.org/{i}", f"{MENU}<{tag}>{own[i]}</{tag}>") for i, tag in enumerate(("article", "p", "article", "p"))]
    out = {r["page_id"]: r["text"] for r in hx.extract(pages(spark, rows)).collect()}
    assert [out[i] for i in range(4)] == own
