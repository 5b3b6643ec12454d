import re
from collections import defaultdict

import pytest

from cairn.llm import html_text as H


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; &amp; more", "plain <text> & more"),
        ("<p>a<p>b<br>c<div>d</div>e", "a\n\nb c\n\nd\n\ne"),
        ("<body><nav><p>menu</p></nav><article><h1>T</h1><p>x <b>y</b>\n z</p></article><footer>f</footer>", "T\n\nx y z"),
        ("<article><header><h1>T</h1></header><p>a</p><div class='comments'><p>c</p></div><aside>s</aside></article>", "T\n\na"),
        ("<div class=\"ad\">x</div><main><p>m</p><form>q</form></main><div>z</div>", "m"),
        ("<script>var t='</p><p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<p title='a>b'>ok</p><div class='side-bar sidebar'>no</div><div id=cookie-notice>no</div>", "ok"),
        ("<p title=it's>a</p><p id='b'>b</p>", "a\n\nb"),
        ("<div class='overflow-hidden'><p>a</p></div><div hidden>b</div><div hidden=until-found>c</div>", "a\n\nc"),
        ("<article class='post comments-open'>a</article><article class='comment'>b</article>", "a"),
        ("<p><b>bold<br><p>next</b> on</p>", "bold\n\nnext on"),
    ],
)
def test_extract(source, want):
    assert H.extract(source or "") == want


def test_template_subtrees_are_deleted(spark):
    same = "<div><p>Our site since 1999</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{same}<div><p>page {i} text</p></div></body>") for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body>{same if i == 0 else ''}<p>other {i}</p></body>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
    assert out[3] == "page 3 text" and out[100] == "Our site since 1999\n\nother 0" and out[105] == "other 5"


def test_template_subtrees_inside_articles_are_deleted(spark):
    same = "<div><p>Follow us everywhere</p></div>"
    often = lambda i: "<p>A line of some pages</p>" if i % 4 == 0 else ""
    book = "<div class=box><p>Buy our book now</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<article><p>page {i}</p>{often(i)}{same}</article>") for i in range(40)]
    rows += [(100 + i, f"http://b.example/{i}", f"<main>{same}<p>page {i}</p></main>") for i in range(12)]
    rows += [(200 + i, f"http://c.example/{i}", f"<article><p>page {i}</p>{book}</article>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
    assert out[203] == "page 3" and out[3] == "page 3" and out[4] == "page 4\n\nA line of some pages" and out[105] == "page 5"


def test_templates_of_some_layouts_are_deleted(spark):
    same = "<div><p>Opening hours of the shop</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{same if i % 5 < 2 else ''}<p>page {i}</p></body>") for i in range(60)]
    rows += [(100 + i, "http://b.example/", "<p>the same page</p>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
    assert out[5] == "page 5" and out[3] == "page 3" and out[105] == "the same page"


def test_a_teaser_does_not_hide_the_text():
    long = "the text of this page goes on " * 20
    assert H.extract(f"<article>Read on</article><div><p>{long}</p></div>") == f"Read on\n\n{long.strip()}"
    assert H.extract(f"<main><article>Read on</article><p>{long}</p></main><p>b</p>") == f"Read on\n\n{long.strip()}"


def test_words_that_change_go_by_their_shape(spark):
    """No tag or class here has a telling name, and no text repeats on a host."""
    page = lambda i: f"<div class=top-{i}><ul><li>go {i}<li>to {i + 1}</ul></div><article><p>page {i}</p><p>has its own text {i}</p></article><div id=end>year {i}</div>"
    bare = lambda i: f"<div class=text><p>page {i}</p><p>line {i}</p></div>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)] + [(100 + i, f"http://b.example/{i}", bare(i)) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = {r["host"]: set(r["hashes"]) for r in H.templates(pages).collect()}
    assert H.extract(page(3), known["a.example"], names=False) == "page 3\n\nhas its own text 3"
    assert H.extract(page(3), names=False) == "go 3\n\nto 4\n\npage 3\n\nhas its own text 3\n\nyear 3"
    # Shapes say nothing about pages without a marked article.
    assert H.extract(bare(3), known.get("b.example", set())) == "page 3\n\nline 3"


def test_templates_alone_give_the_articles(spark):
    """Names switched off: the table makes the text, as counted by brute force; without it the texts are others."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(400)
    pages = rows.collect()
    host = lambda r: re.match("[a-z]+://([^/?#:]*)", r["url"])[1]
    parsed = [(host(r), r["html"], H.Page(r["html"])) for r in pages]
    on, every = defaultdict(set), defaultdict(set)
    for h, html, p in parsed:
        every[h].add(html)
        for code in p.codes():
            on[h, code].add(html)
    want = defaultdict(set)
    for (h, code), seen in on.items():
        share = len(seen) / len(every[h])
        if len(seen) >= 5 and code % 2 and share >= 0.1:
            want[h].add(code // 2 * 4 + 2)
        elif len(seen) >= 5 and code % 2 == 0 and share >= 0.02:
            want[h].add(code // 2 * 4 + (share >= 0.5))
    assert want == {r["host"]: set(r["hashes"]) for r in H.templates(rows).collect()}
    big = [(h, p) for h, _, p in parsed if len(every[h]) >= 5]
    same = sum(p.text(want[h], names=False) == p.text() for h, p in big)
    assert same >= 0.98 * len(big) and sum(p.text(want[h], names=False) != p.text(names=False) for h, p in big) >= 0.98 * len(big)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = []
        for block in re.split(r"</?(?:p|h1)>", article):
            text = re.sub(r"<br>", " ", block)
            text = re.sub(r"</?b>", "", text)
            import html

            text = " ".join(html.unescape(text).split())
            want += [text] * bool(text)
        assert out[r["page_id"]] == "\n\n".join(want)


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, host string"
    rows = [(1, None, None, "t", "h"), (2, "", "", "t", "h"), (2, "x", "<", "t", "h"), (None, "http://h", "<p>" * 3000 + "deep", "t", "h")]
    out = H.main_text(spark.createDataFrame(rows, schema))
    assert sorted((r["page_id"] or 0, r["text"]) for r in out.collect()) == [(0, "deep"), (1, ""), (2, ""), (2, "<")]
    assert H.main_text(spark.createDataFrame([], schema)).count() == 0


def test_deep_pages_take_linear_time():
    deep = "<div>" * 50_000 + "x"
    page = H.Page(deep)
    assert page.text({0}) == "x" and len({exact for _, _, exact, _, _ in page.spans}) == 50_000
    every = {4 * exact + H.ANYWHERE for _, _, exact, _, _ in page.spans}
    assert page.text(every) == ""


def test_equal_subtrees_have_equal_hashes():
    one, two, three = ([x[2] for x in H.Page(s).spans] for s in ("<div><p>a  b</p></div>", "x <div>\n<p>a b</p></div>", "<div><p>a c</p></div>"))
    assert one == two and not set(one) & set(three)
