import random
import re
from collections import Counter

import numpy as np
import pytest

from helixframe.llm.pages import blocks, main_text, shared_lines

SCHEMA = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">buy</div><div id='cookie-notice'>We use cookies</div>
<article><h1>Head &lt;1&gt;</h1><p><b>First&nbsp;part
 of text<br>next <i>word</i><p>Second &amp; last &am</p><aside>side</aside><form><input value="a>b"><p>form text</p></form><ul><li>one<li>two</ul>
<div class="comments"><article class="comment"><p>Nice!</p></article></div></article><section class="comment">reader</section><footer>&copy; me</footer></body></html>"""


def test_blocks_of_a_page_with_everything():
    assert [t for t, inside, _ in blocks(PAGE) if inside] == ["Head <1>", "First part of text next word", "Second & last &am", "one", "two"]
    assert [t for t, inside, _ in blocks(PAGE) if not inside] == []


def test_broken_and_odd_markup_doesnt_crash():
    for source in ["", "plain", "<", "<p", "<p>a<b>c", "</div>x</p>", "<div class='ad'>never closed", "<!-- open", "a < b and c > d", "<p title=\"x>y\">q", "<script>x", "<" * 5000, "<p class='" * 500, "&#0;&#xFFFFFFFF;&bogus;"]:
        blocks(source)
    assert [t for t, *_ in blocks("a < b <p>c")] == ["a < b", "c"]


def brute_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        kept = shared_lines(a, b)
        own, at = a[kept].tolist(), 0
        assert len(own) == brute_lcs(a, b)
        for x in own:
            at = b.tolist().index(x, at) + 1


def test_pages_without_article_lose_what_neighbours_share(spark):
    page = lambda body: f"<body><div>Top line of the site</div><p>Section list</p>{body}<p>Bottom line</p></body>"
    rows = [
        (1, "http://a.example/news/1", page("<p>First story.</p><p>More of it.</p>")),
        (2, "http://a.example/news/2?x=1", page("<p>Second story.</p>")),
        (3, "https://www.a.example/shop/9", page("<p>Third story.</p>")),
        (4, "http://b.example/1", page("<p>Alone.</p>")),
        (5, "http://c.example/1", page("<p>Copy.</p>")),
        (6, "http://c.example/2", page("<p>Copy.</p>")),
        (7, None, None),
        (None, "http://[bad", "<article>x</article>"),
        (8, "http://a.example/news/1", PAGE),
        (8, "http://a.example/news/1", PAGE),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'h' as host", "'t' as text", "1 as row")
    got = main_text(df).collect()
    text = {r.page_id: r.text for r in got}
    assert text[1] == "First story.\n\nMore of it." or text[1].startswith("First story.")
    assert text[2] == "Second story." and text[3] == "Third story."
    assert text[4] == "Top line of the site\n\nSection list\n\nAlone.\n\nBottom line"
    assert text[5] == text[6] == "Top line of the site\n\nSection list\n\nCopy.\n\nBottom line"
    assert text[7] == "" and text[None] == "x" and text[8].startswith("Head <1>")
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert main_text(df.limit(0)).count() == 0


def test_pages_of_sure_lines_are_neighbours_too(spark):
    page = lambda menu, *lines: "<article>" + "".join(f"<p>{x}</p>" for x in lines) + (f"<ul class='menu'><li>{menu}</li></ul>" if menu else "") + "</article>"
    rows = [(1, "http://a.example/news/1", page("Section", "One")), (2, "http://a.example/news/2", page("", "Section", "Two")), (3, "http://a.example/shop/9", page("Other", "Three")), (4, "http://a.example/news/2", "<p>Section</p>"), (5, "http://a.example/news/3", "")]
    text = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert text == {1: "One", 2: "Section\n\nTwo", 3: "Three\n\nOther", 4: "Section", 5: ""}


def test_copies_lose_what_other_pages_share(spark):
    page = lambda body: f"<body><div>Top line</div><p>{body}</p><p>Bottom line</p></body>"
    rows = [(i, f"http://a.example/news/1?x={i}", page("Copied story.")) for i in range(4)] + [(9, "http://a.example/news/2", page("Other story."))]
    text = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert text == {0: "Copied story.", 1: "Copied story.", 2: "Copied story.", 3: "Copied story.", 9: "Other story."}


@pytest.mark.parametrize(
    "around",
    ['div class="layout no-sidebar"', 'div class="content has-sidebar"', 'div class="row with-ads"', 'div class="main-menu-open"', 'section id="related-work"', 'form id="aspnetForm"', 'div data-note="the hidden valley"', 'div title="a hidden gem"', 'div class="modal"', 'span class="widget"'],
)
def test_layouts_keep_their_article(around):
    page = f"<body><nav>n</nav><{around}><p>aside</p><article title='The hidden valley'><p>Kept.</p></article></{around.split()[0]}></body>"
    assert [t for t, inside, _ in blocks(page) if inside] == ["Kept."]


def test_names_that_only_look_like_marks_stay():
    page = """<article><p id="notice-of-motion">a</p><p class="share-price">b</p><ul class="menu"><li>soup</li></ul><div class="ad-slot">no</div><p class="cookie-notice">no</p>
    <div class="newsletter signup">no</div><div hidden>no</div><p style="display: none">no</p><p aria-hidden="false">c</p></article><aside><article>no</article></aside>"""
    found = [(t, unsure) for t, inside, unsure in blocks(page) if inside]
    assert found == [("a", False), ("b", False), ("soup", True), ("c", False)]


def test_names_in_doubt_in_an_article_go_where_pages_share_them(spark):
    page = lambda menu, body: f"<article><p>{body}</p><ul class='menu'><li>{menu}</li></ul></article>"
    rows = [(1, "http://a.example/1", page("Home", "One")), (2, "http://a.example/2", page("Home", "Two")), (3, "http://b.example/1", page("Soup", "Same")), (4, "http://b.example/2", page("Fish", "Same"))]
    text = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert text == {1: "One", 2: "Two", 3: "Same\n\nSoup", 4: "Same\n\nFish"}


def test_hosts_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for host in ("h.example", "i.example"):
        for k in range(40):
            lines = [f"line {r.randrange(12)} of {host}" for _ in range(r.randrange(1, 9))]
            rows.append((len(rows), f"http://{host}/{r.choice('abc')}/{r.randrange(30)}", "".join(f"<p>{x}</p>" for x in lines)))
    got = {x.page_id: x.text.split("\n\n") if x.text else [] for x in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    pages = {i: ((u.split("/")[2], "/" + u.split("/", 3)[3]), re.findall("<p>(.*?)</p>", h)) for i, u, h in rows}
    firsts = {}
    for i, (key, lines) in sorted(pages.items(), key=lambda x: (x[1][0], x[0])):
        firsts.setdefault((key[0], tuple(lines)), i)
    order = sorted(firsts.values(), key=lambda i: (pages[i][0], i))
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    for i, ((host, path), lines) in pages.items():
        at = order.index(firsts[host, tuple(lines)])
        me = pages[order[at]][0][1]
        beside = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order) and pages[order[j]][0][0] == host]
        other = max(beside, key=lambda j: (common(me, pages[j][0][1]), -order.index(j)))
        shared = brute_lcs(lines, pages[other][1])
        left = len(lines) - (0 if shared == len(lines) else shared)
        assert len(got[i]) == left and not Counter(got[i]) - Counter(lines)


def test_very_long_pages(spark):
    body = lambda k: "".join(f"<p>line {i if i % 7 else i * k}</p>" for i in range(4000))
    rows = [(1, "http://a.example/1", body(1)), (2, "http://a.example/2", body(-1)), (3, "http://z.example/", "<p>" + "long " * 300_000)]
    got = {x.page_id: x for x in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text.startswith("line 7\n\nline 14") and len(got[1].text.split("\n\n")) == 571 and got[3].n_chars == 1_499_999
