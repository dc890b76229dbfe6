import re
import time
from html import unescape

from pyspark.sql import functions as F

from panelwright.llm import html_text, registry

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{x}</style></head><body class="has-sidebar">
<div id="menu"><ul><li><a href=x>Home</a></ul></div><div class="cookie-notice">We use cookies %(n)s</div>
<div class="wrap page%(n)s"><div class="content"><h1>Title &amp; %(n)s</h1><p>First <b>bold</b>word
 of   text&nbsp;here, quite long.<br>same block<p>Second &lt;p&gt; &#233;<script>var a="<p>no</p>"</script>
<div class="ad">buy</div><!-- hidden <p>x</p> --><ul><li>one<li>two</ul><blockquote>quote</blockquote>
<form>send</form></div><aside>side side side</aside><div class="comments"><p>I think this is a very long comment that
has a lot of words in it, more than the article itself has, and it goes on and on and on</p></div></div>
<footer>foot</footer></body>"""

WANT = "Title & {n}\n\nFirst boldword of text here, quite long. same block\n\nSecond <p> é\n\none\n\ntwo\n\nquote"


def test_pages(spark):
    rows = [(i, f"http://User@A.example:80/{i}", PAGE % {"n": i}) for i in range(6)]
    rows += [
        (10, "http://a.example/odd", "<html><body><article>Only this here</article></body></html>"),
        (11, None, PAGE % {"n": 11}), (12, "nonsense", None), (13, "http://b.example", ""), (14, "http://b.example", "a < b & c &amp; d"),
        (15, "http://c.example", "<p>open <div class='content'>x <b>y"), (None, "http://c.example", "<nav>only menu</nav>"),
        (16, "http://c.example", "<" * 5000), (17, "http://c.example", '<p title="x > y">in</p><p a="unclosed>t</p>'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"path": F.lit(1), "host": F.lit(2), "text": F.lit(3)})
    got = {r["page_id"]: r for r in html_text.main_texts(df).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i]["text"] == WANT.format(n=i)
        assert got[i]["path"] == "/html/body.has-sidebar/div.wrap/div.content" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[10]["text"] == "Only this here" and got[11]["text"] == WANT.format(n=11)
    assert [got[i]["text"] for i in (12, 13, 14, None)] == ["", "", "a < b & c & d", ""]
    assert got[15]["text"] == "x y" and got[16]["n_chars"] == 5000 and "in" in got[17]["text"]
    assert html_text.main_texts(df.limit(0)).collect() == []


def test_query_against_the_article_elements(spark):
    """On the given pages, the article element holds the text; a plain cut by regular expressions agrees."""
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in registry.table(spark, sf, "pages").collect()}
    got = registry.QUERIES["op3_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        article = re.sub(r"<br>", " ", article)
        blocks = re.split(r"</?(?:p|h1|div|ul|li|article)[^>]*>", re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", article))
        blocks = [" ".join(unescape(b).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in blocks if b), r["page_id"]


def _text(source, path="own"):
    if path == "own":
        found = html_text.page_containers(source)
        path = found[0][0] if found else None
    return html_text.page_text(source, path)


def test_titles_and_leads_around_sections():
    words = "many words of the story stand here " * 6
    page = f"<html><body><article><h1>T</h1><p>lead text</p><section><p>{words}</section><section><p>{words}</section></article></body>"
    assert _text(page) == "\n\n".join(["T", "lead text", words.strip(), words.strip()])
    table = f"<body><article><h1>T</h1><table><tr><td>{words}<td>b<tr><td><table><tr><td>in</table><td>c</table><p>end</article>"
    assert _text(table).split("\n\n") == ["T", words.strip(), "b", "in", "c", "end"]
    soup = f"<body><div id=x><div class=hd><h1>T</h1></div><div class=tx><p>{words}</div></div><div class=z>noise</div>"
    assert _text(soup) == "T\n\n" + words.strip()
    lists = f"<body><div class=story><h1>T</h1><ul><li>{words}<li>{words}</ul></div><div class=rail>noise</div>"
    assert _text(lists) == "\n\n".join(["T", words.strip(), words.strip()])


def test_names():
    words = "many words of the story stand here " * 6
    for name in ("elementor-widget-container", "social-history", "has-sidebar", "no-comments", "entry-header", "advertising-law"):
        assert _text(f"<body><div class=w><div class='{name}'><h1>T</h1><p>{words}</div><div class=ad>buy</div></div>") == "T\n\n" + words.strip()
    for name in ("cookie-notice", "comments-area", "site-footer", "mainNavigation", "ads", "ad-300", "widget_area", "comment-body", "skip-link"):
        assert _text(f"<body><div class=w><h1>T</h1><p>{words}<div class='{name}'><p>{words} out</div></div>") == "T\n\n" + words.strip()
    # A form or a composed name around the whole page is its frame; comments never are.
    assert _text(f"<body><form id=f><article><h1>T</h1><p>{words}</article></form>") == "T\n\n" + words.strip()
    assert _text(f"<body><div class=page-widget><article><h1>T</h1><p>{words}</article></div>") == "T\n\n" + words.strip()
    assert _text(f"<body><article>short</article><div class=comments-area><article class=x><h1>A</h1>{words * 9}</article></div>") == "short"


def test_page_of_another_layout_goes_by_its_own_container():
    words = "many words of the story stand here " * 6
    page = f"<body><article>Teaser!</article><div class=story><p>{words}</div>"
    assert _text(page, "/body/article") == words.strip()
    assert _text(page, "/body/div.story") == words.strip()
    assert _text(f"<body><article>{words}</article><div class=story><p>{words}</div>", "/body/article") == words.strip()


def test_long_and_deep_pages_take_linear_time():
    pages = [
        "<a " * 350_000, "<a x='" * 180_000, '<a "\'>' * 180_000, "<div>" * 200_000 + "x", "<div><b>" * 100_000 + "</i>" * 100_000,
        "<p " + "a" * 1_000_000 + ">t", "<p " + "a=\"b " * 150_000 + ">t", "<!--" * 250_000, "<b>" * 200_000 + "</div>" * 100_000, "<p>" * 300_000,
        "<table><tr><td>" * 60_000, "word " * 200_000, "<script>" * 100_000, "</div" * 200_000, "&" * 1_000_000, "<" * 1_000_000,
    ]
    for page in pages:
        begun = time.perf_counter()
        html_text.page_text(page, "/div/div")
        assert time.perf_counter() - begun < 8, page[:20]
    deep = "<div>" * 8_000 + "story " * 50 + "</div>" * 8_000
    assert html_text.page_text(deep, html_text.page_containers(deep)[0][0]) == ("story " * 50).strip()
