import html
import re

import pytest

from touchline.llm import html_text
from touchline.llm.html_text import main_blocks
from touchline.llm.queries import QUERIES

RICH = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar nav-open"><header class="site-header"><h1>Site name</h1><a href="/">home</a></header>
<nav><ul><li><a href=1>one</a><li><a href=2>two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site work better for you and for everyone else who comes by.</p></div>
<div class="layout with-sidebar"><main>
<div class="post"><header class="entry-header"><h1>Tall &amp; long</h1></header>
<p>First   paragraph with <a href=x>a link</a> and enough words in it to count as real prose in anybody's book.
<p>Second paragraph, <b>bold <i>and</b> more</i> text&nbsp;here, which goes on for some while longer than a menu entry does.<br>After the break.
<div class="ad-box advert">Buy now, the best offers of the whole year are waiting for you here, click at once!</div>
<p>Third paragraph: 1 &lt; 2 &amp;&amp; 3 &gt; 2, and &#8364;5 are not &euro;6; the last words of the article come now.</p>
<form action=x><p>Sign up for our letter</p><input name=q><button>Go</button></form>
</div>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I have read this very long article twice and I liked the second paragraph best of all, thank you so much for it!</p></article></section>
</main><aside class="sidebar"><p>Elsewhere on this site there are many other things to read, of which these are the latest ones.</p></aside></div>
<footer>&copy; someone, all rights reserved in every land that knows such rights</footer></body></html>"""


def test_rich_page():
    assert main_blocks(RICH) == [
        "Tall & long",
        "First paragraph with a link and enough words in it to count as real prose in anybody's book.",
        "Second paragraph, bold and more text here, which goes on for some while longer than a menu entry does. After the break.",
        "Third paragraph: 1 < 2 && 3 > 2, and €5 are not €6; the last words of the article come now."]


def test_core_is_found_without_telling_names():
    menu = "".join(f'<div><a href="/{i}">Entry {i}</a></div>' for i in range(12))
    body = "".join(f"<p>Paragraph {i} tells of something at length, so that it holds many more characters than tags.</p>" for i in range(6))
    got = main_blocks(f'<body><div class=a>{menu}</div><div class=b><div class=c>{body}</div></div><div class=d><a href=x>Imprint</a> 2020</div></body>')
    assert got == [f"Paragraph {i} tells of something at length, so that it holds many more characters than tags." for i in range(6)]


def test_sections_of_one_article_stay_together():
    part = lambda k: "".join(f"<p>Sentence {k}.{i} runs on and on until it has become a paragraph of the usual length.</p>" for i in range(k))
    got = main_blocks(f"<body><div><a href=x>Top</a></div><div><div>{part(3)}</div><div>{part(5)}</div></div></body>")
    assert len(got) == 8


@pytest.mark.parametrize("page, blocks", [
    ("", []), ("   ", []), ("<html></html>", []), ("plain words", ["plain words"]), ("a < b and c > d", ["a < b and c > d"]),
    ("<p>x<!-- c --> y<p>z", ["x y", "z"]), ("<p>open <b>tag", ["open tag"]), ("<p>cut off <a href='x", ["cut off"]), ("<p>&am &amp &#x41;&bogus;", ["&am & A&bogus;"]),
    ("<nav>only a menu</nav>", []), ("<script>x</script>", []), ("<p>a</p><script>never closed <p>b", ["a"]), ("<p hidden>gone</p><p>there</p>", ["there"]),
    ("<p>one</p></div></p><p>two</p>", ["one", "two"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1 2", "3"])])
def test_small_and_broken_pages(page, blocks):
    assert main_blocks(page) == blocks


def test_deep_and_long_pages_end():
    deep = "<div>" * 20000 + "<p>words at the bottom</p>"
    assert main_blocks(deep) == ["words at the bottom"]
    long = "<article>" + "<p>many words stand here</p>" * 30000 + "</article>"
    assert len(main_blocks(long)) == 30000
    assert main_blocks("<ul><li>" * 3000 + "x")[-1] == "x"


def test_table_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>hello there</p>"), (3, "u", "<p>hello there</p>"), (None, "v", "<article><p>é text</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    odd = pages.selectExpr("'<p>wrong</p>' as HTML", "page_id", "url", "html", "7 as n_chars", "'t' as text")
    got = sorted(map(tuple, html_text.extract(odd).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", "hello there", 11), (3, "u", "hello there", 11), (None, "v", "é text", 6)], key=repr)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_query_against_plain_patterns(spark):
    """The given pages keep their article in one element, so patterns give the same text by another way."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op11_html_text"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(given)
    for row in given:
        found = re.search(r"<article>(.*?)</article>", row.html or "", re.S)
        parts = re.split(r"</?p>|</?h1>", found[1]) if found else []
        clean = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        want = "\n\n".join(p for p in clean if p)
        assert (got[row.page_id].text, got[row.page_id].n_chars, got[row.page_id].url) == (want, len(want), row.url)
