import html
import re
import time

import pytest
from helpers import SMALL

from millrace.llm import html_text as H
from millrace.runtime import table


def test_articles_of_the_pages(spark):
    got = {r["page_id"]: r for r in H.op4_html_text(spark, SMALL).collect()}
    for r in table(spark, SMALL, "pages").collect():
        article = re.sub(r"\s+", " ", r["html"][r["html"].find("<article>") + 9 : r["html"].find("</article>")])
        lines = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)>", "\n", article)).split("\n")
        want = "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


LONG = "A sentence that is long enough to be the text of an article, and then some more of it."


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain words", "plain words"), ("<p>a&amp;b &lt;c&gt; &eacute;<br>d</p>", "a&b <c> é d"),
    (f"<nav><a>x</a></nav><main><p>{LONG}<p>Short.<p>{LONG}</main><aside>no</aside>", f"{LONG}\nShort.\n{LONG}"),
    (f"<body><header>Top</header><div class='post'><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div><footer>end</footer>", f"Title\n{LONG}\n{LONG}"),
    (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}</p><form><p>Subscribe</p></form><script>var x='<p>no</p>'</script><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<div class='ad'>never closed <article><p>{LONG}</p></article>", LONG), (f"<article><ul><li>one<li>two</ul><p>{LONG}<table><tr><td>a<td>b</table></article>", f"one\ntwo\n{LONG}\na b"),
    (f"<article><p>{LONG} <b>bold</b>\n text</p><p hidden>no</p><p style='display: none'>no</p></article>", f"{LONG} bold text"),
])
def test_pages(page, want):
    assert H.extract(page) == want


@pytest.mark.parametrize("page,want", [
    (f"<body><article><h1>Title</h1><p>lead</p><div class='body'><p>{LONG}</p><p>{LONG}</p></div><p>closing</p></article></body>", f"Title\nlead\n{LONG}\n{LONG}\nclosing"),
    (f"<main><h1>Title</h1><section><div><p>{LONG}</p><p>{LONG}</p></div></section><table><tr><td>a<td>b</table></main><div>other</div>", f"Title\n{LONG}\n{LONG}\na b"),
    (f"<main><h1>Title</h1><article><div><p>{LONG}</p></div><p>end</p></article><p>after</p></main>", f"Title\n{LONG}\nend\nafter"),
    (f"<article><div class='article-header'><h1>Title</h1></div><div class='header'>lead</div><p>{LONG}</p></article>", f"Title\nlead\n{LONG}"),
    (f"<div class='post no-sidebar'><p>{LONG}</p></div>", LONG), (f"<div id='page' class='has-header'><p>{LONG}</p></div>", LONG),
    (f"<body><div class='site-footer'>{LONG}</div><div class='cookie-notice'>{LONG}</div><div id='comments'>{LONG}</div><div class='wide sidebar'>{LONG}</div><div><p>{LONG} end</p></div></body>", f"{LONG} end"),
])
def test_articles_are_whole_and_names_are(page, want):
    assert H.extract(page) == want


LINKS = "".join(f"<a href='/{k}'>link number {k} of a long list</a> " for k in range(12))


@pytest.mark.parametrize("page,want", [
    (f"<article><p>{LONG}</p></article><section class=comments><article class=comment><p>{LONG}</p></article><article><p>{LONG}</p></article></section>", LONG),
    (f"<article><p>{LONG}</p></article><section class=comments>" + f"<article class=comment><p>{LONG}</p></article>" * 60 + "</section>", LONG),
    (f"<article><p>{LONG}</p><ol class='commentlist'><li>{LONG}</ol><div class='reader-comments'>{LONG}</div><div id='comment-7'>{LONG}</div></article>", LONG),
    (f"<div class='layout with-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"), (f"<div class='main sidebar'><h1>Title</h1><p>{LONG}</p></div>", f"Title\n{LONG}"),
    (f"<div class=post-header><h1>Title</h1></div><div><p>{LONG}</p></div>", f"Title\n{LONG}"), (f"<div class=page-header><h1>Title</h1></div><p>{LONG}</p>", f"Title\n{LONG}"),
    (f"<body><div>{LINKS}</div><div class=text><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></body>", f"Title\n{LONG}\nShort.\n{LONG}"),
    (f"<body><ul>{LINKS}</ul><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div>{LINKS}</div></body>", f"Title\n{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a href=a>One source</a><li><a href=b>Another</a><li><a href=c>A third</a></ul></article>", f"{LONG}\nOne source\nAnother\nA third"),
    (f"<form id=all><nav>{LINKS}</nav><div><h1>Title</h1><p>{LONG}</p></div><footer>end</footer></form>", f"Title\n{LONG}"),
    (f"<nav>never closed <article><p>{LONG}</p></article>", LONG), (f"<nav>{LINKS}</nav><footer>All rights reserved and so on, for a line that is long enough to be the text of a page.</footer>", ""),
    (f"<article><p>one <span class=ad>buy</span> two <script>x()</script> three <b>four</b><button>Like</button> five.</p><p>{LONG}</p></article>", f"one two three four five.\n{LONG}"),
    (f"<article><b><p>{LONG}</b> and on</p><p>{LONG}</p></article>", f"{LONG} and on\n{LONG}"), (f"<article><a name=top><p>{LONG}<p><a href=x>Go on<a href=y> here</a> now</article>", f"{LONG}\nGo on here now"),
    (f"<article>{LONG}</p>more</article>", f"{LONG}\nmore"), (f"<article><p aria-hidden=true>no</p><p>{LONG}</p><p class='share-buttons'>Share</p><p class='shared'>yes</p></article>", f"{LONG}\nyes"),
    (f"<main><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>{LONG}</p></section><aside>{LONG}</aside></main>", f"A\n{LONG}\nB\n{LONG}"),
    (f"<div role=navigation>{LONG}</div><div role=main><p>{LONG}</p></div>", LONG), (f"<div class='widget'><h3>Popular</h3>{LINKS}</div><div id=content><p>{LONG}</p><p>{LONG}</p></div><div class='footer-widgets'>{LONG}</div>", f"{LONG}\n{LONG}"),
])
def test_comments_layout_and_links(page, want):
    assert H.extract(page) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + LONG, "<div><span>" * 50_000 + LONG + "</b></span>" * 50_000, "<b>" * 50_000 + f"<p>{LONG}</p><div>x</div>" * 20_000, "<ul><li>" * 30_000 + "<li>x" * 30_000, "<div class=ad>" * 50_000 + LONG, "<p>x</p>" * 100_000 + LONG, "<a href=x>" * 50_000 + LONG])
def test_linear_time(page):
    began = time.process_time()
    text = H.extract(page)
    assert time.process_time() - began < 4 and ("class=ad" in page or "<a " in page or "x" in text or LONG in text)


@pytest.mark.parametrize("tail", ["x <b ", "<", "<!--", "x <!-- ", "</", "</b", "<b a='", '<b a="x', "<script>", "<style>x", "&", "&lt", "<b <b", "<![CDATA[", "<?x", "<b a=\"'", "x < y ", "<a b=c'd"])
@pytest.mark.parametrize("before", ["", "<!--", "<b '", "<script>"])
def test_hostile_tails_take_linear_time(tail, before):
    """A megabyte of what never ends, under a second of work; the text before it stays."""
    began = time.process_time()
    text = H.extract(f"<article><p>{LONG}</p>" + before + tail * (1_000_000 // len(tail)))
    assert time.process_time() - began < 2.5 and text.startswith(LONG)


def test_tags_that_end_the_page():
    for rest in ("<b unfinished", "<!-- open <p>x</p>", "<script>x()<p>y</p>", "</div unfinished"):
        assert H.extract(f"<article><p>{LONG}</p>{rest}") == LONG
    assert H.extract(f"<article><p>{LONG} a < b &lt;c> 1<2 <3</p><!-- <p>no</p> --><p>yes<!----> on<!--> still</p></article>") == f"{LONG} a < b <c> 1<2 <3\nyes on still"
    assert H.extract(f"""<article><p title="a > b" data-x='<p>'>{LONG}</p><script>if (a < b) "</p>"</script><p class=x"y>two</p></article>""") == f"{LONG}\ntwo"


@pytest.mark.parametrize("page,want", [
    (f"<table><tr><td><a href=a>Home</a> <a href=b>News</a></td><td><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></td></tr></table>", f"Title\n{LONG}\n{LONG}"),
    (f"<table><tr><td>menu links</td><td><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></td></tr></table>", f"Title\n{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table></article>", f"{LONG}\na 1\nb 2"),
    (f"<article><p>{LONG}</p><ins class='adsbygoogle'>Buy it now</ins><p>on</p></article><div class='replies'><p>{LONG}</p></div>", f"{LONG}\non"),
    (f"<article><p>{LONG}</p><div class='reply-form'>Say something</div><ol class='replies'><li>{LONG}</li></ol></article>", LONG),
])
def test_cells_adverts_and_replies(page, want):
    assert H.extract(page) == want


def test_fed_in_pieces(monkeypatch):
    page = f"<article><p>{LONG} &amp; more &eacute;</p><p>{LONG}</p></article>"
    whole = H.extract(page)
    monkeypatch.setattr(H, "FEED", 3)
    assert H.extract(page) == whole


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", None), (2, None, ""), (3, "u", "<p>" * 3000 + "deep"), (None, "u", "<p>x"), (4, "u", "a " * 200_000)], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in H.extract_pages(pages).collect())
    assert got == [("1", 0), ("1", 0), ("2", 0), ("3", 4), ("4", 399_999), ("None", 1)]
    assert H.extract_pages(pages.limit(0)).count() == 0


def test_smoothing():
    assert H.smooth([3.0] * 7) == pytest.approx([3.0] * 7) and H.smooth([]) == []
    peak = H.smooth([0, 0, 0, 9, 0, 0, 0])
    assert peak[3] == max(peak) and peak[2] == pytest.approx(peak[4])
