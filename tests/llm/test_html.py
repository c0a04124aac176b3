"""Main text extraction on pages written by hand, and as a query."""

import time

import pytest

from tripgraph.llm import html_density as H
from tripgraph.llm.queries import op3_html_text_density

from . import brute

LONG = "A sentence of the article that goes on for a while, with commas and more words. " * 4
LINKS = "".join(f'<li><a href="/{k}">Menu entry {k}</a></li>' for k in range(20))


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"),
    ("<html><head><title>T</title></head><body></body></html>", ""),
    ("<body><nav><a href=/>x</a></nav><article><h1>Head &amp; tail</h1><p>One\n  two<br>three</p><p>four</article><footer>foot</footer>", "Head & tail\nOne two three\nfour"),
    ("<article><p>a &lt;b&gt; &#233;&hellip;</p><script>var t='</p>'</script><style>p{}</style><!-- no <p>x</p> --><p>c</p></article>", "a <b> é…\nc"),
    ("<article><p>text</p><section class='comments'><p>me too</p></section><div id=cookie-banner>ok?</div><form><input>Send</form></article>", "text"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table></article>", "one\ntwo\nx\ny\nz"),
    ("<article><p>say <b>it <i>all</b></i> now</p></article>", "say it all now"),
    ("<article><p>   </p><div></div><p>x</p></article>", "x"),
    ("<article><p>a</p><script>never closed <p>b</p>", "a"),
    ("<article><p title='a > b'>quoted</p></article>", "quoted"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><header><h1>Kept</h1></header><p>body</p></article><header>site</header>", "Kept\nbody"),
])
def test_pages(page, text):
    assert H.main_text(page) == text


NAMES = ("user-comments comment-body post-comments comments-area ad-container advert-slot sidebar-left site-footer newsletter-box related-posts "
         "cookie-banner-text ad-slot-2 comments comment_list userComments post__comments js-ad site-notice").split()


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("page", [
    "<article><p>{}</p><div class='{}'><p>{}</p></div></article>", "<article><p>{}</p></article><div id={}><p>{}</p></div>",
    "<div><p>{}</p><p>And more of it.</p></div><div class='x {}'><p>{}</p></div>",
])
def test_longer_names_of_boilerplate(page, name):
    got = H.main_text("<body>" + page.format(LONG, name, "Said beside the article, in a sentence or two."))
    assert got.startswith(LONG.strip()) and "beside" not in got


def test_comments_longer_than_the_article_go():
    talk = "".join(f"<div class=comment-body><p>{LONG}{k}</p></div>" for k in range(9))
    assert H.main_text(f"<article><p>{LONG}</p><section id='post-comments'>{talk}</section></article>") == LONG.strip()
    assert H.main_text(f"<div><h1>Head</h1><p>{LONG}</p></div><div>{talk}</div>") == f"Head\n{LONG.strip()}"
    assert H.main_text(f"<body><div class=comment-body><p>{LONG}</p></div></body>") == LONG.strip()


@pytest.mark.parametrize("name", "comments-open has-sidebar layout--with-sidebar post-header side-by-side".split())
def test_names_of_states_and_parts_stay(name):
    assert H.main_text(f"<article><h1>One</h1><div class={name}><p>{LONG}</p></div><p>Two.</p></article>") == f"One\n{LONG.strip()}\nTwo."


@pytest.mark.parametrize("page, text", [
    ('<article><p><a href="x>link</a> one</p><p class="y z">two</p></article>', "link one\ntwo"),
    ('<article><p>one <a href="x>link</a></p><p>two</p></article>', "one link\ntwo"),
    ("<article><p title=it's>one</p><p data-x='<b>no</b>'>two</p></article>", "one\ntwo"),
    ('<article><p class="a"id="b>c">one</p></article>', "one"),
    ("<article><p>one<!--> two<!-- <p>no</p> --!> three</p></article>", "one two three"),
    ("<article><p>one</p><script>'</p>'</script x><p>two</p></article>", "one\ntwo"),
    ("<article><p>a</p></span></div></p><table><tr><td>b</span></td></tr></table></article>", "a\nb"),
    ("<article><p>one<", "one<"), ("<article><p>one <b", "one <b"), ("<", "<"), (">", ">"),
])
def test_loose_markup(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("piece, before, after", [
    ("</div>", "", ""), ("</span>", "<span><table>", "</table>"), ("</b>", "<b>" + "<table><tr><td>" * 2_000, ""), ('<a href="', "", ""), ('<a href="', "", ">"),
    ('<a href="x>', "", "<p>x"), ("<a b='x>\" ", "", ">"), ("<!-", "", ">"), ("<!--", "", ""), ("<a", "", ">"), ("<li>", "<ul>" + "<div>" * 2_000, ""),
    ("<div class=sidebar>", "", "x"), ("<p>", "<span>" * 2_000, ""), ("<td>", "<table>" + "<b>" * 2_000, ""), ("= ", "<a ", ">"),
])
def test_cost_grows_with_the_page(piece, before, after):
    """Eight times the page takes about eight times the time, not 64 times."""
    def seconds(n):
        page = before + piece * n + "text" + after
        taken = []
        for _ in range(3):
            start = time.process_time()
            H.main_text(page)
            taken.append(time.process_time() - start)
        return min(taken)

    assert seconds(64_000) < 24 * max(seconds(8_000), 0.02)


def test_density_finds_the_article_without_a_name():
    page = f"<body><div><ul>{LINKS}</ul></div><div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div><div><ul>{LINKS}</ul></div></body>"
    assert H.main_text(page) == "\n".join([LONG.strip(), "Short.", LONG.strip()])


@pytest.mark.parametrize("page", [
    "<div class='has-sidebar'><article><p>{}</p></article></div>", "<div id=page-with-sidebar><p>{}</p></div>", "<body><form><div><p>{}</p></div></form></body>",
    "<article><section class='post-share-wrap'><p>{}</p></section></article>", "<div class=sidebar><main><p>{}</p></main></div>", "<aside><p>{}</p></aside>",
    "<article><p>{}</p><section class=comments><article class=comment><p>me too</p></article></section><div class='navBar side-bar'>x</div></article>",
])
def test_names_do_not_remove_the_article(page):
    assert H.main_text(page.format(LONG)) == LONG.strip()


@pytest.mark.parametrize("page, n", [
    ("<ul>{links}</ul><article><h1>One</h1><p>{long}</p></article><article><h1>Two</h1><p>{long}{long}</p></article><article><h1>Three</h1><p>{long}</p></article>", 3),
    ("<main><ul>{links}</ul><article><p>{long}</p><ul>{links}</ul></article><article><p>{long}</p></article></main>", 2),
    ("<article><p>{long}</p><div><ul>{links}</ul></div><p>{long}</p></article>", 2),
    ("<div><ul>{links}</ul></div><article><p>{long}</p></article><div><p>{long}</p></div>", 2),
    ("<div><ul>{links}</ul></div><div><p>{long}</p></div><div><ul>{links}</ul></div><div><p>{long}</p></div>", 2),
])
def test_threshold_selects_over_the_whole_page(page, n):
    lines = H.main_text("<body>" + page.format(links=LINKS, long=f"<p>{LONG}</p>")).split("\n")
    assert "".join(lines).count(LONG.strip()) >= n and not any("Menu entry" in x for x in lines)
    assert [h in lines for h in ("One", "Two", "Three")] == [f"<h1>{h}<" in page for h in ("One", "Two", "Three")]


def test_a_footer_longer_than_the_article_goes():
    assert H.main_text(f"<article><p>Short.</p></article><footer>{LONG}</footer>") == "Short."


def test_deep_pages_do_not_overflow():
    assert H.main_text("<div>" * 20_000 + "x") == "x"
    assert len(H.main_text("<article>" + "<p>word " * 50_000).split("\n")) == 50_000


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>", "c"), (1, "u", "<p>a</p>", "c"), (None, None, None, None), (2, None, "", "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((tuple(r) for r in H.extract_main_text(df).collect()), key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, None, "", 0)], key=repr)
    assert H.extract_main_text(df.limit(0)).collect() == []


def test_query_leaves_nothing_of_the_article(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{brute.SMALL}/pages.parquet").collect()}
    rows = op3_html_text_density(spark, brute.SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        article = page[page.index("<article>") :].split("</article>")[0]
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", article))).split()
        assert r.text.split() == want and r.n_chars == len(r.text)
