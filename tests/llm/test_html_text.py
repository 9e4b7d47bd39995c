import html
import re

import pytest

from stagewise.llm import html_text as H


def plain(page):
    """The article of the test pages by plain string operations."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op10_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html), r.page_id
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "This is one of the long paragraphs that tells what was seen on the way to the sea, and it is as long as it has to be for the rules. " * 2


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("no tags at all", "no tags at all"),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        (f"<nav><a>home</a></nav><div class='side ad-box'>buy the best of it</div><p>{LONG}</p><p>Short end.</p><footer>&copy; me</footer>", LONG.strip() + " Short end."),
        (f"<header><h1>Site</h1></header><main><h1>Title</h1><p>a&amp;b &lt;c&gt;&nbsp;d\n\n e<p>x<br>y</p><aside>more</aside></main><div id=comments><p>{LONG}</p></div>", "Title a&b <c> d e x y"),
        (f"<body><ul><li><a href='/a'>First of the links</a><li><a>Second</a></ul><div><p>{LONG}<p>And.<p>{LONG}</div><form>name of the user</form>", f"{LONG}And. {LONG}".strip()),
        ("<article><p>one<script>if (a < b) x('</p>')</script> two</p><!-- <p>no</p> --><div hidden>no</div><div style='display: none'>no</div><p>1 < 2 & 3</p></article>", "one two 1 < 2 & 3"),
        ('<article><p title="a > b">yes</p><div role="navigation">no</div><section class="comments">no</section></article><p>out</p>', "yes"),
    ],
)
def test_rules(page, text):
    assert H.main_text(page) == text


def test_cases(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "<p>x", "b"), (None, "", "c")], "page_id long, html string, text string")
    assert sorted(map(repr, H.extract(df).collect())) == sorted(["Row(page_id=1, text='')", "Row(page_id=1, text='x')", "Row(page_id=None, text='')"])
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert len(H.main_text("<div><p>" + "of the sea " * 200000)) > 10**6


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='layout with-sidebar'><article><p>{LONG}</p></article></div>", LONG.strip()),
        (f"<div class='page sidebar-left'><div class='sidebar'>other</div><article><p>{LONG}</p></article></div>", LONG.strip()),
        ("<article><p>yes</p></article><div class='comments'><article><p>no</p></article></div>", "yes"),
        ("<article><section id='related-work'><h2 id='legal-status'>Law</h2><p class='notice'>one</p></section></article>", "Law one"),
        ("<article><p>a</p><video-player src='x'></video-player><p>b</p></article>", "a b"),
        ("<article><p>a</p><svg viewBox='0 0 1 1'/><p>b</p><svg/><p>c <math><mi>x</mi></math></p></article>", "a b c x"),
        ("<article><p>a</p><svg><text>no</text></svg><video src='x'>no</video></article>", "a"),
    ],
)
def test_frames_and_dropped_tags(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div><p>{LONG}</p><p>Short end.</p></div><article><a href='/x'>Next</a><p>Read on</p></article>", LONG.strip() + " Short end."),
        (f"<div><p>{LONG}</p></div><article class='comment'><p>{LONG}no</p></article>", LONG.strip()),
        (f"<article class='teaser-card'><p>{LONG}no</p></article><article class='post with-comment'><p>yes</p></article>", "yes"),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><p>{LONG}</p><p>out</p>", f"{LONG}{LONG}{LONG}".strip()),
    ],
)
def test_article_is_one_feature(page, text):
    assert H.main_text(page) == text


CHINESE = "这是一篇很长的文章,讲述了去海边的路上看到的一切,它的长度足以满足规则的要求。" * 6
RUSSIAN = "Это один из длинных абзацев, который рассказывает о том, что было видно по дороге к морю, и он настолько длинный, насколько нужно. " * 3


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<nav><a>家</a></nav><p>{CHINESE}</p><p>短句。</p><footer>版权</footer>", f"{CHINESE} 短句。"),
        (f"<div class=ad>Купить</div><h1>Море</h1><p>{RUSSIAN}</p><ul><li><a href=x>{RUSSIAN}</a></ul>", f"Море {RUSSIAN}".strip()),
        (f"<p>{RUSSIAN}</p><p>{LONG}</p>", f"{RUSSIAN}{LONG}".strip()),
        (f"<form><nav>menu</nav><p>{LONG}</p><p>{LONG}</p><input></form>", f"{LONG}{LONG}".strip()),
        (f"<form><article><p>{LONG}</p></article></form>", LONG.strip()),
        (f"<article><p>{LONG}</p><form>your mail</form><div class='legal-analysis'>kept</div><div class='ad-box'>no</div></article>", f"{LONG}kept"),
        (f"<div class='page has-sidebar'><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class='search page'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}{LONG}".strip()),
        (f"<div class='post comments'><p>{LONG}</p></div><p>Short.</p>", "Short."),
        (f"<article><p>a<svg class='i'/> b</p><p>{LONG}</p></article>", f"a b {LONG}".strip()),
        (f"<article><button>Go<p>{LONG}</p></article>", f"Go {LONG}".strip()),
        (f"<article><p>{LONG}</p><button>Go<p>yes</p><button>No</button></article>", f"{LONG}Go yes"),
        (f"<article><p title=it's>{LONG}</p></article>", LONG.strip()),
        ("<article><p title='a>b' class=\"x=>\">one</p><p a=b=c>two</p></article>", "one two"),
        ("<head><title>t<body><article><p>x</p></article>", "x"),
        ("<article>a <3 b <- c < d</article>", "a <3 b <- c < d"),
    ],
)
def test_no_text_is_lost(page, text):
    assert H.main_text(page) == text


def test_pages_without_marks(spark, sf):
    """The test pages with the article's tags taken away: stop words, links, length and neighbours decide."""
    exact, lost = 0, 0
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for page in pages:
        want = plain(page).split()
        got = H.main_text(re.sub(r"</?article[^>]*>", "", page)).split()
        exact += got == want
        lost += len(want) - sum(1 for w in want if w in set(got))
    print("exact", exact, "of", len(pages), "words lost", lost)
    assert exact >= 0.9 * len(pages)


@pytest.mark.parametrize("page", ["<span>" * 20000 + "</b>" * 20000, "<p><span>x</p>" * 20000, "<a x='" * 20000 + ">", '<a x="' * 20001, "<button>" * 20000 + "x", "<div class=ad>" * 20000, "<" * 50000, "<svg>" * 20000 + "</svg>"])
def test_time_is_linear(page):
    import time

    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>x", "h", "t", 5)] * 2, "page_id long, html string, _html string, page string, c0 int")
    got = H.extract(df)
    assert got.columns == ["page_id", "_html", "page", "c0", "text"] and [tuple(r) for r in got.collect()] == [(1, "h", "t", 5, "x")] * 2
