import numpy as np
import pytest

from tallymark.llm import html_text as H

LONG = "Long enough a sentence that a window of lines counts it as text of the page and not as a label."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>Hi", "Hi"),
        ("just text &amp; more", "just text & more"),
        ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav>"
         f"<div class=\"ad\">{LONG}</div><article><h1>Head&nbsp;line</h1><p><b>One</b>two.<br><p>A\n  b.</p><p>x</p></article><footer>{LONG}</footer>", "Head line Onetwo. A b. x"),
        (f"<body><div class='top menu'>{LONG}</div><div><p>{LONG}</p><p>short</p></div><div>label</div><!-- {LONG} --><form>{LONG}</form>", f"{LONG} short"),
        (f"<div id=comments><p>{LONG}</p></div><main><p>{LONG}</p><section><p>tail</p></section></main><aside>{LONG}</aside>", f"{LONG} tail"),
        (f"<div class='cookie-notice'>{LONG}<article><header><h1>Title</h1></header><p>ok &#233; &lt;b&gt;</p><div class='share'>tweet</div><p>end</p></article>", "Title ok é <b> end"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article>" + "<p>w w</p>" * 3000 + "</article>", " ".join(["w w"] * 3000)),
        (f"<p title=\"a>b\">{LONG}</p><img alt='x'><script>unclosed {LONG}", LONG),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_surges_and_dives():
    lengths = np.array([5, 0, 0, 0, 90, 3, 0, 40, 0, 0, 0, 10, 10, 0, 0, 0, 100])
    assert H.between(lengths) == [(4, 8), (16, 17)]
    assert H.between(np.array([0, 7, 0])) == [(1, 2)] and H.between(np.zeros(4, int)) == []


def test_tables(spark, rows, clashing):
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>"), (None, None, None), (1, "u", f"<p>{LONG}</p>")], schema)
    assert rows(H.extracted(clashing(pages)), "page_id", "url", "text") == sorted([(1, "u", LONG), (None, None, ""), (1, "u", LONG)], key=repr)
    assert rows(H.extracted(spark.createDataFrame([], schema))) == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<main class="site-main no-sidebar"><p>{LONG}</p></main>', LONG),
        (f'<article class="post-12 category-social"><p>{LONG}</p></article>', LONG),
        (f'<article class="comments-open comments"><p>{LONG}</p></article>', LONG),
        (f'<div class="content has-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<main><div class="sidebar"><article><p>{LONG}</p></article></div></main>', LONG),
        ('<article><header class="entry-header"><h1>Head</h1></header><p>x</p><section id="comments"><article>no</article></section><p>y</p></article>', "Head x y"),
        ('<article><header class="header"><h1>Head</h1></header><p>x</p></article>', "Head x"),
        ('<article><ul><li class="share">tweet<ul><li>no</ul><li>one<li>two</ul><p>x</p></article>', "one two x"),
        ('<article><ul><li>one<li class="share">tweet</ul><p>x</p></article>', "one x"),
        (f'<table><tr><td class="header">no<td>{LONG}</table><p>{LONG}</p>', f"{LONG} {LONG}"),
        ('<article><div><div class="ad">no<p>no</div><p>x</p></div></article><p>no</p>', "x"),
        ('<article><section><div class="ad">no</section><p>x</p></article>', "x"),
        ('<article><div class="social-share">no</div><div class="ad-slot-2">no</div><div data-id="share">yes</div></article>', "yes"),
    ],
)
def test_marks_leave_the_article(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div><p>{LONG}</p><div class="ad">no</div><p>Short last line.</p></div>', f"{LONG} Short last line."),
        (f'<body><div><p>{LONG}</p><div class="ad">no</div><p>One.</p><div class="ad">no</div><p>Two.</p></div><div>label</div>', f"{LONG} One. Two."),
        (f"<body><div><h1>Head</h1></div><div><p>{LONG}</p></div><div>label</div>", f"Head {LONG}"),
        (f"<body><div><div>Head</div><div><p>{LONG}</p></div><div>Last.</div></div><div>label</div>", f"Head {LONG} Last."),
        (f"<body><div>label</div><div><p>{LONG}</p><figure>Caption</figure><p>Short.</p></div>", f"{LONG} Caption Short."),
        (f"<body><p>{LONG}</p><div>nested</div><p>Short.</p>", f"{LONG} nested Short."),
        (f"<body><div>{LONG}</div><div>Short.</div><div>{LONG}</div>", f"{LONG} Short. {LONG}"),
    ],
)
def test_low_ranges_of_the_same_text_stay(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="sidebar-right"><p>{LONG}</p></div><article><p>x</p></article>', "x"),
        (f'<article><p>x</p><div class="sidebar-left"><p>{LONG}</p></div><p>y</p></article>', "x y"),
        (f'<body><div><p>{LONG}</p></div><div class="sidebar-right"><p>no {LONG}</p></div>', LONG),
    ],
)
def test_sidebars_are_left_out(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><p>x</p></article><div class="reader-comments"><p>{LONG}</p><article><p>{LONG}</p></article></div>', "x"),
        (f'<article><p>x</p><article><p>{LONG}</p></article><p>y</p></article>', "x y"),
        (f'<article><p>x</p><article><p>{LONG}</p><article><p>answer</p></article></article><article><p>no</p></article></article><p>no</p>', "x"),
        (f'<main><article><p>x</p></article></main><section class="more-stories"><article><p>{LONG}</p></article></section>', "x"),
        (f'<article><p>x</p></article><section class="more-stories"><h2>More</h2><article><p>{LONG}</p></article><article>no</article></section>', "x"),
    ],
)
def test_reader_comments_and_other_stories_are_left_out(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>x</p><p class="ad">no</p><p>y</p></article>', "x y"),
        ('<article><p>x<p class="ad">no<p>y</article>', "x y"),
        (f'<body><div><p>{LONG}</p><p class="advert">no</p><p>y</p></div>', f"{LONG} y"),
    ],
)
def test_adverts_in_paragraphs_are_left_out(page, text):
    assert H.main_text(page) == text
