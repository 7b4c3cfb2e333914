import pytest

from equitally.llm.extract import extract, main_text, smoothed, threshold

LONG = "This is a paragraph of the article with quite a few words in it, and they go on for some time."
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="top">Site <b>name</b></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>{0}<form><p>Your mail</p><input></form>
<section id="comments"><p>{1}</p></section><footer>&copy; x</footer></body></html>"""


def test_article_without_everything_around_it():
    article = f"<article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>Short.</p><ul><li>a<li>b</ul><div class='ad'>buy</div><p>x&nbsp;\n y<!-- no --></article>"
    assert main_text(PAGE.format(article, LONG * 5)) == f"Head & line\n{LONG}\nShort.\na\nb\nx y"


def test_page_without_article_takes_the_content_region():
    body = "".join(f"<div><p>{LONG} {i}</p></div>" for i in range(4)) + "<p>Short.</p>" + f"<p>{LONG} 9</p>"
    assert main_text(PAGE.format(body, LONG)) == "\n".join([f"{LONG} {i}" for i in range(4)] + ["Short.", f"{LONG} 9"])


@pytest.mark.parametrize("html", [None, "", "   ", "<p></p>", "<nav>a</nav>", "<!-- x", "<", "<script>a</script>"])
def test_nothing_to_extract(html):
    assert main_text(html) in ("", "<")


def test_unclosed_and_crossed_tags():
    assert main_text(f"<body><article><p><b>{LONG}<p><i>two</b> three<table><tr><td>c<td>d</table>end") == f"{LONG}\ntwo three\nc\nd\nend"
    assert main_text("<p>only " + "<span>" * 5000 + "x") == "only x"


def test_smoothing_and_threshold():
    import numpy as np
    flat = smoothed(np.full(7, 3.0))
    assert abs(flat - 3).max() < 1e-9
    assert 2 < threshold(np.array([1.0, 1.2, 0.9, 9.0, 10.0])) < 9


def test_rows_pass_through(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<p>x</p>", "b"), (1, None, None, "a"), (2, "v", "<p>" + "w " * 50_000, "c")],
                                  "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(pages).collect()), key=str)
    want = [(1, None, "", 0), (1, None, "", 0), (2, "v", ("w " * 50_000).strip(), 99_999), (None, "u", "x", 1)]
    assert got == sorted(want, key=str)
    assert extract(pages.limit(0)).count() == 0


def test_given_pages_equal_their_article_element(spark):
    import html as h
    import re
    for r in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(
            spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_any_markup_fragment_has_a_defined_text():
    import random

    rng = random.Random(9)
    bits = ["<![", "<![foo[bar]]>", "<![CDATA[x]]>", "]]>", "<!x", "<!", "<!-", "<!--", "-->", "<?", "?>", "</", "<p", "<p>", ">", "a", " ", "&", "&#", "&#x110000;",
            "&lt", "<!DOCTYPE", "<script>", "</script", "<div class=", "'", '"', "/>", "<1", "</ p>", "<a b=c", "\x00", "<![if IE]>", "<![endif]>", "<svg>", "<!ELEMENT [", "[", "]"]
    for _ in range(4000):
        assert isinstance(main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))), str)
    assert main_text(f"<![foo[bar]]><article><p>{LONG}</article>") == LONG


@pytest.mark.parametrize("page", [f'<div class="content no-sidebar"><p>{LONG}</div>', f'<div id="page" class="has-sidebar"><article><p>{LONG}</article></div>',
                                  f'<article><div class="entry-header"><h1>{LONG}</h1></div></article>', f'<article><section class="related-work"><p>{LONG}</section></article>'])
def test_states_and_parts_of_the_article_are_no_marks(page):
    assert main_text(f"<body>{page}<div class='sidebar-left'>x</div><section class='related-posts'>y</section></body>") == LONG
