import html
import re
import time

import pytest

from poolwatch.llm import pages


@pytest.fixture(scope="module")
def tree():
    return pages.train(*pages.table())


def test_sample_table(spark):
    """The test pages hold their text in one article element, cut here by its paragraphs."""
    rows = pages.op7_pages(spark, "/root/testdata/sf0.001").collect()
    source = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id].html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_every_block_of_the_small_pages(tree):
    x, y = pages.table()
    assert (pages.verdicts(tree, x) == y).mean() >= 0.98


LONG = "The council met again to speak about the bridge that has been closed since the flood of last autumn"
PAGES = {
    "text in an article": (f"<nav>Home</nav><article><h1>Bridge</h1><p>{LONG}</p><p>So.</p></article><footer>Imprint</footer>",
                           f"Bridge\n\n{LONG}\n\nSo."),
    "references and white space": ("<article><p>a &amp; b&nbsp;&#233;\n\t&lt;tag&gt; &notit; &copy</p></article>", "a & b é <tag> ¬it; ©"),
    "scripts, styles, comments": (f"<article><script>if (a < b) '</p>'</script><style>p{{}}</style><!-- <p>x</p> --><p>{LONG}</p></article>", LONG),
    "quoted brackets": (f'<article><p title="a > b">{LONG}</p></article>', LONG),
    "adverts and forms inside": (f'<article><p>{LONG}</p><div class="ad-box ads">Buy now</div><form>Name <input></form><p>{LONG}</p></article>',
                                 f"{LONG}\n\n{LONG}"),
    "reader comments": (f'<main><p>{LONG}</p><section id="comments"><h2>Comments</h2><p>{LONG}</p></section></main>', LONG),
    "cookie notice": (f'<div role="dialog">We use cookies</div><div class="cookie-notice"><p>{LONG}</p></div><article><p>{LONG}</p></article>', LONG),
    "hidden": (f'<article><p hidden>no</p><p style="display: none">no</p><p aria-hidden="true">no</p><p>{LONG}</p></article>', LONG),
    "plain": (f"<div><a href=1>Home</a> <a href=2>News</a></div><p>{LONG}</p><p>{LONG}</p><div><a href=3>Back to the top</a></div>", f"{LONG}\n\n{LONG}"),
    "unclosed": (f"<article><p><b>One two<br><p>{LONG}<p>Next", f"One two\n\n{LONG}\n\nNext"),
    "cut in a tag": (f"<article><p>{LONG}</p><p cla", LONG),
    "cut in a script": (f"<article><p>{LONG}</p><script>var a = '<p>no</p>'", LONG),
    "bare signs": (f"<article><p>1 < 2 and {LONG}</p></article>", f"1 < 2 and {LONG}"),
    "upper case": (f"<NAV>Home</NAV><ARTICLE><P>{LONG}</P></ARTICLE>", LONG),
    "nothing": ("<html><body></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(tree, name):
    page, want = PAGES[name]
    assert pages.main_text(page, tree) == want


OPEN = {
    "head without its end": f"<html><head><meta charset=utf-8><title>x</title><script>'<p>no</p>'</script><body><article><p>{LONG}</p></article>",
    "head with its end": f"<head><title>x</title></head><body><article><p>{LONG}</p></article>",
    "self-closed drawing": f'<article><svg class="i" viewBox="0 0 1 1"/><p>{LONG}</p></article>',
    "drawing": f"<article><svg><path d='M0'/><text>no</text></svg><p>{LONG}</p></article>",
    "drawing without its end": f"<article><svg viewBox='0 0 1 1'><path d='M0'/><p>{LONG}</p></article>",
    "self-closed frame": f'<article><iframe src="x" /><p>{LONG}</p></article>',
    "class of the page": f'<div class="content has-sidebar"><article class="post category-legal"><p>{LONG}</p></article></div>',
    "comments open": f'<div class="site comments-open"><article><p>{LONG}</p></article><div class="comments"><p>{LONG} not</p></div></div>',
    "hint around the article": f'<div id="social"><nav>Home</nav><article><p>{LONG}</p><div class="related">no</div></article></div>',
}


INLINE = {
    "button": f"<article><p>{LONG} <button>Share</button></p></article>",
    "label": f"<article><p><label>Mail</label>{LONG}</p></article>",
    "advert in a line": f'<article><p>{LONG[:20]}<span class="ad">Buy <b>now</b></span>{LONG[20:]}</p></article>',
    "hidden in a line": f"<article><p><span hidden>secret</span>{LONG}</p></article>",
    "camel case": f'<article><div class="adBox">Buy now</div><p>{LONG}</p><div id="relatedPosts"><p>{LONG} no</p></div></article>',
    "nested drawings": f"<article><svg><svg><text>a</text></svg><text>b</text></svg><p>{LONG}</p></article>",
    "open drawing ahead of a closed one": f"<article><svg class=x><p>{LONG}</p><svg><text>b</text></svg></article>",
    "comment with an odd end": f"<!-- x --!><article><!--> <!---> <p>{LONG}</p></article>",
}


@pytest.mark.parametrize("name", INLINE)
def test_what_is_inside_a_line(tree, name):
    assert pages.main_text(INLINE[name], tree) == LONG


def test_a_teaser_does_not_displace_the_text(tree):
    page = f"<div><article><p>More news.</p></article></div><h1>Bridge</h1>{f'<p>{LONG}</p>' * 4}"
    assert pages.main_text(page, tree).endswith("\n\n".join([LONG] * 4))


@pytest.mark.parametrize("part", ["<svg>", "<iframe/>", "<iframe>", "<div>", "<b>", "<li>", "</section>", "<!-- x --!>", "<a href=1>x", "<script/>", "<math/>x", "<p><span hidden>x"])
def test_time_grows_with_the_page(tree, part):
    page = part * (2_000_000 // len(part)) if part in ("<svg>", "<iframe/>", "<!-- x --!>") else part * (300_000 // len(part))
    began = time.process_time()
    pages.main_text(f"<article><p>{LONG}</p>{page}", tree)
    assert time.process_time() - began < 10


@pytest.mark.parametrize("name", OPEN)
def test_open_elements_and_wrappers(tree, name):
    assert pages.main_text(OPEN[name], tree) == LONG


def test_edges(spark, tree):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (None, "u", f"<article><p>{LONG}</p></article>", "x"),
            (3, "u", f"<article>{'<p>' + LONG + '</p>'}</article>" * 1, "x"), (3, "u", "<div>" * 20_000, "x"),
            (4, "u", "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(df).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert [r.n_chars for r in got if r.page_id == 4] == [20_000 * (len(LONG) + 2) - 2]
    assert pages.extract(df.filter("false")).count() == 0
