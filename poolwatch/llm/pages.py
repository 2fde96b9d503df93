"""Operator 7, HTML extraction by text blocks and a decision tree.

A page is read once into flat blocks, the text between two block-level tags. Each block is described
by its words and link density, those of its neighbours, and where it stands: inside an element that
holds no main text, beside an article element, or as a heading. A decision tree, trained on the
small labelled table below, tells main text from the rest.

An article element tells what stands beside it only where it holds a good part of the page's words; a
teaser does not. Inside a line, elements that hold no main text are left out and the line stays one block.

Defined results: a null or empty page and a page without main text give the empty string; an
unfinished tag at the end is dropped; an unclosed script or comment lasts to the end, an unclosed
drawing is its tag alone; a head needs no end tag; time grows with the length of a page, whatever is open in it; repeated rows
and null ids are extracted like any other; an empty table gives no rows; extra columns are not read.
"""

import html
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
RAW = "script|style|noscript|template|iframe|object|textarea|select|title"
# The same, but a tag of these without an end of its own, or that ends in />, is the whole element.
DRAWN = "svg|math"
# An article holds the page's text if at least one in so many words stands in it.
HOLDS = 4
NOT_MAIN = frozenset("nav footer aside form button dialog menu label legend fieldset".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|promos?|promotion|sponsor(?:ed)?|side-?bar|menu|nav|navbar|"
    r"navigation|bread-?crumbs?|footer|site-?header|page-?header|top-?bar|masthead|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|"
    r"overlay|newsletter|subscribe|subscription|paywall|share|sharing|social|comments?|comment-?list|discussion|disqus|replies|reply|"
    r"related|recommended|recommendations|read-?more|widget|login|sign-?up|sign-?in|register|search|pager|pagination|tool-?bar|"
    r"copyright|legal|disclaimer|terms|tags|byline-?links|skip-?link|hidden|print-?only)(?:$|[\s_-])",
    re.I,
)
ROLES = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|form|dialog|alertdialog|alert|menu|menubar|toolbar)\b", re.I)
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
_RAW, _DRAWN = frozenset(RAW.split("|")), frozenset(DRAWN.split("|"))
_RAW_ENDS = re.compile(rf"</({RAW})\s*>", re.I)
_DRAWN_TAGS = re.compile(rf"<(/?)({DRAWN})\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# Class names that tell what a page has or is filed under, not what the element is.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:(?:has|with|without|no|category|tag)-\S+|\S*comments?-(?:open|closed))(?=\s|$)", re.I)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/\"'>]+)")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "a": {"a"}}
_LISTS = frozenset("ul ol dl table menu select".split())


@dataclass
class Block:
    text: str
    words: int
    links: float
    outside: bool
    inside: bool
    heading: bool


def _hinted(tag: str, attrs: str) -> bool:
    if tag in ("html", "head", "body", "main") or not attrs or attrs.isspace():
        return False
    for name, value, bare in _ATTR.findall(attrs):
        name, value = (name or bare).lower(), value.strip("\"'")
        if name in ("class", "id"):
            value = _CAMEL.sub("-", value)
        if name in ("class", "id") and HINT.search(_ABOUT.sub("", value) if name == "class" else value) or name == "role" and ROLES.search(value) or name == "hidden":
            return True
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class _Ends:
    """Where elements whose content is no text end. Each kind of tag is looked for once a page."""

    def __init__(self, page: str):
        self.raw: dict[str, list[int]] = {}
        for m in _RAW_ENDS.finditer(page):
            self.raw.setdefault(m[1].lower(), []).append(m.end())
        self.drawn: dict[int, int] = {}
        open_: dict[str, list[int]] = {}
        for m in _DRAWN_TAGS.finditer(page):
            kind = open_.setdefault(m[2].lower(), [])
            if not m[1] and not m[3].endswith("/"):
                kind.append(m.start())
            elif m[1] and kind:
                self.drawn[kind.pop()] = m.end()
        self.size = len(page)

    def after(self, m: re.Match, tag: str) -> int:
        """The place behind the element that begins with this tag."""
        if tag in _DRAWN:
            return self.drawn.get(m.start(), m.end())
        ends = self.raw.get(tag, ())
        at = bisect_right(ends, m.end())
        if at < len(ends):
            return ends[at]
        return m.end() if m["attrs"].endswith("/") else self.size


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    # Open elements: tag, whether they or one around them hold no main text, whether inside an article,
    # whether they hold none by their tags, by these and the hints inside the article alone, whether in
    # a link, and whether in a line's element that holds no main text.
    stack: list[tuple[str, bool, bool, bool, bool, bool, bool]] = [("", False, False, False, False, False, False)]
    opened: Counter[str] = Counter()
    ends: _Ends | None = None
    within: list[bool] = []
    parts: list[tuple[str, bool]] = []
    heading = ""

    def close() -> None:
        text = "".join(p for p, _ in parts)
        if text and not text.isspace():
            linked = sum(len(html.unescape(p).split()) for p, link in parts if link)
            words = html.unescape(text).split()
            if words:
                _, outside, inside, _, own, _, _ = stack[-1]
                within.append(own)
                out.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), outside, inside, bool(heading)))
        parts.clear()

    def leave(place: int) -> None:
        opened.subtract(t for t, *_ in stack[place:])
        del stack[place:]

    def read(begin: int, to: int) -> None:
        if to > begin and not stack[-1][6]:
            parts.append((page[begin:to], stack[-1][5]))

    def close_open(tags: set, barrier: frozenset) -> None:
        """Ends an open element of these tags, unless another list or section began in it."""
        if not any(opened[t] for t in tags):
            return
        for place in range(len(stack) - 1, 0, -1):
            if stack[place][0] in tags:
                leave(place)
                return
            if stack[place][0] in barrier or not barrier and stack[place][0] in BLOCKS:
                return

    end = 0
    for m in _TOKEN.finditer(page):
        if m.start() < end:
            continue  # inside an element without text
        read(end, m.start())
        end = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW or tag in _DRAWN:
            if not m["end"]:
                ends = ends or _Ends(page)
                end = ends.after(m, tag)
            continue
        is_block = tag in BLOCKS
        if is_block:
            close()
            heading = ""
        elif tag == "br":
            parts.append((" ", False))
        if tag in VOID:
            continue
        if m["end"]:
            for place in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[place][0] == tag:
                    leave(place)
                    break
                if not is_block and stack[place][0] in BLOCKS:
                    break
            continue
        if is_block:
            close_open({"p"}, frozenset())
        if tag in _CLOSES:
            close_open(_CLOSES[tag], _LISTS)
        _, outside, inside, by_tag, own, linked, skipped = stack[-1]
        named = tag in NOT_MAIN or tag == "header" and not inside
        apart = named or _hinted(tag, m["attrs"])
        opens = tag in ("article", "main") and not inside
        stack.append((tag, outside or apart, inside or opens, by_tag or named, (by_tag if opens else own) or apart,
                      linked or tag == "a", not is_block and (skipped or apart)))
        opened[tag] += 1
        if tag[0] == "h" and tag[1:].isdigit():
            heading = tag
    read(end, len(page))
    close()
    # Hints around an article do not count where nothing else on the page is left.
    if all(b.outside for b in out):
        for b, own in zip(out, within):
            b.outside = own or not b.inside
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "inside", "beside", "heading")


def features(page_blocks: list[Block]) -> np.ndarray:
    n = len(page_blocks)
    here = [b for b in page_blocks if not b.outside]
    held = HOLDS * sum(b.words for b in here if b.inside) >= sum(b.words for b in here) > 0
    own = np.array([(b.words, b.links) for b in page_blocks], float).reshape(n, 2)
    edge = np.zeros((1, 2))
    flags = np.array([(b.outside, b.inside, held and not b.inside, b.heading) for b in page_blocks], float).reshape(n, 4)
    return np.hstack([own, np.vstack([edge, own[:-1]])[:n], np.vstack([own[1:], edge])[:n], flags])


# The labelled table: pages as blocks, + for main text and - for the rest.
_LONG = "the harbour was rebuilt after the storm and the town council opened the new quay to the public in early spring"
_MID = "ships from many countries call at the port each week"
TABLE = [
    f"""<nav><a href=1>- Home</a></nav><nav><a href=2>- All news</a></nav><div class=ad>- Buy one and get one free at our shop this week only</div>
    <article><h1>+ The harbour opens</h1><p>+ {_LONG}</p><p>+ Read <a href=3>the whole report</a> of the council, which {_MID}</p>
    <p>+ It rained.</p><p>+ {_LONG}</p></article><footer>- All rights reserved by the publisher of this page</footer>""",
    f"""<header>- The Daily Page</header><div><a href=1>- Sport</a></div><div><a href=2>- Weather today</a></div>
    <div><h2>+ A port in spring</h2></div><div>+ {_LONG}</div><div>+ {_MID}</div><div>+ {_LONG}</div>
    <div><a href=3>- Older entries</a></div><div><a href=4>- Newer entries</a></div><div>- Imprint</div>""",
    f"""<div><a href=1>- Home</a> <a href=2>Shop</a></div><h1>+ News of the port</h1><p>+ {_LONG}</p><ul><li>+ {_MID}</li>
    <li>+ {_MID} and <a href=3>leave</a> again</li></ul><p>+ {_LONG}</p><section id=comments><p>- {_LONG}</p><p>- Well said!</p></section>""",
    f"""<main><h1>+ Quay</h1><p>+ {_LONG}</p><aside>- {_MID}</aside><p>+ {_MID}</p><blockquote>+ {_LONG}</blockquote>
    <form>- Sign up for letters from the harbour every week</form></main><div>- {_MID}</div><div>- {_LONG}</div>""",
    f"""<article><p>+ Short.</p><p>+ <a href=1>A source</a></p><p>+ Shorter.</p><div class=related>- {_LONG}</div></article><p>- Tail</p>""",
    f"""<div class="cookie-notice">- We use cookies to make this page better for all readers, {_MID}</div><div>+ {_LONG}</div>
    <div>+ {_LONG}</div><div class=sidebar><p>- {_LONG}</p><p>- {_MID}</p></div><p>- Contact</p>""",
    """<p>- Login</p><p><a href=1>- Register here</a></p><p><a href=2>- Forgot your password</a></p><p>- Powered by software</p>""",
    f"""<div>- <a href=1>One</a> <a href=2>two</a> <a href=3>three</a> <a href=4>four</a></div><p>+ {_LONG}</p><p>+ {_MID}</p>
    <p>+ {_LONG}</p><div>- <a href=5>First story of the week</a></div><div>- <a href=6>Second story of the week in the harbour</a></div>""",
    f"""<article><header><h1>+ Title in a header</h1></header><h2>+ Part</h2><p>+ {_MID}</p><h2>+ Other part</h2><p>+ {_LONG}</p>
    <table><tr><td>+ Ships</td><td>+ 12</td></tr></table><div class="share">- Share this</div></article>""",
    f"""<nav><a href=1>- Home</a></nav><article><h1>+ Ends the page</h1><p>+ {_MID}</p><p>+ Short end.</p></article>""",
    f"""<article><p>+ {_LONG}</p><p>+ Then this.</p><p>+ {_MID}</p></article>""",
    """<article><p>+ Only this.</p></article>""",
    f"""<article><h1>+ Ahoy</h1><p>+ {_LONG}</p><p>+ <a href=1>See the list of ships</a></p><p>+ Done.</p></article>""",
    """<nav><a href=1>- Home</a></nav><article><h1>+ A name</h1></article><footer>- Imprint</footer>""",
    f"""<div class=menu><a href=1>- Start</a></div><h1>+ A plain page</h1><p>+ {_LONG}</p><p>+ {_LONG}</p>""",
    f"""<h1>+ Plain</h1><p>+ {_LONG}</p><p>+ Yes.</p><p>+ {_LONG}</p><p>+ {_MID}</p>""",
    f"""<p>+ {_LONG}</p>""",
    f"""<main><p>+ <a href=1>Linked</a></p><p>+ <a href=2>Linked as well</a></p></main><div><a href=3>- Top</a></div>""",
    f"""<div class="banner">- {_LONG}</div><div class="popup">- {_MID}</div><aside><p>- {_LONG}</p></aside><p>+ {_LONG}</p><p>+ {_LONG}</p>""",
]


def table() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in TABLE:
        read = blocks(page)
        rows.append(features(read))
        labels += [b.text[0] == "+" for b in read]
    x = np.vstack(rows)
    x[:, [0, 2, 4]] -= (x[:, [0, 2, 4]] > 0)  # the label is no word
    return x, np.array(labels)


def train(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """Decision tree by Gini impurity: (feature, cut, tree up to the cut, tree above) or a verdict."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() >= y.size)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            cost = sum(s.sum() * p * (1 - p) for s in (low, ~low) if (p := y[s].mean()) is not None)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(cut), low
    if best is None:
        return bool(2 * y.sum() >= y.size)
    _, f, cut, low = best
    return f, cut, train(x[low], y[low], depth - 1), train(x[~low], y[~low], depth - 1)


def verdicts(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    below = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[below], out[~below] = verdicts(low, x[below]), verdicts(high, x[~below])
    return out


def main_text(page: str | None, tree) -> str:
    read = blocks(page or "")
    if not read:
        return ""
    kept = verdicts(tree, features(read))
    return "\n\n".join(b.text for b, k in zip(read, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    tree = train(*table())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [main_text(p, tree) for p in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    columns = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_pages(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
