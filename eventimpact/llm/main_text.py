"""Main text of web pages: flat text blocks, shallow features of a block and its neighbours, a decision tree."""

from __future__ import annotations

import functools
import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

TAG = re.compile(r"""<!--.*?(?:-->|\Z)
    |<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S | re.X)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style noscript template iframe textarea title svg math object audio video canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
SIBLINGS = frozenset("p li dt dd tr td th option".split())       # a new one ends the one before
BAD_TAGS = frozenset("nav aside footer form dialog menu button select fieldset label datalist".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BAD_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header banner masthead cookie cookies consent gdpr "
                      "notice alert popup modal overlay newsletter subscribe subscription signup login advert advertisement advertising ad "
                      "ads adv sponsor sponsored promo promotion share sharing social related recommended comment comments disqus respond "
                      "reply replies widget toolbar pagination pager copyright skip search".split())
GOOD_WORDS = frozenset("article content main post entry story body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = ("container", "heading", "words", "link density", "words before", "link density before",
            "words after", "link density after")


def hint(name: str, attrs: str, in_article: bool) -> int:
    """What an element says of its content: -1 page furniture, 1 article, 0 nothing."""
    role, names = "", []
    if name not in ("html", "body"):
        for m in ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                role = value.strip().lower()
            else:
                names += value.split()
    if name in BAD_TAGS or role in BAD_ROLES or (name == "header" and not in_article):
        return -1
    good = name in ("article", "main") or role in ("main", "article")
    for token in names[:64]:
        words = [w.lower() for w in WORD.findall(token[:200])]
        if words and words[0] in ("has", "no", "with", "without", "is"):
            continue
        bad = {w for w in words if w in BAD_WORDS}
        nice = any(w in GOOD_WORDS for w in words)
        if bad and not (bad == {"header"} and (nice or in_article)):
            return -1
        good = good or (nice and not bad)
    return 1 if good else 0


def blocks(html: str) -> list[tuple[str, int, int, int, int]]:
    """Flat text blocks of a page in order: (text, words, words in links, container, heading). The container is -1
    anywhere in page furniture, else 1 in an article, else 0. Inline tags, links and line breaks do not end a block,
    any other tag does."""
    out, text, links = [], [], []
    stack, opened, bad, good = [], {}, 0, 0                      # open containers (name, hint), how many of each name
    link, pos = None, 0

    def flush():
        nonlocal text, links
        joined = " ".join("".join(text).split())
        if joined:
            n = joined.count(" ") + 1
            heading = any(x[0] in HEADINGS for x in stack[-3:])
            out.append((joined, n, min(n, len("".join(links).split())), -1 if bad else int(good > 0), int(heading)))
        text, links = [], []

    def pop():
        nonlocal bad, good, link
        name, h = stack.pop()
        opened[name] -= 1
        bad, good = bad - (h < 0), good - (h > 0)
        if link is not None and len(stack) < link:
            link = None

    def data(s):
        if s:
            s = references.unescape(s)
            text.append(s)
            links.append(s if link is not None else " ")

    while m := TAG.search(html, pos):
        data(html[pos:m.start()])
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not end and not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, pos)
                pos = close.end() if close else len(html)
            continue
        if name in INLINE:
            if name == "a":
                link = None if end else len(stack)
            elif name == "br":
                text.append(" ")
                links.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if end:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in SIBLINGS)):
            pop()
        h = hint(name, attrs, good > 0)
        stack.append((name, h))
        opened[name] = opened.get(name, 0) + 1
        bad, good = bad + (h < 0), good + (h > 0)
    data(html[pos:])
    flush()
    return out


def features(page: list[tuple]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    x = np.zeros((len(page), len(FEATURES)))
    if page:
        words = np.array([b[1] for b in page], float)
        density = np.array([b[2] for b in page], float) / words
        x[:, :2] = [b[3:5] for b in page]
        x[:, 2], x[:, 3] = words, density
        x[1:, 4], x[1:, 5] = words[:-1], density[:-1]
        x[:-1, 6], x[:-1, 7] = words[1:], density[1:]
    return x


# The labelled table: blocks of small pages. A number stands for so many words, the sign before the first number of a
# block says whether the block belongs to the main text.
LABELLED = (
    "<nav><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></nav><div class='ad'>-8</div><article><h1>+7</h1><p>+12</p>"
    "<p>+80</p><p>+1</p><p>+35</p></article><footer>-9</footer>",
    "<header><div>-2</div><a>-1</a><a>-1</a></header><main><h1>+5</h1><p>+40 <a>2</a> 15</p><h2>+3</h2><p>+60</p><ul><li>+6</li>"
    "<li>+4</li></ul></main><aside><h3>-2</h3><p>-25</p><a>-6</a></aside><footer><p>-12</p><a>-1</a></footer>",
    "<article><h1>+9</h1><p>+2</p><p>+1</p><p>+3</p></article><footer>-30</footer>",
    "<div class='cookie-notice'><p>-40 <a>2</a></p></div><article><p>+25</p><blockquote>+18</blockquote><p>+50</p><div class='share'>"
    "<a>-1</a></div></article><section id='comments'><h2>-2</h2><div><b>-2</b></div><p>-45</p><p>-20</p></section>",
    "<div><a>-2</a></div><div><a>-3</a></div><div><a>-1</a></div><h1>+8</h1><div>+55</div><div>+70 <a>3</a></div><div>+30</div>"
    "<div>-5 <a>4</a></div><div><a>-2</a></div><div>-6</div>",
    "<table><tr><td><a>-1</a></td><td><a>-1</a></td></tr><tr><td>+90</td></tr><tr><td>+45</td></tr><tr><td>+24</td></tr><tr><td>-4</td></tr>"
    "<tr><td><a>-3</a></td></tr></table>",
    "<p>+120</p>", "<p>+18</p>", "<div>+30</div><div>+9</div><div>+40</div>", "<h1>+4</h1><p>+22</p><p>+7</p><p>+31</p><p>-3</p>",
    "<div><a>-1</a></div><div>-2</div><div><a>-4</a></div><div>-3</div><div><a>-2</a></div>", "<p><a>-6</a></p>", "<p>-2</p>",
    "<form><p>-25</p><label>-2</label></form><div class='content'><h2>+6</h2><p>+3</p><p>+44</p><p><a>+5</a></p><p>+38</p></div>"
    "<div class='sidebar'><p>-30</p></div><div class='newsletter'>-22</div>",
    "<article><h1>+6</h1><p>+33</p><ul><li><a>-3</a></li><li><a>-4</a></li><li><a>-2</a></li><li><a>-3</a></li></ul></article><aside>-60</aside>",
    "<div><a>-2</a> <a>2</a> <a>1</a></div><h1>+6</h1><p>+28</p><p>+11</p><p>+42 <a>1</a></p><p>+9</p><p>+36</p><p>-7</p><div><a>-3</a></div>",
    "<div class='ad'>-55</div><div class='ad'>-4</div><article><h1>+3</h1><p>+4</p><p>+65</p><p>+2</p></article><div class='related'>"
    "<p>-15</p></div>",
    "<article><h1>+5</h1><p>+1</p><p>+4</p></article>", "<main><h1>+2</h1></main>", "<article><p>+3</p></article>", "<div>-7</div><div>-5</div>",
    "<div>-9</div><nav><a>-1</a></nav><article><header><h1>+6</h1><p>+5</p></header><p>+21</p><p>+2</p></article>",
    "<article><h1>+2</h1></article><div>-6</div>", "<div>-3</div><main><p>+2</p><p>+1</p></main><div>-11</div>",
    "<div class='ad'>-7</div><p>+60</p><aside>-6</aside><p>+24</p><div class='promo'>-8</div><p>+33</p>", "<header>-6</header><p>+40</p>",
    "<div class='notice'>-5</div><h1>+6</h1><p>+28</p><div class='ad'>-3</div><p>+19</p><div class='widget'>-4</div>",
    "<nav>-4</nav><div class='banner'>-9</div><h1>+4</h1><div>+35</div><aside>-7</aside><div>+50</div><footer>-5</footer><footer>-20</footer>",
    "<div><a>-1</a></div><h1>+3</h1><div>+30</div><h2>+2</h2><div>+26</div><div>-2</div>",
    "<div class='login'>-6</div><article><p>+42</p><div class='ad'>-5</div><p>+23</p><div class='share'>-3</div><p>+70</p></article>",
    "<article><p>+30</p><p>+30</p></article>", "<p>+26</p><p>+40</p><p>+12</p>", "<article><p>+16</p><p>+3</p></article>",
    "<div>+35</div><div>+20</div>", "<article><p>+8</p><p>+25</p></article>", "<div>-2</div><div>+60</div>", "<div>-4</div><div>-3</div>",
    "<div>-3</div><div><a>-5</a></div><div>-4 <a>3</a></div><div>+48</div><div>+21</div><div><a>-4</a></div><div>-2</div>",
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED."""
    xs, ys = [], []
    for page in LABELLED:
        found = blocks(re.sub(r"(?<!<h)(?<!</h)\d+", lambda m: " ".join(["w"] * int(m[0])), page))
        xs.append(features(found))
        ys += [b[0][0] == "+" for b in found]
    return np.concatenate(xs), np.array(ys, int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple:
    """Binary decision tree by Gini impurity: (feature, threshold, left, right) or a share of label 1; thresholds lie
    halfway between values, ties go to the first feature."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(v))
        cut = (v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least)
        a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(v) - n)
        cost = np.where(cut, n * a * (1 - a) + (len(v) - n) * b * (1 - b), np.inf)
        i = int(cost.argmin()) if len(cost) else 0
        if len(cost) and np.isfinite(cost[i]) and (best is None or cost[i] < best[0] - 1e-12):
            best = (cost[i], f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return (share,)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def shares(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = shares(tree[2], x[left]), shares(tree[3], x[~left])
    return out


@functools.lru_cache(1)
def tree() -> tuple:
    return grow(*labelled())


def main_text(html: str | None, model: tuple | None = None) -> str:
    """The main text of one page: its content blocks, joined by line feeds."""
    page = blocks(html or "")
    keep = shares(model or tree(), features(page)) >= 0.5
    return "\n".join(b[0] for b, k in zip(page, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the page) plus ``text``, the main text, and ``n_chars``, its code points.

    A page is cut into flat blocks; scripts, styles, comments and other raw elements are dropped, character references
    decoded, white space in a block made one space. A block is described by its words and link density, those of the
    blocks before and after it, and whether its containers (tag, role, class, id) speak for an article or for page
    furniture; a decision tree, grown from LABELLED, says whether it is main text.

    A null or empty page has an empty text; so has a page of which no block is main text. Broken markup is read as
    far as it goes: an element without an end lasts to the end of its container, a tag cut off at the end is dropped.
    Pages are whole, however long. Rows that repeat stay; columns named ``text`` or ``n_chars`` are replaced.
    """
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep

    def make():
        model = tree()
        return lambda texts: [pa.array([main_text(t, model) for t in texts.to_pylist()], pa.string())]

    got = map_text(pages, html_col, [("text", "string")], make, [c for c in keep if c.lower() != "n_chars"])
    return got.withColumn("n_chars", F.length("text").cast("long"))
