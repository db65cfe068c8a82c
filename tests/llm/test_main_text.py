"""Main text of pages: against the pages' own article, hand-made pages and odd markup."""

import html
import re
import time

import numpy as np
from pyspark.sql import functions as F

from eventimpact.llm import main_text as M
from eventimpact.llm import queries
from llm_rows import SF


def article(page):
    """The blocks of the article of a given page, by plain splitting."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?p>|</?h1>", re.sub(r"</?b>|<br>", " ", inner))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op12_main_text(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


W = "word " * 30


def test_hand_made_pages():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) {{ "</p>" }}</script></head>
    <body class="has-sidebar"><header class="site"><h1>Site</h1><a href="/">Home</a></header><div id="cookie-banner"><p>{W}</p></div>
    <main><div class="post-header"><h1>A &amp; B&nbsp;&lt;c&gt;</h1></div><p>{W}<b>bo</b>ld <a href="x>y">link</a><br>end</p><p>Short.
    </p><!-- <p>no</p> --><form><input value="x"><p>{W}</p><button>Send</button></form><p title='a>"b'>tail {W}</main>
    <div class="articleSidebar"><p>{W}</p></div><div class="adBox">{W}</div><div id="comments"><p>{W}</p></div><footer><p>{W}</p></footer>"""
    w = W.strip()
    assert M.main_text(page).split("\n") == ["A & B <c>", f"{w} bold link end", "Short.", f"tail {w}"]


def test_pages_without_semantic_tags():
    page = f"<div><a>Home</a></div><div><a>News</a></div><h1>Title of it</h1><div>{W}</div><div>{W}</div><div><a>More</a> <a>less</a></div>"
    assert M.main_text(page).split("\n") == ["Title of it", W.strip(), W.strip()]
    assert M.main_text("plain text " * 20) == ("plain text " * 20).strip()


def test_tree_learns_the_table():
    x, y = M.labelled()
    assert ((M.shares(M.tree(), x) >= 0.5) == y).mean() > 0.97
    rng = np.random.default_rng(3)
    hits = []
    for _ in range(20):                                            # held out a fifth of the table
        out = rng.random(len(y)) < 0.2
        hits.append((M.shares(M.grow(x[~out], y[~out]), x[out]) >= 0.5) == y[out])
    assert np.concatenate(hits).mean() > 0.85


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "<p>"), (5, "<script>never ends " + W), (6, f"<article><p>{W}&#0;&#xD800;&bogus;</p"),
            (7, f"<article>{W}<!-- never ends {W}"), (8, f"</div></p></article><article><p>{W}</nav>{W}</p></article>"), (None, f"<p>{W}</p>"),
            (8, f"<p>{W}</p>"), (9, "<article>" + "<div>" * 20000 + W), (10, f"<article><p>{W}<a href='x>{W}</p>")]
    df = spark.createDataFrame([(i, "u", h, 3, "clash") for i, h in rows], "page_id long, url string, html string, N_CHARS int, Text string")
    got = M.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.text) for r in got}
    w = W.strip()
    for i in (1, 2, 3, 4, 5):
        assert (i, "") in by
    assert {(6, f"{w} ��&bogus;"), (7, w), (8, f"{w}\n{w}"), (8, w), (None, w), (9, w)} <= by
    assert [c.lower() for c in M.extract(df).columns] == ["page_id", "url", "text", "n_chars"]
    assert M.extract(df.limit(0)).count() == 0
    assert M.extract(df, keep=["page_id", "url"]).columns == ["page_id", "url", "text", "n_chars"]


def test_long_pages_take_linear_time():
    def seconds(n):
        page = "<article>" + "".join(f"<p>{W}<a href='{i}'>x</a></p>" for i in range(n)) + "<p title=\"" + "<b '" * n
        t0 = time.perf_counter()
        assert len(M.main_text(page)) >= n * len(W)
        return time.perf_counter() - t0
    seconds(100)
    assert seconds(8000) < 12 * max(seconds(2000), 0.02)
