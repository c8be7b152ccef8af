from __future__ import annotations

import html as html_
import re
import time

import pytest
from pyspark.sql import functions as F

from gridloom.llm import extraction, markup
from gridloom.llm.extraction import main_text

from ..conftest import SMALL

PROSE = "It was the best of times for all of us, and it was not the worst of them in the end, as they had said before."
LISTING = "Zxqv wrtk plmb ghjk " * 5

CASES = {
    "plain text": ("just a line &amp; more", "just a line & more"),
    "nothing": ("", ""),
    "markup only": ("<html><head><title>t</title><style>p{}</style></head><body><script>var t='</p>';</script><!-- x --></body>", ""),
    "article": (f"<nav><a href=/>Home</a></nav><div class=ad>{PROSE}</div><article><h1>T&eacute;</h1><p>{PROSE}<p>Short.</article><footer>&copy; x</footer>", f"Té\n\n{PROSE}\n\nShort."),
    "short article only": ("<nav>menu of the site</nav><article><p>Three words only</article><footer>foot</footer>", "Three words only"),
    "apart inside": (f"<article><header><h1>Title</h1></header><p>{PROSE}</p><aside>{PROSE}</aside><div class='share-buttons'>Share</div><form><p>{PROSE}</p></form><section id=comments><article class=comment><p>{PROSE}</p></article></section><footer>by x</footer><p>End.</p></article>", f"Title\n\n{PROSE}\n\nEnd."),
    "page parts": (f"<header><h1>Site</h1><p>{PROSE}</p></header><main><p>{PROSE}</p></main><div class=sidebar><p>{PROSE}</p></div><div class='cookie-notice'>{PROSE}</div>", PROSE),
    "article in main": (f"<main><div>{PROSE}</div><article><p>Inner {PROSE}</p></article></main>", f"Inner {PROSE}"),
    "article in form and header": (f"<form><header><article>{PROSE}</article></header></form>", PROSE),
    "wrapper named by its sidebar": (f"<div class='content-with-sidebar'><article>{PROSE}</article></div>", PROSE),
    "named content": (f"<div>{PROSE}</div><div id='main-content'><p>{PROSE} Here.</p><p>Yes</p></div>", f"{PROSE} Here.\n\nYes"),
    "no article": (f"<div><a href=1>One</a> <a href=2>Two</a></div><h2>About</h2><p>{PROSE}</p><p>Ja.</p><ul><li><a href=3>Three more links here</a></li></ul>", f"About\n\n{PROSE}\n\nJa."),
    "unclosed nav": (f"<nav><ul><li>a<article><p>{PROSE}</article>", PROSE),
    "inline advert": (f"<article><p>Before <span class=ad>buy <span>now</span></span> after</p></article>", "Before after"),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>{PROSE}</p></article>", PROSE),
    "white space": ("<article><p> a\n\t b&nbsp;&nbsp;c<br>d<b>e</b>f </p></article>", "a b c d" + "ef"),
    "quotes": ("<article><p title='a > b' class=x data-y=\"<p>\">one</p><p title='never closed>two</p></article>", "one\n\ntwo"),
    "stray": ("<article><p>1 < 2 & 3 <3 </ x><b>four</p></article>", "1 < 2 & 3 <3 four"),
    "comment ends": ("<article><!--> a --><!-- <p>no</p> --><p>yes</p><!-- open <p>no", "a -->\n\nyes"),
    "list of links": (f"<article><p>{PROSE}</p><ul><li><a href=1>Other story</a></li></ul><p>See <a href=2>this long source</a></p></article>", f"{PROSE}\n\nSee this long source"),
    "cells": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"),
    "references": ("<article>&lt;b&gt; &#x65E5;&#0; &amp;lt; &notit;</article>", "<b> 日� &lt; ¬it;"),
    "upper case": (f"<ARTICLE><SCRIPT>x</Script ><P CLASS='AD'>no</P><P>{PROSE}</P></ARTICLE>", PROSE),
    "two articles": ("<article><p>One</article><p>between</p><article><p>Two</article>", "One\n\nTwo"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    assert main_text(html) == want


def test_open_blocks_take_the_nearest_label():
    def page(*kinds):
        link = markup.Block("x" * 80, 80, False, True, markup.BODY, 0, None)
        return [{"good": markup.Block(PROSE, 0, False, False, 0, 0, None), "bad": link, "open": markup.Block("x", 0, False, False, 0, 0, None), "head": markup.Block("x", 0, True, False, 0, 0, None)}[k] for k in kinds]

    def brute(kinds):
        out = []
        for i, k in enumerate(kinds):
            known = [(abs(i - j), x != "good") for j, x in enumerate(kinds) if x in ("good", "bad") and (k != "head" or j > i or not {"good", "bad"} & set(kinds[i:]))]
            out.append(k == "good" if k in ("good", "bad") else (not min(known)[1] if known else True))
        return out

    for kinds in (["open"] * 3, ["bad", "open", "open", "open", "good"], ["good", "open", "open", "bad"], ["open", "bad", "head", "good"], ["good", "head", "bad", "open"], ["bad", "open", "good", "head"]):
        assert extraction.labels(page(*kinds)) == brute(kinds), kinds


@pytest.mark.parametrize("piece", ["<div>", '<a "', "<a b='", "<!--", '<b class="ad">', "<script>", "<form><article>x", "&", "< ", "<p>x", "<x = = = ", "<li><a href=x>y", "x <br>"])
def test_time_grows_with_the_length(piece):
    def took(n):
        start = time.perf_counter()
        main_text(piece * n + "</span></b>" * (n // 4))
        return time.perf_counter() - start

    assert took(40_000) < 12 * took(10_000) + 0.2


def plainly(html: str) -> str:
    """The text of a test page by what the generator writes: one article of headings and paragraphs."""
    article = re.search(r"<article>(.*)</article>", html, re.S)[1].replace("<br>", " ")
    parts = [" ".join(html_.unescape(re.sub(r"</?[a-z][^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(x for x in parts if x)


def test_pages_equal_their_articles(spark):
    source = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = extraction.op12_extraction(spark, SMALL).collect()
    assert len(got) == len(source) > 0
    for r in got:
        want = plainly(source[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (source[r.page_id].url, want, len(want))


def test_defined_cases_as_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<article><p>🇩🇪é</article>"), (3, "u", "<article><p>🇩🇪é</article>"), (4, "u", "<article><p>" + "word " * 200_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("own"), "n_chars": F.lit(7), "a.b": F.lit(1), "m": F.create_map(F.lit("k"), F.lit(1))})
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extraction.extract(df).collect()), key=repr)
    long = ("word " * 200_000).strip()
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (0, "u", "x", 1), (3, "u", "🇩🇪é", 3), (3, "u", "🇩🇪é", 3), (4, "u", long, len(long))], key=repr)
    assert extraction.extract(df.limit(0)).count() == 0
