"""Main text of web pages by block rules in two passes, row by row, so that nothing is shuffled.

First pass: `markup.blocks` cuts a page into blocks, leaves out what an element, role, class or id says is no part of an article
(menus, footers, sidebars, notices, adverts, forms, comments, hidden parts), and says how surely the place of each other block
holds the article: inside <article>, inside <main>, inside an element named as content, or none of these. The surest place
that the page has is its article. Each block in it is then decided by length, the share of stop words among its words and
the share of its characters in links: running text is good, lists of links are bad, and what is short or unlike running text stays
open. Second pass: an open block takes the label of the nearest decided block (the good one on ties), a heading that of
the next one; the edges of an article count as good neighbours, and with no decided block at all open blocks are good.

Good blocks, in page order, joined by an empty line, are the text: character references decoded, white space inside a block one
space. Cases: null and empty pages, pages without text and pages of markup only give an empty text; equal pages and repeated ids
give equal rows; a page without any tag is one block; long pages are walked once; extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import common
from .markup import BODY, MAIN, Block, blocks

SHORT = 70
LONG = 200
MANY_STOPS = 0.25
SOME_STOPS = 0.10
LINKED = 0.33
ALL_LINKED = 0.8

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with by at from his he be this have not but they or an she which you one were all their there "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "de la le et les des en un du une que est pour qui dans par plus au sur ne se pas avec ce sont il ou son aux mais nous elle leur été être cette "
    "el y los del las con no una su para lo como más pero sus este ya o porque cuando muy sin sobre también me hasta hay donde".split()
)
_LETTERS = re.compile(r"[^\W\d_]+")


def decided(block: Block) -> bool | None:
    """Whether a block is running text (True), boilerplate (False) or open (None), by its own features."""
    n = len(block.text)
    linked = block.link_chars / n
    if linked > LINKED and (block.level < MAIN or (block.item and linked >= ALL_LINKED)):
        return False
    words = _LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if linked <= LINKED and not block.heading and ((n >= SHORT and stops >= MANY_STOPS) or (n >= LONG and stops >= SOME_STOPS)):
        return True
    return None


def labels(page: list[Block]) -> list[bool]:
    """Both passes over the blocks of one page."""
    surest = max((b.level for b in page if not b.outside), default=BODY)
    first = [decided(b) if b.level == surest and not b.outside else None for b in page]
    inside = [i for i, b in enumerate(page) if b.level == surest and not b.outside]
    keep = [False] * len(page)
    before: dict[int, tuple[int, bool]] = {}
    after: dict[int, tuple[int, bool]] = {}
    for order, near in ((inside, before), (inside[::-1], after)):
        scope, last = None, None
        for place, i in enumerate(order):
            if page[i].scope != scope:
                # edge of an article: a good neighbour; elsewhere there is none
                scope, last = page[i].scope, ((place - 1, True) if surest >= MAIN else last)
            if first[i] is not None:
                last = (place, first[i])
            elif last is not None:
                near[i] = (place - last[0], last[1])
    for i in inside:
        if first[i] is not None:
            keep[i] = first[i]
        elif page[i].heading and i in after:
            keep[i] = after[i][1]
        else:
            keep[i] = min((x for x in (before.get(i), after.get(i)) if x is not None), key=lambda x: (x[0], not x[1]), default=(0, True))[1]
    return keep


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    return "\n\n".join(b.text for b, good in zip(page, labels(page), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def make():
        def run(html: list[str | None]) -> list:
            texts = [main_text(h) for h in html]
            return [texts, [len(t) for t in texts]]

        return run

    return common.scan(pages, ["page_id", "url"], ["html"], [common.string("text"), common.long("n_chars")], make)


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
