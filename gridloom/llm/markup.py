"""Markup of a page cut into blocks of text, with what their place in the page says. One pass over the characters.

Block elements end a block, inline ones and line breaks do not. Script, style and the like are passed over up to their own end
tag, whatever stands in them; comments, declarations and stray `<` are told apart; end tags that close nothing are ignored;
elements left open end with their parent or the page. Open elements are counted by name, so that an end tag is answered
without searching, and no input makes the walk more than linear.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

# Names of the HTML standard, and words by which sites name the parts of a page that are not its article.
RAW = frozenset("script style noscript iframe noembed noframes template textarea title xmp svg math canvas object audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header "
    "hgroup h1 h2 h3 h4 h5 h6 html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul hr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
APART = frozenset("nav aside footer dialog menu button label option fieldset legend search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets related recommended recommendations share sharing social "
    "comment comments commentlist reply replies respond disqus nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer header masthead "
    "toolbar login search copyright disclaimer teaser teasers".split()
)
CONTENT = frozenset("article content main articlebody maincontent postcontent entrycontent articlecontent postbody storybody".split())
NOT_ALONE = frozenset("free open enabled disabled closed count has no with without is".split())

BODY, NAMED, MAIN, ARTICLE = range(4)
"""How surely a place holds the article."""

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass(slots=True)
class Block:
    """Text with white space turned into single spaces; how many of its characters stand in links; where it stands."""

    text: str
    link_chars: int
    heading: bool
    item: bool
    level: int
    scope: int
    """Number of the innermost element of that level."""
    soft: _Open | None
    """The element named by its looks only, or a form, around it: not the article, unless it holds one."""

    @property
    def outside(self) -> bool:
        return self.soft is not None and not self.soft.holds


@dataclass(slots=True)
class _Open:
    name: str
    muted: bool = False
    level: int = BODY
    scope: int = 0
    soft: _Open | None = None
    holds: bool = False


def _tag_end(html: str, at: int, open_quotes: dict[str, int]) -> int:
    """Where the tag whose name ends before `at` ends: the next > outside of quoted values. A quote that never closes counts as a letter."""
    while True:
        close = html.find(">", at)
        if close < 0:
            return len(html)
        value = html.find("=", at, close)
        while value >= 0:
            i = value + 1
            while html[i].isspace():
                i += 1
            if (q := html[i]) in "\"'":
                end = html.find(q, i + 1) if i < open_quotes.get(q, len(html)) else -1
                if end < 0:
                    open_quotes[q] = min(i, open_quotes.get(q, i))
                elif end > close:
                    at = end + 1
                    break
                else:
                    i = end
            value = html.find("=", i, close)
        else:
            return close


def _attributes(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), a or b or c)
    return out


def _apart(name: str, attributes: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """(surely, by its looks) no part of an article: by element, role, or the first or last word of a class or id.

    The header inside an article is that of the article."""
    if name in ("html", "body"):
        return False, False
    role, label = attributes.get("role"), f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if name in APART or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, False
    if name in ("article", "main") or name in HEADINGS:
        return name == "article" and any(x.lower() in HINTS for x in label.split()), False
    words = [w for x in label.split() if (w := [y.lower() for y in _WORDS.findall(x)]) and w[0] not in NOT_ALONE and w[-1] not in NOT_ALONE]
    hints = HINTS - {"header"} if inside else HINTS
    return any(w[0] in hints for w in words), name == "form" or role == "form" or (name == "header" and not inside) or any(w[-1] in hints for w in words)


def _level(name: str, attributes: dict[str, str]) -> int:
    role = attributes.get("role")
    if name == "article" or role == "article" or "articlebody" in attributes.get("itemprop", "").lower():
        return ARTICLE
    if name == "main" or role == "main":
        return MAIN
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return NAMED if name in ("div", "section", "td") and any("".join(_WORDS.findall(x)).lower() in CONTENT for x in names) else BODY


def blocks(html: str) -> list[Block]:
    """Blocks of a page in its order, without those that are surely no part of an article; none is empty."""
    out: list[Block] = []
    stack, names = [_Open("")], Counter()
    quotes: dict[str, int] = {}
    parts: list[str] = []
    links, in_link, n_scopes = 0, False, 0

    def flush() -> None:
        nonlocal links
        if parts and (text := " ".join("".join(parts).split())):
            top = stack[-1]
            out.append(Block(text, min(links, len(text)), top.name in HEADINGS, top.name == "li", top.level, top.scope, top.soft))
        parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if not stack[-1].muted:
            parts.append(text := unescape(raw) if "&" in raw else raw)
            links += len(text.strip()) if in_link else 0

    def close(name: str) -> None:
        while True:
            top = stack.pop()
            names[top.name] -= 1
            if top.name == name:
                return

    i, n = 0, len(html)
    while i < n:
        lt = html.find("<", i)
        say(html[i : lt if lt >= 0 else n])
        if lt < 0:
            break
        tag = _TAG.match(html, lt)
        if tag is None:
            if html.startswith("<!--", lt):
                end = lt + 4 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
                i = n if end < 0 else html.find(">", end) + 1
            elif html.startswith(("<!", "<?", "</"), lt):
                i = html.find(">", lt) + 1 or n
            else:
                say("<")
                i = lt + 1
            continue
        name, closing, end = tag[1].lower(), html[lt + 1] == "/", _tag_end(html, tag.end(), quotes)
        i = end + 1
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        if name in RAW and not closing:
            stop = _RAW_END[name].search(html, i)
            i = n if stop is None else _tag_end(html, stop.end(), quotes) + 1
            continue
        if closing:
            if name in BLOCK:
                flush()
            if names[name]:
                close(name)
            continue
        attributes = _attributes(html[tag.end() : end]) if end > tag.end() else {}
        surely, looks = _apart(name, attributes, stack[-1].level > BODY)
        if name not in BLOCK:
            # an inline element that is no part of the article is left out of its block
            if name not in VOID and (surely or names[name]):
                top = stack[-1]
                stack.append(_Open(name, top.muted or surely, top.level, top.scope, top.soft))
                names[name] += 1
            continue
        flush()
        if name == "hr":
            continue
        level = _level(name, attributes)
        if level >= MAIN and names["nav"]:
            close("nav")  # never around an article: its end tag is missing
        if stack[-1].name == "p" or (name in ("li", "td", "th", "tr", "dd", "dt") and stack[-1].name == name):
            close(stack[-1].name)
        top = stack[-1]
        this = _Open(name, top.muted or surely, top.level, top.scope, top.soft)
        if looks:
            this.soft = _Open(name, soft=top.soft)
        if level > top.level and not this.muted:
            n_scopes += 1
            this.level, this.scope = level, n_scopes
            if level >= MAIN:
                around = this.soft
                while around is not None and not around.holds:
                    around.holds, around = True, around.soft
        stack.append(this)
        names[name] += 1
    flush()
    return out
