"""Main text of web pages by two passes over blocks.

Markup is cut into blocks: runs of text between tags that begin or end a block. Every block carries its
length, its share of stop words, the share of its characters inside links, whether it is a heading, and
where it stands: in an article, in an element made for other things (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) or in neither.

Pass 1 decides the clear blocks. Blocks inside an element made for other things and blocks mostly of links are
dropped; long blocks with enough stop words are kept, also outside the article of a page that has one. An article
inside an aside, nav or footer, or named like one, is made for other things. Everything else, short blocks and long
ones without stop words, stays open.

Forms and names of classes are evidence, not a verdict: a class counts when its head noun is a name of such elements
(``cookie-banner``, but not ``no-sidebar`` or ``social-science``), and on a page without article the blocks
beside the text for such reasons only are judged like any other when their long blocks with stop words hold more
text than all that is kept without them.

Pass 2 gives an open block the label of its nearest decided neighbours in its own section (an article,
or the page outside of articles): what both sides agree on, or the nearer one; in an article it takes two
dropped sides to drop a block. With none decided the block is kept, but outside the
article of a page that has one it is dropped.

Scripts, styles, comments and hidden elements have no text. Character references are decoded, white space
inside a block becomes one space, a single <br> counts as white space and two in a row end a block. Null
and empty pages, and pages without text, give an empty text. Broken markup never fails: an unclosed
script or comment lasts to the end, an unclosed tag at the end is dropped, a stray < is text. A nav, header or
aside that is never closed ends where an article or main element begins, a link that is not closed before the next
one ends with its block. Pages of any length take one linear pass. Repeated rows are read each, an empty table gives
an empty one, and a column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.quality import STOP_WORDS

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)

# Element and class names of markup.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title noembed noframes".split())
#: Elements of other languages, which a slash at the end of the tag closes.
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav header footer aside form button select menu dialog".split())
#: Articles inside of these stand beside the text too.
HOLDING = frozenset("aside nav footer".split())
#: A page that does not close these ends them where its article begins.
UNCLOSED = ("nav", "header", "aside")
HOLDING_ROLES = frozenset("complementary navigation contentinfo".split())
ARTICLE = frozenset("article main".split())
ASIDE_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads "
    "adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations widget toolbar pagination pager copyright skip search".split()
)
#: First words of classes that say what the page as a whole has or lacks.
LAYOUT_WORDS = frozenset("no not non without has have with is js hide hidden show".split())
#: Last words of classes that say nothing; the word before them is the head noun.
CONTAINER_WORDS = frozenset(
    "area bar block body bottom box button buttons col column container content fixed group header holder icon icons "
    "inner item items left link links list outer panel primary right row secondary section text title top unit "
    "widget wrap wrapper".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

LONG_CHARS = 80
LEAST_STOP_SHARE = 0.1
MOST_LINK_SHARE = 0.5
_STOP = frozenset(STOP_WORDS)
_STRIP = ".,;:!?\"'()[]*#%&$"

KEEP, DROP, OPEN = 1, 0, -1


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    place: int
    section: int

    def stop_share(self) -> float:
        words = self.text.lower().split()
        return sum(w.strip(_STRIP) in _STOP for w in words) / len(words) if words else 0.0


#: Places of a block; DOUBTFUL is beside the text for a form or a class name only.
IN_ARTICLE, BESIDE, ELSEWHERE, DOUBTFUL = 1, 2, 0, 3


def _head_nouns(token: str) -> set[str]:
    """The words of a class that may name what its element is for."""
    parts = [w.lower() for w in _NAME_PART.findall(token) if not w.isdigit()]
    if not parts or parts[0] in LAYOUT_WORDS and len(parts) > 1:
        return set()
    last = len(parts) - 1
    while last and parts[last] in CONTAINER_WORDS:
        last -= 1
    return {parts[last], parts[-1]}


def _place_of(name: str, rest: str, place: int, sticky: bool) -> tuple[int, bool, bool]:
    """(place, sticky, hidden) inside an element: an article frees from forms and names of menus, but not from
    comments, aside, nav and footer."""
    hidden = False
    words: set[str] = set()
    role = ""
    if rest and not rest.isspace():
        for key, value in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                for token in value.split():
                    words |= _head_nouns(token)
            elif key == "role":
                role = value.lower()
            elif key == "style":
                hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif key == "hidden":
                hidden = True
            elif key == "aria-hidden" and value.lower() == "true":
                hidden = True
    if name in ("html", "body"):
        return place, sticky, False
    if words & COMMENT_NAMES:
        return BESIDE, True, hidden
    if name == "article" and words & ASIDE_NAMES:
        return BESIDE, True, hidden
    if name in ARTICLE or role in ("main", "article"):
        return (place if sticky else IN_ARTICLE), sticky, hidden
    if name == "header" and place == IN_ARTICLE and not words & (ASIDE_NAMES - {"header"}):
        return place, sticky, hidden
    if name != "form" and (name in ASIDE or role in ASIDE_ROLES):
        return BESIDE, sticky or name in HOLDING or role in HOLDING_ROLES, hidden
    if name == "form" or (name not in HEADINGS and words & ASIDE_NAMES):
        return (place if place == BESIDE else DOUBTFUL), sticky, hidden
    return place, sticky, hidden


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order, without empty ones."""
    blocks: list[Block] = []
    # Name, what held outside of it, and the begun block that an inline element interrupts.
    stack: list[tuple[str, int, bool, int, tuple | None]] = []
    depths: dict[str, list[int]] = {}  # places in the stack by name
    ahead: dict[str, tuple[int, bool]] = {}  # next tag of a name, and whether it is a closing one
    link_closed = False
    place, sticky, section, sections = ELSEWHERE, False, 0, 0
    parts: list[str] = []
    links = 0
    link_from = -1
    heading = False
    breaks = 0
    chars = 0

    def flush() -> None:
        nonlocal links, link_from, heading, breaks, chars
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                inside = links + (chars - link_from if link_from >= 0 else 0)
                blocks.append(Block(text, inside, heading, place, section))
            parts.clear()
        links, chars, breaks, heading = 0, 0, 0, False
        link_from = 0 if link_from >= 0 and link_closed else -1

    def leave(k: int) -> None:
        """Close the element at place ``k`` of the stack and all inside it."""
        nonlocal place, sticky, section, parts, links, link_from, heading, breaks, chars
        while len(stack) > k:
            name, *outside, begun = stack.pop()
            depths[name].pop()
            if begun or name in BLOCKS:
                flush()
            place, sticky, section = outside
            if begun:
                parts, links, link_from, heading, breaks, chars = begun

    def closes(name: str, at: int) -> bool:
        """Whether the next tag of that name behind ``at`` closes it."""
        found, closing = ahead.get(name, (-1, False))
        if found < at:
            tag = re.compile(rf"<(/?){name}(?=[\s/>])", re.I).search(html, at)
            found, closing = ahead[name] = (tag.start(), bool(tag[1])) if tag else (len(html) + 1, False)
        return closing

    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.search(html, at)
        stop = token.start() if token else end
        if stop > at:
            text = html[at:stop]
            parts.append(text)
            chars += len(text)
            if not text.isspace():
                breaks = 0
        if not token:
            break
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        if token["close"] or token["close2"]:
            if name == "a":
                if link_from >= 0:
                    links += chars - link_from
                    link_from = -1
                continue
            if name in BLOCKS:
                flush()
            if depths.get(name):
                leave(depths[name][-1])
            continue
        if name in FOREIGN and (token["rest"] or "").endswith("/"):
            continue
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = closing.end() if closing else end
            continue
        if name == "br":
            parts.append(" ")
            chars += 1
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if name == "a":
            if link_from >= 0 and not link_closed:
                links += chars - link_from
                link_from = -1
            link_from = chars if link_from < 0 else link_from
            following = _LINK.search(html, at)
            link_closed = bool(following and following[1])
            continue
        if name in BLOCKS:
            flush()
            heading = name in HEADINGS
        if name in VOID:
            continue
        if name in ARTICLE and place == BESIDE:
            unclosed = [depths[n][0] for n in UNCLOSED if depths.get(n) and not closes(n, at)]
            if unclosed:
                leave(min(unclosed))
        inner, held, hidden = _place_of(name, token["rest"] or "", place, sticky)
        if hidden:
            inner, held = BESIDE, True
        if name in BLOCKS and name != "p" and name not in HEADINGS or inner != place or held != sticky:
            depths.setdefault(name, []).append(len(stack))
            begun = None
            if name not in BLOCKS and inner != place and inner in (BESIDE, DOUBTFUL):
                begun = (parts, links, link_from, heading, breaks, chars)
                parts, links, link_from, heading, breaks, chars = [], 0, -1, False, 0, 0
            stack.append((name, place, sticky, section, begun))
            if inner == IN_ARTICLE and (place != IN_ARTICLE or name in ARTICLE):
                sections += 1
                section = sections
            place, sticky = inner, held
    flush()
    leave(0)
    return blocks


def _is_long_text(block: Block) -> bool:
    return len(block.text) >= LONG_CHARS and block.stop_share() >= LEAST_STOP_SHARE


def first_pass(block: Block) -> int:
    if block.place in (BESIDE, DOUBTFUL):
        return DROP
    if block.link_chars > MOST_LINK_SHARE * max(len(block.text), 1) and not block.heading:
        return DROP
    if _is_long_text(block):
        return KEEP
    return OPEN


def second_pass(blocks: list[Block], labels: list[int], undecided: int = KEEP) -> list[int]:
    """Open blocks inherit from the nearest decided blocks of their section that pass 1 judged by content.

    ``undecided`` is the label outside of articles where no block is decided.
    """
    by_section: dict[int, list[int]] = {}
    for i, block in enumerate(blocks):
        if block.place not in (BESIDE, DOUBTFUL):
            by_section.setdefault(block.section, []).append(i)
    result = list(labels)
    for members in by_section.values():
        n = len(members)
        before: list[tuple[int, int] | None] = [None] * n
        last = None
        for k, i in enumerate(members):
            before[k] = last
            if labels[i] != OPEN:
                last = (k, labels[i])
        following = None
        for k in range(n - 1, -1, -1):
            i = members[k]
            if labels[i] != OPEN:
                following = (k, labels[i])
                continue
            near = [x for x in (before[k], following) if x]
            if blocks[i].place == IN_ARTICLE:
                result[i] = DROP if [x[1] for x in near] == [DROP, DROP] else KEEP
            else:
                # Both sides alike, the only side, or the nearer one; a tie keeps the block.
                result[i] = min(near, key=lambda x: (abs(x[0] - k), -x[1]))[1] if near else undecided
    return result


def _kept(blocks: list[Block]) -> list[Block]:
    has_article = any(b.place == IN_ARTICLE for b in blocks)
    labels = second_pass(blocks, [first_pass(b) for b in blocks], DROP if has_article else KEEP)
    return [b for b, label in zip(blocks, labels, strict=True) if label == KEEP]


def main_text(html: str | None) -> str:
    """The kept blocks of a page, one per line."""
    blocks = blocks_of(html or "")
    kept = _kept(blocks)
    if not any(b.place == IN_ARTICLE for b in blocks):
        # Those of an empty article have a section of their own and stay out.
        judged = [replace(b, place=ELSEWHERE) if b.place == DOUBTFUL and not b.section else b for b in blocks]
        weight = sum(len(b.text) for b, old in zip(judged, blocks, strict=True) if b is not old and first_pass(b) == KEEP)
        if weight > sum(len(b.text) for b in kept):
            kept = _kept(judged)
    return "\n".join(b.text for b in kept)


def with_main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each page; one pass in Arrow batches, no shuffle."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([main_text(h) for h in htmls], dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pages.withColumn(name, F.pandas_udf(run, "string")(F.col(html)))

