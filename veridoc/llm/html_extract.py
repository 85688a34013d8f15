"""Main text of web pages from flat text blocks and a decision tree.

A page is read once into a flat list of text blocks. Each block has its number of words and its link density, those of the
blocks before and after it, whether it is a heading, and, as one feature of eight, what the containers around it are for. A
decision tree, grown on the small labelled table below, says which blocks are the article's. The table holds blocks of real pages,
also with class, id and role removed and with all containers renamed, so that words and links decide where names don't; and
hand-labelled cases that those pages don't have, such as forms, comments and lists of links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by what they do to the text.
#: What they hold is not text of the page.
UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video textarea select option button datalist title head".split())
#: Of these the content is not markup, up to their end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
#: They stand inside a line; all others part blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the next block; they say nothing about what stands in them.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6 html body".split())
#: Containers apart from an article, by element, by role, and by words in class or id.
APART_TAGS = frozenset("nav footer aside form dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion disqus footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Of these words, those of comments, adverts and notices: no article begins in them, and they stay apart whatever they hold.
CLOSED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising comment comments consent cookie cookies discussion disqus gdpr promo promoted "
    "promotion recommended related replies reply respond sponsor sponsored".split()
)
#: Containers of an article.
MAIN_TAGS, MAIN_ROLES = frozenset("article main".split()), frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

APART, NEITHER, MAIN = -1, 0, 1
#: What a container can be besides, until the page has been read: apart for good; apart unless it holds most of the page's text;
#: a header, which belongs to the article that it stands in and else is apart.
CLOSED, WRAPPER, HEADER = -3, -2, -4


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: int
    heading: int


def _place(tag: str, attributes: str) -> int | None:
    """What a container is for, or None where it says nothing."""
    names: set[str] = set()
    role, hidden = "", False
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                names.update(x.lower() for x in _PARTS.findall(value))
            elif name == "role":
                role = value.strip().lower()
            elif name == "style":
                hidden |= _HIDDEN.search(value) is not None
            elif name == "hidden" or value.lower() == "true":
                hidden = True
    if hidden:
        return CLOSED
    if tag in ("body", "html"):
        return None
    if tag in MAIN_TAGS or role in MAIN_ROLES:
        return CLOSED if names & {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo", "related"} else MAIN
    if names & CLOSED_WORDS:
        return CLOSED
    if tag in APART_TAGS - {"form"} or role in APART_ROLES - {"form"}:
        return APART
    if tag == "form" or role == "form" or names & APART_WORDS:
        return WRAPPER
    if tag == "header":
        return HEADER
    return MAIN if names & MAIN_WORDS else None


def _begins(tag: str, attributes: str) -> bool:
    """Whether an article begins here by element or role, not by words of class or id alone."""
    return tag in MAIN_TAGS or any(n.lower() == "role" and v.strip("\"' ").lower() in MAIN_ROLES for n, v in _ATTRIBUTE.findall(attributes))


def _places(containers: list[tuple[int, int | None, bool]], within: list[int], words: list[int]) -> list[int]:
    """The place of each container. containers: of each the one around it (an earlier one), what it is, whether an article begins by its element.

    A wrapper (a form, or a class or id that may as well tell of the layout) that holds more than half of the page's words outside links says nothing, unless an
    article stands outside it. within, words: of each block its container and its words outside links.
    """
    held, main = [0] * len(containers), [0] * len(containers)
    closed = [False] * len(containers)
    for k, (around, found, _) in enumerate(containers):
        closed[k] = found == CLOSED or (k > 0 and closed[around])
    for k, n in zip(within, words, strict=True):
        if not closed[k]:
            held[k] += n
    # words in an article that no container but wrappers sets apart
    article = [False] * len(containers)
    for k, (around, found, begins) in enumerate(containers):
        if k:
            article[k] = not closed[k] and (begins or found != APART and (found == MAIN or article[around]))
            main[k] = held[k] if article[k] else 0
    for k in range(len(containers) - 1, 0, -1):
        held[containers[k][0]] += held[k]
        main[containers[k][0]] += main[k]
    places = [NEITHER] * len(containers)
    for k, (around, found, begins) in enumerate(containers[1:], 1):
        inherited = places[around]
        if found == HEADER:
            found = None if inherited == MAIN else APART
        if found == WRAPPER:
            found = None if 2 * held[k] > held[0] and main[k] == main[0] else APART
        if closed[k]:
            places[k] = APART
        elif found == MAIN and inherited == APART and not begins:
            places[k] = APART
        else:
            places[k] = inherited if found is None else found
    return places


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: character references decoded, white space turned into single spaces, trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # open containers: element, number, whether unseen
    containers: list[tuple[int, int | None, bool]] = [(0, NEITHER, False)]  # the page, then each in order
    opened: dict[str, int] = {}
    place, unseen, links, heading = 0, False, 0, 0
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), place, heading))
            parts.clear()
            linked.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if (m.start() if m else end) > at and not unseen:
            piece = page[at : m.start()] if m else page[at:]
            parts.append(piece)
            if links:
                linked.append(piece)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br" and not unseen:
                parts.append(" ")
            if closing or tag in VOID or _plain(m[3]):
                if closing and opened.get(tag):
                    pass
                else:
                    continue
        if not closing and tag in RAW:
            close()
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag not in INLINE:
            close()
            links = 0
        if tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                while stack:
                    name, _, _ = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
                if tag in INLINE:
                    close()
            heading = 0
        else:
            heading = int(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
            found = _place(tag, m[3])
            if tag in LOOSE and found is None:
                continue
            if tag in INLINE:
                if found not in (APART, CLOSED, WRAPPER):
                    continue
                close()
            if not m[3].endswith("/"):
                if tag in LOOSE and opened.get(tag):  # a paragraph or cell ends where the next one begins
                    while stack and stack[-1][0] != tag and stack[-1][0] in LOOSE:
                        opened[stack.pop()[0]] -= 1
                    if stack and stack[-1][0] == tag:
                        opened[stack.pop()[0]] -= 1
                        place, unseen = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                containers.append((stack[-1][1] if stack else 0, found, found == MAIN and _begins(tag, m[3])))
                stack.append((tag, len(containers) - 1, unseen or tag in UNSEEN))
                opened[tag] = opened.get(tag, 0) + 1
        place, unseen = (stack[-1][1], stack[-1][2]) if stack else (0, False)
    close()
    places = _places(containers, [b.place for b in out], [max(0, b.words - b.linked) for b in out])
    return [b._replace(place=places[b.place]) for b in out]


def _plain(attributes: str) -> bool:
    """Whether an inline element can't be a container apart."""
    return not attributes or _place("span", attributes) not in (APART, CLOSED, WRAPPER)


#: Words, link density, words before, density before, words after, density after, place (-1 apart, 0 neither, 1 article), heading; 1 for main text.
LABELLED = (
    # in a container apart from the article: never
    (6, 1.0, 0, 0.0, 8, 0.0, -1, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, -1, 0, 0), (8, 0.0, 1, 1.0, 12, 0.0, -1, 0, 0), (40, 0.0, 30, 0.0, 50, 0.0, -1, 0, 0),
    (15, 0.1, 80, 0.0, 0, 0.0, -1, 0, 0), (120, 0.0, 90, 0.0, 100, 0.0, -1, 0, 0), (3, 0.0, 2, 0.0, 4, 0.0, -1, 1, 0), (25, 0.0, 3, 0.0, 20, 0.0, -1, 0, 0),
    (2, 0.5, 60, 0.0, 2, 0.5, -1, 0, 0), (60, 0.0, 0, 0.0, 0, 0.0, -1, 0, 0), (300, 0.02, 10, 0.0, 80, 0.0, -1, 0, 0), (10, 0.0, 200, 0.0, 200, 0.0, -1, 0, 0),
    # in the article: yes, short lines and headings too
    (1, 0.0, 50, 0.0, 60, 0.0, 1, 0, 1), (2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (8, 0.0, 8, 0.0, 60, 0.0, 1, 1, 1), (120, 0.0, 10, 0.0, 90, 0.0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (80, 0.1, 60, 0.0, 70, 0.05, 1, 0, 1), (30, 0.3, 40, 0.0, 50, 0.0, 1, 0, 1), (12, 0.0, 6, 1.0, 8, 0.0, 1, 1, 1),
    (4, 0.0, 8, 0.0, 0, 0.0, 1, 0, 1), (5, 0.0, 0, 0.0, 9, 0.0, 1, 0, 1), (3, 0.0, 3, 0.0, 12, 0.0, 1, 1, 1), (500, 0.0, 9, 0.0, 5, 0.0, 1, 0, 1),
    (9, 0.4, 70, 0.0, 60, 0.0, 1, 0, 1), (20, 0.6, 50, 0.0, 40, 0.0, 1, 0, 1), (3, 1.0, 70, 0.0, 60, 0.0, 1, 0, 1), (10, 0.0, 2, 0.5, 15, 0.1, 1, 0, 1),
    (3, 0.0, 2, 0.0, 2, 0.0, 1, 0, 1), (5, 0.0, 60, 0.0, 2, 0.0, 1, 0, 1), (4, 0.0, 50, 0.0, 0, 0.0, 1, 0, 1), (7, 0.0, 4, 0.0, 5, 0.0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 2, 0.0, 1, 0, 1), (6, 0.0, 70, 0.0, 4, 0.0, 1, 0, 1), (9, 0.0, 5, 0.0, 6, 0.0, 1, 0, 1), (2, 0.0, 100, 0.0, 5, 0.0, 1, 0, 1),
    (14, 0.0, 40, 0.0, 6, 0.0, 1, 0, 1), (11, 0.0, 13, 0.0, 3, 0.0, 1, 0, 1), (8, 0.0, 2, 0.0, 1, 0.0, 1, 0, 1), (15, 0.0, 1, 0.0, 4, 0.0, 1, 0, 1),
    (6, 0.2, 3, 0.5, 0, 0.0, 1, 0, 1), (5, 0.0, 3, 1.0, 2, 1.0, 1, 0, 1), (2, 0.0, 7, 0.0, 6, 0.0, 1, 1, 1), (4, 0.0, 0, 0.0, 1, 0.0, 1, 1, 1),
    # lists of links, in the article too: no
    (3, 1.0, 4, 1.0, 5, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0), (6, 1.0, 5, 1.0, 40, 0.0, 1, 0, 0), (4, 1.0, 3, 1.0, 0, 0.0, 1, 0, 0),
    (3, 1.0, 4, 1.0, 5, 1.0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (5, 1.0, 5, 1.0, 40, 0.0, 0, 0, 0), (2, 1.0, 2, 1.0, 3, 0.0, 0, 0, 0),
    (12, 0.9, 10, 0.8, 11, 0.9, 0, 0, 0), (30, 0.7, 25, 0.8, 28, 0.7, 0, 0, 0), (3, 1.0, 80, 0.0, 3, 1.0, 0, 0, 0), (8, 0.6, 3, 1.0, 4, 0.5, 0, 0, 0),
    # containers that say nothing: running text, and short lines beside it
    (60, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1), (25, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1), (18, 0.05, 30, 0.0, 25, 0.0, 0, 0, 1), (100, 0.1, 3, 1.0, 90, 0.0, 0, 0, 1),
    (40, 0.0, 2, 1.0, 5, 0.2, 0, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (16, 0.0, 8, 0.0, 22, 0.0, 0, 0, 1), (30, 0.2, 45, 0.0, 35, 0.1, 0, 0, 1),
    (4, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1), (2, 0.0, 40, 0.0, 30, 0.0, 0, 0, 1), (6, 0.0, 80, 0.0, 50, 0.0, 0, 1, 1), (8, 0.0, 3, 1.0, 70, 0.0, 0, 1, 1),
    (5, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1), (7, 0.0, 2, 0.0, 40, 0.0, 0, 1, 1), (3, 0.0, 30, 0.0, 45, 0.0, 0, 0, 1), (10, 0.0, 20, 0.0, 25, 0.0, 0, 0, 1),
    (30, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1), (24, 0.0, 40, 0.0, 3, 1.0, 0, 0, 1), (22, 0.0, 5, 0.0, 4, 0.5, 0, 0, 1), (28, 0.05, 30, 0.0, 8, 0.0, 0, 0, 1),
    (20, 0.0, 2, 1.0, 3, 0.0, 0, 0, 1), (17, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1), (32, 0.0, 0, 0.0, 6, 1.0, 0, 0, 1), (19, 0.1, 20, 0.0, 9, 0.0, 0, 0, 1),
    # containers that say nothing: short lines among short lines or links
    (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0), (5, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (4, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0), (6, 0.2, 3, 0.5, 0, 0.0, 0, 0, 0),
    (2, 0.0, 1, 0.0, 3, 0.0, 0, 0, 0), (3, 0.0, 2, 0.0, 3, 1.0, 0, 1, 0), (7, 0.0, 4, 1.0, 5, 0.0, 0, 0, 0), (5, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0),
    (4, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0), (6, 0.3, 70, 0.0, 4, 0.5, 0, 0, 0), (1, 0.0, 0, 0.0, 2, 0.0, 0, 0, 0), (9, 0.0, 5, 1.0, 6, 1.0, 0, 0, 0),
    # short lines of an article before its last, shorter one
    (4, 0.0, 3, 0.0, 1, 0.0, 1, 0, 1), (3, 0.0, 2, 0.0, 1, 0.0, 1, 0, 1), (18, 0.0, 3, 0.0, 2, 0.0, 1, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 1, 0, 1),
    # blocks of real pages, as they stand, without class, id and role, and with all containers renamed to div: not the article's
    (6, 0.0, 1, 1.0, 1, 0.0, -1, 0, 0), (5, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0), (5, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0), (6, 0.0, 1, 1.0, 1, 0.0, 0, 0, 0),
    (8, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0), (9, 0.0, 10, 0.0, 0, 0.0, 0, 0, 0), (10, 0.0, 1, 1.0, 20, 0.0, 0, 0, 0), (10, 0.0, 1, 1.0, 24, 0.0, 0, 0, 0),
    (10, 0.0, 1, 1.0, 1, 0.0, 0, 0, 0), (13, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0), (13, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0), (13, 0.0, 1, 1.0, 11, 0.0, 0, 0, 0),
    (16, 0.0, 74, 0.0, 0, 0.0, 0, 0, 0),
    # and the article's
    (1, 0.0, 8, 0.0, 5, 0.0, 0, 0, 1), (1, 0.0, 1, 0.0, 6, 0.0, 0, 0, 1), (1, 0.0, 10, 0.0, 1, 0.0, 0, 1, 1), (1, 0.0, 1, 0.0, 2, 0.0, 0, 0, 1),
    (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1), (2, 0.0, 1, 0.0, 40, 0.0, 0, 0, 1), (2, 0.0, 1, 0.0, 2, 0.0, 0, 0, 1), (2, 0.0, 2, 0.0, 3, 0.0, 0, 0, 1),
    (3, 0.0, 10, 0.0, 3, 0.0, 0, 1, 1), (3, 0.0, 3, 0.0, 3, 0.0, 0, 0, 1), (4, 0.0, 1, 0.0, 78, 0.0, 0, 0, 1), (4, 0.0, 10, 0.0, 4, 0.0, 0, 1, 1),
    (4, 0.0, 55, 0.0, 1, 0.0, 0, 0, 1), (4, 0.0, 4, 0.0, 1, 0.0, 0, 0, 1), (4, 0.0, 3, 0.0, 78, 0.0, 0, 0, 1), (6, 0.0, 93, 0.0, 9, 0.0, 0, 0, 1),
    (6, 0.0, 23, 0.0, 1, 0.0, 0, 0, 1), (8, 0.0, 520, 0.0, 1, 0.0, 0, 0, 1), (8, 0.0, 1, 0.0, 1, 0.0, 0, 0, 1), (9, 0.0, 6, 0.0, 9, 0.0, 0, 1, 1),
    (11, 0.0, 7, 0.0, 2, 0.0, 0, 0, 1), (14, 0.0, 52, 0.0, 2, 0.0, 0, 0, 1), (14, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1), (20, 0.0, 3, 0.0, 4, 0.0, 0, 0, 1),
    (38, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1), (41, 0.0, 3, 0.0, 1, 0.0, 0, 0, 1), (53, 0.0, 76, 0.0, 1, 0.0, 0, 0, 1), (96, 0.0, 81, 0.0, 1, 0.0, 0, 0, 1),
    (114, 0.0, 74, 0.0, 3, 0.0, 0, 0, 1), (3, 0.0, 3, 0.0, 3, 0.0, 1, 0, 1), (46, 0.0, 2, 0.0, 3, 0.0, 1, 0, 1),
)


class Tree:
    """A binary decision tree over numbers, grown by Gini impurity until its leaves are pure."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        self.label = int(2 * labels.sum() > len(labels))
        self.split: tuple[int, float] | None = None
        if 0 < labels.sum() < len(labels) and (best := self._best(rows, labels)):
            self.split = best
            left = rows[:, best[0]] <= best[1]
            self.low, self.high = Tree(rows[left], labels[left]), Tree(rows[~left], labels[~left])

    @staticmethod
    def _best(rows: np.ndarray, labels: np.ndarray) -> tuple[int, float] | None:
        found = []
        for k in range(rows.shape[1]):
            values = np.unique(rows[:, k])
            for cut in (values[1:] + values[:-1]) / 2:
                left = rows[:, k] <= cut
                impurity = sum(len(s) * (p := s.mean()) * (1 - p) for s in (labels[left], labels[~left]))
                found.append((round(float(impurity), 9), k, float(cut)))
        return min(found)[1:] if found else None

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(rows), self.label)
        out, left = np.empty(len(rows), np.int64), rows[:, self.split[0]] <= self.split[1]
        out[left], out[~left] = self.low.predict(rows[left]), self.high.predict(rows[~left])
        return out


def grow() -> Tree:
    table = np.array(LABELLED, float)
    return Tree(table[:, :-1], table[:, -1].astype(np.int64))


def _features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words, b.place, b.heading) for b in found], float).reshape(-1, 4)
    padded = np.vstack((np.zeros((1, 4)), own, np.zeros((1, 4))))
    return np.column_stack((own[:, :2], padded[:-2, :2], padded[2:, :2], own[:, 2:]))


def extract(page: str, tree: Tree) -> str:
    """The article's blocks in page order, joined by line feeds."""
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, main in zip(found, tree.predict(_features(found)), strict=True) if main)


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row of df, from the whole html; null or empty html gives an empty text.

    One pass without a shuffle. Broken markup is read as far as it goes: unclosed elements end with the container or the page.
    Repeated rows each give a row, an empty table none; other columns are ignored, whatever their names.
    """
    own = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = grow()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array([extract(x, tree) for x in b["html"].to_pylist()], pa.string())], ["page_id", "url", "text"])

    return own.mapInArrow(run, own.select("page_id", "url").schema.add("text", "string"))
