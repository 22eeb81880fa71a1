"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures.

A page becomes a flat list of text blocks. Each has its word count, link density, both of the blocks before and
after it, its place (inside a marked article; on a page without one; outside it; in an element that is boilerplate by
its kind or name), whether it is a heading, whether it lies in an element of controls (a menu, share links, a search
box), and how many blocks of links it stands among. An article element that is boilerplate itself, such as a reader's
comment, marks no article. A small labelled table (TABLE) trains the tree.

Inside an article and inside controls, neighbours are those of the same article or element, and blocks of links in a
row have those around the row: a list of links between two paragraphs is the article's, one behind its last is a menu.
A class, id or role counts by its last word that says what the element is: comment-body and user-comments are comments,
social-history is a history. What holds prose that is not the article (comments, notices, adverts, footers) goes by
place alone, as it must however long it is; controls go by words and links, so text in a section called search stays.

Defined results. A null or empty page gives an empty text, and so does one without article text. Broken markup is
read as far as it goes, in time linear in the page: unknown or unmatched end tags are skipped, what is not closed ends
with its parent, a tag that the page's end cuts off goes with all behind it, and a reference to no character is U+FFFD.
Texts count whole. Repeated rows give equal rows, an empty table an empty one. A column of the result's name is replaced.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: Up to what can end a tag or open a quoted value.
IN_TAG = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

#: Elements whose content is no markup, or none of the page's text; it ends at their end tag alone.
OPAQUE = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style noscript template textarea svg iframe object select title".split()}
#: Character references of more digits than any character has, and leading zeros.
TOO_LONG, ZEROS = re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?"), re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no article text of their own, and those of controls.
NOT_TEXT, CONTROLS = frozenset("head footer aside form dialog fieldset button".split()), frozenset("nav menu".split())
#: Last words of a class, id or role: of elements whose text, however long, is not the article; of controls.
NOT_ARTICLE = frozenset("ad ads adv advert adverts advertisement advertising banner byline comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus footer form gdpr masthead modal newsletter notice notices notification overlay popup privacy promo promoted promotion reader recommended related replies reply respond sidebar signup sponsor sponsored subscribe teaser".split())
CONTROL_NAMES = frozenset("breadcrumb breadcrumbs login menu menubar nav navbar navigation pagination search share sharing skip social toc toolbar topbar widget widgets".split())
#: Words of such names that say where or how an element is, and not what it holds.
NEUTRAL = frozenset("area articles bar block body bottom box button buttons card column container content desktop fixed footer group header holder icons inner item items label left link links list main message mobile outer panel posts right section site slot sticky stories text this thread title top unit wrap wrapper zone".split()) - NOT_ARTICLE
#: Of these, what an article element of its own is for a reader's comment or a teaser.
NO_ARTICLE_OF_ITS_OWN = frozenset("comment comments reply teaser related promo ad".split())
CLOSED_BY_SAME = frozenset("p li dt dd td th tr option".split())

FIELDS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading", "scope", "row")
#: Scopes, which the tree asks for first: neighbours of the flat page, of the article, of one element of controls.
FLAT, ARTICLE, IN_CONTROLS = 0, 1, 2
#: From this share of its words on, a block is one of links.
OF_LINKS = 0.6
#: Places: in the marked article; on a page that marks none; outside the article, or boilerplate or controls on a page that
#: marks none; boilerplate on a page that marks its article. Only in the last does the place alone decide.
INSIDE, UNMARKED, OUTSIDE, NAMED = 2, 1, 0, -1
#: The labelled table: FIELDS up to heading (links are shares of words inside links), then 1 for article text.
PLAIN = np.array([
    (3, 1.0, 60, 0, 4, 1.0, -1, 0, 0), (45, 0, 60, 0, 40, 0, -1, 0, 0), (10, 0, 90, 0, 30, 0, -1, 1, 0), (300, 0, 40, 0, 20, 0, -1, 0, 0),
    (40, 0, 0, 0, 90, 0, -1, 0, 0), (15, 0, 3, 1.0, 8, 0, -1, 0, 0), (4, 0, 2, 1.0, 60, 0, -1, 1, 0), (90, .1, 70, 0, 10, 0, -1, 0, 0),
    (12, 0, 180, 0, 0, 0, -1, 0, 0), (60, 0, 5, 1.0, 70, 0, -1, 0, 0), (14, 0, 2, 1.0, 9, 0, -1, 0, 0), (35, .05, 80, 0, 60, 0, -1, 0, 0),
    (5, 0, 40, 0, 55, 0, -1, 1, 0), (200, 0, 30, 0, 50, 0, -1, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, -1, 0, 0), (9, 0, 300, 0, 4, 1.0, -1, 0, 0),
    (3, 0, 0, 0, 0, 0, 2, 0, 1), (1, 0, 8, 0, 2, 0, 2, 0, 1), (9, 0, 4, 1.0, 40, 0, 2, 1, 1), (150, 0, 9, 0, 80, 0, 2, 0, 1),
    (60, .1, 150, 0, 12, .1, 2, 0, 1), (4, .5, 60, 0, 50, 0, 2, 0, 1), (8, 0, 60, 0, 9, 1.0, 2, 0, 1), (5, 0, 3, 1.0, 4, 1.0, 2, 0, 1),
    (6, 0, 100, 0, 3, 1.0, 2, 0, 1), (2, 0, 4, 1.0, 2, 1.0, 2, 1, 1), (9, 0, 320, 0, 0, 0, 2, 0, 1), (400, 0, 3, 1.0, 8, 1.0, 2, 0, 1),
    (3, 1.0, 0, 0, 4, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (12, .9, 6, 1.0, 30, 0, 1, 0, 0), (25, .8, 5, 1.0, 4, 1.0, 1, 0, 0),
    (7, .7, 90, 0, 80, 0, 1, 0, 0), (5, 1.0, 2, 1.0, 60, 0, 1, 1, 0),
    (40, 0, 8, 0, 55, 0, 1, 0, 1), (120, .05, 40, 0, 80, 0, 1, 0, 1), (22, .1, 60, 0, 35, .05, 1, 0, 1), (300, 0, 0, 0, 0, 0, 1, 0, 1),
    (18, 0, 90, 0, 3, 1.0, 1, 0, 1), (20, .2, 3, 1.0, 3, 1.0, 1, 0, 1), (17, 0, 0, 0, 0, 0, 1, 0, 1), (55, .3, 4, 1.0, 2, 1.0, 1, 0, 1),
    (6, 0, 70, 0, 65, 0, 1, 0, 1), (4, 0, 30, .1, 45, 0, 1, 0, 1), (2, 0, 25, 0, 90, 0, 1, 0, 1), (9, 0, 18, 0, 40, 0, 1, 0, 1),
    (5, 0, 2, 1.0, 60, 0, 1, 1, 1), (8, 0, 1, 1.0, 28, 0, 1, 1, 1), (3, 0, 40, 0, 70, 0, 1, 1, 1), (6, 0, 0, 0, 20, 0, 1, 1, 1),
    (5, 0, 3, 1.0, 2, 1.0, 1, 0, 0), (7, .2, 2, 1.0, 5, .8, 1, 0, 0), (9, 0, 80, 0, 0, 0, 1, 0, 0), (6, 0, 0, 0, 4, 1.0, 1, 0, 0),
    (4, 0, 12, .9, 3, 1.0, 1, 1, 0), (8, 0, 60, 0, 5, 1.0, 1, 0, 0), (10, 0, 30, 0, 2, 0, 1, 0, 0), (3, 0, 2, 0, 4, 0, 1, 0, 0),
    (25, .1, 6, 1.0, 5, 1.0, 2, 0, 1), (7, .3, 5, 1.0, 6, 1.0, 2, 0, 1),
    (3, 1.0, 60, 0, 4, 1.0, 0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (10, 0, 90, 0, 5, 0, 0, 0, 0), (15, 0, 3, 1.0, 8, 0, 0, 0, 0),
    (4, 0, 2, 1.0, 6, 1.0, 0, 1, 0), (12, 0, 180, 0, 0, 0, 0, 0, 0), (35, .05, 8, 0, 6, 0, 0, 0, 0), (45, 0, 60, 0, 6, 0, 0, 0, 0),
    (40, 0, 9, 1.0, 4, 1.0, 0, 0, 0), (90, .7, 70, .6, 60, .5, 0, 0, 0), (25, .8, 80, 0, 90, 0, 0, 0, 0), (14, 0, 2, 1.0, 9, 0, 0, 0, 0),
    (150, 0, 60, 0, 80, 0, 0, 0, 1), (60, .05, 90, 0, 70, 0, 0, 0, 1), (300, 0, 40, 0, 20, 0, 0, 0, 1), (45, 0, 60, 0, 40, 0, 0, 0, 1),
    (80, 0, 9, 0, 120, 0, 0, 0, 1), (120, 0, 100, 0, 5, 1.0, 0, 0, 1), (200, .1, 5, 1.0, 90, 0, 0, 0, 1), (5, 0, 40, 0, 55, 0, 0, 1, 1),
    (12, 0, 70, 0, 90, 0, 0, 0, 1), (9, 0, 3, 1.0, 90, 0, 0, 1, 1), (70, 0, 80, 0, 6, 0, 0, 0, 1), (75, 0, 90, 0, 3, 1.0, 0, 0, 1),
    (45, 0, 60, 0, 6, 0, 1, 0, 1), (35, .05, 8, 0, 6, 0, 1, 0, 1), (70, 0, 80, 0, 6, 0, 1, 0, 1), (40, 0, 9, 1.0, 4, 1.0, 1, 0, 1),
    (30, 0, 60, 0, 6, 0, 1, 0, 1), (25, 0, 12, 0, 8, 0, 1, 0, 1), (3, 0, 2, 1.0, 60, 0, 0, 0, 0), (6, 0, 4, 1.0, 80, 0, 0, 0, 0),
    (3, 0, 0, 0, 60, 0, 0, 0, 0), (8, 0, 60, 0, 20, 0, 0, 0, 0), (10, 0, 5, 0, 90, 0, 0, 0, 0), (14, 0, 3, 1.0, 40, 0, 0, 0, 0),
])
#: All FIELDS, but for scope whether the block lies in controls: blocks of links inside an article, then what lies in
#: controls, inside an article and outside.
LINKED = np.array([
    (30, .7, 80, 0, 5, 0, 2, 0, 0, 1, 1), (2, 1.0, 60, 0, 50, 0, 2, 0, 0, 1, 1), (6, 1.0, 90, 0, 70, .1, 2, 0, 0, 1, 1), (6, 1.0, 8, 0, 9, 0, 2, 0, 0, 1, 1),
    (4, 1.0, 0, 0, 40, 0, 2, 1, 0, 1, 1), (7, 1.0, 0, 0, 12, 0, 2, 1, 0, 1, 1), (5, 1.0, 30, 0, 6, 0, 2, 1, 0, 1, 1), (8, 1.0, 0, 0, 40, 0, 2, 0, 0, 1, 1),
    (5, 1.0, 30, 0, 0, 0, 2, 0, 0, 1, 1), (6, .8, 80, 0, 0, 0, 2, 0, 0, 1, 1), (12, 1.0, 9, 0, 0, 0, 2, 0, 0, 1, 1), (3, 1.0, 5, 0, 0, 0, 2, 0, 0, 1, 1),
    (3, 1.0, 60, 0, 50, 0, 2, 0, 0, 3, 1), (2, 1.0, 9, 0, 8, 0, 2, 0, 0, 5, 1), (4, 1.0, 30, 0, 90, 0, 2, 0, 0, 12, 1), (3, .9, 40, 0, 5, .2, 2, 0, 0, 2, 1),
    (6, .7, 4, 0, 30, .1, 2, 0, 0, 4, 1), (1, 1.0, 3, .3, 3, 0, 2, 0, 0, 8, 1), (5, 1.0, 0, 0, 1, 0, 2, 1, 0, 1, 1), (4, 1.0, 1, 0, 1, 0, 2, 0, 0, 3, 1),
    (3, 1.0, 60, 0, 0, 0, 2, 0, 0, 3, 0), (2, 1.0, 90, 0, 0, 0, 2, 0, 0, 6, 0), (4, .9, 12, 0, 0, 0, 2, 0, 0, 4, 0), (6, 1.0, 5, 0, 0, 0, 2, 0, 0, 2, 0),
    (3, 1.0, 0, 0, 60, 0, 2, 0, 0, 4, 0), (2, 1.0, 0, 0, 8, 0, 2, 0, 0, 7, 0), (5, .8, 0, 0, 30, 0, 2, 0, 0, 5, 0), (4, 1.0, 0, 0, 12, .2, 2, 0, 0, 2, 0),
    (4, 1.0, 0, 0, 0, 0, 2, 0, 0, 2, 0), (3, 1.0, 0, 0, 0, 0, 2, 0, 0, 8, 0), (2, 1.0, 0, 0, 0, 0, 2, 0, 0, 1, 0), (9, .8, 0, 0, 0, 0, 2, 0, 0, 1, 0),
    *((*r[:6], place, *r[6:]) for place in (INSIDE, OUTSIDE) for r in [
        (1, 1.0, 0, 0, 0, 0, 0, 1, 1, 0), (2, 1.0, 0, 0, 0, 0, 0, 1, 5, 0), (5, 1.0, 0, 0, 0, 0, 0, 1, 2, 0), (30, 1.0, 0, 0, 0, 0, 0, 1, 9, 0),
        (1, 0, 0, 0, 0, 0, 0, 1, 0, 0), (3, 0, 0, 0, 2, 0, 0, 1, 0, 0), (2, 0, 3, 0, 2, 0, 0, 1, 0, 0), (4, 0, 2, 1.0, 3, 1.0, 0, 1, 0, 0),
        (9, 0, 0, 0, 5, 0, 0, 1, 0, 0), (12, 0, 0, 0, 0, 0, 0, 1, 0, 0), (16, .1, 4, 0, 3, 0, 0, 1, 0, 0), (8, .5, 0, 0, 9, .6, 0, 1, 0, 0),
        (3, 1.0, 2, 0, 0, 0, 0, 1, 4, 0), (2, 1.0, 8, 0, 3, 0, 0, 1, 3, 0), (12, .9, 6, 0, 0, 0, 0, 1, 2, 0), (2, 0, 0, 0, 4, 1.0, 1, 1, 0, 0),
        (1, 0, 0, 0, 6, 0, 1, 1, 0, 0), (25, .5, 3, 0, 4, 0, 0, 1, 0, 0), (4, 0, 14, 0, 9, 0, 0, 1, 0, 0), (40, .55, 0, 0, 0, 0, 0, 1, 0, 0),
        (80, 0, 60, 0, 70, 0, 0, 1, 0, 1), (150, 0, 90, 0, 60, .1, 0, 1, 0, 1), (60, .2, 70, 0, 55, 0, 0, 1, 0, 1), (5, 0, 60, 0, 70, 0, 1, 1, 0, 1),
    ]),
    (40, 0, 0, 0, 0, 0, 2, 0, 1, 0, 1), (24, 0, 0, 0, 0, 0, 2, 0, 1, 0, 1), (25, .1, 5, 0, 30, 0, 2, 0, 1, 0, 1), (22, .1, 4, 0, 3, 0, 2, 0, 1, 0, 1),
    (18, 0, 40, 0, 0, 0, 2, 0, 1, 0, 1), (4, 0, 0, 0, 40, 0, 2, 1, 1, 0, 1), (1, 0, 0, 0, 30, 0, 2, 1, 1, 0, 1), (8, 0, 40, 0, 25, 0, 2, 0, 1, 0, 1),
    (6, 0, 60, 0, 0, 0, 2, 0, 1, 0, 1), (5, 1.0, 40, 0, 30, 0, 2, 0, 1, 1, 1),
    (40, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0), (24, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0), (45, 0, 8, 0, 0, 0, 0, 0, 1, 0, 0), (18, 0, 40, 0, 0, 0, 0, 0, 1, 0, 0),
    (4, 0, 0, 0, 40, 0, 0, 1, 1, 0, 0), (8, 0, 40, 0, 25, 0, 0, 0, 1, 0, 0), (5, 1.0, 40, 0, 30, 0, 0, 0, 1, 1, 0),
])
TABLE = np.vstack([np.insert(PLAIN, [8, 8], 0, axis=1), LINKED])
TABLE[:, 8] = np.where(TABLE[:, 8] == 1, IN_CONTROLS, np.where(TABLE[:, 6] == INSIDE, ARTICLE, FLAT))


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    region: bool
    boiler: bool
    heading: bool
    control: int  # which element of controls it lies in; 0 for none


def grow(rows: np.ndarray, depth: int = 8):
    """A tree by Gini impurity: the share of article text in a leaf, or (field, bound, below or equal, above)."""
    share = rows[:, -1].mean()
    if depth == 0 or share in (0.0, 1.0):
        return float(share)
    best = None
    for field in range(rows.shape[1] - 1):
        values = np.unique(rows[:, field])
        for bound in (values[1:] + values[:-1]) / 2:
            low = rows[:, field] <= bound
            p, q = rows[low, -1].mean(), rows[~low, -1].mean()
            impurity = low.mean() * p * (1 - p) + (1 - low.mean()) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, field, float(bound), low
    if best is None:
        return float(share)
    _, field, bound, low = best
    return field, bound, grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


@functools.cache
def tree():
    """The scopes at its root, since blocks of different scopes have different neighbours; each grows on its own rows."""
    flat, article, controls = (grow(TABLE[TABLE[:, 8] == k]) for k in (FLAT, ARTICLE, IN_CONTROLS))
    return 8, 0.5, flat, (8, 1.5, article, controls)


def is_article(fields: tuple) -> bool:
    at = tree()
    while isinstance(at, tuple):
        at = at[2] if fields[at[0]] <= at[1] else at[3]
    return at >= 0.5


def called(attributes: str) -> Iterator[str]:
    """Of each name in class, id and role its last word that says what the element is, in lower case."""
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for name in (a or b or c).split():
            parts = [x.lower() for x in NAME_PART.findall(name)]
            said = [x for x in parts if x not in NEUTRAL and not x[0].isdigit()]
            if said:
                yield said[-1]


class Marks(NamedTuple):
    boiler: bool
    control: bool
    main: bool
    aside: bool  # what an article element of its own may hold beside the article


def marked(attributes: str) -> Marks:
    """What class, id and role say of an element."""
    names = frozenset(called(attributes))
    main = any(k.lower() == "role" and (a or b or c).strip().lower() == "main" for k, a, b, c in ATTRIBUTE.findall(attributes))
    return Marks(bool(names & NOT_ARTICLE), bool(names & CONTROL_NAMES), main, bool(names & NO_ARTICLE_OF_ITS_OWN))


UNNAMED = Marks(False, False, False, False)
remembered = functools.lru_cache(maxsize=4096)(marked)


def decoded(text: str) -> str:
    if "&#" in text:
        text = TOO_LONG.sub("\ufffd", ZEROS.sub(r"&#\1", text))
    return html.unescape(text) if "&" in text else text


class Token(NamedTuple):
    start: int
    end: int
    tag: str | None  # None for comments, declarations and opaque elements
    closes: bool
    attributes: str


def tokens(page: str) -> Iterator[Token]:
    """Markup in order. Time is linear in the page, whatever it holds: every step goes forward, except that one tag
    which runs to the page's end inside quotes is read again without regard to quotes, as are all tags after it."""
    last = {c: page.rfind(c) for c in "\"'>"}
    quotes, i, n = True, 0, len(page)
    while (i := page.find("<", i)) >= 0:
        sign = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = n if end < 0 else end + 3
            yield Token(i, end, None, False, "")
        elif sign in ("!", "?") and sign:
            end = n if i > last[">"] else page.find(">", i) + 1
            yield Token(i, end, None, False, "")
        elif m := NAME.match(page, i + 2 if sign == "/" else i + 1):
            end = closing(page, m.end(), last, quotes)
            if end is None and quotes:
                quotes = False
                end = closing(page, m.end(), last, quotes)
            if end is None:  # cut off by the page's end
                yield Token(i, n, None, False, "")
                return
            name = m[0].lower()
            if name in OPAQUE and sign != "/":
                stop = OPAQUE[name].search(page, end)
                end = n if stop is None or stop.start() > last[">"] else page.find(">", stop.start()) + 1
                yield Token(i, end, None, False, "")
            else:
                yield Token(i, end, name, sign == "/", page[m.end() : end - 1])
        else:
            i += 1
            continue
        i = end


def closing(page: str, at: int, last: dict[str, int], quotes: bool) -> int | None:
    """The end of the tag that is open at ``at``. A quote that is never closed is a character like others."""
    if at > last[">"]:
        return None
    if not quotes:
        return page.find(">", at) + 1
    while True:
        at = IN_TAG.match(page, at).end()
        if at == len(page):
            return None
        if page[at] == ">":
            return at + 1
        at = page.find(page[at], at + 1) + 1 if at < last[page[at]] else at + 1


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # element, in an article, in boilerplate, controls
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    heading, link, at, controls = False, 0, 0, 0

    def flush() -> None:
        words = "".join(parts).split()
        if words:
            out.append(Block(" ".join(words), len(words), len("".join(linked).split()), stack[-1][1], stack[-1][2], heading, stack[-1][3]))
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        parts.append(text)
        if link:
            linked.append(text)

    def pop() -> None:
        open_[stack.pop()[0]] -= 1

    for t in tokens(page):
        if t.start > at:
            say(decoded(page[at : t.start]))
        at, tag = t.end, t.tag
        if tag is None:
            continue
        if tag == "a":
            link = 0 if t.closes else 1
            if not t.closes:
                linked.append(" ")
        elif tag == "br":
            say(" ")
        elif tag in BLOCKS or tag == "button":
            flush()
            if t.closes:
                heading, link = False, 0
                if open_[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag in CLOSED_BY_SAME and stack[-1][0] == tag or stack[-1][0] == "p":
                pop()
            heading = tag in HEADINGS
            if tag != "hr":
                m = (remembered if len(t.attributes) < 200 else marked)(t.attributes) if t.attributes else UNNAMED
                _, region, boiler, control = stack[-1]
                root = tag in ("html", "body", "article", "main")
                bad = m.boiler and not root or tag in NOT_TEXT or tag == "header" and not region or tag == "article" and m.aside
                if not control and (m.control and not root or tag in CONTROLS):
                    controls += 1
                    control = controls
                stack.append((tag, region or tag == "article" or tag == "main" or m.main, boiler or bad, control))
                open_[tag] += 1
    if at < len(page):
        say(decoded(page[at:]))
    flush()
    return out


Figures = tuple[int, float]
NONE: Figures = (0, 0.0)


def among(figures: list[Figures]) -> Iterator[tuple[Figures, Figures, int]]:
    """For each block of one article or element: what is before and after it, and how many blocks of links it is
    among; those in a row have what is around the row."""
    i = 0
    while i < len(figures):
        end = i + 1
        linked = figures[i][1] > OF_LINKS
        while linked and end < len(figures) and figures[end][1] > OF_LINKS:
            end += 1
        before, after = figures[i - 1] if i else NONE, figures[end] if end < len(figures) else NONE
        for _ in range(i, end):
            yield before, after, (end - i) * linked
        i = end


def fields(found: list[Block]) -> list[tuple]:
    """FIELDS of each block."""
    region = any(b.region and not b.boiler and not b.control for b in found)
    figures = [(b.words, min(1.0, b.linked / b.words)) for b in found]
    groups: dict[int, list[int]] = {}  # blocks of the article (0) and of each element of controls
    out: list[tuple] = []
    for i, b in enumerate(found):
        before, after = figures[i - 1] if i else NONE, figures[i + 1] if i + 1 < len(found) else NONE
        place = INSIDE if b.region and region else OUTSIDE if b.boiler or b.control or region else UNMARKED
        if b.boiler and region:
            place = NAMED
        elif region and (b.control or b.region):
            groups.setdefault(b.control, []).append(i)
        out.append((*figures[i], *before, *after, place, b.heading, FLAT, 0))
    for control, members in groups.items():
        for i, (before, after, row) in zip(members, among([figures[j] for j in members]), strict=True):
            out[i] = (*figures[i], *before, *after, out[i][6], found[i].heading, IN_CONTROLS if control else ARTICLE, row)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, f in zip(found, fields(found), strict=True) if is_article(f))


def with_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``html`` replaced by ``text``."""
    keep = [c for c in pages.columns if c not in (html, text)]

    def run(batches):
        for b in batches:
            found = pa.array([main_text(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=[*keep, text])

    return pages.select(*keep, F.col(html).cast("string").alias("_html")).mapInArrow(run, pages.select(*keep, F.lit("").alias(text)).schema)
