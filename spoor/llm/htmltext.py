"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks. Each block has
its word count and link density, those of the blocks before and after it, its kind
(heading, paragraph, list item or other text), and whether it stands apart: in an element
for menus, headers, footers, sidebars, notices, adverts, forms or comments. A decision tree, grown on the small
labelled table below by least impurity, marks the blocks of the article. Link density and words of a block and its
neighbours come first in it; standing apart decides only what they leave open, as a reader's
comment reads like a paragraph of the article.

Defined cases: null and empty pages give an empty text; a comment, script or style that
never ends runs to the end of the page; a ``<`` that opens no tag is text; an unclosed
element lasts until one around it closes; repeated rows are treated one by one; an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by the part they play here.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote button details dialog div dl fieldset figure footer form header main menu nav ol search section select table ul".split()
)
OUTSIDE = frozenset("aside button dialog fieldset footer form header menu nav search select".split())
KINDS = {"p": "paragraph", "blockquote": "paragraph", "pre": "paragraph", "li": "item", "dd": "item", "dt": "item", **{f"h{k}": "heading" for k in range(1, 7)}}
UNSEEN = frozenset("script style noscript template textarea title iframe svg math object canvas audio video head".split())
HINTS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted related replies reply rss search share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


@dataclass
class Block:
    text: str
    words: int
    links: float
    kind: str
    apart: bool


def _marks(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element's name or attributes set it outside the main text."""
    if name in OUTSIDE and not (name == "header" and in_article):
        return True
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if name not in ("article", "main", "body") and not HINTS.isdisjoint(_WORDS.findall(value)):
                return True
        elif key == "role":
            if value in ROLES:
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, in an article, apart from the main text
    article = outside = in_link = False
    kind = ""

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip(" ")
        if text:
            n = text.count(" ") + 1
            inside = len(_SPACE.sub(" ", " ".join(linked)).split()) if linked else 0
            out.append(Block(text, n, min(1.0, inside / n), kind, outside))
        parts.clear()
        linked.clear()

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in UNSEEN and not closing and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page) if name != "head" else at
            flush()
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            kind = KINDS.get(name, "") if not closing else ""
            if name in CONTAINERS:
                if not closing:
                    stack.append((name, article, outside))
                    outside = outside or _marks(name, attrs, article)
                    article = article or name in ("article", "main")
                elif any(s[0] == name for s in stack):
                    while stack:
                        last, article, outside = stack.pop()
                        if last == name:
                            break
                    in_link = False
            elif not closing and name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
                in_link = False
    add(page[at:])
    flush()
    return out


#: Labelled blocks: words and link density of the block, of the one before, of the one after; kind (p, h, li, or other); apart; main text.
TABLE = [
    # paragraphs, long and short, among others of their kind
    (80, 0.0, 60, 0.0, 70, 0.0, "p", 0, 1), (45, 0.1, 12, 0.0, 90, 0.0, "p", 0, 1), (25, 0.0, 80, 0.0, 10, 0.3, "p", 0, 1), (3, 0.0, 90, 0.0, 60, 0.0, "p", 0, 1),
    (1, 0.0, 40, 0.0, 50, 0.0, "p", 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, "p", 0, 1), (9, 0.0, 20, 0.0, 120, 0.0, "p", 0, 1), (12, 0.0, 8, 0.0, 30, 0.0, "p", 0, 1),
    (2, 0.5, 70, 0.0, 12, 0.0, "p", 0, 1), (150, 0.05, 1, 1.0, 9, 0.1, "p", 0, 1), (14, 0.0, 1, 1.0, 40, 0.0, "p", 0, 1), (30, 0.2, 40, 0.0, 2, 1.0, "p", 0, 1),
    (1, 0.0, 14, 0.0, 12, 0.0, "p", 0, 1), (2, 0.0, 3, 0.0, 15, 0.0, "p", 0, 1), (14, 0.0, 0, 0.0, 0, 0.0, "p", 0, 1), (5, 0.0, 6, 0.0, 0, 0.0, "p", 0, 1), (40, 0.4, 60, 0.1, 50, 0.0, "p", 0, 1),
    # the last of a page
    (40, 0.0, 60, 0.0, 0, 0.0, "p", 0, 1), (8, 0.0, 50, 0.0, 0, 0.0, "p", 0, 1), (20, 0.1, 25, 0.0, 0, 0.0, "p", 0, 1), (6, 0.0, 30, 0.0, 0, 0.0, "li", 0, 1), (2, 0.0, 90, 0.0, 0, 0.0, "p", 0, 1), (45, 0.0, 20, 0.0, 0, 0.0, "", 0, 1),
    # beside lists of links
    (6, 0.0, 2, 1.0, 40, 0.0, "p", 0, 1), (1, 0.0, 1, 1.0, 12, 0.0, "p", 0, 1), (4, 0.0, 40, 0.0, 1, 1.0, "p", 0, 1), (1, 0.0, 12, 0.0, 2, 1.0, "p", 0, 1), (9, 0.0, 60, 0.0, 1, 1.0, "p", 0, 1), (12, 0.2, 4, 0.0, 2, 1.0, "p", 0, 1),
    (4, 0.0, 1, 1.0, 60, 0.0, "h", 0, 1), (1, 0.0, 1, 1.0, 30, 0.0, "h", 0, 1), (1, 0.0, 3, 1.0, 9, 0.0, "h", 0, 1), (2, 0.0, 1, 1.0, 1, 0.0, "h", 0, 1), (8, 0.0, 2, 1.0, 30, 0.0, "h", 0, 1), (9, 0.0, 1, 1.0, 14, 0.0, "h", 0, 1), (7, 0.0, 1, 1.0, 20, 0.0, "h", 0, 1), (6, 0.0, 2, 1.0, 12, 0.0, "p", 0, 1), (9, 0.0, 1, 1.0, 16, 0.0, "p", 0, 1), (25, 0.25, 40, 0.0, 12, 0.0, "p", 0, 1), (8, 0.25, 9, 0.0, 30, 0.1, "p", 0, 1),
    # headings before text; those over lists of links are not of the article
    (9, 0.0, 12, 0.0, 60, 0.0, "h", 0, 1), (3, 0.0, 90, 0.0, 70, 0.1, "h", 0, 1), (12, 0.0, 1, 1.0, 3, 0.0, "h", 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, "h", 0, 1), (25, 0.0, 8, 0.0, 40, 0.0, "h", 0, 1),
    (6, 0.0, 0, 0.0, 25, 0.0, "h", 0, 1), (2, 0.0, 30, 0.0, 12, 0.0, "h", 0, 1), (7, 0.0, 14, 0.0, 1, 0.0, "h", 0, 1),
    (2, 0.0, 10, 0.0, 2, 1.0, "h", 0, 0), (1, 0.0, 1, 1.0, 1, 1.0, "h", 0, 0), (3, 0.0, 70, 0.0, 6, 1.0, "h", 0, 0), (4, 0.0, 12, 0.0, 8, 0.9, "h", 0, 0),
    # list items of text
    (10, 0.0, 40, 0.0, 12, 0.0, "li", 0, 1), (3, 0.0, 5, 0.0, 3, 0.0, "li", 0, 1), (2, 0.0, 60, 0.0, 2, 0.0, "li", 0, 1), (30, 0.1, 25, 0.0, 30, 0.2, "li", 0, 1), (4, 0.0, 4, 0.0, 0, 0.0, "li", 0, 1), (1, 0.0, 1, 0.0, 50, 0.0, "li", 0, 1),
    # menus, lists of links, link bars, whatever their element
    (1, 1.0, 1, 1.0, 1, 1.0, "li", 1, 0), (1, 1.0, 0, 0.0, 1, 1.0, "li", 1, 0), (2, 1.0, 2, 1.0, 14, 0.0, "li", 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, "li", 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, "li", 0, 0),
    (4, 1.0, 3, 1.0, 40, 0.0, "li", 0, 0), (6, 1.0, 2, 0.0, 7, 1.0, "li", 0, 0), (9, 1.0, 8, 1.0, 10, 1.0, "li", 0, 0), (3, 0.9, 70, 0.0, 4, 1.0, "li", 0, 0), (10, 0.9, 8, 1.0, 9, 1.0, "p", 0, 0),
    (25, 0.8, 20, 0.9, 30, 0.7, "p", 0, 0), (60, 0.9, 40, 0.8, 50, 0.9, "", 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, "", 0, 0), (1, 1.0, 1, 1.0, 9, 0.0, "", 0, 0), (12, 0.8, 70, 0.0, 3, 1.0, "", 0, 0), (2, 1.0, 80, 0.0, 1, 1.0, "p", 0, 0),
    (5, 1.0, 70, 0.0, 60, 0.0, "p", 0, 0), (3, 1.0, 100, 0.0, 80, 0.0, "", 1, 0), (15, 0.9, 15, 0.9, 10, 0.0, "", 1, 0), (1, 1.0, 50, 0.0, 1, 1.0, "", 0, 0), (7, 1.0, 4, 0.0, 8, 1.0, "h", 0, 0), (5, 0.7, 12, 0.0, 40, 0.0, "p", 0, 0),
    # text of no such element: long blocks are of the article, short ones are labels, adverts and notes
    (70, 0.0, 50, 0.0, 60, 0.0, "", 0, 1), (35, 0.1, 2, 1.0, 60, 0.0, "", 0, 1), (22, 0.0, 40, 0.0, 5, 0.8, "", 0, 1), (120, 0.2, 3, 1.0, 3, 1.0, "", 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, "", 0, 1), (16, 0.0, 25, 0.0, 60, 0.0, "", 0, 1),
    (9, 0.0, 60, 0.1, 30, 0.0, "", 0, 1), (4, 0.0, 50, 0.0, 45, 0.0, "", 0, 1), (14, 0.0, 0, 0.0, 0, 0.0, "", 0, 1), (12, 0.0, 30, 0.0, 40, 0.0, "", 0, 1),
    (8, 0.0, 1, 1.0, 12, 0.0, "", 0, 0), (5, 0.0, 1, 1.0, 30, 0.0, "", 0, 0), (11, 0.0, 1, 1.0, 60, 0.0, "", 0, 0), (3, 0.0, 2, 1.0, 9, 0.0, "", 0, 0), (1, 0.0, 1, 1.0, 16, 0.0, "", 0, 0), (9, 0.0, 1, 1.0, 5, 0.0, "", 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, "", 0, 0), (5, 0.0, 3, 0.7, 4, 1.0, "", 0, 0), (12, 0.0, 70, 0.0, 0, 0.0, "", 1, 0),
    (14, 0.0, 1, 1.0, 12, 0.0, "", 1, 0), (6, 0.3, 50, 0.0, 0, 0.0, "", 1, 0), (20, 0.1, 4, 0.0, 0, 0.0, "", 1, 0), (2, 0.0, 1, 1.0, 9, 0.0, "", 1, 0), (90, 0.0, 2, 1.0, 70, 0.0, "", 1, 0),
    # text that stands apart: notices, adverts, comments, sidebars
    (60, 0.0, 40, 0.0, 40, 0.0, "p", 1, 0), (40, 0.0, 30, 0.0, 25, 0.0, "p", 1, 0), (120, 0.1, 90, 0.0, 5, 0.0, "p", 1, 0), (9, 0.0, 80, 0.0, 90, 0.0, "p", 1, 0), (25, 0.0, 3, 0.0, 30, 0.0, "p", 1, 0),
    (1, 0.0, 60, 0.0, 1, 0.0, "p", 1, 0), (3, 0.0, 70, 0.0, 30, 0.0, "h", 1, 0), (2, 0.0, 12, 0.0, 40, 0.0, "h", 1, 0), (8, 0.0, 9, 0.0, 7, 0.0, "li", 1, 0), (30, 0.0, 60, 0.0, 80, 0.0, "", 1, 0),
]
NAMES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "paragraph", "heading", "item", "apart"]
_SHORT = {"p": "paragraph", "h": "heading", "li": "item"}


def features(words: int, links: float, before: tuple[int, float], after: tuple[int, float], kind: str, apart: bool) -> tuple:
    return (words, links, *before, *after, *(int(kind == k) for k in ("paragraph", "heading", "item")), int(apart))


def labelled(table: list[tuple] = TABLE) -> list[tuple]:
    return [(*features(r[0], r[1], r[2:4], r[4:6], _SHORT.get(r[6], ""), r[7]), r[8]) for r in table]


DEPTH = 7

Tree = tuple | int


def _impurity(rows: list[tuple]) -> float:
    p = sum(r[-1] for r in rows) / len(rows)
    return len(rows) * p * (1 - p)


def grow(rows: list[tuple], depth: int = DEPTH) -> Tree:
    """A binary tree by least Gini impurity: (feature, threshold, up to it, above it) or a label."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            score = _impurity(low) + _impurity(high)
            if best is None or score < best[0] - 1e-12:
                best = score, f, cut, low, high
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, low, high = best
    return (f, cut, grow(low, depth - 1), grow(high, depth - 1))


def decide(tree: Tree, row: tuple) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    around = [(0, 0.0), *((b.words, b.links) for b in found), (0, 0.0)]
    return "\n".join(b.text for k, b in enumerate(found) if decide(tree, features(b.words, b.links, around[k], around[k + 2], b.kind, b.apart)))


def extract(pages: DataFrame, html_col: str = "html", table: list[tuple] | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points."""
    pages = pages.drop("text", "n_chars")  # columns of these names are replaced
    tree = grow(labelled(table or TABLE))

    @F.pandas_udf("string")
    def of(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: main_text(x, tree), na_action=None)

    return pages.withColumn("text", of(F.col(f"`{html_col}`"))).withColumn("n_chars", F.length("text").cast("long"))
