"""HTML main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags; where it marks an article, its blocks are those of the article. The first
pass decides blocks by their share of linked text, their length and their density of stop words; what is marked as menu,
form, notice and the like is out, and in an article length or density alone is enough. Short and middling blocks stay
open. The second pass gives each open block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words by language (fixed values).
STOP_WORDS = {
    "en": "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you",
    "de": "als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht oder sich sie sind über um und von war wie wird zu zum zur",
    "fr": "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se ses son sont sur un une vous",
    "es": "a al como con de del el ella en es esta este fue ha la las lo los más me no o para pero por que se si sin su sus un una y ya",
}
_STOP = frozenset(w for line in STOP_WORDS.values() for w in line.split())
#: Letters of scripts that are written without spaces count as words, the frequent ones as stop words (fixed values).
_UNSPACED = re.compile(r"[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\u0E00-\u0E7F]")
_STOP_LETTERS = frozenset("的一是不了在人有我他这中大来上个们到说为和地也你得就那以会着过对的にはをがでとのもたしてる")

# In a tag a quote opens a value only right after an equals sign; elsewhere it is a character like others.
_VALUE = r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?"
_TAG = re.compile(rf"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|{_VALUE})*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPLIT_NAME = re.compile(r"[^a-z]+")

#: Elements whose content is no text of the page; it runs to their own end tag. Of these, some run to the page's end without one.
_TO_THE_END = frozenset("script style textarea title xmp".split())
_RAW = frozenset("script style noscript template textarea iframe svg math title select object noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text, and those that usually hold all of it.
_OUT = frozenset("nav aside footer form menu button dialog search head".split())
_MAIN = frozenset("article main".split())
#: Words in class or id that mark an element as out.
_OUT_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar"
    " navigation newsletter notice notices notification pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip"
    " social sponsor sponsored subscribe toolbar widget adsbygoogle commentlist".split()
)
#: Words that may stand before and after them in one class; any other word makes it a class of its own (has-sidebar, comments-open).
_BEFORE = frozenset("article bottom entry global google header left main mobile page post primary reader readers right secondary site top user users visitor".split())
_AFTER = frozenset("area bar block body box button buttons container content form icons inner item items left links list outer panel posts right section slot text unit wrap wrapper".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status".split())
#: End tags that some elements do without: a new one ends an open one of the same set.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

GOOD, OPEN, BAD = 1, 0, -1
#: Words of a long block and of one that density alone can decide in an article; share of linked characters; density of stop words.
_LONG, _SOME, _LINKED, _DENSE = 12, 5, 0.5, 0.15
#: Items of a menu: share of links, how many follow each other, and words up to which they are names of places and not titles of sources.
_ALL_LINKED, _MENU, _NAMES = 0.9, 3, 5
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved\b)", re.I)


#: An element is out by a class or id that only names it so (an article or main element in it may still be the text), or for good.
NAMED, OUT = 1, 2


def _names_out(token: str) -> bool:
    """Whether a class or id is made of words that mark an element as out, and of known words around them only."""
    words = [w for w in _SPLIT_NAME.split(token) if w]
    while words and words[0] in _BEFORE:
        del words[0]
    while words and words[-1] in _AFTER:
        del words[-1]
    return bool(words) and _OUT_NAMES.issuperset(words)


def _is_out(name: str, attributes: str, in_main: bool) -> int:
    if name in _OUT or (name == "header" and not in_main):
        return OUT
    if not attributes.strip():
        return 0
    named = 0
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return OUT
        if key == "role" and value in _OUT_ROLES:
            return OUT
        if key == "style" and "display:none" in value.replace(" ", ""):
            return OUT
        if key in ("class", "id") and any(map(_names_out, value.split())) and name not in ("body", "html", "main"):
            named = OUT if in_main and name not in _MAIN else NAMED
    return named


class Block(NamedTuple):
    """Text between two block-level tags (one space for any white space)."""

    text: str
    linked: int  # characters in links
    out: int  # stands out of the text (NAMED, OUT)
    main: bool  # stands in an article
    element: str  # block-level element that it stands in


class _Open(NamedTuple):
    name: str
    out: int
    main: bool
    link: bool
    element: str


class _Stack:
    """Open elements; the places of each name are kept, so an end tag costs no search."""

    def __init__(self) -> None:
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block-level elements

    def top(self) -> _Open:
        return self.open[-1] if self.open else _Open("", 0, False, False, "")

    def push(self, element: _Open) -> None:
        self.places.setdefault(element.name, []).append(len(self.open))
        if element.name in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(element)

    def pop(self) -> None:
        name = self.open.pop().name
        self.places[name].pop()
        if name in _BLOCK:
            self.blocks.pop()

    def end(self, name: str) -> None:
        """Close the last element of a name and all that was opened in it; an end tag without a start is nothing."""
        if self.places.get(name):
            for _ in range(len(self.open) - self.places[name][-1]):
                self.pop()

    def end_implied(self, names: set[str]) -> None:
        """Close an element that does without its end tag, and all inline elements left open in it."""
        while self.blocks and self.open[self.blocks[-1]].name in names:
            for _ in range(len(self.open) - self.blocks[-1]):
                self.pop()


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order."""
    blocks: list[Block] = []
    parts: list[str] = []
    stack, linked, at = _Stack(), 0, 0
    here = stack.top()
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page

    def close() -> None:
        nonlocal linked
        joined = " ".join("".join(parts).split())
        if joined:
            blocks.append(Block(joined, linked, here.out, here.main, here.element))
        parts.clear()
        linked = 0

    while True:
        tag = _TAG.search(html, at)
        piece = unescape(html[at : tag.start() if tag else len(html)])
        parts.append(piece)
        if here.link:
            linked += len("".join(piece.split()))
        if not tag:
            close()
            return blocks
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name in _BLOCK:
            close()
        elif name == "br":
            parts.append(" ")
        if name in _VOID:
            continue
        if tag[1]:
            stack.end(name)
        elif name in _RAW:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif name in _TO_THE_END:
                at = len(html)
            else:
                endless.add(name)
            continue
        else:
            if name in _ENDS:
                stack.end_implied(_ENDS[name])
            up = stack.top()
            out = max(up.out, _is_out(name, tag[3], up.main))
            stack.push(_Open(name, out, up.main or (name in _MAIN and out < OUT), up.link or name == "a", name if name in _BLOCK else up.element))
        here = stack.top()


def _words(text: str) -> tuple[int, int]:
    """Words of a text and how many of them are stop words."""
    letters = _UNSPACED.findall(text)
    words = (_UNSPACED.sub(" ", text) if letters else text).split()
    stops = sum(w.strip(".,;:!?\"'()[]&%$#*|").lower() in _STOP for w in words) + sum(x in _STOP_LETTERS for x in letters)
    return len(words) + len(letters), stops


def menus(blocks: list[Block]) -> list[bool]:
    """Whether each block is an item of a menu: list items that are links, several in a row, and short."""
    found, run = [False] * len(blocks), 0
    for k, block in enumerate([*blocks, None]):
        if block is not None and block.element == "li" and block.linked >= _ALL_LINKED * len(block.text.replace(" ", "")):
            run += 1
            continue
        if run >= _MENU and sum(_words(b.text)[0] for b in blocks[k - run : k]) <= _NAMES * run:
            found[k - run : k] = [True] * run
        run = 0
    return found


def first_pass(block: Block, in_article: bool = False, in_menu: bool = False) -> int:
    """Label by share of linked text, length and density of stop words; the place moves the bounds."""
    if in_menu or (block.out and not in_article):
        return BAD
    words, stops = _words(block.text)
    if block.linked > _LINKED * len(block.text.replace(" ", "")):
        # A paragraph of links may be a sentence with one, and in an article a source; other short blocks of links are menus.
        return OPEN if in_article or block.element == "p" or words > _LONG else BAD
    dense = stops >= _DENSE * words
    if in_article:
        return GOOD if words >= _LONG or (dense and words >= _SOME) else OPEN
    if words < _LONG:
        return BAD if _RIGHTS.match(block.text) else OPEN
    return GOOD if dense else OPEN


def second_pass(labels: list[int], otherwise: int) -> list[int]:
    """Open blocks take the label of the nearest decided block before or after them; good wins a tie, ``otherwise`` holds without any."""
    n = len(labels)
    nearest: list[tuple[int, int]] = [(n, -otherwise)] * n  # distance and negated label
    for order in (range(n), range(n - 1, -1, -1)):
        last = None
        for k in order:
            if labels[k] != OPEN:
                last = k
            elif last is not None:
                nearest[k] = min(nearest[k], (abs(last - k), -labels[last]))
    return [-nearest[k][1] if x == OPEN else x for k, x in enumerate(labels)]


def main_text(html: str | None) -> str:
    """Main text of a page, a line for each block; empty if there is none."""
    blocks = blocks_of(html or "")
    article = [b for b in blocks if b.main and not b.out]
    if not article:  # articles only where a class names them out (comments, teasers beside an article stay out)
        article = [b for b in blocks if b.main and b.out < OUT]
    blocks = article or blocks
    labels = [first_pass(b, bool(article), m) for b, m in zip(blocks, menus(blocks))]
    if GOOD not in labels:  # a page of short lines is kept whole, but for what stands out of the text
        labels = [GOOD if x == OPEN else x for x in labels]
    return "\n".join(b.text for b, k in zip(blocks, second_pass(labels, BAD)) if k == GOOD)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, plus ``text`` (main text) and ``n_chars`` (its code points), for every row.

    A null or empty page has an empty text. Nothing is cut short; repeated rows come back as often as they occur, an
    empty table gives an empty result, and existing columns named ``text`` or ``n_chars`` are replaced.
    """

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in parts:
            yield pd.Series([main_text(h) for h in html], dtype=object)

    return pages.withColumn("text", extract(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long")).drop(html_col)
