"""Main text of pages against a tree made by the standard parser, and pages with odd markup."""

from __future__ import annotations

import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from skylane.llm import html as rules
from skylane.llm.html import main_text

BODY = "This is the first part of the story that was told by the people of the town, and it is long enough to count."


VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style noscript template textarea iframe svg math title select object noframes xmp".split()
BLOCK = (
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
).split()
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
OUT_ROLES = "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status".split()
OUT_NAMES = (
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter"
    " notice notices notification pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar"
    " widget adsbygoogle commentlist"
).split()
AROUND = (
    "article bottom entry global google header left main mobile page post primary reader readers right secondary site top user users visitor",
    "area bar block body box button buttons container content form icons inner item items left links list outer panel posts right section slot text unit wrap wrapper",
)
STOPS = set(" ".join(rules.STOP_WORDS.values()).split())


def names_out(token: str) -> bool:
    before, after = (f"(?:(?:{'|'.join(words.split())})-)*" for words in AROUND)
    words = "-".join(re.findall("[a-z]+", token)) + "-"
    # Known words around are taken first, as many as there are; all between them has to mark the element as out.
    rest = re.sub(f"^{before}", "", words)
    rest = "-".join(reversed([w for w in rest.split("-") if w])) + "-"
    rest = [w for w in re.sub(f"^{after}", "", rest).split("-") if w]
    return bool(rest) and all(w in OUT_NAMES for w in rest)


class Tree(HTMLParser):
    """A list of (path of elements, text) with the standard parser; a path holds (name, attributes)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.path, self.found = [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("tag", tag, None))
        if tag in VOID:
            return
        while True:
            blocks = [k for k, (n, _) in enumerate(self.path) if n in BLOCK]
            if not blocks or self.path[blocks[-1]][0] not in ENDS.get(tag, "").split():
                break
            del self.path[blocks[-1] :]
        self.path.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.found.append(("tag", tag, None))
        names = [n for n, _ in self.path]
        if tag in names:
            del self.path[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.found.append(("text", data, list(self.path)))


def _standing(path):
    """Out, in main, in a link, block element, raw."""
    out, main, link, element, raw = 0, False, False, "", False
    for name, attributes in path:
        words = " ".join(filter(None, (attributes.get("class"), attributes.get("id")))).lower().split()
        mine = 0
        if name in ("nav", "aside", "footer", "form", "menu", "button", "dialog", "search", "head") or name == "header" and not main:
            mine = 2
        elif "hidden" in attributes or attributes.get("role", "").lower() in OUT_ROLES:
            mine = 2
        elif name not in ("body", "html", "main") and any(map(names_out, words)):
            mine = 2 if main and name != "article" else 1
        out = max(out, mine)
        main = main or name in ("article", "main") and out < 2
        link, raw = link or name == "a", raw or name in RAW
        element = name if name in BLOCK else element
    return out, main, link, element, raw


def plain_main_text(html: str) -> str:
    blocks, parts = [], []

    def close():
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            standing = parts[-1][1]
            blocks.append((text, sum(len("".join(t.split())) for t, s in parts if s[2]), *standing))
        parts.clear()

    for kind, value, path in Tree(html).found:
        if kind == "tag" and value in BLOCK:
            close()
        elif kind == "tag" and value == "br":
            parts.append((" ", parts[-1][1] if parts else (0, False, False, "", False)))
        elif kind == "text" and not _standing(path)[4]:
            parts.append((value, _standing(path)))
    close()
    article = [b for b in blocks if b[3] and not b[2]] or [b for b in blocks if b[3] and b[2] < 2]
    blocks, article = article or blocks, bool(article)
    size = lambda b: len(b[0].replace(" ", ""))
    item = [b[5] == "li" and b[1] >= 0.9 * size(b) for b in blocks]
    labels = []
    for k, b in enumerate(blocks):
        words = b[0].split()
        stops = sum(w.strip(".,;:!?\"'()[]&%$#*|").lower() in STOPS for w in words)
        low, high = k, k
        while item[k] and low > 0 and item[low - 1]:
            low -= 1
        while item[k] and high + 1 < len(blocks) and item[high + 1]:
            high += 1
        run = blocks[low : high + 1]
        if b[2] and not article or item[k] and len(run) >= 3 and sum(len(r[0].split()) for r in run) <= 5 * len(run):
            labels.append("bad")
        elif b[1] > 0.5 * size(b):
            labels.append("open" if article or b[5] == "p" or len(words) > 12 else "bad")
        elif article:
            labels.append("good" if len(words) >= 12 or len(words) >= 5 and stops >= 0.15 * len(words) else "open")
        elif len(words) < 12:
            labels.append("bad" if re.match(r"(©|\(c\)|copyright\b|all rights reserved\b)", b[0], re.I) else "open")
        else:
            labels.append("good" if stops >= 0.15 * len(words) else "open")
    kept = []
    for k, b in enumerate(blocks):
        decided = [(abs(k - j), x != "good", x) for j, x in enumerate(labels) if x != "open"]
        label = labels[k] if labels[k] != "open" else "good" if "good" not in labels else min(decided)[2]
        kept += [b[0]] * (label == "good")
    return "\n".join(kept)


def test_pages_equal_a_tree_of_the_standard_parser():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert all(main_text(r["html"]) == plain_main_text(r["html"] or "") for r in pages)


@pytest.mark.parametrize(
    "page",
    [
        f"<article><p class=it's>{BODY}</p><p>second</p><p>don't stop</p></article>",
        f"<article><p title='a > b' data-x=\"'\">{BODY}<p>more &lt;text&gt; &amp; so on<ul><li>one<li>two</ul></article><nav>out</nav>",
        f"<main><header><h1>Title</h1></header><div class=ad><p>buy</p></div><p>{BODY}</p><aside>beside</aside><form>send</form></main>",
        f"<article><ul><li><a href=/>a</a><li><a href=/>b</a><li><a href=/>c</a></ul><p>{BODY}</p><ul><li><a href=/>only two</a><li><a href=/>links</a></ul></article>",
        f"<article><h1>Odd</h1><p>{BODY}<b><i><u><s><em>deep<p>next<ul><li><a href=/>a b</a><li><a href=/>b</a><li><a href=/>c</a></ul><p>One<p>two<p>three<p>{BODY}</article>",
        f"<div><h1>Title here</h1><p>{BODY}</p><p>short</p><ul><li><a href=/>a</a><li><a href=/>b</a></ul><p>end of it</p><p>Copyright 2024 by me</p></div>",
        "<div><h1>Only</h1><p>short lines</p></div>",
        f"<div id=comments><article>no</article></div><article><p>See <a href=/r>the full report of the committee here</a></p><p>{BODY}</p></article>",
    ],
)
def test_odd_markup_equals_the_standard_parser(page):
    assert main_text(page) == plain_main_text(page) != ""


def test_articles_lose_no_block():
    linked = "See the full report of the committee here"
    assert main_text(f"<article><p>{BODY}</p><p>See <a href=/>the full report of the committee here</a></p><p>end</p></article>") == f"{BODY}\n{linked}\nend"
    for name in ("story-related-facts", "status-notice"):
        assert main_text(f"<article><p>{BODY}</p><div class='{name}'><p>Kept</p></div></article>") == f"{BODY}\nKept"
    assert main_text(f"<p>{BODY}</p><p>See <a href=/>the full report of the committee here</a></p><p>{BODY}</p>").split("\n")[1] == linked
    assert main_text(f"<article><script>if (a<b && c==\"x) {{}}</script><p>{BODY}</p><svg><p>open</p></article>") == f"{BODY}\nopen"


def test_comments_adverts_sources_and_rights():
    text = f"{BODY}\nThe end of it"
    for out in ("section id=user-comments", "div class=reader-comments", "ol class=commentlist", "ins class=adsbygoogle", "div id=google_ads_1", "div class=sponsored-content"):
        name = out.split()[0]
        assert main_text(f"<article><p>{BODY}</p><p>The end of it</p><{out}><p>First! {BODY}</p></{name}></article>") == text, out
    sources = [f"The full report number {k} of the committee here" for k in range(3)]
    listed = "".join(f"<li><a href=/{k}>{line}</a></li>" for k, line in enumerate(sources))
    assert main_text(f"<article><p>{BODY}</p><ul>{listed}</ul></article>") == "\n".join([BODY, *sources])
    assert main_text(f"<div><p>{BODY}</p><p>The end of it</p></div><div>© 2024 The Town Paper</div>") == text
    unspaced = "这是一个关于城市的故事,它说的是人们在这里的生活和他们的工作。"
    assert main_text(f"<div><p>{unspaced}</p><ul><li><a href=/>甲</a></li></ul></div>") == unspaced


def test_both_passes_decide_given_pages():
    """Long and dense blocks are decided at once, the short ones by their neighbours."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    labels = []
    for r in pages:
        article = [b for b in rules.blocks_of(r["html"] or "") if b.main and not b.out]
        labels += [rules.first_pass(b, True, m) for b, m in zip(article, rules.menus(article))]
    assert labels.count(rules.GOOD) > 1000 and labels.count(rules.OPEN) > 200


def test_badly_nested_pages_take_linear_time():
    def seconds(n):
        began = time.process_time()
        main_text("<div><b>" * n + "</i></b>" * n + "<svg>" * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(4_000), 0.02)
