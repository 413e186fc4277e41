"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. Parts that are never article text
(scripts, menus, headers, footers, sidebars, notices, adverts, forms, comments) are left
out by tag, role or class. The first pass decides each other block by where it stands and
by its length, link density and stop-word density; short or doubtful blocks stay open.
The second pass gives an open block the label of its nearest decided neighbours.

An article or main element of some length has the page's text, whatever its words. One of
few and short blocks may be a teaser: it has the text only if the passes find no longer text
outside it; else the passes decide on all blocks, and its short ones go. Inside an article a class or id leaves
a part out only if all its words say so. Character references are decoded, white space
inside a block becomes one space, and blocks are joined by line breaks; nothing else is
dropped or shortened. Null and empty pages have an empty text, no pages give no rows. Pages
are worked on whole, one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame

from emberlog.llm.batches import per_text

#: Characters below which a block is short, and from which it is long.
SHORT = 70
LONG = 200
#: Shares of link characters and of stop words.
MAX_LINKS = 0.4
LOW_STOP_WORDS = 0.15
HIGH_STOP_WORDS = 0.3
#: Share of link characters from which a list item is a menu entry.
MENU_ITEM = 0.9
#: Most blocks of an article that may be a teaser, if it has fewer than ``LONG`` characters.
TEASER = 3

#: Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his if in into is it its
    not of on or our she so than that the their then there they this to was we were which
    who will with would you
    der die das den dem des ein eine einen einem und oder aber ist sind war im in zu mit von
    auf für als auch nicht sich es er sie wir aus bei nach über
    le la les un une des du de et ou mais est sont dans en au aux par pour pas que qui sur
    avec ce cette il elle ne se plus
    el los las una unos y o pero es son con por para del al lo como su sus no
    """.split()
)

#: Elements by their part in a page.
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu
    nav ol p pre section summary table tbody td tfoot th thead tr ul
    """.split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset(
    "script style noscript template iframe svg math object canvas textarea title".split()
)
LEFT_OUT = frozenset("aside button dialog footer form head menu nav select".split())
ARTICLE = frozenset("article main".split())

#: Roles and class or id words of parts outside the article.
OUTSIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search".split()
)
OUTSIDE_WORDS = frozenset(
    """
    ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent
    cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar
    navigation newsletter notice notices pagination popup promo promoted recommended related
    replies reply respond share sharing sidebar signup social sponsor sponsored subscribe
    subscription toolbar widget
    """.split()
)
#: Words that say nothing of what a part is for.
BOX_WORDS = frozenset(
    "area bar block box button buttons container content inner item items links list section "
    "slot text title unit wrap wrapper".split()
)
ARTICLE_NAMES = frozenset(
    """
    article-body article-content article-text entry-content main-content post-body post-content
    story-body articlebody
    """.split()
)

TOKEN = re.compile(
    r"""(?P<comment><!--.*?(?:-->|\Z))
      | <(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)
        (?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | (?P<other><[a-zA-Z/!?][^>]*+(?:>|\Z))
      | (?P<text>[^<]++|<)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(
    r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S
)
WORD = re.compile(r"\w+")

GOOD, BAD, OPEN, MAYBE = "good", "bad", "open", "maybe"

MAIN_TEXT = [("text", "string"), ("n_chars", "bigint")]


@dataclass
class Element:
    name: str
    outside: bool
    article: int | None


@dataclass
class Block:
    text: str
    tag: str
    links: int
    article: int | None

    @property
    def letters(self) -> int:
        """Characters but white space, as links are counted."""
        return len(self.text) - self.text.count(" ")

    @property
    def link_density(self) -> float:
        return self.links / max(self.letters, 1)

    @property
    def stop_density(self) -> float:
        words = [w.lower() for w in WORD.findall(self.text)]
        return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def attributes_of(source: str) -> dict[str, str]:
    found = {}
    for name, value in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(value.strip("\"'")).lower())
    return found


def says_outside(names: list[str], in_article: bool) -> bool:
    """Whether class and id names tell of a part outside the article."""
    for name in names:
        words = {word for word in re.split(r"[^a-z0-9]+", name) if word}
        if OUTSIDE_WORDS & words and (not in_article or words <= OUTSIDE_WORDS | BOX_WORDS):
            return True
    return False


def element_of(
    name: str, attributes: dict[str, str], inside: Element | None, number: int
) -> Element:
    """An element; ``number`` is that of an article that starts with it."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    words = {word for n in names for word in re.split(r"[^a-z0-9]+", n)}
    role = attributes.get("role", "")
    in_article = inside is not None and inside.article is not None
    starts = (
        name in ARTICLE
        or role == "main"
        or "articlebody" in attributes.get("itemprop", "")
        or bool(ARTICLE_NAMES.intersection(names))
    )
    outside = (
        (inside is not None and inside.outside)
        or name in LEFT_OUT
        or (name == "header" and not in_article)
        or role in OUTSIDE_ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "")
        or (name not in ("html", "body", *ARTICLE) and says_outside(names, in_article))
        or (name in ARTICLE and bool({"comment", "comments", "reply"} & words))
        or (not in_article and "header" in words and name not in ("html", "body", *HEADINGS))
    )
    article = inside.article if in_article else number if starts else None
    return Element(name, outside, article)


class Page:
    """The blocks of one page, from a single pass over its tokens."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.open: list[Element] = []
        self.parts: list[str] = []
        self.links, self.in_link = 0, False
        self.tag = "body"
        self.articles = 0
        at, end = 0, len(html)
        while at < end:
            token = TOKEN.match(html, at)
            at = token.end()
            if token["text"] is not None:
                self.read_text(token["text"])
            elif token["name"] is not None:
                name = token["name"].lower()
                if token["close"]:
                    self.close(name)
                elif name in RAW and not token["attributes"].endswith("/"):
                    raw = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                    at = raw.end() if raw else end
                else:
                    self.start(name, token["attributes"])
        self.end_block()

    def read_text(self, text: str) -> None:
        if self.open and self.open[-1].outside:
            return
        decoded = unescape(text) if "&" in text else text
        self.parts.append(decoded)
        if self.in_link:
            self.links += len("".join(decoded.split()))

    def start(self, name: str, source: str) -> None:
        if name == "br":
            self.parts.append(" ")
        elif name == "a":
            self.in_link = True
        if name in VOID:
            if name == "hr":
                self.end_block()
            return
        block = name in BLOCK
        if block:
            self.end_block()
            if name == "p" or name in HEADINGS:
                self.close_implied({"p"})
            elif name == "li":
                self.close_implied({"li", "p"})
            elif name in ARTICLE:
                self.end_unclosed(name)
        if block or name in LEFT_OUT or source:
            inside = self.open[-1] if self.open else None
            element = element_of(name, attributes_of(source), inside, self.articles)
            self.articles += element.article == self.articles
            if not block and not element.outside and name not in LEFT_OUT:
                return  # an inline element that changes nothing
            if not block and name == "a":
                return
            self.open.append(element)
            if block:
                self.tag = name

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name in BLOCK:
            self.end_block()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].name == name:
                del self.open[k:]
                break
        self.tag = self.open[-1].name if self.open else "body"

    def close_implied(self, names: set[str]) -> None:
        while self.open and self.open[-1].name in names:
            self.open.pop()

    def end_unclosed(self, name: str) -> None:
        """A main element is never inside these, and an article never inside a menu."""
        never = {"nav", "aside", "header", "footer"} if name == "main" else {"nav"}
        for k, element in enumerate(self.open):
            if element.name in never:
                del self.open[k:]
                break

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            article = self.open[-1].article if self.open else None
            self.blocks.append(Block(text, self.tag, self.links, article))
        self.parts, self.links, self.in_link = [], 0, False


def first_pass(block: Block) -> str:
    if block.tag in HEADINGS:
        return OPEN
    if block.link_density > MAX_LINKS:
        return BAD
    if len(block.text) < SHORT:
        return BAD if block.links else OPEN
    stops = block.stop_density
    if stops >= HIGH_STOP_WORDS:
        return GOOD if len(block.text) >= LONG else MAYBE
    if stops >= LOW_STOP_WORDS:
        return MAYBE
    # words of no known language: long text without links is text all the same
    return MAYBE if len(block.text) >= LONG and not block.links else BAD


def second_pass(labels: list[str]) -> list[str]:
    """Doubtful blocks first, by neighbours; then the short ones, with those decided."""
    decided = settle(labels, MAYBE, GOOD)
    return settle(decided, OPEN, BAD)


def settle(labels: list[str], which: str, alone: str) -> list[str]:
    n = len(labels)
    left, right = [(n, "")] * n, [(n, "")] * n
    last = None
    for i, label in enumerate(labels):
        left[i] = (i - last, labels[last]) if last is not None else (n, "")
        last = i if label in (GOOD, BAD) else last
    last = None
    for i in range(n - 1, -1, -1):
        right[i] = (last - i, labels[last]) if last is not None else (n, "")
        last = i if labels[i] in (GOOD, BAD) else last
    out = []
    for i, label in enumerate(labels):
        if label == which:
            (near, a), (far, b) = sorted((left[i], right[i]), key=lambda x: x[0])
            if not a:
                label = alone
            elif near == far and b and a != b:
                label = alone
            else:
                label = a
        out.append(label)
    return out


def of_articles(blocks: list[Block], labels: list[str]) -> set[int] | None:
    """Articles that have the page's text; None if the labels decide."""
    size: dict[int, list[int]] = {}
    for block in blocks:
        if block.article is not None:
            held = size.setdefault(block.article, [0, 0])
            held[0] += 1
            held[1] += round(len(block.text) * (1 - min(block.link_density, 1.0)))
    whole = {k for k, (count, length) in size.items() if count > TEASER or length >= LONG}
    if whole or not size:
        return whole or None
    beside = sum(len(b.text) for b, x in zip(blocks, labels) if x == GOOD and b.article is None)
    return None if beside > sum(length for _, length in size.values()) else set(size)


def main_blocks(html: str) -> list[str]:
    blocks = Page(html).blocks
    first = [first_pass(block) for block in blocks]
    labels = second_pass(first)
    articles = of_articles(blocks, labels)
    if articles is None:
        return [
            block.text
            for block, open_or_not, label in zip(blocks, first, labels)
            # short blocks of a teaser stay out, whatever stands next to it
            if label == GOOD and not (block.article is not None and open_or_not == OPEN)
        ]
    return [
        block.text
        for block in blocks
        if block.article in articles and not (block.tag == "li" and block.link_density >= MENU_ITEM)
    ]


def main_text(html: bytes) -> tuple[str, int]:
    text = "\n".join(main_blocks(html.decode("utf-8")))
    return text, len(text)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, main ``text`` and its length in characters, per page."""
    found = per_text(main_text, MAIN_TEXT)("html").alias("main")
    return pages.select("page_id", "url", found).select("page_id", "url", "main.*")
