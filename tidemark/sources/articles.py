"""The article of a web page, by scores of its paragraphs, and its sections.

A page is read into a tree of elements; an open paragraph, list item or table cell ends where the next of its kind or a block begins.
Each paragraph of some length scores by its commas and length; the score goes to its parent, half of it to the grandparent, and
less to each element further up. An element's score is scaled by the share of its text that is not in links. The best element
is the article, with those of its siblings that score a good share of it or are paragraphs of running text. A page
whose article is short is read whole, but for its menus, headers, footers, sidebars and forms: its main element, else its article
element, else its body.

Pages are read one by one inside a task; nothing is shuffled. Limits are parameters; None turns one off.
"""

from __future__ import annotations

import html.parser
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text, parts of a page's frame, elements that break lines, headings, bold ones, elements without an end.
DEAD = frozenset("script style noscript svg template iframe canvas object".split())
CHROME = frozenset("nav header footer aside form button select dialog".split())
BLOCKS = frozenset("p div li ul ol tr td th table section article main blockquote dd dt dl figure figcaption h4 h5 h6 pre address br hr".split())
HEADINGS = frozenset(["h1", "h2", "h3"])
BOLD = frozenset(["strong", "b"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an open element is ended by, besides its own end.
ENDS = {"p": (BLOCKS | HEADINGS | CHROME) - {"br"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "select": BLOCKS - {"br"}, "button": BLOCKS - {"br"}, "head": {"body"}}
#: Elements that keep what is open outside them from being ended by what is inside.
FENCES = frozenset("ul ol dl table article section main div blockquote body html".split())
#: An article's least characters, a page's most characters of text, the lengths of a bold lead that is a title.
LEAST_ARTICLE, MOST_TEXT, TITLE_LENGTHS = 500, 20_000, (12, 200)
#: Elements that count as paragraphs, a paragraph's least characters, characters for a point and the most such points.
PARAGRAPHS = frozenset("p td pre blockquote dd section h2 h3 h4 h5 h6".split())
LEAST_PARAGRAPH, CHARS_A_POINT, MOST_POINTS = 25, 100, 3
#: What elements score by themselves.
BONUS = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3} | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "th"), -5)
#: Of a sibling: the least score and share of the best; running text has so many characters and at most so much of it in links.
LEAST_SIBLING, SIBLING_SHARE, RUNNING, RUNNING_LINKS = 10.0, 0.2, 80, 0.25
SECTIONS = "array<struct<heading:string,text:string>>"


@dataclass
class Element:
    tag: str
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo.extend(reversed(node.children))
        return "".join(out)


class _Tree(html.parser.HTMLParser):
    def __init__(self, dead: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("html")
        self.dead, self.skipped = dead, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipped or tag in self.dead:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag == "html":
            return
        node = self.at
        while node.parent is not None:
            if tag in ENDS.get(node.tag, ()):
                self.at = node.parent
            elif node.tag in FENCES:
                break
            node = node.parent
        child = Element(tag, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or not (self.skipped or tag in self.dead):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.at.children.append(data)


def tree(page: str, dead: frozenset[str] = DEAD) -> Element:
    reader = _Tree(dead)
    reader.feed(page)
    reader.close()
    return reader.root


def elements(root: Element) -> list[Element]:
    """root and all below it, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def article(root: Element) -> list[Element]:
    """The elements that make the article, in the order of the page; none, if nothing scores."""
    nodes = elements(root)
    place = {id(n): k for k, n in enumerate(nodes)}
    chars, linked, commas = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):  # children come behind their parents
        n = nodes[k]
        own = " ".join(" ".join(c for c in n.children if isinstance(c, str)).split())
        chars[k] += len(own)
        commas[k] += own.count(",") + own.count("،") + own.count("，")
        if n.tag == "a":
            linked[k] = chars[k]
        if n.parent is not None:
            up = place[id(n.parent)]
            chars[up], linked[up], commas[up] = chars[up] + chars[k], linked[up] + linked[k], commas[up] + commas[k]
    frame = [False] * len(nodes)
    scores: dict[int, float] = {}
    for k, n in enumerate(nodes):
        frame[k] = n.tag in CHROME or n.tag == "head" or (n.parent is not None and frame[place[id(n.parent)]])
        if frame[k] or n.tag not in PARAGRAPHS or chars[k] < LEAST_PARAGRAPH:
            continue
        points = 1 + commas[k] + min(chars[k] // CHARS_A_POINT, MOST_POINTS)
        up, level = n.parent, 0
        while up is not None and up.parent is not None and level < 5:
            at = place[id(up)]
            scores.setdefault(at, float(BONUS.get(up.tag, 0)))
            scores[at] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    free = lambda k: 1 - linked[k] / chars[k] if chars[k] else 0.0
    final = {k: s * free(k) for k, s in scores.items()}
    if not final:
        return []
    best = max(final, key=lambda k: (final[k], -k))
    parent = nodes[best].parent
    if parent is None:
        return [nodes[best]]
    out = []
    for n in parent.children:
        if isinstance(n, str):
            continue
        k = place[id(n)]
        running = n.tag == "p" and chars[k] > RUNNING and 1 - free(k) < RUNNING_LINKS
        if k == best or not frame[k] and (final.get(k, 0.0) >= max(LEAST_SIBLING, SIBLING_SHARE * final[best]) or running):
            out.append(n)
    return out


def only_references(page: str, names: tuple[str, ...]) -> str:
    """Markup of which a reader of HTML decodes just the named references, where a semicolon ends them, and leaves all others as they are written."""
    return re.sub(f"&(?!(?:{'|'.join(map(re.escape, names))});)", "&amp;", page)


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Sections:
    """Sections of subtrees: a heading or a paragraph's bold lead begins one, blocks break lines."""

    def __init__(self, most: int | None, lengths: tuple[int, int]) -> None:
        self.out: list[dict[str, str | None]] = []
        self.heading, self.lines, self.line = None, [], []
        self.left, self.lengths = most, lengths

    def break_line(self) -> None:
        if text := _clean("".join(self.line)):
            self.lines.append(text)
        self.line = []

    def flush(self, heading: str | None = None) -> None:
        self.break_line()
        text = "\n".join(self.lines)
        if self.left is not None:
            text = text[: max(0, self.left)]
            self.left -= len(text)
        if text or self.heading:
            self.out.append({"heading": self.heading, "text": text})
        self.heading, self.lines = heading, []

    def lead(self, paragraph: Element) -> Element | None:
        """The bold element that a paragraph begins with, perhaps inside a link."""
        for child in paragraph.children:
            if isinstance(child, str):
                if _clean(child):
                    return None
            elif child.tag in BOLD:
                return child
            elif child.tag == "a":
                return self.lead(child)
            elif child.tag != "img":
                return None
        return None

    def read(self, root: Element, skipped: frozenset[str] = frozenset()) -> None:
        ahead: list[tuple[str, Element | str]] = [("open", root)]
        titles: set[int] = set()
        while ahead:
            what, node = ahead.pop()
            if isinstance(node, str):
                self.line.append(node)
            elif what == "close":
                self.break_line()
            elif node.tag in skipped or id(node) in titles:
                continue
            elif node.tag in HEADINGS:
                self.flush(_clean(node.text()) or None)
            else:
                if node.tag == "p" and (bold := self.lead(node)) is not None and self.lengths[0] <= len(_clean(bold.text())) <= self.lengths[1]:
                    self.flush(_clean(bold.text()))
                    titles.add(id(bold))
                if node.tag in BLOCKS:
                    self.break_line()
                    ahead.append(("close", node))
                ahead.extend(("open", c) for c in reversed(node.children))


def sections_of(page: str, least_article: int = LEAST_ARTICLE, most_text: int | None = MOST_TEXT, lengths: tuple[int, int] = TITLE_LENGTHS) -> list[dict[str, str | None]]:
    root = tree(page)
    found, skipped = article(root), frozenset()
    if sum(len(_clean(n.text())) for n in found) < least_article:
        nodes, skipped = elements(root), CHROME | {"head"}
        found = [next((n for tag in ("main", "article", "body") for n in nodes if n.tag == tag), root)]
    reader = _Sections(most_text, lengths)
    for node in found:
        reader.read(node, skipped)
    reader.flush()
    return reader.out


def with_sections(pages: DataFrame, html_col: str = "html", name: str = "sections", most_text: int | None = MOST_TEXT, references: tuple[str, ...] | None = None) -> DataFrame:
    """pages with the sections of their articles; a null page has none. references: the character references that are decoded; None: by HTML's rules."""

    @F.pandas_udf(SECTIONS)
    def read(column: pd.Series) -> pd.Series:
        return column.map(lambda page: sections_of(only_references(page or "", references) if references else page or "", most_text=most_text))

    return pages.withColumn(name, read(html_col))
