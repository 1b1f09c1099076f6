"""Web pages as sources: cleaned markup, sections, structured data, what a page says of itself."""

from __future__ import annotations

import html.parser
import json
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.articles import only_references

#: Characters of a page's markup and of its sections; a bold-led paragraph is a section's title between these lengths.
MOST_MARKUP, MOST_TEXT, TITLE_LENGTHS = 2_000_000, 20_000, (12, 200)
#: Declared names of a page, items of a list of signals, depth and nodes of structured data that are read, at most.
MOST_DECLARED, MOST_ITEMS, MOST_DEPTH, MOST_NODES = 15, 20, 6, 200
#: Elements that break lines, elements without text, bold ones.
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form header hr li main nav ol p pre section table td th tr ul".split())
DEAD = frozenset("script style noscript template iframe svg form button nav header footer aside".split())
BOLD = frozenset(["b", "strong"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Keys of structured data whose objects made or host the page, or are parts of it, and are not what it is about.
NOT_ABOUT = frozenset(
    """author creator publisher copyrightHolder provider sourceOrganization editor contributor funder sponsor potentialAction breadcrumb image logo
    isPartOf mainEntityOfPage itemListElement brand seller offers aggregateRating review""".split()
)
#: The kinds of thing that types of structured data name; other types are no one's names.
KINDS = (
    (r"Person$", "person"),
    (r".*Event$|Festival$|Exhibition", "event"),
    (r"(GovernmentOrganization|GovernmentOffice|Courthouse|City|Country|State|AdministrativeArea)$", "public_body"),
    (r"(NGO|NonprofitOrganization|Charity)$", "nonprofit"),
    (r".*Organization$|Corporation$|.*Business$|Store$|Restaurant$|Museum$|Library$|MusicGroup$|SportsTeam$", "company"),
    (r"(Place|LandmarksOrHistoricalBuildings|TouristAttraction|Park|CivicStructure|Venue|.*Venue)$", "place"),
    (r"(Product|SoftwareApplication|MobileApplication|WebApplication|VideoGame)$", "product"),
    (r"(Book|Movie|TVSeries|MusicAlbum|MusicRecording|VisualArtwork|Painting|Sculpture|Play|Podcast|PodcastSeries|CreativeWorkSeries)$", "work"),
)
#: Types of structured data that are someone, and link types that are feeds.
WHO = frozenset(["Person", "Organization", "NewsMediaOrganization", "Corporation"])
FEED_TYPES = frozenset(["application/rss+xml", "application/atom+xml", "application/feed+json", "application/json"])
SECTIONS = "array<struct<heading:string,text:string>>"
SIGNALS = "struct<canonical:string,title:string,site_name:string,description:string,author:string,feeds:array<string>,feed_titles:array<string>,rel_me:array<string>,same_as:array<string>,author_urls:array<string>>"


def cleaned(markup: Column, most: int | None = None) -> Column:
    """Markup without comments and the bodies of scripts and styles, but for structured data; the first `most` characters of it, if given."""
    bare = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)(<(script|style)\b(?![^>]*application/ld\+json)[^>]*>).*?</\2\s*>", "$1</$2>")
    return bare if most is None else F.substring(bare, 1, most)


def kind_of(node: dict) -> tuple[str, str] | None:
    """The first type of a node that names a kind of thing, and that kind."""
    for name in node["@type"] if isinstance(node.get("@type"), list) else [node.get("@type")]:
        for pattern, kind in KINDS:
            if isinstance(name, str) and re.match(pattern, name):
                return name, kind
    return None


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))).isin("text/html", "application/xhtml+xml"), F.lit(False))


class _Sections(html.parser.HTMLParser):
    """Sections in the order of the page: a heading or a paragraph's bold lead begins one, block elements break lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str | None, str]] = []
        self.heading, self.lines, self.line = None, [], []
        self.dead, self.title, self.lead = 0, None, False

    def close_line(self) -> None:
        if text := " ".join("".join(self.line).split()):
            self.lines.append(text)
        self.line = []

    def flush(self, heading: str | None = None) -> None:
        self.close_line()
        if self.lines or self.heading:
            self.out.append((self.heading, "\n".join(self.lines)))
        self.heading, self.lines = heading, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dead or tag in DEAD:
            self.dead += tag not in VOID
        elif tag in ("h1", "h2", "h3") or (tag in BOLD and self.lead and self.title is None):
            self.title = (tag, [])
        elif tag in BREAKS:
            self.close_line()
            self.lead = tag == "p"

    def handle_endtag(self, tag: str) -> None:
        if self.dead:
            self.dead -= tag not in VOID
        elif self.title and tag == self.title[0]:
            text, bold, self.title = " ".join("".join(self.title[1]).split()), tag in BOLD, None
            if not bold or TITLE_LENGTHS[0] <= len(text) <= TITLE_LENGTHS[1]:
                self.flush(text or None)
            else:
                self.line.append(text)
            self.lead = False
        elif tag in BREAKS:
            self.close_line()

    def handle_data(self, data: str) -> None:
        if self.dead:
            return
        if self.title:
            self.title[1].append(data)
        else:
            self.line.append(data)
            self.lead &= not data.strip()


def sections_of(page: str) -> list[dict[str, str | None]]:
    main = re.search(r"(?is)<(main|article)\b[^>]*>(.*)</\1\s*>", page)
    reader = _Sections()
    reader.feed(main[2] if main else re.sub(r"(?is)<head\b.*?</head\s*>", "", page))
    reader.close()
    reader.flush()
    out, left = [], MOST_TEXT
    for heading, text in reader.out:
        text = text[: max(0, left)]
        left -= len(text)
        if text or heading:
            out.append({"heading": heading, "text": text})
    return out


def with_sections(pages: DataFrame, html_col: str = "html", name: str = "sections") -> DataFrame:
    """pages with their sections: of the main or article element, else of the body without its frame."""

    @F.pandas_udf(SECTIONS)
    def read(column: pd.Series) -> pd.Series:
        return column.map(lambda page: sections_of(page or ""))

    return pages.withColumn(name, read(cleaned(F.col(html_col))))


def linked_objects(page: str) -> list[object]:
    out = []
    for script in re.findall(r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script""", page):
        try:
            out.append(json.loads(script.strip()))
        except (ValueError, RecursionError):
            continue  # a page's broken script says nothing; its others still count
    return out


def _nodes(root: object, most_depth: int | None = MOST_DEPTH) -> Iterator[tuple[dict, bool]]:
    """Every object of structured data, down to a depth of objects, and whether it hangs under a key of NOT_ABOUT."""
    todo: list[tuple[object, bool, int]] = [(root, False, 0)]
    while todo:
        node, under, depth = todo.pop()
        if isinstance(node, dict) and (most_depth is None or depth <= most_depth):
            yield node, under
            todo.extend((value, under or key in NOT_ABOUT, depth + 1) for key, value in reversed(node.items()))
        elif isinstance(node, list):
            todo.extend((child, under, depth) for child in reversed(node))


def declared_of(page: str, most: int | None = MOST_DECLARED, depth: int | None = None) -> list[dict[str, str]]:
    """Names that structured data declares, the first of each: of things of some kind that neither hang under a key of NOT_ABOUT nor are
    referred to from there."""
    nodes = [pair for root in linked_objects(page) for pair in _nodes(root, most_depth=depth)]
    apart = {n["@id"] for n, under in nodes if under and isinstance(n.get("@id"), str)}
    out: dict[str, dict[str, str]] = {}
    for node, under in nodes:
        found, name = kind_of(node), node.get("name")
        if found and isinstance(name, str) and name.strip() and not under and node.get("@id") not in apart:
            name = html.unescape(name.strip())
            out.setdefault(name.lower(), {"type": found[0], "kind": found[1], "name": name, "start": str(node.get("startDate") or "")})
    return list(out.values())[:most]


def with_declared(pages: DataFrame, html_col: str = "html", name: str = "declared") -> DataFrame:
    """pages with the declared names (type, kind, name, start) of their structured data."""

    @F.pandas_udf("array<struct<type:string,kind:string,name:string,start:string>>")
    def read(column: pd.Series) -> pd.Series:
        return column.map(lambda page: declared_of(page or ""))

    return pages.withColumn(name, read(html_col))


class _Relations(html.parser.HTMLParser):
    """A page's title, meta values (the first of each name), and what its links relate to, by rel."""

    def __init__(self, url: str) -> None:
        super().__init__()
        self.base, self.title, self.said = url, "", {}
        self.related: dict[str, list[tuple[str, str, str]]] = {}
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: (v or "").strip() for k, v in attrs}
        self.inside = tag == "title" and not self.title
        if tag == "base" and given.get("href"):
            self.base = urljoin(self.base, given["href"])
        elif tag == "meta" and given.get("content"):
            self.said.setdefault((given.get("property") or given.get("name", "")).lower(), given["content"])
        elif tag in ("a", "link") and given.get("href"):
            for rel in given.get("rel", "").lower().split():
                self.related.setdefault(rel, []).append((given["href"], given.get("type", "").lower(), given.get("title", "")))

    def handle_endtag(self, tag: str) -> None:
        self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.title += data

    def urls(self, found: list[object]) -> list[str]:
        """Absolute urls of references, each once, the first MOST_ITEMS."""
        out: dict[str, None] = {}
        for x in found:
            if isinstance(x, str) and x.strip():
                try:
                    whole = urljoin(self.base, x.strip())
                    if urlsplit(whole).scheme:
                        out[whole] = None
                except ValueError:
                    continue  # no url
        return list(out)[:MOST_ITEMS]

    def of(self, rel: str) -> list[str]:
        return [href for href, *_ in self.related.get(rel, [])]


def _each(node: dict, key: str) -> list[object]:
    """A key's values, whether it has one or a list of them."""
    value = node.get(key, [])
    return value if isinstance(value, list) else [value]


def signals_of(page: str, url: str, references: tuple[str, ...] | None = None) -> dict[str, object]:
    """What a page says of itself: canonical url, title, description, author, feeds and profiles."""
    page_says = _Relations(url)
    page_says.feed(only_references(page, references) if references else page)
    data = [node for node, _ in islice((x for root in linked_objects(page) for x in _nodes(root)), MOST_NODES)]
    written = [a for node in data for a in _each(node, "author") if isinstance(a, dict)]
    profiles = [x for node in data if WHO.intersection(map(str, _each(node, "@type"))) for x in _each(node, "sameAs")]
    said = page_says.said
    feeds: dict[str, str] = {}
    for href, kind, title in page_says.related.get("alternate", []):
        if kind in FEED_TYPES:
            for whole in page_says.urls([href]):
                feeds.setdefault(whole, title)
    feeds = dict(islice(feeds.items(), MOST_ITEMS))
    return {
        "canonical": next(iter(page_says.urls(page_says.of("canonical"))), None),
        "title": said.get("og:title") or " ".join(page_says.title.split()) or None,
        "site_name": said.get("og:site_name"),
        "description": said.get("description") or said.get("og:description"),
        "author": said.get("author") or next((str(a["name"]) for a in written if a.get("name")), None),
        "feeds": list(feeds),
        "feed_titles": list(feeds.values()),
        "rel_me": page_says.urls(page_says.of("me")),
        "same_as": page_says.urls(profiles),
        "author_urls": page_says.urls([*page_says.of("author"), *(a.get("url") for a in written)]),
    }


def with_signals(pages: DataFrame, html_col: str = "html", url_col: str = "url", name: str = "signals", references: tuple[str, ...] | None = None) -> DataFrame:
    """pages with their signals. references: the character references of the markup that are decoded; None: by HTML's rules."""

    @F.pandas_udf(SIGNALS)
    def read(markup: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signals_of(m or "", u or "", references) for m, u in zip(markup, url)], columns=["canonical", "title", "site_name", "description", "author", "feeds", "feed_titles", "rel_me", "same_as", "author_urls"])

    return pages.withColumn(name, read(html_col, url_col))


def absolute_url(url: Column, base: Column) -> Column:
    """A reference made absolute: whole urls, //host, /path and relative paths; null stays null."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*)?/)", 1)
    folder = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme, F.lit(":"), url)).when(url.startswith("/"), F.concat(origin, url)).otherwise(F.concat(folder, url))
