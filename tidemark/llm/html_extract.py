"""The main text of HTML pages from flat text blocks.

A page becomes a flat row of text blocks, cut at block-level tags. Each block has its word count, the
share of its words inside links, and the same two of its neighbours. A decision tree fitted on a small
labelled table below tells content from the rest; content blocks are joined in page order by line ends.

The first PLAIN levels of the tree split by these word counts and link shares alone. Further down it may
also ask what the elements around a block say (a menu or form, an article, a heading), since a reader's
comment, a notice or a caption can have an article's counts. `decided` says how many blocks needed that.

Pages: null counts as empty and gives an empty text; broken markup is read as far as it goes: an
unclosed element lasts to the end, a stray `<` is text. Existing columns text and n_chars are replaced, other
columns stay whatever their names. Repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Block-level elements of HTML; a block ends where one begins or ends.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page.
SILENT = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video|title|select|button"
#: Elements and roles that hold no article text.
OUTSIDE = frozenset("nav footer aside form dialog menu fieldset search".split())
OUTSIDE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
#: Words of class and id names that say the same.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side rail widget widgets related recommended share sharing social comment comments disqus discussion reply replies respond footer foot header masthead topbar toolbar login search hidden tags".split()
)
INSIDE = frozenset(["article", "main"])
INSIDE_NAMES = frozenset("article content main post entry story body text maintext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What makes even an article element one of a reader's.
READERS = frozenset("comment comments reply replies respond discussion review".split())
#: Levels of the tree that split by counts and shares alone, and columns of these.
PLAIN, COUNTS = 2, 6
#: What makes even an article element one of a reader's.
READERS = frozenset("comment comments reply replies respond discussion review".split())
#: Levels of the tree that split by counts and shares alone, and columns of these.
PLAIN, COUNTS = 2, 6

#: A small labelled table of blocks, made by hand. Columns: words and share of linked words of the block, of the one
#: before and of the one after, then 1 if around it are: an outside element, an inside element, a heading; last 1 for content.
LABELLED = """
1 1.0  0 0.0  1 1.0  1 0 0  0
1 1.0  1 1.0  1 1.0  1 0 0  0
3 1.0  2 1.0  12 0.0  1 0 0  0
2 1.0  1 1.0  9 0.0  1 0 0  0
12 0.0  1 1.0  9 0.0  1 0 0  0
8 0.0  1 1.0  14 0.0  1 0 0  0
45 0.0  2 1.0  10 0.0  1 0 0  0
90 0.1  60 0.0  3 0.5  1 0 0  0
25 0.0  110 0.0  0 0.0  1 0 0  0
14 0.2  80 0.0  0 0.0  1 0 0  0
60 0.0  80 0.0  40 0.0  1 1 0  0
6 0.0  80 0.0  40 0.0  1 1 1  0
35 0.0  50 0.0  7 0.0  1 1 0  0
2 1.0  90 0.0  2 1.0  1 1 0  0
4 0.0  4 1.0  30 0.0  1 0 1  0
150 0.0  2 0.0  140 0.0  1 0 0  0
70 0.0  90 0.0  85 0.0  1 0 0  0
10 0.0  95 0.0  88 0.0  1 0 0  0
2 0.0  75 0.0  130 0.0  1 0 0  0
5 0.0  0 0.0  75 0.0  1 0 0  0
18 0.0  2 1.0  95 0.0  1 0 0  0
33 0.0  2 0.0  210 0.0  1 0 0  0
55 0.0  20 0.0  64 0.0  1 0 0  0
210 0.0  44 0.0  48 0.0  1 0 0  0
28 0.0  30 0.0  50 0.0  1 1 0  0
75 0.0  66 0.0  90 0.0  1 1 0  0
12 0.0  55 0.0  70 0.0  1 1 0  0
3 0.0  48 0.0  52 0.0  1 1 0  0
130 0.0  64 0.0  58 0.0  1 1 0  0
19 0.0  77 0.0  61 0.0  1 0 1  0
7 0.0  46 0.0  83 0.0  1 0 1  0
40 0.0  12 0.0  9 0.0  1 0 0  0
22 0.0  6 0.0  4 0.0  1 0 0  0
120 0.0  4 1.0  30 0.0  1 0 0  0
30 0.0  2 1.0  60 0.0  1 1 0  0
12 0.0  1 1.0  5 0.0  1 1 0  0
50 0.0  1 1.0  1 1.0  1 1 0  0
90 0.0  3 1.0  110 0.0  1 1 0  0
16 0.0  1 1.0  40 0.0  1 0 0  0
45 0.0  4 1.0  80 0.0  1 0 0  0
110 0.0  1 1.0  20 0.0  1 0 0  0
7 0.0  1 1.0  95 0.0  1 0 0  0
40 0.0  1 1.0  30 0.0  0 0 0  1
60 0.0  2 1.0  90 0.0  0 0 0  1
25 0.0  3 1.0  20 0.0  0 0 0  1
100 0.0  1 1.0  50 0.0  0 0 0  1
20 0.0  1 1.0  100 0.0  0 0 0  1
140 0.0  1 1.0  12 0.0  0 0 0  1
12 0.0  1 1.0  45 0.0  0 1 0  1
85 0.0  2 1.0  6 0.0  0 1 0  1
1 1.0  7 0.0  8 0.0  1 0 0  0
2 1.0  30 0.0  66 0.0  1 0 0  0
6 1.0  45 0.0  52 0.0  1 0 0  0
3 1.0  60 0.0  70 0.0  1 0 0  0
14 0.8  9 0.0  40 0.0  1 0 0  0
4 1.0  25 0.0  30 0.0  0 1 0  1
3 1.0  120 0.0  90 0.0  0 1 0  1
6 1.0  85 0.0  40 0.0  0 1 0  1
5 1.0  100 0.0  33 0.0  1 1 0  0
2 1.0  30 0.0  45 0.0  1 1 0  0
2 1.0  9 0.0  14 0.0  0 1 0  1
9 0.0  12 0.0  60 0.0  0 1 1  1
2 0.0  1 1.0  60 0.0  0 1 1  1
6 0.0  70 0.0  80 0.0  0 1 1  1
60 0.0  9 0.0  80 0.0  0 1 0  1
80 0.0  60 0.0  75 0.0  0 1 0  1
3 0.0  80 0.0  75 0.0  0 1 0  1
1 0.0  40 0.0  0 0.0  0 1 0  1
1 0.0  0 0.0  0 0.0  0 1 0  1
12 0.4  80 0.0  75 0.0  0 1 0  1
1 1.0  60 0.0  60 0.0  0 1 0  1
7 1.0  30 0.0  50 0.0  0 1 0  1
300 0.05  10 0.0  20 0.0  0 1 0  1
4 0.0  3 0.0  5 0.0  0 1 0  1
2 0.0  10 0.0  25 0.0  0 1 0  1
20 0.0  2 0.0  14 0.0  0 1 0  1
10 0.0  25 0.0  12 0.0  0 1 0  1
40 0.0  0 0.0  0 0.0  0 1 0  1
8 0.0  1 1.0  1 1.0  0 1 0  1
2 0.0  4 0.0  3 0.0  0 1 0  1
22 0.8  5 0.0  6 0.0  0 1 0  1
5 1.0  3 1.0  4 1.0  0 1 0  0
2 1.0  3 1.0  2 1.0  0 1 0  0
1 1.0  1 1.0  1 1.0  1 0 0  0
2 1.0  1 1.0  2 1.0  1 1 0  0
1 1.0  0 0.0  1 1.0  1 0 0  0
3 1.0  2 1.0  1 1.0  1 0 0  0
1 1.0  2 1.0  1 1.0  0 0 0  0
4 1.0  3 1.0  3 1.0  1 0 0  0
1 1.0  1 1.0  7 0.0  1 0 0  0
1 1.0  1 1.0  12 0.0  1 0 0  0
14 0.0  8 0.0  0 0.0  0 1 0  1
3 0.0  11 0.0  2 0.0  0 1 1  1
1 0.0  2 1.0  1 0.0  0 1 1  1
40 0.0  90 0.0  120 0.0  0 1 0  1
10 0.0  100 0.0  100 0.0  0 1 0  1
5 0.0  30 0.0  150 0.0  0 1 0  1
150 0.0  40 0.0  90 0.0  0 1 0  1
20 0.0  200 0.0  95 0.0  0 1 0  1
100 0.1  150 0.0  200 0.0  0 1 0  1
3 0.0  20 0.0  110 0.0  0 1 0  1
1 0.0  12 0.0  160 0.0  0 1 0  1
60 0.0  5 0.0  84 0.0  0 1 0  1
14 0.0  8 0.0  240 0.0  0 1 0  1
8 0.0  2 0.0  300 0.0  0 1 1  1
100 0.0  150 0.0  200 0.0  0 0 0  1
30 0.0  90 0.0  110 0.0  0 0 0  1
18 0.0  40 0.0  220 0.0  0 0 0  1
70 0.0  11 0.0  95 0.0  0 0 0  1
9 0.0  3 0.0  130 0.0  0 0 1  1
12 0.3  60 0.0  90 0.1  0 1 0  1
25 0.4  100 0.0  140 0.0  0 1 0  1
2 0.0  8 0.0  4 0.0  0 1 0  1
6 0.0  4 0.0  2 0.0  0 1 0  1
1 0.0  3 0.0  1 0.0  0 1 0  1
7 0.0  1 1.0  9 0.0  0 1 1  1
33 0.0  80 0.0  1 1.0  0 1 0  1
16 0.0  28 0.0  7 0.0  0 1 0  1
80 0.0  60 0.0  75 0.0  0 0 0  1
45 0.1  60 0.0  30 0.0  0 0 0  1
25 0.0  60 0.0  40 0.0  0 0 0  1
16 0.0  9 0.0  60 0.0  0 0 0  1
30 0.0  3 1.0  45 0.0  0 0 0  1
9 0.0  2 1.0  60 0.0  0 0 1  1
5 0.0  70 0.0  50 0.0  0 0 1  1
6 0.0  60 0.0  50 0.0  0 0 0  1
11 0.0  40 0.0  30 0.0  0 0 0  1
4 0.0  2 1.0  3 1.0  0 0 1  0
3 0.0  3 1.0  2 1.0  0 0 0  0
1 1.0  1 1.0  1 1.0  0 0 0  0
5 1.0  4 1.0  6 1.0  0 0 0  0
8 0.8  7 0.9  6 1.0  0 0 0  0
20 0.9  5 1.0  8 1.0  0 0 0  0
40 0.8  30 0.9  20 0.9  0 0 0  0
6 1.0  60 0.0  7 1.0  0 0 0  0
5 1.0  80 0.0  0 0.0  0 0 0  0
12 0.9  70 0.0  9 1.0  0 0 0  0
70 0.0  60 0.0  3 1.0  0 0 0  1
55 0.0  80 0.0  0 0.0  0 0 0  1
90 0.0  0 0.0  0 0.0  0 0 0  1
34 0.0  28 0.0  4 0.0  0 0 0  1
120 0.1  2 1.0  5 1.0  0 0 0  1
27 0.0  45 0.0  12 0.0  0 0 0  1
1 1.0  1 1.0  60 0.0  0 0 0  0
5 1.0  5 1.0  70 0.0  0 0 0  0
12 0.9  9 1.0  45 0.0  0 0 0  0
30 0.9  4 1.0  80 0.0  0 0 0  0
3 0.7  2 1.0  33 0.0  0 0 0  0
2 1.0  50 0.0  46 1.0  0 0 0  0
4 0.0  1 1.0  0 0.0  0 0 0  0
6 0.3  20 0.9  0 0.0  0 0 0  0
7 0.0  3 0.6  2 0.5  0 0 0  0
3 0.0  4 0.0  2 0.0  0 0 0  0
5 0.0  2 1.0  6 0.0  0 0 0  0
"""

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>|<(?P<silent>{SILENT})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=silent)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-z/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(4096)
def _says(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is outside the article, and whether it is (part of) it."""
    outside, inside = name in OUTSIDE, name in INSIDE
    if rest:
        for key, *values in _NAMED.findall(rest):
            value, key = "".join(values), key.lower()
            if key in ("class", "id"):
                parts = {p.lower() for p in _PARTS.findall(value)}
                if name in INSIDE:  # `post share-story` is an article still, `ad` and `comment-item` are not
                    outside |= not parts.isdisjoint(READERS) or not OUTSIDE_NAMES.isdisjoint(value.lower().split())
                else:
                    outside |= not parts.isdisjoint(OUTSIDE_NAMES)
                    inside |= not parts.isdisjoint(INSIDE_NAMES)
            elif key == "role":
                outside |= value.lower() in OUTSIDE_ROLES
                inside |= value.lower() in ("main", "article")
            elif key == "style":
                outside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            else:
                outside |= value.lower() != "false"
    return outside, inside


def blocks_of(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, linked words, outside, inside, heading) of each block, in page order."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    state = [False, False, False]
    linked, links = 0, 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(piece.split())

    def end() -> None:
        nonlocal linked
        words = "".join(text).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words)), *state))
        text.clear()
        linked = 0

    at = 0
    for m in _TAG.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        if (name := m["name"]) is None:
            if m["silent"] and m["silent"].lower() in BLOCKS:
                end()
            continue
        name = name.lower()
        if name == "a":
            links = max(0, links - 1) if m["close"] else links + 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            end()
            links = 0
            if m["close"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name == "p" or name == "li":
                outside, inside = _says(name, m["rest"])
                while stack and stack[-1][0] in ("p", name):
                    stack.pop()
                stack.append((name, outside, inside))
            elif not m["rest"].rstrip().endswith("/") and name != "hr":
                outside, inside = _says(name, m["rest"])
                if name == "header" and not any(x[2] for x in stack):
                    outside = True
                while stack and stack[-1][0] == "p":
                    stack.pop()
                if outside and name in ("body", "html"):
                    outside = False  # a page's own class names say nothing of its blocks
                stack.append((name, outside, inside))
            state = [any(x[1] for x in stack), any(x[2] for x in stack), any(x[0] in HEADINGS for x in stack)]
    put(page[at:])
    end()
    return out


def features(blocks: list[tuple[str, int, int, bool, bool, bool]]) -> np.ndarray:
    """The columns of LABELLED for each block of a page."""
    own = np.array([(n, linked / n) for _, n, linked, *_ in blocks], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    marks = np.array([b[3:] for b in blocks], float).reshape(-1, 3)
    return np.hstack([own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:], marks])


# A tree is a label or (column, threshold, tree up to it, tree above it).


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 7, plain: int = PLAIN) -> object:
    """A decision tree by the largest fall of Gini impurity; ties go to the first column and threshold.

    In the first `plain` levels only the first COUNTS columns are tried.
    """
    if depth == 0 or len(set(y.tolist())) < 2:
        return bool(round(float(y.mean()))) if len(y) else False
    best = None
    for column in range(COUNTS if plain else x.shape[1]):
        values = np.unique(x[:, column])
        for threshold in ((values[1:] + values[:-1]) / 2).tolist():
            low = x[:, column] <= threshold
            impurity = sum(part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, column, threshold)
    if best is None:
        return fit_tree(x, y, depth, 0) if plain else bool(round(float(y.mean())))
    _, column, threshold = best
    low = x[:, column] <= threshold
    return column, threshold, fit_tree(x[low], y[low], depth - 1, max(0, plain - 1)), fit_tree(x[~low], y[~low], depth - 1, max(0, plain - 1))


def decided(tree: object, row: list[float]) -> int:
    """The last column that the tree asks for a row: below COUNTS, counts and shares alone decide it."""
    marks = column = 0
    while not isinstance(tree, bool):
        column, threshold, low, high = tree
        marks = max(marks, column if column >= COUNTS else 0)
        tree = low if row[column] <= threshold else high
    return marks or column


def classify(tree: object, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        column, threshold, low, high = tree
        tree = low if row[column] <= threshold else high
    return tree


def labelled() -> tuple[np.ndarray, np.ndarray]:
    table = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return table[:, :-1], table[:, -1]


def main_text(page: str, tree: object) -> str:
    blocks = blocks_of(page)
    return "\n".join(b[0] for b, row in zip(blocks, features(blocks).tolist()) if classify(tree, row))


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df without its html, with text (empty if none) and n_chars (its code points)."""
    others = [c for c in df.columns if c not in (html_col, "text", "n_chars")]
    rows = common.small_batches(df).select(*others, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias(common.fresh(df, "_html")))
    tree = fit_tree(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.freeing(batches):
            texts = [main_text(page, tree) for page in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*others, "text", "n_chars"])

    return rows.mapInArrow(run, df.select(*others, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
