"""HTML extraction against a twin on html.parser, page shapes, and the registered query."""

import html.parser

import pytest

from tidemark.llm import html_extract as H


class Twin(html.parser.HTMLParser):
    """Flat blocks of a well-formed page, read event by event."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.text, self.links, self.linked, self.silent = [], [], [], 0, 0, None

    def cut(self):
        words = "".join(self.text).split()
        if words:
            tags = [t for t, _ in self.stack]
            says = [H._says(t, rest) for t, rest in self.stack]
            outer = [o or (t == "header" and not any(i for _, i in says[:k])) for k, (t, (o, _)) in enumerate(zip(tags, says))]
            self.out.append((" ".join(words), len(words), min(self.linked, len(words)), any(o for o, t in zip(outer, tags) if t not in ("body", "html")), any(i for _, i in says), not H.HEADINGS.isdisjoint(tags)))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.silent is None and tag in H.SILENT.split("|"):
            self.silent = tag
            if tag in H.BLOCKS:
                self.cut()
        elif self.silent is not None:
            return
        elif tag == "a":
            self.links += 1
        elif tag == "br":
            self.text.append(" ")
        elif tag in H.BLOCKS:
            self.cut()
            self.links = 0
            if tag in ("p", "li"):
                while self.stack and self.stack[-1][0] in ("p", tag):
                    self.stack.pop()
            else:
                while self.stack and self.stack[-1][0] == "p":
                    self.stack.pop()
            if tag != "hr":
                self.stack.append((tag, "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in attrs)))

    def handle_endtag(self, tag):
        if self.silent is not None:
            if tag == self.silent:
                self.silent = None
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in H.BLOCKS:
            self.cut()
            self.links = 0
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    del self.stack[k:]
                    break

    def handle_data(self, data):
        if self.silent is None:
            self.text.append(data)
            if self.links:
                self.linked += len(data.split())


def twin(page, tree):
    reader = Twin()
    reader.feed(page)
    reader.close()
    reader.cut()
    lines = []
    for k, block in enumerate(reader.out):
        near = [reader.out[j] if 0 <= j < len(reader.out) else ("", 0, 0) for j in (k, k - 1, k + 1)]
        row = [x for b in near for x in (float(b[1]), b[2] / b[1] if b[1] else 0.0)] + [float(x) for x in block[3:]]
        if H.classify(tree, row):
            lines.append(block[0])
    return "\n".join(lines)


def test_the_query_gives_what_the_twin_gives(spark):
    from tidemark.llm import queries

    tree = H.fit_tree(*H.labelled())
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = queries.op9_html_text(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        expected = twin(pages[r["page_id"]]["html"] or "", tree)
        assert (r["text"], r["n_chars"], r["url"]) == (expected, len(expected), pages[r["page_id"]]["url"])


def test_counts_and_shares_decide_first():
    tree = H.fit_tree(*H.labelled())

    def top(t, levels):
        return set() if isinstance(t, bool) or not levels else {t[0]} | top(t[2], levels - 1) | top(t[3], levels - 1)

    assert max(top(tree, H.PLAIN)) < H.COUNTS
    menu = [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 0.0]
    assert not H.classify(tree, menu) and H.decided(tree, menu) < H.COUNTS
    x, y = H.labelled()
    assert all(H.classify(tree, r) == bool(v) for r, v in zip(x.tolist(), y))


WORDS = " ".join(["plain"] * 50)


@pytest.mark.parametrize(
    "page,kept",
    [
        (f'<article class="post share-story"><p>{WORDS}</p></article>', True),
        (f'<article class="comment-item"><p>{WORDS}</p></article>', False),
        (f'<article class="ad"><p>{WORDS}</p></article>', False),
        (f'<section id="comments"><p>{WORDS}</p></section>', False),
        (f'<div class="cookie-notice"><p>{WORDS}</p></div>', False),
        (f"<aside><p>{WORDS}</p></aside>", False),
        (f'<div role="dialog">{WORDS}</div>', False),
        (f"<main><aside>no</aside><p>{WORDS}</p></main>", True),
        (f'<div style="display:none">{WORDS}</div>', False),
    ],
)
def test_page_shapes(page, kept):
    tree = H.fit_tree(*H.labelled())
    got = H.main_text(f'<nav><a href="/">a</a><a href="/b">b</a></nav>{page}<footer>end of it</footer>', tree)
    assert got == (WORDS if kept else "")


def test_existing_columns_give_way_and_others_stay(spark):
    df = spark.createDataFrame([(1, f"<article><p>{WORDS}</p></article>", "old", 3, "x"), (2, None, None, None, "y")], "page_id long, html string, text string, n_chars int, _html string")
    got = {r["page_id"]: r for r in H.extract(df).collect()}
    assert got[1]["text"] == WORDS and got[1]["n_chars"] == len(WORDS) and got[1]["_html"] == "x"
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[2]["_html"] == "y"
