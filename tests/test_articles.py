"""Articles of pages against known text and plain recursion."""

from tidemark.sources import articles

TEXT = "A sentence of the article, with commas, goes on for a while and says something that readers want to know. "


def page(body, head="<title>x</title><script>var a='<p>no</p>'</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def texts(found):
    return [(s["heading"], s["text"]) for s in found]


def test_the_best_element_and_its_siblings_are_the_article():
    menu = "<nav><ul>" + "".join(f'<li><a href="/{k}">Menu entry number {k}, with words</a></li>' for k in range(30)) + "</ul></nav>"
    links = "<div>" + "".join(f'<p><a href="/{k}">A long related headline, number {k}, that is only a link, nothing more</a></p>' for k in range(20)) + "</div>"
    body = "".join(f"<p>{TEXT}{k}</p>" for k in range(8))
    found = texts(articles.sections_of(page(f"{menu}<div id=c>{body}</div>{links}<footer><p>{TEXT}</p></footer>")))
    assert found == [(None, "\n".join(f"{TEXT}{k}" for k in range(8)))]
    split = "<div><div>" + body + "</div><p>" + TEXT + "last</p><p><a>" + TEXT + "</a></p></div>"
    (section,) = articles.sections_of(page(menu + split))
    assert section["text"].endswith("last") and section["text"].count("\n") == 8


def test_headings_and_bold_leads_begin_sections_and_open_elements_end():
    body = f"<main><p>Lead text<h2>Title  of &amp; it</h2><div>One<br>two <i>three</i></div><p> <a><b>A bold beginning</b></a> and its text<p><b>Short</b> is text<h3>Last</h3><ul><li>a<li>b</ul></main>"
    want = [(None, "Lead text"), ("Title of & it", "One\ntwo three"), ("A bold beginning", "and its text\nShort is text"), ("Last", "a\nb")]
    assert texts(articles.sections_of(page(body))) == want  # short: the main element is read whole
    unclosed = page(f"<article><p><b>A bold beginning that is never closed<br><p>{TEXT}<p>{TEXT}</article><footer>f</footer>")
    assert texts(articles.sections_of(unclosed)) == [("A bold beginning that is never closed", f"{TEXT.strip()}\n{TEXT.strip()}")]


def test_odd_pages():
    assert articles.sections_of("") == [] and articles.sections_of("plain") == [{"heading": None, "text": "plain"}]
    deep = "<div>" * 5000 + TEXT + "</div>" * 5000
    assert texts(articles.sections_of(page(deep))) == [(None, TEXT.strip())]
    assert texts(articles.sections_of(page("<select><option>a<option>b<p>kept</p><style>p{}</style>"))) == [(None, "kept")]
    long = page("<article>" + f"<p>{TEXT}</p>" * 1000 + "</article>")
    assert sum(len(s["text"]) for s in articles.sections_of(long)) == 20_000 and sum(len(s["text"]) for s in articles.sections_of(long, most_text=None)) > 100_000


def plain_scores(root):
    """Scores by recursion, each element's text read anew."""
    out = {}

    def words(node, inside=False):
        return [(" ".join(" ".join(c for c in n.children if isinstance(c, str)).split()), n) for n in articles.elements(node)]

    def chars(node):
        return sum(len(t) for t, _ in words(node))

    def visit(node, above, frame):
        frame = frame or node.tag in articles.CHROME or node.tag == "head"
        if not frame and node.tag in articles.PARAGRAPHS and chars(node) >= 25:
            points = 1 + sum(t.count(",") for t, _ in words(node)) + min(chars(node) // 100, 3)
            for level, up in enumerate([a for a in reversed(above) if a.parent is not None][:5]):
                out.setdefault(id(up), [up, float(articles.BONUS.get(up.tag, 0))])[1] += points / [1, 2, 6, 9, 12][level]
        for c in node.children:
            if not isinstance(c, str):
                visit(c, [*above, node], frame)

    visit(root, [], False)

    def free(node):
        links, todo = 0, [node]
        while todo:
            n = todo.pop()
            if n.tag == "a":
                links += chars(n)
            else:
                todo += [c for c in n.children if not isinstance(c, str)]
        return 1 - links / chars(node) if chars(node) else 0.0

    return {k: (n, s * free(n)) for k, (n, s) in out.items()}


def test_scores_equal_plain_recursion_on_the_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()
    for r in rows:
        root = articles.tree(r["html"])
        scores = plain_scores(root)
        found = articles.article(root)
        if not scores:
            assert found == []
            continue
        best = max(s for _, s in scores.values())
        assert any(abs(scores[id(n)][1] - best) < 1e-9 for n in found if id(n) in scores)
        assert all("article" in {n.tag, n.parent.tag} or n.tag == "body" for n in found)


def test_public_links(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import urls

    bad = [f"https://a.{x}/" for x in "localdomain intranet corp home.arpa onion local LOCAL lan internal".split()] + ["https://a.corp./x", "https://b .org/", "https://b.org/​x", "https://b.org/ ", "https://localhost", "https://b.org./\x00", "https://1.2.3.4/"]
    good = ["https://b.org./x", "https://corp.org/", "https://home.arpa.org/", "http://b.org/é?q=1#f"]
    rows = spark.createDataFrame([(u,) for u in bad + good], "url string").select("url", urls.public_https(F.col("url")).alias("clean")).collect()
    assert [r["url"] for r in rows if r["clean"] is None] == bad and rows[-1]["clean"] == "https://b.org/é?q=1"
