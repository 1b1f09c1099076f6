"""Character references: by HTML's rules, or a stated list of them."""

import duckdb

from tidemark.plans import registry, source_queries
from tidemark.sources import articles, pages

TEXT = "A sentence of the article, with commas, goes on for a while and says something that readers want to know. "
#: Pages with references that nothing ends and others than the SQL decodes.
PAGES = [
    (1, "https://a.example.org/1", f"<html><head><title>Cut &amp;&amp</title></head><body><article><h1>Cut &amp;&amp</h1><p>{TEXT * 6}&amp;lt; &copy; &#x27;x&#39; &lt;b&gt; &quot;q&quot;<br></article></body></html>"),
    (3, "https://a.example.org/3", f"<html><head><title>Said &quot;so &amp; on</title></head><body><article><h1>Said &quot;so &am</h1><p>{TEXT * 6}&ampx; R&D<br></article></body></html>"),
]


def both(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    mine = registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    return sorted(map(repr, map(tuple, mine))), sorted(map(repr, found.fetchall()))


def test_sections_decode_what_their_sql_decodes(spark, tmp_path):
    mine, wanted = both(spark, tmp_path, "src_18_article_sections")
    assert mine == wanted and len(mine) == 2


def test_signals_decode_what_their_sql_decodes(spark, tmp_path):
    mine, wanted = both(spark, tmp_path, "src_20_page_signals")
    assert mine == wanted and len(mine) == 2


def test_by_default_references_are_read_as_html_reads_them():
    page = f"<article><h1>A &amp;&amp</h1><p>{TEXT * 6}&copy;</article>"
    (section,) = articles.sections_of(page)
    assert section["heading"] == "A &&" and section["text"].endswith("©")
    (section,) = articles.sections_of(articles.only_references(page, source_queries.DECODED))
    assert section["heading"] == "A &&amp" and section["text"].endswith("&copy;")
    assert pages.signals_of("<title>A &quot;&amp</title>", "")["title"] == 'A "&' and pages.signals_of("<title>A &quot;&amp</title>", "", ("amp",))["title"] == "A &quot;&amp"
